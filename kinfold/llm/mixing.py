"""Mixing sources to target weights, DataFrame functions only.

Each source's share of tokens is raised to an exponent between 0 (all sources alike) and 1 (as found)
and normalised. The exponent is bisected: it is the largest at which the weights' entropy still meets
the target, raised further if a source would be repeated more often than allowed. The budget times a
source's weight is what the source may give: whole passes over all its texts, then a part of one.
Each pass is a permutation of its own, by a seeded hash, cut into blocks of about ``BLOCK_ROWS`` rows;
the part of a pass holds the first permutation's first blocks, and of the block where the budget ends
the first rows.

Only counts per source and block are shuffled, and the rows of one block per source; which texts go
out, and how often, every row then tells by itself.

Defined results: a text's tokens are its words and one end mark, so null and empty texts cost one; a
null source is a source of its own; rows that are alike in all columns stand or fall together; added
columns take the place of like-named ones; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import WORD, row_digest, staged, unused
from kinfold.operators import skew

HASH_BITS = 62
BLOCK_ROWS = 1 << 10
#: Halvings per pass over the sources.
HALVINGS = 4


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long") + 1


def place(seed: int, digest: Column) -> Column:
    """A number below 2^62 that orders one pass."""
    return F.xxhash64(F.lit(seed), digest).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def weights(sources: DataFrame, target: float, max_repeats: float, budget: int | None) -> tuple[float, float, float]:
    """Exponent, normaliser and budget for ``sources(total)``.

    Entropy falls and the repetition limit loosens as the exponent rises, so both are bisected; a pass
    over the sources weighs all points of ``HALVINGS`` halvings.
    """
    one = sources.agg(
        F.max("total").alias("most"), F.min("total").alias("least"), F.count("*").alias("n"), F.sum("total").alias("all")
    ).first()
    n, most, least = one["n"], one["most"], one["least"]
    goal = target * math.log(n)
    share = F.col("total") / F.lit(float(most))

    def measured(points: list[float]) -> list[tuple[float, float]]:
        """Normaliser (of shares of the largest source) and entropy at each exponent."""
        sums = []
        for i, x in enumerate(points):
            sums += [F.sum(F.pow(share, F.lit(x))).alias(f"z{i}"), F.sum(F.pow(share, F.lit(x)) * F.log(share)).alias(f"s{i}")]
        row = sources.agg(*sums).first()
        return [(row[f"z{i}"], math.log(row[f"z{i}"]) - x * row[f"s{i}"] / row[f"z{i}"]) for i, x in enumerate(points)]

    def repeats(x: float, z: float) -> float:
        """Passes over the most repeated source, the smallest."""
        smallest = (least / most) ** (x - 1)
        return smallest if budget is None else budget * smallest / z / most

    def bisect(too_high) -> float:
        low, high = 0.0, 1.0
        for _ in range(24 // HALVINGS):
            step = (high - low) / (1 << HALVINGS)
            points = [low + step * k for k in range(1, 1 << HALVINGS)]
            passed = [x for x, (z, h) in zip(points, measured(points)) if not too_high(x, z, h)]
            low = max([low, *passed])
            high = low + step
        return low

    natural = measured([1.0])[0]
    entropy_point = 1.0 if natural[1] >= goal else bisect(lambda x, z, h: h < goal)
    # above this point no source is repeated too often
    flat = measured([0.0])[0]
    repeat_point = 0.0 if repeats(0.0, flat[0]) <= max_repeats else bisect(lambda x, z, h: repeats(x, z) <= max_repeats)
    if repeat_point > 0:
        repeat_point = min(1.0, repeat_point + 2.0**-24)
    exponent = max(entropy_point, repeat_point)
    z = measured([exponent])[0][0]
    # without a budget: the least at which the largest source, the least repeated, is used once
    return exponent, z, float(z * most) if budget is None else float(budget)


def plan(counted: DataFrame, target: float, max_repeats: float, budget: int | None) -> DataFrame:
    """``source, weight, passes, cut, shift``: whole passes of each source, and the last place of the
    part of a pass; from ``counted(source, place, tokens)``."""
    sources = staged(
        counted.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("n"), F.max("tokens").alias("m")),
        "sources",
    )
    exponent, z, budget_tokens = weights(sources, target, max_repeats, budget)
    most = sources.agg(F.max("total")).first()[0]
    bits = F.greatest(F.ceil(F.log2(F.col("n") / F.lit(float(BLOCK_ROWS)))), F.lit(0))
    weight = F.pow(F.col("total") / F.lit(float(most)), F.lit(exponent)) / F.lit(z)
    # whole tokens; a hair above, so that a budget of exactly one pass is one pass
    given = F.floor(weight * budget_tokens + 1e-6 * F.col("total")).cast("long")
    shares = staged(
        sources.withColumn("weight", weight)
        .withColumn("given", given)
        .withColumn("passes", F.expr("given div total"))
        .select(
            "source",
            "weight",
            "passes",
            F.expr("given - passes * total").alias("rest"),
            (F.lit(HASH_BITS) - bits).cast("int").alias("shift"),
        ),
        "shares",
    )
    shares_small = small(shares)
    blocked = counted.join(shares_small, counted["source"].eqNullSafe(shares_small["source"])).select(
        counted["source"], "place", "tokens", "rest", F.expr("shiftright(place, shift)").alias("block")
    )
    summed = blocked.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("tokens"))
    running = Window.partitionBy("source").orderBy("block")
    ends = staged(
        summed.withColumn("upto", F.sum("tokens").over(running))
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("tokens") <= F.col("rest")))
        .select("source", "block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left")),
        "last-blocks",
    )
    small_ends = small(ends)
    inside = blocked.join(
        small_ends,
        blocked["source"].eqNullSafe(small_ends["source"]) & (blocked["block"] == small_ends["block"]),
    ).select(blocked["source"], blocked["block"], "place", "tokens", "left")
    alike = inside.groupBy("source", "block", "left", "place").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("place"))
    cuts = (
        alike.withColumn("upto", upto).where(F.col("upto") <= F.col("left")).groupBy("source").agg(F.max("place").alias("cut"))
    )
    joined = shares.join(ends.select(F.col("source").alias("s"), "block"), shares["source"].eqNullSafe(F.col("s")), "left")
    joined = joined.join(cuts.select(F.col("source").alias("t"), "cut"), shares["source"].eqNullSafe(F.col("t")), "left")
    start = F.expr("shiftleft(block, shift)")  # without a row that fits, the blocks before
    return staged(
        joined.select(shares["source"], "weight", "passes", "shift", F.coalesce("cut", start - 1, F.lit(-1)).alias("cut")),
        "mixture",
    )


def small(df: DataFrame) -> DataFrame:
    """Broadcast if its rows, one per source, measure little enough; else the join shuffles, and Spark
    splits skewed sources."""
    return F.broadcast(df) if skew.broadcastable(df) else df


def used_rows(
    docs: DataFrame, target: float, max_repeats: float, budget: int | None, seed: int, name: str
) -> DataFrame:
    """Every row as often as it is used, all columns kept, with ``name``: which pass, where in it, and
    the weight of the row's source."""
    own, key, times = unused(docs, "own_place"), unused(docs, "mix_source"), unused(docs, "times")
    numbered = docs.withColumn(own, place(seed, row_digest(docs)))
    counted = staged(
        numbered.select("source", F.col(own).alias("place"), tokens(F.col("text")).alias("tokens")), "token-counts"
    )
    lead = [f"`{c}`" for c in docs.columns]
    if counted.isEmpty():
        none = "named_struct('epoch', 0, 'block', 0L, 'block_key', 0L, 'weight', 0D)"
        return docs.select(*lead, F.expr(none).alias(name))
    mixture = plan(counted, target, max_repeats, budget).select(
        F.col("source").alias(key), F.struct("passes", "cut", "shift", "weight").alias(times)
    )
    joined = numbered.join(small(mixture), numbered["source"].eqNullSafe(F.col(key)))
    copies = F.col(f"{times}.passes") + F.when(F.col(own) <= F.col(f"{times}.cut"), 1).otherwise(0)
    epochs = F.when(copies > 0, F.sequence(F.lit(0), (copies - 1).cast("int")))
    epoch = F.explode(F.coalesce(epochs, F.array().cast("array<int>")))
    used = joined.select(*lead, own, times, epoch.alias(name))
    # every pass is another permutation
    ordered = F.when(F.col(name) == 0, F.col(own)).otherwise(
        F.xxhash64(F.col(name), F.col(own)).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    )
    block = F.expr(f"shiftright(`{own}`, `{times}`.shift)")
    parts = F.struct(
        F.col(name).alias("epoch"), block.alias("block"), F.col(own).alias("block_key"), F.col(f"{times}.weight").alias("weight")
    )
    return used.withColumn(own, ordered).select(*lead, parts.alias(name))


def mix(
    docs: DataFrame, target: float = 0.95, max_repeats: float = 2.0, budget: int | None = None, seed: int = 1
) -> DataFrame:
    """The rows of the mixture: every input row as often as it is used, with ``epoch`` (which pass),
    ``block`` and ``block_key`` (where in the pass: blocks in order, rows by key) and ``weight``.

    ``target``: least entropy of the weights, as a share of that of equal weights. ``max_repeats``:
    most passes over a source; it wins over ``target``. ``budget``: tokens to give out; None is the
    least at which every text is used once.
    """
    added = ("epoch", "block", "block_key", "weight")
    name = unused(docs, "mix")
    used = used_rows(docs, target, max_repeats, budget, seed, name)
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in added]
    return used.select(*kept, *[F.col(f"{name}.{c}").alias(c) for c in added])


def repeat_rows(
    docs: DataFrame, target: float = 0.95, max_repeats: float = 2.0, budget: int | None = None, seed: int = 1
) -> DataFrame:
    """The same rows with the columns of ``docs`` alone, all of them unchanged."""
    used = used_rows(docs, target, max_repeats, budget, seed, unused(docs, "mix"))
    return used.select(*[f"`{c}`" for c in docs.columns])


def sequence(mixed: DataFrame) -> DataFrame:
    """The mixture as numbered block permutations: ``position`` inside source, epoch and block."""
    within = Window.partitionBy("source", "epoch", "block").orderBy("block_key", "doc_id")
    return mixed.select(
        "doc_id",
        "source",
        tokens(F.col("text")).alias("n_tokens"),
        "epoch",
        "block",
        F.row_number().over(within).alias("position"),
        F.round("weight", 9).alias("weight"),
    )
