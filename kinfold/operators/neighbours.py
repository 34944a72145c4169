"""Candidate pairs by sorted neighbourhood: records that stand close in some order are compared.

Records are sorted by several keys, each of which brings together what some kind of spelling difference
keeps apart. Every record is paired with the ``window - 1`` records after it, in each order: so pairs are
linear in records, however many records share a block or a value. The sorted rows are cut into runs of
equal length, each with the first rows of the next run as its border, so that no task holds more than a
run and no pair is lost where runs or range partitions meet.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed
from kinfold.functions.tags import DEFAULT_TAGS, SourceTags
from kinfold.operators import skew
from kinfold.operators.standardize import node_record_id
from kinfold.operators.workspace import Workspace

WINDOW = 5
#: Rows of a run, which one task holds.
RUN_ROWS = 4096
COMPARED = ("canonical", "contactName", "email", "phone", "state")


def sort_keys() -> dict[str, Column]:
    """Name -> sort key; records whose key is blank are not in that order."""
    contact = F.lower("contactName")
    domain = F.substring_index("email", "@", -1)
    return {
        "company": F.when(F.col("canonical") != "", F.concat_ws("|", "canonical", F.substring_index(contact, " ", -1), contact)),
        "phone": F.when(F.col("phone").rlike(fixed.PHONE_SHAPE), F.concat_ws("|", "phone", "canonical")),
        "email": F.when(F.col("email").contains("@"), F.concat_ws("|", domain, F.substring_index("email", "@", 1))),
    }


def sorted_rows(records: DataFrame, keys: Mapping[str, Column], workspace: Workspace) -> DataFrame:
    """One row per record and key that it has, with its ``position`` in all orders, one after the other."""
    entries = F.array(*[F.struct(F.lit(i).alias("order_no"), key.alias("key")) for i, key in enumerate(keys.values())])
    rows = records.select("node", *COMPARED, F.inline(entries)).where("key <> ''")
    return skew.number_rows(rows, ["order_no", "key", "node"], workspace)


def close_pairs(rows: DataFrame, window: int, run_rows: int) -> DataFrame:
    """``(order_no, a, b)``: each row with the rows after it, up to ``window - 1``, of the same order."""
    run = F.floor((F.col("position") - 1) / run_rows)
    place = (F.col("position") - 1) % run_rows
    border = F.when((place < window - 1) & (run > 0), F.array(run, run - 1)).otherwise(F.array(run))
    in_run = Window.partitionBy("run").orderBy("position")
    own = F.struct("node", *COMPARED)
    after = [F.lead(F.struct("order_no", own.alias("row"))).over(in_run)] + [
        F.lead(F.struct("order_no", own.alias("row")), i).over(in_run) for i in range(2, window)
    ]
    spread = rows.withColumn("home", run).withColumn("run", F.explode(border))
    # a row beyond the run's end is null, and its order no order
    paired = spread.withColumn("after", F.array(*after)).where("run = home")
    paired = paired.select(F.col("order_no").alias("own_order"), own.alias("a"), F.inline("after").alias("order_no", "b"))
    return paired.where("order_no = own_order").drop("own_order").select("order_no", "a", "b")


def evidence() -> dict[str, Column]:
    """What a pair ``a, b`` shares, as columns."""

    def same(field: str) -> Column:
        mine, theirs = F.col(f"a.{field}"), F.col(f"b.{field}")
        if field == "contactName":
            mine, theirs = F.lower(mine), F.lower(theirs)
        equal = (mine == theirs) & (mine != "")
        return (equal & mine.rlike(fixed.PHONE_SHAPE) if field == "phone" else equal).cast("int")

    def words(side: str) -> Column:
        return F.array_distinct(F.array_remove(F.split(f"{side}.canonical", " "), ""))

    # equal names need no word lists, and no distances
    alike = F.col("a.canonical") == F.col("b.canonical")
    same_name = F.lower("a.contactName") == F.lower("b.contactName")
    either = F.size(F.array_union(words("a"), words("b")))
    both = F.size(F.array_intersect(words("a"), words("b"))).cast("double")
    return {
        "same_email": same("email"),
        "same_phone": same("phone"),
        "same_contact": same("contactName"),
        "same_state": same("state"),
        "company_jaccard": F.when(alike, (F.trim("a.canonical") != "").cast("double"))
        .when(either == 0, 0.0)
        .otherwise(both / either.cast("double")),
        "name_distance": F.when(same_name, 0).otherwise(
            F.levenshtein(F.lower("a.contactName"), F.lower("b.contactName"))
        ),
    }


def score() -> Column:
    """From 0 to 1: what is shared, weighed by how well it tells entities apart."""
    shared = F.col("same_email") * 4 + F.col("same_phone") * 3 + F.col("same_contact") * 2 + F.col("same_state")
    return (shared.cast("double") + F.lit(2.0) * F.col("company_jaccard")) / F.lit(12.0)


def neighbour_pairs(
    records: DataFrame,
    workspace: Workspace,
    window: int = WINDOW,
    keys: Mapping[str, Column] | None = None,
    run_rows: int = RUN_ROWS,
    tags: SourceTags = DEFAULT_TAGS,
) -> DataFrame:
    """``(first_id, second_id, orders, evidence..., score)``, each pair once, the earlier record first;
    ``orders`` names the orders in which the two are close. Exact shared values beyond the window are in
    ``linking.link_edges``."""
    keys = sort_keys() if keys is None else dict(keys)
    pairs = close_pairs(sorted_rows(records, keys, workspace), window, run_rows)
    turned = F.col("a.node") > F.col("b.node")
    pairs = pairs.select(
        "order_no",
        F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"),
    )
    found = evidence()
    rows = pairs.select(
        F.col("a.node").alias("first"), F.col("b.node").alias("second"), "order_no", *[c.alias(n) for n, c in found.items()]
    )
    once = rows.groupBy("first", "second", *found).agg(
        F.bit_or(F.expr("shiftleft(1L, order_no)")).alias("bits")
    )
    names = [F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) > 0, F.lit(n)) for i, n in enumerate(keys)]
    return once.select(
        node_record_id(F.col("first"), tags).alias("first_id"),
        node_record_id(F.col("second"), tags).alias("second_id"),
        F.concat_ws("+", *names).alias("orders"),
        *found,
        score().alias("score"),
    )
