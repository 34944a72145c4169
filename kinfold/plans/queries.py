"""Every operator as a query over the driver's tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import fixed_values as fixed
from kinfold.functions import standard
from kinfold.functions.tags import SourceTags
from kinfold.operators import linking, merging, neighbours, profiling, quality, query, spec_index, views
from kinfold.operators.standardize import (
    node_record_id,
    raw_from_json,
    raw_to_json,
    standardize,
    standardize_all,
    upsert_latest,
)
from kinfold.operators.workspace import Workspace
from kinfold.plans import driver_tables, incremental
from kinfold.plans.unify import Unified, unify_records, unify_sources
from kinfold.sources import delimited, markup, payload, sinks
from kinfold.sources import lookup_tables as lookups
from kinfold.streaming.progress import batch_progress

FIELDS = list(fixed.UNIFIED_FIELDS)
ROWS_PER_PAGE = 25
ROWS_PER_PAYLOAD = 20

_runs: dict[tuple[str, str], tuple[Unified, dict[str, DataFrame]]] = {}


def forget_runs() -> None:
    _runs.clear()
    _lookups.clear()


def run(spark: SparkSession, sf_dir: str) -> tuple[Unified, dict[str, DataFrame]]:
    """The unification run and its stored tables, made once per application and data folder.

    Reports read stored tables, as they would in production, instead of each redoing the run.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        workspace = Workspace(spark)
        unified = unify_sources(driver_tables.raw_sources(spark, sf_dir), workspace)
        path = f"{workspace.path}/tables"
        sinks.write_entity_tables(unified, path)
        tables = {
            t: spark.read.parquet(f"{path}/{t}")
            for t in ("entities", "field_provenance", "entity_members")
        }
        _runs[key] = unified, tables
    return _runs[key]


def standard_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize_all(driver_tables.raw_sources(spark, sf_dir))


def raw_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources' raw values under neutral names."""
    parts = [
        driver_tables.fragments(spark, sf_dir, s).drop("e").withColumn("source", F.lit(s))
        for s in driver_tables.BINDINGS
    ]
    return reduce(DataFrame.unionByName, parts)


# --- sources -------------------------------------------------------------------------------


def ingest_csv(spark, sf_dir):
    """Customer fragments written as CSV files in key order, read back through the CSV source."""
    workspace = Workspace(spark)
    columns = list(fixed.DEFAULT_MAPPINGS["A"])
    path = export_csv(spark, sf_dir, workspace)
    rows = delimited.read_csv(spark, f"{path}/*", columns, workspace)
    return standardize(rows, "A").select("id", *FIELDS, "block_key")


def export_csv(spark, sf_dir, workspace):
    """Two sets of files: the lower half of the rows, and the upper half with its columns reversed."""
    raw = driver_tables.raw_source(spark, sf_dir, "A")
    path = f"{workspace.path}/export-csv"
    columns = list(fixed.DEFAULT_MAPPINGS["A"])
    middle = raw.agg(F.percentile_approx("ordinal", 0.5)).first()[0] or 0
    halves = ((F.col("ordinal") <= middle, "0", columns), (F.col("ordinal") > middle, "1", columns[::-1]))
    for half, name, order in halves:
        ordered = raw.where(half).repartitionByRange("ordinal").sortWithinPartitions("ordinal")
        ordered.select(*order).write.csv(f"{path}/{name}", header=True, quote='"', escape='"')
    return path


def ingest_csv_multi_line(spark, sf_dir):
    """Customer fragments written as CSV files with line breaks inside quotes, read back in splits."""
    workspace = Workspace(spark)
    raw = driver_tables.raw_source(spark, sf_dir, "A")
    columns = list(fixed.DEFAULT_MAPPINGS["A"])
    broken = F.when(F.col("ordinal") % 3 == 0, F.replace(F.col("Company Name"), F.lit(" "), F.lit(" \n")))
    padded = F.when(F.col("ordinal") % 5 == 0, F.concat(F.lit("\n\n"), F.col("contact")))
    raw = raw.withColumn("Company Name", F.coalesce(broken, "Company Name"))
    ordered = raw.withColumn("contact", F.coalesce(padded, "contact")).repartitionByRange("ordinal")
    path = f"{workspace.path}/export-csv-lines"
    ordered.sortWithinPartitions("ordinal").select(*columns).write.csv(path, header=True, quote='"', escape='"')
    rows = delimited.read_csv(spark, path, columns, workspace, multi_line=True)
    return standardize(rows, "A").select("id", *FIELDS, "block_key")


def ingest_json(spark, sf_dir):
    """Supplier fragments written as payload documents, read back through the JSON source."""
    workspace = Workspace(spark)
    columns = list(fixed.DEFAULT_MAPPINGS["B"])
    path = export_json(spark, sf_dir, workspace)
    read = payload.read_json(spark, f"{path}/*", columns, workspace)
    return standardize(read, "B").select("id", *FIELDS, "block_key")


def export_json(spark, sf_dir, workspace):
    """One numbered folder per document of up to 20 records."""
    raw = driver_tables.raw_source(spark, sf_dir, "B")
    document = F.lpad(F.floor(F.col("ordinal") / ROWS_PER_PAYLOAD).cast("string"), 12, "0")
    rows = F.sort_array(F.collect_list(F.struct("ordinal", *fixed.DEFAULT_MAPPINGS["B"])))
    documents = raw.groupBy(document.alias("document")).agg(rows.alias("records"))
    path = f"{workspace.path}/export-json"
    value = F.to_json(F.struct(F.lit("export").alias("source"), "records")).alias("value")
    documents.select("document", value).repartition("document").write.partitionBy("document").text(path)
    return path


def directory_pages(spark, sf_dir):
    """Order fragments rendered as directory pages of up to 25 rows, one table per page."""
    raw = driver_tables.fragments(spark, sf_dir, "C")
    cells = [
        F.concat(F.lit("<td>"), F.col(driver_tables.NEUTRAL[f]), F.lit("</td>"))
        for f in fixed.DEFAULT_MAPPINGS["C"].values()
    ]
    header = "".join(f"<th> {c} </th>" for c in fixed.DEFAULT_MAPPINGS["C"])
    row = F.concat(F.lit("<TR><td hidden>&amp;lt;"), F.col("ordinal").cast("string"), F.lit("</td>"), *cells, F.lit("</TR>\n"))
    return (
        raw.select(F.floor(F.col("ordinal") / ROWS_PER_PAGE).alias("page_no"), "ordinal", row.alias("row"))
        .groupBy("page_no")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "row"))).alias("rows"))
        .select(
            F.concat(F.lit("D"), F.lpad(F.col("page_no").cast("string"), 12, "0")).alias("page_id"),
            F.concat(
                F.lit(f"<html><body><h1>Directory</h1><table id='d'><tr><th>No</th>{header}</tr>\n"),
                F.array_join(F.col("rows.row"), ""),
                F.lit("</table><table><tr><td>footer</td></tr></table></body></html>"),
            ).alias("html"),
        )
    )


def page_corpus(spark, sf_dir):
    """The crawled pages together with the directory pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    crawled = pages.select(
        F.concat(F.lit("P"), F.lpad(F.col("page_id").cast("string"), 12, "0")).alias("page_id"), "html"
    )
    return crawled.unionByName(directory_pages(spark, sf_dir))


def html_table_rows(spark, sf_dir):
    rows = markup.extract_table_rows(page_corpus(spark, sf_dir))
    return rows.select("page_id", "row_no", F.array_join("cells", "|").alias("cells"))


def ingest_json_split(spark, sf_dir):
    """Supplier fragments as one large payload document per range of rows, read back in splits."""
    workspace = Workspace(spark)
    columns = list(fixed.DEFAULT_MAPPINGS["B"])
    raw = driver_tables.raw_source(spark, sf_dir, "B").repartitionByRange("ordinal").sortWithinPartitions("ordinal")
    part = F.lpad(F.spark_partition_id().cast("string"), 9, "0")
    rows = raw.select(part.alias("part"), F.monotonically_increasing_id().alias("at"), F.to_json(F.struct(*columns)).alias("value"))
    rows = workspace.stage(rows, "documents")
    ends = rows.groupBy("part").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    head = F.when(F.col("at") == F.col("first"), '{"generatedAt": "now", "records": [').otherwise(", ")
    tail = F.when(F.col("at") == F.col("last"), "]}").otherwise("")
    text = rows.join(ends, "part").select("part", "at", F.concat(head, "value", tail).alias("value"))
    path = f"{workspace.path}/export-documents"
    in_order = text.repartition("part").sortWithinPartitions("part", "at")
    in_order.select("part", "value").write.partitionBy("part").text(path)
    read = payload.read_json(spark, f"{path}/*", columns, workspace, split=True)
    return standardize(read, "B").select("id", *FIELDS, "block_key")


def ingest_html(spark, sf_dir):
    columns = list(fixed.DEFAULT_MAPPINGS["C"])
    rows = markup.read_html(page_corpus(spark, sf_dir), columns, Workspace(spark))
    return standardize(rows, "C").select("id", *FIELDS, "block_key")


def all_records(spark, sf_dir):
    return standard_records(spark, sf_dir).select("id", "source", "ordinal")


def source_records_sink(spark, sf_dir):
    path = f"{Workspace(spark).path}/source_records"
    sinks.write_source_records(standard_records(spark, sf_dir), path)
    stored = spark.read.schema(sinks.STORED_RECORD).parquet(path)
    return stored.select("id", "source", "raw_json", *FIELDS)


def entity_tables_sink(spark, sf_dir):
    _, tables = run(spark, sf_dir)
    parts = [
        df.agg(F.count("*").alias("n_rows"), F.count_distinct("entity_id").alias("n_entities")).withColumn(
            "table_name", F.lit(name)
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def files_to_tables(spark, sf_dir):
    """All sources as files, unified, published, and the entities read back from the published version.
    Pages are rows of larger files, as crawls store them; ``read_pages`` reads one page per file."""
    workspace = Workspace(spark)
    a, b, c = (list(fixed.DEFAULT_MAPPINGS[s]) for s in fixed.SOURCES)
    pages = f"{workspace.path}/export-pages"
    page_corpus(spark, sf_dir).write.parquet(pages)
    raws = {
        "A": delimited.read_csv(spark, f"{export_csv(spark, sf_dir, workspace)}/*", a, workspace),
        "B": payload.read_json(spark, f"{export_json(spark, sf_dir, workspace)}/*", b, workspace),
        "C": markup.read_html(spark.read.parquet(pages), c, workspace).drop("page_id", "row_no"),
    }
    unified = unify_sources(raws, workspace)
    sinks.publish(unified, f"{workspace.path}/published")
    published = sinks.read_published(spark, f"{workspace.path}/published")
    return published["entities"]


# --- standard values -----------------------------------------------------------------------


def _standardised(field):
    def compute(spark, sf_dir):
        raw = F.col(driver_tables.NEUTRAL[field])
        return raw_values(spark, sf_dir).select(
            "source", "ordinal", raw.alias("raw"), standard.STANDARDISERS[field](raw).alias("value")
        )

    return compute


def std_text(spark, sf_dir):
    return raw_values(spark, sf_dir).select(
        "source",
        "ordinal",
        standard.text(F.col("company")).alias("company"),
        standard.text(F.col("contact")).alias("contact_name"),
    )


def canonical_company(spark, sf_dir):
    return raw_values(spark, sf_dir).select(
        "source", "ordinal", standard.canonical_company(F.col("company")).alias("canonical")
    )


def block_keys(spark, sf_dir):
    """Both forms of the key: by company, and the email fallback for a blank company."""
    return raw_values(spark, sf_dir).select(
        "source",
        "ordinal",
        standard.block_key(F.col("company"), F.col("email")).alias("block_key"),
        standard.block_key(F.lit(""), F.col("email")).alias("fallback_key"),
    )


def standardised_records(spark, sf_dir):
    return standard_records(spark, sf_dir).select("id", "source", *FIELDS, "block_key")


def apply_mapping(spark, sf_dir):
    """Standard records under the mappings that profiling found."""
    raws = driver_tables.raw_sources(spark, sf_dir)
    profile = profiling.column_profile(standardize_all(raws))
    found = profiling.mapping_by_source(profiling.field_mapping(profile))
    return standardize_all(raws, found).select("id", "source", *FIELDS, "block_key")


def raw_roundtrip(spark, sf_dir):
    stored = raw_to_json(standard_records(spark, sf_dir)).select("id", "raw_json")
    back = raw_from_json(stored.withColumn("stored", F.col("raw_json")))
    return back.select(
        "id",
        F.col("stored").alias("raw_json"),
        F.size("raw").alias("n_columns"),
        (F.to_json("raw") == F.col("stored")).alias("same"),
    )


def doc_contacts(spark, sf_dir):
    return views.contacts_in_text(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def doc_phones(spark, sf_dir):
    """Phones of every layout that standardisation knows, in whole texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return views.phones_in_text(docs)


# --- blocks, links, clusters, entities -----------------------------------------------------


def upsert(spark, sf_dir):
    """Each source's rows as successive versions of its entity's contact; the last load wins."""
    parts = [
        driver_tables.fragments(spark, sf_dir, s).withColumn("source", F.lit(s))
        for s in driver_tables.BINDINGS
    ]
    versions = reduce(DataFrame.unionByName, parts).select(
        F.concat("source", F.col("e").cast("string")).alias("id"), "ordinal", "company", "contact", "phone", "email", "state"
    )
    return upsert_latest(versions, "id", "ordinal")


def reloaded_entities(spark, sf_dir):
    """Source B loaded again, with other phones and without every third record: the second load replaces
    the records it has before anything is linked."""
    raws = driver_tables.raw_sources(spark, sf_dir)
    again = raws["B"].where("ordinal % 3 <> 0").withColumn("tel", F.concat(F.lit("2"), F.substring(F.col("tel"), 2, 99)))
    records = standardize_all(raws).withColumn("load", F.lit(0)).unionByName(
        standardize_all({"B": again}).withColumn("load", F.lit(1))
    )
    unified = unify_records(records, Workspace(spark))
    return merging.entities(unified.merged)


def successive_loads(spark, sf_dir):
    """Four loads in three deliveries. The first lacks every tenth order; the second brings other phones
    of source B, and orders without a load number; the third, customers that moved to another block, some
    of them twice under one number."""
    raws = driver_tables.raw_sources(spark, sf_dir)
    a, b, c = (raws[s] for s in fixed.SOURCES)
    moved = a.where("ordinal % 11 = 0").withColumn("Company Name", F.concat(F.lit("Moved "), F.col("Company Name")))
    twice = moved.where("ordinal % 22 = 0").withColumn("contact", F.concat(F.lit("zz "), F.col("contact")))
    phones = b.where("ordinal % 3 <> 0").withColumn("tel", F.concat(F.lit("2"), F.substring(F.col("tel"), 2, 99)))
    unnumbered = c.where("ordinal % 5 = 0").withColumn("Location", F.lit("Texas"))

    def standard(raws, load):
        return standardize_all(raws).withColumn("load", F.lit(load).cast("int"))

    return [
        standard({"A": a, "B": b, "C": c.where("ordinal % 10 <> 0")}, 0),
        standard({"B": phones}, 1).unionByName(standard({"C": unnumbered}, None)),
        standard({"A": moved.unionByName(twice)}, 2),
    ]


def upserted_records(spark, sf_dir):
    """Three deliveries put into a store of source records, and what it then holds."""
    workspace = Workspace(spark)
    store = sinks.record_store(spark, f"{workspace.path}/store")
    for load in successive_loads(spark, sf_dir):
        version = sinks.upsert_source_records(store, load, workspace)
    return store.read("source_records", version).select("id", "source", "raw_json", *FIELDS, "load")


def incremental_entities(spark, sf_dir):
    """The same deliveries, after each of which only the blocks that changed are unified again."""
    workspace = Workspace(spark)
    store = incremental.open_store(spark, f"{workspace.path}/store")
    for load in successive_loads(spark, sf_dir):
        incremental.apply_load(store, load, workspace)
    return incremental.entity_tables(store)["entities"]


#: Tag, place in the load order, authority.
FIVE_TAGS = [("lead", 1, 4), ("web", 2, 5), ("erp", 3, 3), ("shop", 4, 2), ("crm-eu", 5, 1)]


def five_source_entities(spark, sf_dir):
    """Five sources whose tags and authority are rows of a table; three of them share a layout."""
    raws = driver_tables.raw_sources(spark, sf_dir)
    a, b, c = (raws[s] for s in fixed.SOURCES)
    lead = a.where("ordinal % 3 = 0").withColumns({"Phone": F.lit(""), "State": F.lit("")})
    five = {
        "erp": a, "crm-eu": b, "web": c.where("ordinal % 2 = 0"), "shop": c.where("ordinal % 2 = 1"), "lead": lead
    }
    layout = {"erp": "A", "crm-eu": "B", "web": "C", "shop": "C", "lead": "A"}
    mappings = {tag: fixed.DEFAULT_MAPPINGS[s] for tag, s in layout.items()}
    tags = SourceTags.from_table(spark.createDataFrame(FIVE_TAGS, "tag string, load_order int, priority int"))
    unified = unify_sources(five, Workspace(spark), mappings, tags=tags)
    view = views.unified_view(unified.merged, tags)
    entries = F.transform("provenance", lambda p: F.concat(p["field"], F.lit("="), p["source"], F.lit(":"), p["value"]))
    return view.withColumn("provenance", F.array_join(entries, "|"))


#: So low that the hot block and the hot cluster of the skewed table are heavy at every scale.
SKEWED_HEAVY_ROWS = 200


def skewed_entities(spark, sf_dir):
    """All orders in one block, a third of them under one email: heavy keys throughout."""
    raw = driver_tables.raw_source(spark, sf_dir, "C")
    own = F.concat(F.lit("n"), F.floor(F.col("ordinal") / 2).cast("string"), F.lit("@x.example.com"))
    hot = F.when(F.col("ordinal") % 3 == 0, F.lit("hot@x.example.com")).otherwise(own)
    skewed = raw.withColumns(
        {"Company": F.lit("Firm Nought Media"), "Rep": F.lit(""), "Telephone": F.lit(""), "Contact Email": hot}
    )
    unified = unify_records(standardize(skewed, "C"), Workspace(spark), heavy_rows=SKEWED_HEAVY_ROWS)
    return unified.merged.select("entity_id", *FIELDS, "confidence", "reasoning", "member_count")


def block_sizes(spark, sf_dir):
    return linking.block_sizes(standard_records(spark, sf_dir)).drop("first_node")


def block_histogram(spark, sf_dir):
    return linking.block_histogram(standard_records(spark, sf_dir))


def candidate_pairs(spark, sf_dir):
    unified, _ = run(spark, sf_dir)
    return linking.block_candidates(unified.records, unified.n_records)


def block_batches(spark, sf_dir):
    numbered = linking.block_batches(standard_records(spark, sf_dir), Workspace(spark))
    return numbered.drop("first_node")


def progress(spark, sf_dir):
    unified, _ = run(spark, sf_dir)
    return batch_progress(unified.resolved, Workspace(spark))


def link_edges(spark, sf_dir):
    unified, _ = run(spark, sf_dir)
    return linking.link_edges(unified.records, unified.n_records).select(
        "block_key",
        "key_type",
        "key_value",
        "hub_size",
        node_record_id(F.col("anchor")).alias("anchor_id"),
        node_record_id(F.col("node")).alias("record_id"),
    )


def clusters(spark, sf_dir):
    unified, _ = run(spark, sf_dir)
    return unified.resolved.select(
        F.col("id").alias("record_id"), "block_key", node_record_id(F.col("root")).alias("cluster_id")
    )


def field_provenance(spark, sf_dir):
    unified, _ = run(spark, sf_dir)
    return merging.field_winners(unified.merged)


def neighbour_pairs(spark, sf_dir):
    unified, _ = run(spark, sf_dir)
    return neighbours.neighbour_pairs(unified.records, Workspace(spark))


def pair_scores(spark, sf_dir):
    unified, _ = run(spark, sf_dir)
    return views.member_scores(unified.resolved, unified.merged, unified.n_records)


# --- views ---------------------------------------------------------------------------------


def unified_view(spark, sf_dir):
    unified, _ = run(spark, sf_dir)
    entries = F.transform(
        "provenance", lambda p: F.concat(p["field"], F.lit("="), p["source"], F.lit(":"), p["value"])
    )
    return views.unified_view(unified.merged).withColumn("provenance", F.array_join(entries, "|"))


def entity_member_lists(spark, sf_dir):
    unified, _ = run(spark, sf_dir)
    lists = views.member_lists(unified.resolved, unified.n_records, Workspace(spark))
    return lists.withColumn("members", F.array_join("members", ","))


def fragmented_view(spark, sf_dir):
    stored = raw_to_json(standard_records(spark, sf_dir))
    view = views.fragmented_view(stored)
    return view.withColumn("raw", F.array_join(F.map_values("raw"), "|"))


def entity_lineage(spark, sf_dir):
    unified, tables = run(spark, sf_dir)
    fed = views.entity_lineage(tables["entity_members"], unified.records)
    return fed.withColumn("raw", F.array_join(F.map_values("raw"), "|"))


_lookups: dict[tuple[str, str], str] = {}


def lookup_tables(spark, sf_dir):
    """The run's tables in buckets, written once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lookups:
        unified, _ = run(spark, sf_dir)
        path = f"{Workspace(spark).path}/lookup"
        name = f"lookup_{path.rpartition('run-')[2].partition('/')[0]}"
        lookups.write_lookup_tables(unified, path, name, n_buckets=16)
        _lookups[key] = name
    return lookups.read_lookup_tables(spark, _lookups[key])


def bucketed_field_winner(spark, sf_dir):
    return lookups.field_winner(lookup_tables(spark, sf_dir), "phone")


def bucketed_lineage(spark, sf_dir):
    fed = lookups.entity_lineage(lookup_tables(spark, sf_dir))
    return fed.withColumn("raw", F.array_join(F.map_values("raw"), "|"))


def published_counts(spark, sf_dir):
    """Rows and nulls per table, counted while a version was written that passed all checks, and the rows
    that readers of the announced version find."""
    unified, _ = run(spark, sf_dir)
    root = f"{Workspace(spark).path}/published"
    sinks.publish(unified, root, keep=1)
    tables = sinks.read_published(spark, root)
    announced = sinks.announced_rows(spark, root)
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(t).alias("table_name"), F.lit(announced[t]).cast("long").alias("n_announced"), "n_rows"
        )
        for t, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def source_samples(spark, sf_dir):
    sample = views.source_samples(standard_records(spark, sf_dir))
    return sample.withColumn("raw", F.array_join(F.map_values("raw"), "|"))


def _table(build):
    def compute(spark, sf_dir):
        return build(run(spark, sf_dir)[1])

    return compute


def _spec(**spec):
    return _table(lambda t: query.run_spec(t["entities"], query.QuerySpec(**spec)))


SPECS = {
    "how many in california": query.QuerySpec("count", (query.Filter("state", "=", "CA"),)),
    "how many certain": query.QuerySpec("count", (query.Filter("confidence", ">=", "0.97"),)),
    "how many vegas outside texas": query.QuerySpec(
        "count", (query.Filter("contactName", "LIKE", "VEGA"), query.Filter("state", "!=", "TX"))
    ),
    "not a number": query.QuerySpec("count", (query.Filter("confidence", ">", "high"),)),
    "all": query.QuerySpec("count"),
}


#: Filters of spec number ``i`` of 5,000, five kinds by ``i % 5``; SQL text that other engines read alike.
N_SPECS = 5_000
_J = "cast(floor(i / 5) as int)"
_STATE_OF = f"split_part('CA,NY,TX,WA,IL', ',', {_J} % 5 + 1)"
SPEC_KINDS = [
    [("state", "=", _STATE_OF), ("confidence", ">=", f"'0.' || cast(5000 + {_J} * 4 as string)")],
    [("company", ">=", f"'Firm' || cast({_J} as string)"), ("company", "<", f"'Firm' || cast({_J} + 7 as string) || '~'")],
    [
        (
            "contactName",
            "=",
            f"split_part('{driver_tables.FIRST}', ',', {_J} % 10 + 1) || ' ' || "
            f"split_part('{driver_tables.LAST}', ',', cast(floor({_J} / 10) as int) % 10 + 1)",
        ),
        ("state", "!=", "'TX'"),
    ],
    [("state", "=", _STATE_OF), ("phone", "LIKE", f"cast({_J} as string)")],
    [("confidence", ">", f"'0.' || cast(5000 + {_J} * 4 as string)"), ("confidence", "<=", f"'0.' || cast(5100 + {_J} * 4 as string)")],
]


def spec_table_counts(spark, sf_dir):
    """Five thousand specs, given as a table, in one scan of the entities."""
    kinds = " ".join(
        f"when i % 5 = {k} then array("
        + ", ".join(f"named_struct('column', '{c}', 'op', '{op}', 'value', {value})" for c, op, value in filters)
        + ")"
        for k, filters in enumerate(SPEC_KINDS)
    )
    numbers = spark.range(N_SPECS).select(F.col("id").alias("i"))
    specs = numbers.selectExpr("'q' || cast(i as string) as question", f"case {kinds} end as filters")
    return spec_index.count_spec_table(run(spark, sf_dir)[1]["entities"], specs)


def unified_schema(spark, sf_dir):
    profile = profiling.column_profile(standard_records(spark, sf_dir))
    profile = Workspace(spark).stage(profile, "profile")
    return profiling.unified_schema(profile, profiling.field_mapping(profile))


# --- quality -------------------------------------------------------------------------------


def dq_nulls(spark, sf_dir):
    unified, t = run(spark, sf_dir)
    stored = raw_to_json(unified.records).select("id", "source", "raw_json", *FIELDS, "block_key")
    tables = {"source_records": stored, **t}
    return reduce(DataFrame.unionByName, [quality.blanks(df, name) for name, df in tables.items()])


def _check(check):
    def compute(spark, sf_dir):
        unified, t = run(spark, sf_dir)
        records = unified.records.select("id", "source", "block_key", *FIELDS)
        return quality.counts(
            check(records, t["entities"], t["entity_members"], t["field_provenance"])
        )

    return compute


def queries():
    return {
        "ingest_csv": ingest_csv,
        "ingest_csv_multi_line": ingest_csv_multi_line,
        "ingest_json": ingest_json,
        "ingest_json_split": ingest_json_split,
        "html_table_rows": html_table_rows,
        "ingest_html": ingest_html,
        "all_records": all_records,
        "source_records_sink": source_records_sink,
        "entity_tables_sink": entity_tables_sink,
        "files_to_tables": files_to_tables,
        "published_counts": published_counts,
        "std_state": _standardised("state"),
        "std_phone": _standardised("phone"),
        "std_email": _standardised("email"),
        "std_text": std_text,
        "canonical_company": canonical_company,
        "block_keys": block_keys,
        "standardize_all": standardised_records,
        "apply_mapping": apply_mapping,
        "raw_roundtrip": raw_roundtrip,
        "doc_contacts": doc_contacts,
        "doc_phones": doc_phones,
        "spec_count_state": _spec(operation="count", filters=(query.Filter("state", "=", "CA"),)),
        "spec_select_like": _spec(
            operation="select", filters=(query.Filter("email", "LIKE", "MARSH"),), limit=50
        ),
        "spec_select_confidence": _spec(
            operation="select",
            filters=(query.Filter("confidence", "<", " 0.93 "), query.Filter("state", "!=", "IL")),
            limit=500,
        ),
        "spec_range_text": _spec(
            operation="select",
            filters=(query.Filter("company", ">=", "Firm2"), query.Filter("company", "<", "Firm5")),
        ),
        "spec_batch_counts": _table(lambda t: query.count_specs(t["entities"], SPECS)),
        "spec_table_counts": spec_table_counts,
        "unified_view": unified_view,
        "entity_member_lists": entity_member_lists,
        "entity_lineage": entity_lineage,
        "field_winner": _table(
            lambda t: views.field_winner(t["field_provenance"], t["entities"], "phone")
        ),
        "candidate_pairs": candidate_pairs,
        "bucketed_field_winner": bucketed_field_winner,
        "bucketed_lineage": bucketed_lineage,
        "provenance_wide": _table(lambda t: views.provenance_wide(t["field_provenance"])),
        "source_overlap": lambda s, d: views.source_overlap(run(s, d)[0].resolved),
        "block_sizes": block_sizes,
        "block_histogram": block_histogram,
        "entity_count": _table(lambda t: t["entities"].agg(F.count("*").alias("n"))),
        "run_summary": lambda s, d: views.run_summary(run(s, d)[0].resolved),
        "fragmented_view": fragmented_view,
        "field_conflicts": lambda s, d: views.field_conflicts(
            run(s, d)[0].resolved, run(s, d)[0].n_records
        ),
        "field_provenance": field_provenance,
        "block_batches": block_batches,
        "batch_progress": progress,
        "source_samples": source_samples,
        "entity_members": _table(lambda t: t["entity_members"]),
        "upsert_latest": upsert,
        "reloaded_entities": reloaded_entities,
        "upserted_records": upserted_records,
        "five_source_entities": five_source_entities,
        "incremental_entities": incremental_entities,
        "skewed_entities": skewed_entities,
        "link_edges": link_edges,
        "clusters": clusters,
        "entities": _table(lambda t: t["entities"]),
        "pair_scores": pair_scores,
        "neighbour_pairs": neighbour_pairs,
        "column_profile": lambda s, d: profiling.column_profile(standard_records(s, d)),
        "field_mapping": lambda s, d: profiling.field_mapping(
            profiling.column_profile(standard_records(s, d))
        ),
        "unified_schema": unified_schema,
        "dq_nulls": dq_nulls,
        "dq_domains": _check(lambda r, e, m, p: quality.bad_domains(r, e, p)),
        "dq_orphans": _check(quality.orphans),
        "dq_keys": _check(quality.bad_keys),
        "dq_partition": _check(lambda r, e, m, p: quality.bad_partition(r, m)),
        "dq_provenance": _check(quality.bad_provenance),
    }
