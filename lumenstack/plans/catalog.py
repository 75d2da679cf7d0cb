"""Catalog queries: filtered scans, grouping into series and stacks, counts and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenstack.functions.text import first_known, known_first, natural_key
from lumenstack.numbering import numbered
from lumenstack.operators import catalog, series
from lumenstack.operators.filters import ScanFilter, scan_filter, search
from lumenstack.operators.series import anchor_groups
from lumenstack.registry import query
from lumenstack.session import table


def frame_columns(study: Column, name: Column, index: Column, number: Column, at: Column) -> list[Column]:
    """The columns of an ordinary stack's frames, at a position along the third axis (null: none)."""
    empty = {c: F.lit(None).cast("string") for c in ("kind_uid", "kind_role", "kind_rows", "kind_columns")}
    numbers = {c: F.lit(None).cast("bigint") for c in ("concatenation_offset", "in_concatenation_number")}
    own = {
        "study": study, "series": name, "file_index": index, "instance_number": number, "frame_index": F.lit(0), "path": F.lit(""), "kind": F.lit("ordinary"), "own": F.lit(True),
        "position": F.when(at.isNotNull(), F.array(F.lit(0.0), F.lit(0.0), at.cast("double"))), "orientation": F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)]),
    }
    return [c.alias(n) for n, c in {**own, **empty, **numbers}.items()]


@query(
    "series_stacks",
    """
    SELECT l_suppkey % 50 AS study, l_orderkey AS series, l_linenumber, l_partkey,
           row_number() OVER (PARTITION BY l_suppkey % 50, l_orderkey
                              ORDER BY l_shipdate ASC NULLS LAST, l_linenumber, l_partkey) - 1 AS virtual_index
    FROM lineitem WHERE l_quantity >= 10
    """,
)
def series_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, two-level grouping, stack order by position along the normal and virtual index (FLT-2, AGG-1, SORT-1, SORT-3, SORT-4, WIN-1)."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= 10)
    day = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400
    frames = rows.select("l_partkey", "l_linenumber", *frame_columns((F.col("l_suppkey") % 50).cast("string"), F.col("l_orderkey").cast("string"), F.col("l_partkey"), F.col("l_linenumber"), day))
    found = series.series_stacks(frames)
    return found.select(F.col("study").cast("bigint").alias("study"), F.col("series").cast("bigint").alias("series"), "l_linenumber", "l_partkey", F.col("virtual_index").cast("bigint").alias("virtual_index"))


@query(
    "scan_filter_contains",
    """
    SELECT doc_id, lang, source FROM documents
    WHERE contains(lower(source), 'src1') AND lower(lang) = 'fr'
    """,
)
def scan_filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contains without case, and equality without case, together (FLT-1, FLT-2)."""
    own = scan_filter([ScanFilter("source", "SRC1"), ScanFilter("lang", "FR", equal=True)])
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").where(own)


@query(
    "scoped_search_terms",
    """
    SELECT p_partkey, p_name, p_brand, p_type FROM part
    WHERE contains(lower(p_type), 'economy')
      AND (contains(lower(p_name), '1') OR contains(lower(p_brand), '1') OR contains(lower(p_type), '1'))
    """,
)
def scoped_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`type:economy 1`: one scoped and one unscoped term (FLT-4 to FLT-6)."""
    scopes = {"type": ("p_type",), "brand": ("p_brand",), None: ("p_name", "p_brand", "p_type")}
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type").where(search("type:economy 1", scopes=scopes, fmt=None))


DISCOVERY = """
    SELECT doc_id, CASE WHEN n_chars < 100 THEN 'skipped' WHEN lang <> 'en' THEN 'filtered' ELSE 'selected' END AS disposition,
           CASE WHEN n_chars < 20 THEN 'unrecognized_format' WHEN n_chars < 100 THEN 'inspection_failed'
                WHEN lang <> 'en' THEN 'filter_mismatch' ELSE 'valid_dicom' END AS reason
    FROM documents
"""


def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    short, foreign = F.col("n_chars") < 100, F.col("lang") != "en"
    reason = F.when(F.col("n_chars") < 20, "unrecognized_format").when(short, "inspection_failed").when(foreign, "filter_mismatch").otherwise("valid_dicom")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(short, "skipped").when(foreign, "filtered").otherwise("selected").alias("disposition"), reason.alias("reason"))


@query("discovery_breakdown", f"SELECT disposition, reason, count(*) AS n FROM ({DISCOVERY}) GROUP BY 1, 2")
def discovery_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate has one disposition and reason; counts of both (SRC-2, AGG-6)."""
    return discovery(spark, sf_dir).groupBy("disposition", "reason").agg(F.count("*").alias("n"))


@query("skip_breakdown", f"SELECT reason, count(*) AS n FROM ({DISCOVERY}) WHERE disposition = 'skipped' GROUP BY 1")
def skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skips by reason (AGG-7)."""
    return catalog.skip_breakdown(discovery(spark, sf_dir))


@query("recent_discovery", f"SELECT * FROM ({DISCOVERY}) WHERE disposition <> 'selected' ORDER BY doc_id DESC LIMIT 256")
def recent_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded list of the last records that weren't selected (AGG-6)."""
    return catalog.recent_records(discovery(spark, sf_dir), "doc_id")


@query(
    "stack_spacing_warnings",
    """
    WITH d AS (SELECT DISTINCT user_id, epoch(date_trunc('second', ts))::DOUBLE AS pos FROM events),
         g AS (SELECT user_id, pos, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) - pos AS gap FROM d),
         f AS (SELECT user_id, pos, gap, first_value(gap) OVER (PARTITION BY user_id ORDER BY pos) AS first_gap FROM g)
    SELECT user_id, count(*) AS positions, min(gap) AS least_gap, max(gap) AS largest_gap,
           coalesce(bool_or(abs(gap - first_gap) > 1e-5), false) AS nonuniform
    FROM f GROUP BY user_id
    """,
)
def stack_spacing_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing of adjacent distinct positions, compared with the first one (WIN-2, WIN-3)."""
    at = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", at.alias("at"))
    frames = rows.select(*frame_columns(F.lit("s"), F.col("user_id").cast("string"), F.col("event_id"), F.col("event_id"), F.col("at")))
    found, gaps = series.stack_warnings(frames), F.col("adjacent_spacing")
    return found.select(F.col("series").cast("bigint").alias("user_id"), (F.size(gaps) + 1).cast("bigint").alias("positions"), F.array_min(gaps).alias("least_gap"), F.array_max(gaps).alias("largest_gap"), F.col("nonuniform_spacing").alias("nonuniform"))


@query(
    "duplicate_positions_anchor",
    """
    WITH RECURSIVE p AS (
      SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY x, vec_id) AS i
      FROM (SELECT label, vec_id, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings)),
    walk AS (
      SELECT label, i, x, x AS anchor, 1 AS g FROM p WHERE i = 1
      UNION ALL
      SELECT p.label, p.i, p.x, CASE WHEN abs(p.x - w.anchor) <= 0.02 THEN w.anchor ELSE p.x END,
             CASE WHEN abs(p.x - w.anchor) <= 0.02 THEN w.g ELSE w.g + 1 END
      FROM walk w JOIN p ON p.label = w.label AND p.i = w.i + 1)
    SELECT label, max(g)::BIGINT AS groups, max(n)::BIGINT AS largest FROM (SELECT label, g, count(*) OVER (PARTITION BY label, g) AS n FROM walk) GROUP BY label
    """,
)
def duplicate_positions_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of positions near their group's first one, by label (AGG-19)."""
    x = F.round(F.col("embedding")[0].cast("double"), 6)
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    groups = rows.select("label", anchor_groups(F.col("xs"), 0.02).alias("g"))
    return groups.select("label", F.size("g").cast("bigint").alias("groups"), F.array_max(F.transform("g", F.size)).cast("bigint").alias("largest"))


@query(
    "missing_positions",
    """
    SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_order FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) GROUP BY o_custkey
    """,
)
def missing_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a stack without a position (WIN-5)."""
    placed = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").cast("double").alias("at"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(placed, "o_orderkey", "left")
    frames = rows.select(*frame_columns(F.lit("s"), F.col("o_custkey").cast("string"), F.col("o_orderkey"), F.col("o_orderkey"), F.col("at")))
    missing = F.col("missing_positions")
    found = series.stack_warnings(frames).where(F.size(missing) > 0)
    return found.select(F.col("series").cast("bigint").alias("o_custkey"), F.size(missing).cast("bigint").alias("n"), F.array_min(F.transform(missing, lambda m: m["file_index"])).alias("first_order"))


@query(
    "navigator_counts",
    """
    WITH c AS (SELECT c_custkey, 'patient:' || r_name AS patient_key, 'patient:' || r_name || '/study:' || n_name AS study_key, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
    SELECT patient_key, study_key, count(DISTINCT study_key) AS studies, count(DISTINCT study_key || '/' || c_mktsegment) AS series, count(*) AS images FROM c GROUP BY GROUPING SETS ((patient_key), (patient_key, study_key))
    """,
)
def navigator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies, series and images of every patient and study of the tree (AGG-3, AGG-4)."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name", "n_name")
    rows = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.lit(None).cast("string")
    files = rows.select(
        F.col("c_custkey").alias("file_index"), F.col("r_name").alias("patient_id"), none.alias("patient_name"), F.col("n_name").alias("study_instance_uid"), none.alias("study_description"), none.alias("study_date"),
        F.col("c_mktsegment").alias("series_instance_uid"), none.alias("series_number"), none.alias("series_description"),
    )
    return catalog.navigator_counts(catalog.navigator_rows(files)).select("patient_key", "study_key", "studies", "series", "images")


@query(
    "key_fallback_group",
    """
    SELECT coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_brand END), ''), nullif(trim(p_type), ''), 'part-' || p_partkey) AS key,
           count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY 1
    """,
)
def key_fallback_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by the first identity that isn't blank (AGG-3)."""
    brand = F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_brand"))
    key = F.coalesce(first_known(brand, F.col("p_type")), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query(
    "delta_page",
    """
    WITH e AS (SELECT user_id, max(event_id) AS revision, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id)
    SELECT user_id, revision, event_type FROM e WHERE revision > 300 ORDER BY revision LIMIT 50
    """,
)
def delta_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the change feed: latest row of each key above a cursor, a bounded number, in order (ST-1, SORT-11)."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("revision"), "event_type")
    entries = events.groupBy("user_id").agg(F.max("revision").alias("revision"), F.max_by("event_type", "revision").alias("event_type"))
    return catalog.delta_page(entries, 300, 50)[0]


@query(
    "latest_state",
    """
    SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
    FROM events GROUP BY user_id
    """,
)
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each key (ST-17, ST-18)."""
    return catalog.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query(
    "assigned_revisions",
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS revision FROM events WHERE event_type <> 'view'",
)
def assigned_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotone revisions over the whole table without one sorting task (ST-2)."""
    events = table(spark, sf_dir, "events").where("event_type <> 'view'").select("ts", "event_id")
    return catalog.with_revisions(events, ["ts", "event_id"]).select("event_id", F.col("revision").cast("bigint").alias("revision"))


@query(
    "catalog_diff",
    """
    SELECT c.c_custkey, c.c_mktsegment FROM customer c
    WHERE c.c_custkey % 10 = 0 OR c.c_acctbal < 0
    """,
)
def catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a later state of the catalog doesn't hold unchanged (SET-6)."""
    now = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("balance"))
    before = now.where(F.col("c_custkey") % 10 != 0).withColumn("balance", F.when(F.col("balance") < 0, 0.0).otherwise(F.col("balance")))
    return catalog.changed_entries(before, now, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query(
    "natural_order",
    """
    SELECT c_custkey, row_number() OVER (ORDER BY length(regexp_extract(n, '[0-9]+', 0)), regexp_extract(n, '[0-9]+', 0), c_custkey) AS place
    FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS n FROM customer)
    """,
)
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with numbers in natural order: file9 before file10 (SORT-6)."""
    name = F.concat(F.lit("File"), F.col("c_custkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", natural_key(name).alias("key"))
    return numbered(rows, ["key", "c_custkey"], "place").select("c_custkey", F.col("place").cast("bigint").alias("place"))


@query(
    "known_text_first",
    """
    SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY (b = ''), b DESC, p_partkey) AS place
    FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE lower(p_type) END AS b FROM part)
    """,
)
def known_text_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending order in which blank texts still come last (SORT-7)."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_type")).alias("b"))
    w = W.partitionBy("p_size").orderBy(*known_first(F.col("b"), descending=True), "p_partkey")
    return rows.select("p_partkey", F.row_number().over(w).cast("bigint").alias("place"))


@query(
    "folder_tree",
    """
    WITH p AS (SELECT page_id, list_filter(str_split(url, '/'), lambda x: x <> '' AND x <> 'https:' AND x <> 'http:') AS parts FROM pages),
         s AS (SELECT page_id, parts, unnest(generate_series(1, len(parts))) AS i FROM p)
    SELECT array_to_string(parts[1:i - 1], '/') AS parent, parts[i] AS label,
           CASE WHEN i = len(parts) THEN 'file' ELSE 'folder' END AS kind, count(*) AS files
    FROM s GROUP BY 1, 2, 3
    """,
)
def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and files of a path tree with counts (AGG-5)."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_index"), F.regexp_replace("url", "^https?://", "").alias("path"))
    return catalog.folder_tree(pages).groupBy("parent", "label", "kind").agg(F.sum("files").alias("files"))
