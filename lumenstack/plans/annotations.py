"""Annotation queries: region lists, reports, legends, identities, logs, trees and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenstack.functions.shapes import clamped, quantize
from lumenstack.operators import annotations, identity, oplog, trees
from lumenstack.registry import query
from lumenstack.session import shared_dir, table
from lumenstack.sources import rois
from lumenstack.streaming import catalog_stream


def _roi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region rows made from orders: path, count, coordinates and frames as JSON text, some of them odd."""
    k = F.col("o_orderkey")
    first = F.format_string("[%d,%d,%d,%d]", k % 50 - 2, k % 40, k % 50 + 10, k % 40 + k % 3)
    second = F.format_string("[%d.5,1,20,30]", k % 9)
    coords = F.when(k % 2 == 0, F.concat(F.lit("["), first, F.lit("]"))).otherwise(F.concat(F.lit("["), first, F.lit(","), second, F.lit("]")))
    frames = F.when(k % 4 == 0, "[[0,1]]").when(k % 4 == 1, "[[],[2]]").otherwise("[]")
    return table(spark, sf_dir, "orders").select(k.alias("row"), F.concat(F.lit("/data/"), F.col("o_custkey").cast("string"), F.lit("/"), k.cast("string")).alias("anon_dicom_path"), F.when(k % 2 == 0, "1").otherwise("2").alias("num_ROI"), coords.alias("ROI_coords"), frames.alias("ROI_frames"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").where("o_orderkey % 5 != 0").select(F.col("o_orderkey").alias("file_index"), F.concat(F.lit("/data/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"), F.lit(40).alias("rows"), F.lit(60).alias("columns"), F.lit(4).alias("frame_count"))
    return rois.parse_rois(_roi_rows(spark, sf_dir), lambda rows: rows.join(files, "path"))


BOXES_SQL = """
    SELECT o_orderkey AS row, 0 AS roi, greatest(o_orderkey % 50 - 2, 0) AS y0, o_orderkey % 40 AS x0, o_orderkey % 50 + 10 AS y1, o_orderkey % 40 + o_orderkey % 3 AS x1,
           o_orderkey % 50 < 2 AS negative, false AS fraction, o_orderkey % 4 = 1 AS no_frames FROM orders WHERE o_orderkey % 5 <> 0
    UNION ALL
    SELECT o_orderkey, 1, o_orderkey % 9 + 1, 1, 20, 30, false, true, false FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 2 = 1
"""
WARNED_SQL = f"""
    SELECT row, roi, unnest(list_filter([CASE WHEN negative THEN 'negative_coordinate' END, CASE WHEN fraction THEN 'non_integer_coordinate' END,
        CASE WHEN y0 > 40 OR y1 > 40 OR x0 > 60 OR x1 > 60 THEN 'out_of_range' END, CASE WHEN y0 = y1 OR x0 = x1 THEN 'zero_area' END,
        CASE WHEN y0 > y1 OR x0 > x1 THEN 'corners_out_of_order' END, CASE WHEN no_frames THEN 'frames_empty' END], lambda x: x IS NOT NULL)) AS code FROM ({BOXES_SQL})
"""


@query("roi_json_explode", f"SELECT row, roi, y0::BIGINT AS ymin, x0::BIGINT AS xmin, y1::BIGINT AS ymax, x1::BIGINT AS xmax FROM ({BOXES_SQL})")
def roi_json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the rows that name loaded files, corrected; other rows are not parsed (SRC-13)."""
    flat = _parsed(spark, sf_dir).where("problem is null").select("row", F.posexplode("coords").alias("roi", "box"))
    return flat.select("row", "roi", *[F.col("box")[i].alias(n) for i, n in enumerate(("ymin", "xmin", "ymax", "xmax"))])


@query("import_report", f"SELECT code, count(*) AS n, min(row * 10 + roi) AS first_ref, least(count(*), 16) AS refs FROM ({WARNED_SQL}) GROUP BY code")
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings by code with the first 16 references (SRC-21)."""
    found = rois.report(_parsed(spark, sf_dir).where("problem is null"))
    return found.select("code", "n", (F.col("first_rows")[0]["row"] * 10 + F.col("first_rows")[0]["roi"]).alias("first_ref"), F.size("first_rows").cast("bigint").alias("refs"))


@query(
    "roi_export_sorted",
    """
    SELECT '/data/' || o_custkey AS anon_dicom_path, CAST(count(*) AS VARCHAR) AS num_ROI,
           '[' || string_agg('[' || o_orderkey % 7 || ',' || o_orderkey % 11 || ',' || (o_orderkey % 7 + 5) || ',' || (o_orderkey % 11 + 5) || ']', ',' ORDER BY o_orderkey) || ']' AS ROI_coords,
           '[' || string_agg('[' || o_orderkey % 3 || ']', ',' ORDER BY o_orderkey) || ']' AS ROI_frames
    FROM orders GROUP BY o_custkey
    """,
)
def roi_export_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists by path as compact JSON, in byte order of the path (SRC-15)."""
    k = F.col("o_orderkey")
    box = F.array(k % 7, k % 11, k % 7 + 5, k % 11 + 5)
    rows = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("/data/"), F.col("o_custkey").cast("string")).alias("path"))
    lists = rows.agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), box.alias("box"), F.array(k % 3).alias("frames")))).alias("all"))
    lists = lists.select("path", F.transform("all", lambda x: x["box"]).alias("roi_coords"), F.transform("all", lambda x: x["frames"]).alias("roi_frames"))
    return rois.export_rows(lists)


@query(
    "content_digest_keys",
    """
    WITH d AS (SELECT doc_id AS seq, source || '.' || lang || '.' || n_chars AS uid, n_chars AS size, sha256(text) AS digest FROM documents),
         g AS (SELECT *, min(digest) OVER w <> max(digest) OVER w AS split FROM d WINDOW w AS (PARTITION BY uid)),
         k AS (SELECT seq, CASE WHEN split THEN 'b3:' || digest ELSE 'sop:' || uid END AS key, split AS settled FROM g)
    SELECT seq, key, settled, nullif(min(seq) OVER (PARTITION BY key), seq) AS alias_of FROM k
    """,
)
def content_digest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional keys of groups that agree, content keys of those that don't, and aliases (ST-3, ST-4)."""
    uid = F.concat_ws(".", "source", "lang", F.col("n_chars").cast("string"))
    files = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("path"), uid.alias("sop_instance_uid"), F.col("n_chars").alias("size_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.lit(None).cast("string").alias("failure")
    )
    return identity.with_keys(files).select("seq", "key", "settled", "alias_of")


@query(
    "class_legend",
    """
    WITH r AS (SELECT event_type AS class, CASE WHEN event_id % 7 = 0 THEN 'mask' ELSE 'rect' END AS type, event_id FROM events),
         u AS (SELECT class, count(*) AS n, count(*) FILTER (type = 'mask') AS not_drawn, min(event_id) AS first FROM r GROUP BY class)
    SELECT u.class, n AS count, not_drawn, row_number() OVER (ORDER BY CASE u.class WHEN 'view' THEN 0 WHEN 'click' THEN 1 END NULLS LAST, first) AS place FROM u
    """,
)
def class_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes in use: schema order, then first appearance, with what isn't drawn (AGG-16)."""
    records = table(spark, sf_dir, "events").select(F.col("event_type").alias("class"), F.when(F.col("event_id") % 7 == 0, "mask").otherwise("rect").alias("type"), "event_id")
    classes = spark.createDataFrame([("view", "View", 0), ("click", "Click", 1), ("unused", "Unused", 2)], "id string, name string, place int")
    return annotations.class_legend(records, classes, "event_id").select("class", "count", "not_drawn", F.col("place").cast("bigint").alias("place"))


@query("layer_counts", "SELECT n_nationkey AS id, coalesce(n, 0) AS count FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every layer with its number of records, 0 included (AGG-17)."""
    records = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("layer"))
    return annotations.layer_entries(records, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))).select("id", "count")


@query(
    "label_groups",
    """
    SELECT CASE doc_id % 4 WHEN 0 THEN 'patient' WHEN 1 THEN 'series' WHEN 2 THEN 'file' ELSE 'folder' END AS level, count(*) AS n, min(doc_id) AS first
    FROM labels WHERE toxic = 0 GROUP BY 1
    """,
)
def label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by target level, broadest first, without hidden layers (AGG-18)."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("patient", "series", "file", "folder")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("quality").alias("field"), F.col("quality").alias("value"), F.col("toxic").cast("string").alias("layer"), kind.alias("target_kind"))
    found = annotations.label_groups(rows, hidden_layers=["1"])
    return found.select("level", F.size("labels").cast("bigint").alias("n"), F.col("labels")[0]["id"].alias("first"))


@query(
    "label_violations",
    """
    SELECT event_id, CASE WHEN value < 10 THEN 'below_min' WHEN value > 90 THEN 'above_max' END AS first_code,
           (CASE WHEN value < 10 OR value > 90 THEN 1 ELSE 0 END + CASE WHEN value <> floor(value) THEN 1 ELSE 0 END)::BIGINT AS n FROM events
    WHERE value < 10 OR value > 90
    """,
)
def label_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a value against its field's definition (CTX-39, ST-13)."""
    none = F.lit(None).cast("string")
    v = F.struct(F.lit("number").alias("type"), none.alias("text"), F.col("value").alias("number"), F.lit(None).cast("boolean").alias("flag"), F.array().cast("array<string>").alias("items"))
    f = F.struct(F.lit("number").alias("type"), F.array().cast("array<string>").alias("options"), F.lit(10.0).alias("min"), F.lit(90.0).alias("max"), F.lit(None).cast("double").alias("step"), F.lit(True).alias("integer"), F.lit(100).alias("max_length"))
    rows = table(spark, sf_dir, "events").where("value < 10 or value > 90").select("event_id", annotations.label_violations(v, f).alias("v"))
    return rows.select("event_id", F.col("v")[0]["code"].alias("first_code"), F.size("v").cast("bigint").alias("n"))


@query(
    "staged_and_edited",
    """
    SELECT doc_id AS file_index, 'import' AS source FROM documents WHERE n_chars > 200 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
    UNION ALL SELECT doc_id, 'edit' FROM labels WHERE quality = 0
    """,
)
def staged_and_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit wins over a late import (ST-16)."""
    box = F.array(F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(1)))
    staged = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_index"), F.when(F.col("n_chars") > 200, box).otherwise(F.array().cast("array<array<int>>")).alias("roi_coords"))
    edited = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("file_index"), box.alias("roi_coords"))
    return oplog.staged_and_edited(staged, edited).select("file_index", "source")


@query(
    "quantized_coordinates",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax * 0.12345 * 1000) / 1000 AS quantum, least(greatest(round(l_extendedprice / 1000), 0), 50.0) AS clamped, round(l_extendedprice / 1000) > 50 AS moved FROM lineitem",
)
def quantized_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates to a thousandth, and snapped and clamped to the image (FN-54, FN-55)."""
    c = clamped(F.col("l_extendedprice") / 1000, F.lit(50))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", quantize(F.col("l_tax") * 0.12345).alias("quantum"), c.alias("c"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "quantum", F.col("c.value").alias("clamped"), F.col("c.moved").alias("moved"))


@query(
    "op_log_fold",
    """
    WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) AS n FROM events),
         d AS (SELECT *, min(n) FILTER (event_type = 'purchase' AND n > 1) OVER (PARTITION BY user_id, event_id % 5) AS gone FROM e)
    SELECT CAST(user_id AS VARCHAR) AS store, event_id AS seq, CAST(event_id AS VARCHAR) AS op_id,
           CASE WHEN n > gone THEN 'conflict' ELSE 'ok' END AS result, CASE WHEN n > gone THEN 'deleted' END AS code, CASE WHEN n > gone THEN gone END AS rev
    FROM d
    """,
)
def op_log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes made of events, folded by user: outcomes with optimistic revisions (ST-8 to ST-12)."""
    return oplog.op_results(envelopes(spark, sf_dir))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on five records a user: the first creates, purchases delete, all others update."""
    record = F.format_string("u%d-%d", F.col("user_id"), F.col("event_id") % 5)
    n = F.row_number().over(W.partitionBy("user_id", record).orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", record.alias("id"), n.alias("n"))
    created = F.struct("id", F.lit("f").alias("file"), F.lit("default").alias("layer"))
    op = (
        F.when(F.col("n") == 1, F.to_json(F.struct(F.lit("create_annotation").alias("type"), created.alias("annotation"))))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(F.lit("delete_annotation").alias("type"), "id", (F.col("n") - 1).alias("base_rev"), created.alias("snapshot"))))
        .otherwise(F.to_json(F.struct(F.lit("update_annotation").alias("type"), "id", F.lit("f").alias("file"), (F.col("n") - 1).alias("base_rev"), F.struct(F.col("event_type").alias("class")).alias("after"))))
    )
    return rows.select(F.col("user_id").cast("string").alias("store"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("op_id"), op.alias("op"))


@query("minimal_diff")
def minimal_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new lists of each conversation as the fewest operations (ST-14, ST-15)."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.sha2("text", 256).alias("t")))).alias("all"))
    had = F.transform("all", lambda x: x["t"])
    wanted = F.transform(F.filter("all", lambda x: x["turn"] % 3 != 1), lambda x: F.when(x["turn"] % 5 == 2, F.concat(F.lit("edited-"), x["t"])).otherwise(x["t"]))
    return oplog.replacement_ops(rows.select(F.col("conv_id").alias("file"), had.alias("had"), wanted.alias("wanted")))


@query(
    "tag_flatten_select",
    "SELECT event_id AS file_index, '-0' AS key, 0 AS depth, 'k' AS tag, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
)
def tag_flatten_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON trees as flat rows, a level at a time (FN-65)."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return trees.json_rows(events, "event_id", "props", 2).select("file_index", "key", "depth", "tag", "value")


@query(
    "stream_catalog",
    "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
)
def stream_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream, appended with revisions; the latest entries equal the batch result (SRC-3, ST-24)."""
    from lumenstack.operators.catalog import latest

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{root}/source"
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    events.repartition(3).write.parquet(source)
    stream = catalog_stream.event_stream(spark, source, events.schema)
    catalog_stream.append_changes(stream, f"{root}/changes", f"{root}/checkpoint", ["event_id"]).awaitTermination()
    return latest(spark.read.parquet(f"{root}/changes").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")
