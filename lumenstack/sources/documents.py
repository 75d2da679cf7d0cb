"""Annotation documents as JSON and JSON Lines, and adapters by content (SRC-16 to SRC-20, SRC-23, UDX-1 to UDX-5).

A document has format, version, schema, files, layers, annotations, labels and extensions. As a table it
is one row a record: (kind, place, record as VARIANT), so members that this version doesn't know are
kept and written back.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT, MAJOR = "lumenstack.annotations", "1"
LISTS = {"file": "files", "layer": "layers", "annotation": "annotations", "label": "labels"}
MAX_BYTES, MAX_FILES, MAX_RECORDS, SNIFF_BYTES = 256 << 20, 1_000_000, 5_000_000, 4096
NONE, POSSIBLE, CERTAIN = 0, 1, 2


class DocumentRefused(ValueError):
    pass


def check_head(head: dict, format: str = FORMAT) -> None:
    version = str(head.get("version"))
    major, _, minor = version.partition(".")
    if head.get("format") != format:
        raise DocumentRefused(f"wrong format {head.get('format')!r}")
    if major != MAJOR or not (minor.isascii() and minor.isdigit() and len(minor) <= 9):
        raise DocumentRefused(f"unsupported version {version!r}")


def _bounded(records: DataFrame) -> DataFrame:
    counts = {r["kind"]: r["n"] for r in records.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if counts.get("file", 0) > MAX_FILES or counts.get("annotation", 0) + counts.get("label", 0) > MAX_RECORDS:
        raise DocumentRefused("too many records")
    return records


def read_json(spark: SparkSession, path: str, format: str = FORMAT) -> tuple[dict, DataFrame]:
    """(head, records) of one JSON document of bounded size."""
    text = spark.read.text(path, wholetext=True).where(F.octet_length("value") <= MAX_BYTES)
    doc = text.select(F.try_parse_json("value").alias("v"))
    first = doc.select(*[F.try_variant_get("v", f"$.{n}", "string").alias(n) for n in ("format", "version")], F.to_json(F.try_variant_get("v", "$.schema", "variant")).alias("schema"), F.col("v").isNotNull().alias("ok")).first()
    if first is None or not first["ok"]:
        raise DocumentRefused("not a JSON document within bounds")
    head = {"format": first["format"], "version": first["version"], "schema": json.loads(first["schema"]) if first["schema"] else None}
    check_head(head, format)
    parts = [doc.select(F.lit(kind).alias("kind"), F.posexplode(F.try_variant_get("v", f"$.{name}", "array<variant>")).alias("place", "record")) for kind, name in LISTS.items()]
    records = parts[0]
    for p in parts[1:]:
        records = records.union(p)
    return head, _bounded(records)


def read_json_lines(spark: SparkSession, path: str, format: str = FORMAT) -> tuple[dict, DataFrame]:
    """(head, records) of the line form: a header, one record a line, and an end line with counts; a cut file is refused."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("v"), F.monotonically_increasing_id().alias("id"))
    kind = F.try_variant_get("v", "$.kind", "string")
    rows = lines.select(kind.alias("kind"), "id", F.try_variant_get("v", "$.record", "variant").alias("record"), "v")
    ends = rows.where("kind in ('header', 'end')").orderBy("id").select("kind", F.to_json("v").alias("t")).collect()
    if [r["kind"] for r in ends] != ["header", "end"]:
        raise DocumentRefused("header or end line missing")
    head, end = (json.loads(r["t"]) for r in ends)
    check_head(head, format)
    records = rows.where(F.col("kind").isin(*LISTS)).select("kind", F.col("id").alias("place"), "record")
    counts = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    stated = end.get("counts", {})
    if any(counts.get(k, 0) != stated.get(k, 0) for k in LISTS) or None in counts:
        raise DocumentRefused("counts of the end line disagree")
    return head, _bounded(records)


def write_json(head: dict, records: DataFrame, path: str, max_bytes: int = MAX_BYTES) -> None:
    """One JSON document; a budget refuses it before anything is written."""
    text = records.select("kind", "place", F.to_json("record").alias("t"))
    size = text.agg(F.sum(F.octet_length("t") + 1)).first()[0] or 0
    if size > max_bytes:
        raise DocumentRefused(f"document of {size} bytes is over {max_bytes}")
    lists = text.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), ",").alias("j"))
    spark = records.sparkSession
    kinds = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(LISTS.items())], "i int, kind string, name string")
    parts = kinds.join(lists, "kind", "left").select("i", F.concat(F.lit('"'), "name", F.lit('":['), F.coalesce("j", F.lit("")), F.lit("]")).alias("m"))
    body = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]), ",").alias("b"))
    start = json.dumps(head)[:-1]
    body.select(F.concat(F.lit(start + ","), "b", F.lit("}")).alias("value")).coalesce(1).write.text(path)


def write_json_lines(head: dict, records: DataFrame, path: str) -> None:
    """The line form: records in parallel between a header and an end line."""
    spark = records.sparkSession
    counts = {r["kind"]: r["n"] for r in records.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    rank = F.array_position(F.array(*[F.lit(k) for k in LISTS]), F.col("kind"))
    lines = records.select(rank.alias("r"), "place", F.to_json(F.struct("kind", "record")).alias("value"))
    ends = spark.createDataFrame([(0, 0, json.dumps({"kind": "header", **head})), (99, 0, json.dumps({"kind": "end", "counts": counts}))], "r long, place long, value string")
    lines.withColumn("place", F.col("place").cast("long")).withColumn("r", F.col("r").cast("long")).union(ends).orderBy("r", "place").select("value").coalesce(1).write.text(path)


def file_refs(files: DataFrame, root: str) -> DataFrame:
    """One `file` record for each key, by its first holder: relative path, identifiers, size and frames (CTX-34).

    Paths are below `root`; a file elsewhere is named by its last component, never by an absolute path.
    """
    first = files.where(F.col("key").isNotNull()).groupBy("key").agg(F.min_by(F.struct(*[c for c in files.columns if c != "key"]), "file_index").alias("f"))
    below = F.startswith(F.col("f.path"), F.lit(root.rstrip("/") + "/"))
    path = F.when(below, F.substring(F.col("f.path"), len(root.rstrip("/")) + 2, 1 << 30)).otherwise(F.element_at(F.split("f.path", "/"), -1))
    own = F.struct("key", path.alias("path"), *[F.col(f"f.{c}").alias(c) for c in ("sop_instance_uid", "study_instance_uid", "series_instance_uid", "size_bytes", "rows", "columns", "frame_count") if c in files.columns])
    return first.select(F.lit("file").alias("kind"), F.col("f.file_index").alias("place"), F.to_variant_object(own).alias("record"))


def import_status(records: DataFrame | None, problem: str | None = None) -> dict:
    """State of an import: none, ready with counts by kind, or failed with its first problem (CTX-35)."""
    if problem is not None:
        return {"state": "failed", "problem": problem}
    if records is None:
        return {"state": "none"}
    return {"state": "ready", "counts": {r["kind"]: r["n"] for r in records.groupBy("kind").agg(F.count("*").alias("n")).collect()}}


@dataclass
class Adapter:
    """A format: how sure it is of a head of bytes, and its reader and writer."""

    id: str
    sniff: Callable[[bytes], int]
    read: Callable | None = None
    write: Callable | None = None


@dataclass
class Registry:
    adapters: dict[str, Adapter] = field(default_factory=dict)

    def register(self, adapter: Adapter) -> None:
        if adapter.id in self.adapters:
            raise ValueError(f"adapter {adapter.id} is registered")
        self.adapters[adapter.id] = adapter

    def sniff(self, head: bytes) -> Adapter | None:
        """The surest reader of a head; of equally sure ones the first registered; none if no one is."""
        best, sure = None, NONE
        for a in self.adapters.values():
            if a.read is not None and (own := a.sniff(head[:SNIFF_BYTES])) > sure:
                best, sure = a, own
        return best


def sniff_json(head: bytes) -> int:
    body = head.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n\x0c")
    return NONE if not body.startswith(b"{") else CERTAIN if f'"{FORMAT}"'.encode() in head else POSSIBLE


def sniff_csv(head: bytes) -> int:
    first = head.removeprefix(b"\xef\xbb\xbf").split(b"\n")[0]
    names = [n.strip().strip(b'"') for n in first.split(b",")]
    return CERTAIN if b"anon_dicom_path" in names and b"ROI_coords" in names else NONE


def default_registry() -> Registry:
    from lumenstack.sources import rois

    registry = Registry()
    registry.register(Adapter("json", sniff_json, read_json, write_json))
    registry.register(Adapter("roi-csv", sniff_csv, rois.read_csv, rois.write_csv))
    registry.register(Adapter("jsonl", lambda head: NONE, read_json_lines, write_json_lines))
    return registry
