"""File scans: candidates, sniffing, headers, dispositions (SRC-1 to SRC-12, SRC-24).

A scan reads files through Spark's binaryFile source; each becomes one row with a disposition. Sniffing
is a chain of built-in expressions over the first 132 bytes, and only files of the wanted formats reach
the header parser, an Arrow function over (path, content).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenstack.functions.text import label
from lumenstack.operators.filters import FORMATS, ScanFilter, scan_filter
from lumenstack.session import path_exists
from lumenstack.sources import dicom, raster

#: Columns that every parsed header has.
HEADER = T.StructType(
    [T.StructField(n, T.StringType()) for n in dicom.TEXTS]
    + [T.StructField(n, T.LongType()) for n in dicom.INTEGERS]
    + [T.StructField(n, T.DoubleType()) for n in dicom.DOUBLES]
    + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in dicom.VECTORS]
    + [T.StructField("image_type", T.ArrayType(T.StringType())), T.StructField("has_pixels", T.BooleanType()), T.StructField("pixel_length", T.LongType()), T.StructField("error", T.StringType())]
)


def sniff(content: Column) -> Column:
    """dicom by its mark at offset 128, above all; else png, jpeg, tiff or webp by signature; null. Names don't count."""
    head = F.hex(F.substring(content, 1, 132))
    starts = lambda *marks: head.rlike("^(" + "|".join(marks) + ")")
    return (
        F.when(F.substring(head, 257, 8) == "4449434D", "dicom")
        .when(starts("89504E470D0A1A0A"), "png")
        .when(starts("FFD8FF"), "jpeg")
        .when(starts("49492A00", "4D4D002A", "49492B00", "4D4D002B"), "tiff")
        .when(starts("52494646.{8}57454250"), "webp")
    )


def candidates(spark: SparkSession, paths: Sequence[str], recursive: bool = True) -> tuple[list[str], DataFrame]:
    """Paths that exist, and records of those that don't. Links below a folder are not followed by the reader."""
    there = {p: bool(p) and path_exists(spark, p) for p in paths}
    found = [p for p in paths if there[p]]
    lost = [(p, "skipped", "input_path_unavailable") for p in paths if not there[p]]
    return found, spark.createDataFrame(lost, "path string, disposition string, reason string")


def read_binary(spark: SparkSession, paths: Sequence[str], recursive: bool = True, stream: bool = False) -> DataFrame:
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary") if stream else spark.read).format("binaryFile")
    reader = reader.option("recursiveFileLookup", str(recursive).lower())
    return reader.load(paths[0]) if stream else reader.load(list(paths))


def parse_headers(files: DataFrame) -> DataFrame:
    """files (path, length, format, content) with the struct `h` of the parsed header."""
    schema = T.StructType([files.schema["path"], files.schema["length"], files.schema["format"], T.StructField("h", HEADER)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, content in zip(batch.column(2).to_pylist(), batch.column(3)):
                data = content.as_py()
                parsed = dicom.read_header(data) if kind == "dicom" else raster.read_header(kind, data)
                rows.append({f.name: parsed.get(f.name) for f in HEADER.fields})
            struct = pa.array(rows, pa.struct([(f.name, _arrow(f.dataType)) for f in HEADER.fields]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), struct], names=schema.names)

    return files.select("path", "length", "format", "content").mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {T.StringType: pa.string(), T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}
    return pa.list_(_arrow(kind.elementType)) if isinstance(kind, T.ArrayType) else simple[type(kind)]


def present_frames(declared: Column, per_frame_items: Column, has_pixels: Column, native_capacity: Column, pixel_length: Column) -> Column:
    """Frames that the file can hold: bounded by per-frame items and by pixel data (8 bytes a frame where encapsulated); 1 at least."""
    bound = F.when(per_frame_items > 0, F.least(declared, per_frame_items)).otherwise(declared)
    held = F.when(~has_pixels, F.least(bound, F.lit(1))).when(native_capacity.isNotNull(), F.least(bound, native_capacity)).otherwise(F.least(bound, F.floor(pixel_length / 8)))
    return F.greatest(held, F.lit(1))


def frame_values(per_frame: Column, shared: Column, top: Column) -> Column:
    """Each frame's value, else the shared one, else the file's (SRC-9)."""
    return F.transform(per_frame, lambda v: F.coalesce(v, shared, top))


def discover(spark: SparkSession, paths: Sequence[str], filters: Sequence[ScanFilter | str] = (), formats: Sequence[str] = FORMATS, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, records): catalog rows of selected files, and one record (path, disposition, reason) for every candidate."""
    found, lost = candidates(spark, paths, recursive)
    if not found:
        empty = spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType()), *HEADER.fields]))
        return empty, lost
    return classify(read_binary(spark, found, recursive), filters, formats, lost)


def classify(raw: DataFrame, filters: Sequence[ScanFilter | str] = (), formats: Sequence[str] = FORMATS, lost: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As discover, from rows of the binaryFile source (also streamed). Unwanted formats never reach the parser."""
    kinds = raw.withColumn("format", sniff(F.col("content")))
    wanted = kinds.where(F.col("format").isin(list(formats)))
    headers = parse_headers(wanted).select("path", "length", "format", "h.*")
    dicomdir = F.coalesce(F.col("sop_class_uid"), F.lit("")) == dicom.MEDIA_DIRECTORY
    failed = F.when(F.col("format") == "dicom", "dicom_parse_failed").otherwise("raster_header_invalid")
    good = F.when(F.col("format") == "dicom", "valid_dicom").otherwise("valid_image")
    reason = F.when(F.col("error").isNotNull(), failed).when(dicomdir, "unsupported_media_directory").when(~scan_filter(filters), "filter_mismatch").otherwise(good)
    disposition = F.when(reason.isin("valid_dicom", "valid_image"), "selected").when(reason == "filter_mismatch", "filtered").otherwise("skipped")
    rows = headers.withColumns({"reason": reason, "disposition": disposition})
    name = F.element_at(F.split("path", "/"), -1)
    files = rows.where("disposition = 'selected'").drop("reason", "disposition", "error").withColumns({"display_name": name, "label": label(F.coalesce("patient_id", F.lit("")), F.coalesce("modality", F.lit("")), F.coalesce("study_date", F.lit("")), name)})
    other = kinds.where(F.col("format").isNull() | ~F.col("format").isin(list(formats)))
    records = rows.select("path", "disposition", "reason").union(other.select("path", F.lit("skipped"), F.when(F.col("format").isNull(), "unrecognized_format").otherwise("format_not_selected")))
    return files, records if lost is None else records.union(lost)
