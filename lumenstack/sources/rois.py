"""Region lists as CSV: reader with strict and lenient rules, report, sorted writer (SRC-13 to SRC-15, SRC-21, SRC-22).

Rows are joined to files by path before their JSON is parsed, so rows of files that aren't loaded cost
a path only. The import is all or nothing: `read_rois` gives the rows with their problems, and
`checked` raises on the first in file order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLUMNS = ["anon_dicom_path", "num_ROI", "ROI_coords", "ROI_frames"]
MAX_ROIS, MAX_FRAMES, MAX_PATH, TOP = 100_000, 1_000_000, 32_768, 4_294_967_295
#: Warning codes of a box, in order.
WARNINGS = ("negative_coordinate", "non_integer_coordinate", "out_of_range", "zero_area", "corners_out_of_order", "frames_empty")


class ImportRefused(ValueError):
    pass


def check_header(columns: list[str]) -> None:
    """The two required columns, by exact name, anywhere in the header."""
    for name in ("anon_dicom_path", "ROI_coords"):
        if name not in columns:
            raise ImportRefused(f"missing column {name}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file with `row`, their place counted with the header as 1."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    check_header(df.columns)
    # one CSV file is one ordered input; ids grow with position
    w = W.orderBy("_id")
    return df.withColumn("_id", F.monotonically_increasing_id()).withColumn("row", F.row_number().over(w) + 1).drop("_id")


def parse_rois(rows: DataFrame, resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(row, file_index, coords, frames, warnings, problem) of rows that name loaded files.

    resolve: rows with `path` -> rows joined to (file_index, rows, columns, frame_count), one for each
    file a path names. problem is the first rule that the row breaks; coords are corrected: below zero
    is 0, fractions are rounded, halves away from zero.
    """
    path = F.trim(F.coalesce("anon_dicom_path", F.lit("")))
    given = set(rows.columns)
    has = given.__contains__
    kept = rows.select("row", path.alias("path"), F.trim("ROI_coords").alias("coords_text"), F.trim("num_ROI").alias("count_text") if has("num_ROI") else F.lit(None).cast("string").alias("count_text"), F.trim("ROI_frames").alias("frames_text") if has("ROI_frames") else F.lit(None).cast("string").alias("frames_text"))
    empty = kept.where(F.col("path") == "").select("row", F.lit("empty_path").alias("problem"))
    found = resolve(kept.where((F.col("path") != "") & (F.octet_length("path") <= MAX_PATH)))
    variant = F.try_parse_json("coords_text")
    entries = F.try_variant_get(variant, "$", "array<variant>")
    boxes = F.try_variant_get(variant, "$", "array<array<double>>")
    frames = F.try_variant_get(F.try_parse_json("frames_text"), "$", "array<array<bigint>>") if has("ROI_frames") else F.array().cast("array<array<bigint>>")
    rows = found.withColumns({"_entries": entries, "_boxes": boxes, "_frames": frames})
    fixed = F.transform("_boxes", lambda b: F.transform(b, lambda x: F.when(x < 0, F.lit(0.0)).otherwise(F.round(x))))
    rows = rows.withColumn("coords", F.transform(fixed, lambda b: F.transform(b, lambda x: F.when(x <= TOP, x).cast("bigint"))))
    n = F.size("_boxes")
    count = F.when(F.col("count_text").rlike("^[0-9]+$"), F.col("count_text").try_cast("bigint"))
    twice = F.count("*").over(W.partitionBy("file_index")) > 1
    problem = (
        F.when(F.col("_entries").isNull(), "roi_coords")
        .when(F.size("_entries") > MAX_ROIS, "too_large")
        .when(F.col("_boxes").isNull(), "roi_coords")
        .when(F.exists("_boxes", lambda b: F.size(b) != 4), "roi_coords_entry")
        .when(F.exists("_boxes", lambda b: F.exists(b, lambda x: x.isNull())), "roi_coords")
        .when(F.exists("coords", lambda b: F.exists(b, lambda x: x.isNull())), "coordinate_too_large")
    )
    if has("num_ROI"):
        problem = problem.when(count.isNull(), "num_roi").when(count != n, "num_roi_mismatch")
    if has("ROI_frames"):
        odd = F.exists("_frames", lambda f: f.isNull() | F.exists(f, lambda i: i.isNull() | (i < 0) | (i > TOP)))
        problem = problem.when(F.col("_frames").isNull() | odd, "roi_frames").when(F.exists("_frames", lambda f: F.size(f) > MAX_FRAMES), "too_large").when((F.size("_frames") > 0) & (F.size("_frames") != n), "roi_frames_length")
    problem = problem.when(twice, "duplicate_path").when(F.exists("_frames", lambda f: F.exists(f, lambda i: i >= F.col("frame_count"))), "frame_out_of_range")

    def warn(box: Column, i: Column) -> Column:
        raw = F.get("_boxes", i)
        y0, x0, y1, x1 = (box[k] for k in range(4))
        past = (F.greatest(y0, y1) > F.col("rows")) | (F.greatest(x0, x1) > F.col("columns"))
        tests = (F.exists(raw, lambda v: v < 0), F.exists(raw, lambda v: (v >= 0) & (v != F.round(v))), past, (y0 == y1) | (x0 == x1), (y0 > y1) | (x0 > x1), F.coalesce(F.size(F.get("_frames", i)) == 0, F.lit(False)))
        return F.filter(F.array(*[F.when(t, F.struct(F.lit(c).alias("code"), i.alias("roi"))) for t, c in zip(tests, WARNINGS)]), lambda x: x.isNotNull())

    warnings = F.when(problem.isNull(), F.flatten(F.transform("coords", warn)))
    out = rows.select("row", "file_index", "coords", F.col("_frames").alias("frames"), warnings.alias("warnings"), problem.alias("problem"))
    nothing = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ("file_index", "coords", "frames", "warnings")]
    return out.unionByName(empty.select("row", *nothing, "problem"))


def checked(parsed: DataFrame) -> DataFrame:
    """The parsed rows, or ImportRefused with the first problem in file order: nothing is imported then."""
    first = parsed.where("problem is not null").orderBy("row").limit(1).collect()
    if first:
        raise ImportRefused(f"row {first[0]['row']}: {first[0]['problem']}")
    return parsed.drop("problem")


def report(parsed: DataFrame, refs: int = 16) -> DataFrame:
    """(code, n, first_rows): warnings with up to `refs` (row, roi) references a code."""
    flat = parsed.select("row", F.explode("warnings").alias("w")).select("row", "w.code", "w.roi")
    w = W.partitionBy("code").orderBy("row", "roi")
    ranked = flat.withColumn("_n", F.row_number().over(w))
    return ranked.groupBy("code").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_n") <= refs, F.struct("row", "roi")))).alias("first_rows"))


def export_rows(lists: DataFrame, path: str = "path") -> DataFrame:
    """Rows of the CSV form, in byte order of the path: path, count, compact JSON lists."""
    out = lists.select(
        F.col(path).alias("anon_dicom_path"),
        F.size("roi_coords").cast("string").alias("num_ROI"),
        F.concat(F.lit("["), F.array_join(F.transform("roi_coords", lambda b: F.concat(F.lit("["), F.array_join(F.transform(b, lambda x: x.cast("string")), ","), F.lit("]"))), ","), F.lit("]")).alias("ROI_coords"),
        F.concat(F.lit("["), F.array_join(F.transform("roi_frames", lambda b: F.concat(F.lit("["), F.array_join(F.transform(b, lambda x: x.cast("string")), ","), F.lit("]"))), ","), F.lit("]")).alias("ROI_frames"),
    )
    return out.orderBy("anon_dicom_path")


def write_csv(lists: DataFrame, path: str) -> None:
    """One CSV file (a user's export is one file), minimal quoting."""
    export_rows(lists).coalesce(1).write.option("header", True).option("escape", '"').mode("errorifexists").csv(path)
