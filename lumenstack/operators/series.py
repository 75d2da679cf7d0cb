"""Series, stacks and their geometry (AGG-1, AGG-2, AGG-19, SORT-1 to SORT-5, WIN-1 to WIN-5, CTX-24, CTX-25).

A frame row has: file_index, path, study, series, sop_instance_uid, instance_number, frame_index, kind
columns and position, orientation (arrays of double, null if absent), own (frame-specific values).
Stacks are the windows of all computations; the order inside a stack needs one sort of the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenstack.functions.geometry import dot, finite, magnitude, scale, slice_normal, subtract

TOLERANCE = 1e-5
STACK = ["study", "series", "kind", "kind_uid", "kind_role", "kind_rows", "kind_columns"]


def with_kind(files: DataFrame) -> DataFrame:
    """files with kind columns: concatenation, pyramid_level or companion of a slide, else ordinary."""
    concatenation, pyramid = F.nullif("concatenation_uid", F.lit("")), F.nullif("pyramid_uid", F.lit(""))
    slide = F.col("sop_class_uid") == "1.2.840.10008.5.1.4.1.1.77.1.6"
    kind = F.when(concatenation.isNotNull(), "concatenation").when(slide & pyramid.isNotNull(), "pyramid_level").when(slide, "companion").otherwise("ordinary")
    role = F.nullif(F.get("image_type", F.lit(2)), F.lit(""))
    return files.withColumns({
        "kind": kind,
        "kind_uid": F.when(kind == "concatenation", concatenation).when(kind == "pyramid_level", pyramid).when(kind == "companion", F.col("sop_instance_uid")),
        "kind_role": F.when(kind.isin("pyramid_level", "companion"), role),
        "kind_rows": F.when(kind == "pyramid_level", F.col("matrix_rows")),
        "kind_columns": F.when(kind == "pyramid_level", F.col("matrix_columns")),
    })


def kind_order() -> list[Column]:
    """Ordinary, concatenation, pyramid level (larger matrix first), companion."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ("ordinary", "concatenation", "pyramid_level", "companion")]), F.col("kind"))
    return [rank.asc(), F.col("kind_uid").asc_nulls_first(), F.col("kind_rows").desc_nulls_last(), F.col("kind_columns").desc_nulls_last(), F.col("kind_role").asc_nulls_first()]


def in_series(frames: DataFrame) -> DataFrame:
    """Frames without a study or series identifier belong to no series."""
    return frames.where((F.coalesce("study", F.lit("")) != "") & (F.coalesce("series", F.lit("")) != ""))


def valid_orientation(o: Column) -> Column:
    """The orientation if it is finite and has a normal, else null."""
    return F.when(F.forall(o, finite) & slice_normal(o).isNotNull(), o)


def with_position(frames: DataFrame) -> DataFrame:
    """frames with `reference` (first valid orientation of the stack), `normal` and `along` (position along it)."""
    whole = W.partitionBy(*STACK).orderBy(F.col("instance_number").asc_nulls_last(), "path", "file_index", "frame_index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = frames.withColumn("reference", F.first(valid_orientation(F.col("orientation")), ignorenulls=True).over(whole))
    out = out.withColumn("normal", slice_normal(F.col("reference")))
    return out.withColumn("along", F.when(valid_orientation(F.col("orientation")).isNotNull(), dot(F.col("position"), F.col("normal"))))


def geometry_order() -> list[Column]:
    """Position along the normal (nulls last), instance number (nulls last), path, file, frame."""
    return [F.col("along").asc_nulls_last(), F.col("instance_number").asc_nulls_last(), F.col("path").asc(), F.col("file_index").asc(), F.col("frame_index").asc()]


def stack_order() -> list[Column]:
    """In a concatenation: offset + frame (nulls last), number in it, frame; then, as elsewhere, geometry."""
    inside = F.col("kind") == "concatenation"
    at = F.when(inside, F.col("concatenation_offset").cast("bigint") + F.col("frame_index"))
    return [at.asc_nulls_last(), F.when(inside, F.col("in_concatenation_number")).asc_nulls_last(), F.when(inside, F.col("frame_index")).asc_nulls_last(), *geometry_order()]


def series_stacks(frames: DataFrame) -> DataFrame:
    """frames with `virtual_index`: the place in their stack, from 0."""
    return with_position(in_series(frames)).withColumn("virtual_index", F.row_number().over(W.partitionBy(*STACK).orderBy(*stack_order())) - 1)


def anchor_groups(positions: Column, tolerance: float = TOLERANCE) -> Column:
    """Groups of an ascending array: a value joins the last group if it is near that group's first value.

    Not the same as islands by neighbours' gaps: a chain of close values is cut where it leaves the anchor.
    """
    zero = F.array().cast("array<array<double>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (F.abs(x - F.get(last, F.lit(0))) <= tolerance)
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.array(x))))).otherwise(F.concat(acc, F.array(F.array(x))))

    return F.aggregate(positions, zero, step)


def stack_warnings(frames: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row a stack with missing_positions, duplicate_positions, nonuniform_spacing, inconsistent_orientation and gantry tilt.

    Slides have no geometry warnings. A file's later frames count only with values of their own.
    """
    rows = with_position(in_series(frames).where(~F.col("kind").isin("pyramid_level", "companion")))
    rows = rows.where(F.col("own") | (F.col("frame_index") == 0))
    place = F.struct("file_index", "frame_index", "path")
    same = F.forall(F.zip_with("orientation", "reference", lambda a, b: F.abs(a - b) <= tolerance), lambda ok: ok)
    odd = F.when(F.col("reference").isNull(), valid_orientation(F.col("orientation")).isNull()).otherwise(~F.coalesce(valid_orientation(F.col("orientation")).isNotNull() & same, F.lit(False)))
    aside = subtract(F.col("position"), scale(F.col("normal"), dot(F.col("position"), F.col("normal"))))
    # the first positioned frame in geometry order is the origin of lateral shifts
    first = F.min_by(aside, F.struct("along", F.col("instance_number").isNull(), "instance_number", "path", "file_index", "frame_index")).over(W.partitionBy(*STACK, F.col("along").isNull()))
    rows = rows.withColumn("shift", F.when(F.col("along").isNotNull(), magnitude(subtract(aside, first))))
    grouped = rows.groupBy(*STACK).agg(
        F.collect_list(F.when(F.col("position").isNull(), place)).alias("missing_positions"),
        F.collect_list(F.when(odd, place)).alias("inconsistent_orientation"),
        F.array_sort(F.collect_list("along")).alias("along"),
        F.max("shift").alias("max_lateral_shift"),
        F.count_if(F.col("shift") > tolerance).alias("tilted"),
    )
    groups = grouped.withColumn("groups", anchor_groups(F.col("along"), tolerance))
    firsts = F.transform("groups", lambda g: F.get(g, F.lit(0)))
    spacing = F.when(F.size(firsts) > 1, F.zip_with(F.slice(firsts, F.lit(2), F.size(firsts)), F.slice(firsts, F.lit(1), F.size(firsts) - 1), lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))
    return groups.select(
        *STACK,
        "missing_positions",
        F.filter("groups", lambda g: F.size(g) > 1).alias("duplicate_positions"),
        spacing.alias("adjacent_spacing"),
        F.coalesce(F.exists(spacing, lambda s: F.abs(s - F.get(spacing, F.lit(0))) > tolerance), F.lit(False)).alias("nonuniform_spacing"),
        "inconsistent_orientation",
        F.when(F.col("tilted") > 0, F.col("max_lateral_shift")).alias("gantry_tilt"),
    )


def neighbours(stack: DataFrame, distance: int, by: list[str], position: str = "virtual_index") -> DataFrame:
    """stack with `near`: the positions within a distance (WIN-8)."""
    w = W.partitionBy(*by).orderBy(position).rangeBetween(-distance, distance)
    return stack.withColumn("near", F.collect_list(position).over(w))


def prefetch_order(center: Column, total: Column, distance: int, forward: Column) -> Column:
    """Frames by distance 1..k from the centre, the preferred direction first; only existing ones (WIN-7)."""
    step = F.when(forward, 1).otherwise(-1)
    pairs = [F.array(center + step * d, center - step * d) for d in range(1, distance + 1)]
    return F.filter(F.concat(*pairs), lambda f: (f >= 0) & (f < total))


def prefetch_plan(start: Column, total: Column, frame_bytes: Column, budget: int, near: int, look_ahead: Column, forward: Column, far: int = 512) -> Column:
    """The whole stack if it fits the budget, in cine mode the frames ahead, else the neighbours (CTX-52)."""
    ahead = F.transform(F.sequence(F.lit(1), F.greatest(look_ahead, F.lit(1))), lambda d: F.pmod(start + F.when(forward, d).otherwise(-d), total))
    return F.when(frame_bytes * total <= budget, prefetch_order(start, total, far, forward)).when(look_ahead.isNotNull(), ahead).otherwise(prefetch_order(start, total, near, forward))
