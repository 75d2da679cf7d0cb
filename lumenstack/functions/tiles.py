"""Whole-slide tiles and thumbnails (FN-47 to FN-49, FN-74, FN-75, AGG-21, AGG-22)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS, DEFAULT_SIZE = (64, 128, 256, 512), 256


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def tiled_full(frame: Column, matrix_rows: Column, matrix_columns: Column, tile_rows: Column, tile_columns: Column, paths: Column, planes: Column) -> Column:
    """struct(tile_row, tile_column, path, plane, x, y, width, height) of a frame in raster order; null if it can't be placed."""
    ok = (matrix_rows > 0) & (matrix_columns > 0) & (tile_rows > 0) & (tile_columns > 0) & (paths > 0) & (planes > 0)
    one = lambda c: F.when(ok, c).otherwise(1)
    across, down = div(matrix_columns + one(tile_columns) - 1, one(tile_columns)), div(matrix_rows + one(tile_rows) - 1, one(tile_rows))
    plane = F.greatest(across * down, F.lit(1))
    spatial = F.pmod(frame, plane)
    row, column = div(spatial, F.greatest(across, F.lit(1))), F.pmod(spatial, F.greatest(across, F.lit(1)))
    x, y = column * tile_columns, row * tile_rows
    placed = F.struct(
        row.alias("tile_row"),
        column.alias("tile_column"),
        F.pmod(div(frame, plane), one(paths)).cast("int").alias("path"),
        div(frame, plane * one(paths)).cast("int").alias("plane"),
        x.alias("x"),
        y.alias("y"),
        F.least(tile_columns, matrix_columns - x).alias("width"),
        F.least(tile_rows, matrix_rows - y).alias("height"),
    )
    return F.when(F.coalesce(ok & (frame < across * down * paths * planes), F.lit(False)), placed)


def sparse_tile(row: Column, column: Column, matrix_rows: Column, matrix_columns: Column, tile_rows: Column, tile_columns: Column) -> Column:
    """struct(x, y, width, height, tile_row, tile_column) of a position from 1; tile indexes only on the grid; null outside."""
    y, x = row - 1, column - 1
    ok = (y >= 0) & (x >= 0) & (tile_rows > 0) & (tile_columns > 0) & (x < matrix_columns) & (y < matrix_rows)
    on = lambda v, t: F.when(F.pmod(v, F.when(t > 0, t).otherwise(1)) == 0, div(v, F.when(t > 0, t).otherwise(1)))
    placed = F.struct(x.alias("x"), y.alias("y"), F.least(tile_columns, matrix_columns - x).alias("width"), F.least(tile_rows, matrix_rows - y).alias("height"), on(y, tile_rows).alias("tile_row"), on(x, tile_columns).alias("tile_column"))
    return F.when(F.coalesce(ok, F.lit(False)), placed)


def pyramid_levels(files: DataFrame, pyramid: str = "pyramid_uid", rows: str = "matrix_rows", columns: str = "matrix_columns") -> DataFrame:
    """Distinct matrix sizes of each pyramid with `level`, 0 for the largest."""
    sizes = files.where(F.col(pyramid).isNotNull() & F.col(rows).isNotNull() & F.col(columns).isNotNull()).select(pyramid, rows, columns).distinct()
    w = W.partitionBy(pyramid).orderBy((F.col(rows).cast("bigint") * F.col(columns)).desc(), F.col(rows).desc(), F.col(columns).desc())
    return sizes.withColumn("level", (F.row_number().over(w) - 1).cast("bigint"))


def focal_index(offsets: Column, z: Column) -> Column:
    """Position of z among the distinct finite offsets, ascending; values within 1e-9 of the one kept before are equal."""
    ordered = F.array_sort(F.filter(offsets, lambda o: o.isNotNull() & ~F.isnan(o) & (F.abs(o) < float("inf"))))
    distinct = F.aggregate(ordered, F.array().cast("array<double>"), lambda acc, o: F.when((F.size(acc) > 0) & (F.abs(o - F.try_element_at(acc, F.lit(-1))) <= 1e-9), acc).otherwise(F.concat(acc, F.array(o))))
    at = F.array_position(F.transform(distinct, lambda o: F.abs(o - z) <= 1e-9), F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def thumbnail_bucket(size: Column, buckets: Sequence[int] = BUCKETS, default: int = DEFAULT_SIZE) -> Column:
    """The least bucket of at least the size; the default without one; null for 0 or above the largest."""
    asked = F.coalesce(size, F.lit(default))
    out = F.lit(None).cast("int")
    for b in sorted(buckets, reverse=True):
        out = F.when(asked <= b, F.lit(b)).otherwise(out)
    return F.when(asked > 0, out)


def thumbnail_size(rows: Column, columns: Column, aspect: Column, bucket: Column) -> Column:
    """struct(width, height): the physical shape, its longest edge at most the bucket, never enlarged."""
    ratio = F.when((aspect > 0) & (aspect < float("inf")), aspect).otherwise(1.0)
    w, h = columns * F.least(1 / ratio, F.lit(1.0)), rows * F.least(ratio, F.lit(1.0))
    scale = F.least(bucket / F.greatest(w, h), F.lit(1.0))
    fit = lambda e: F.least(F.greatest(F.round(e * scale), F.lit(1.0)), F.greatest(bucket, F.lit(1)).cast("double")).cast("int")
    return F.struct(fit(w).alias("width"), fit(h).alias("height"))


def reduction_shift(rows: Column, columns: Column, thumbnail: Column, limit: int) -> Column:
    """The largest shift, 1 to limit, that leaves twice the thumbnail's pixels along both axes; null if none."""
    out = F.lit(None).cast("int")
    for s in range(1, limit + 1):
        fits = (F.shiftright(columns, s) >= 2 * thumbnail["width"]) & (F.shiftright(rows, s) >= 2 * thumbnail["height"])
        out = F.when(fits, F.lit(s)).otherwise(out)
    return out
