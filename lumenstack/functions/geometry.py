"""Patient geometry of image planes (FN-17 to FN-26, WIN-6, CTX-8 to CTX-11, CTX-54).

Vectors are arrays of 3 doubles; a frame geometry is struct(position, orientation (6), spacing (2),
rows, columns). All functions take and give Columns, except the resampler, which works on numpy
arrays inside an Arrow function.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLANE_DISTANCE, ORIENTATION, IN_PLANE, SPACING_SHARE, SINGLE_PLANE = 1e-3, 1e-5, 1e-2, 1e-4, 1e-6
EPSILON = 2.0**-52


def vector(*xs: Column) -> Column:
    return F.array(*xs)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression that is used n times in place would be copied n times, at every level."""
    return F.transform(F.array(value), body)[0]


def both(a: Column, b: Column, body) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: body(p["a"], p["b"]))


def dot(a: Column, b: Column) -> Column:
    return both(a, b, lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2])


def cross(a: Column, b: Column) -> Column:
    return both(a, b, lambda a, b: F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def magnitude(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def normalized(a: Column) -> Column:
    """The unit vector, or null if the length is degenerate or not finite."""
    return both(a, magnitude(a), lambda v, n: F.when(finite(n) & (n > EPSILON), F.transform(v, lambda x: x / n)))


def row_axis(orientation: Column) -> Column:
    return normalized(F.slice(orientation, 1, 3))


def column_axis(orientation: Column) -> Column:
    return normalized(F.slice(orientation, 4, 3))


def plane_normal(orientation: Column) -> Column:
    return normalized(cross(row_axis(orientation), column_axis(orientation)))


def slice_normal(orientation: Column) -> Column:
    """The normal of the direction triplets as stored, without normalising them first."""
    return normalized(cross(F.slice(orientation, 1, 3), F.slice(orientation, 4, 3)))


def valid_geometry(g: Column) -> Column:
    """Positive size, finite position and orientation, finite positive spacing, both directions usable; not orthogonality."""
    numbers = F.forall(F.concat(g["position"], g["orientation"]), finite)
    spacing = F.forall(g["spacing"], lambda s: finite(s) & (s > 0))
    ok = (g["rows"] > 0) & (g["columns"] > 0) & numbers & spacing & row_axis(g["orientation"]).isNotNull() & column_axis(g["orientation"]).isNotNull()
    return F.coalesce(ok, F.lit(False))


def in_plane_transform(source: Column, target: Column) -> Column:
    """struct(origin, row_step, column_step): target pixel (row, column) to source pixel; null for invalid geometry."""
    axes = F.struct(*[f(g["orientation"]).alias(n) for n, f, g in (("sr", row_axis, source), ("sc", column_axis, source), ("tr", row_axis, target), ("tc", column_axis, target))])

    def steps(x: Column) -> Column:
        place = lambda v: F.array(dot(v, x["sc"]) / source["spacing"][0], dot(v, x["sr"]) / source["spacing"][1])
        delta = subtract(target["position"], source["position"])
        down, right = scale(x["tc"], target["spacing"][0]), scale(x["tr"], target["spacing"][1])
        return F.struct(place(delta).alias("origin"), place(down).alias("row_step"), place(right).alias("column_step"))

    return F.when(valid_geometry(source) & valid_geometry(target), let(axes, steps))


def coplanar_transform(source: Column, target: Column, plane: float = PLANE_DISTANCE, orientation: float = ORIENTATION) -> Column:
    """As in_plane_transform, but null unless both grids lie in one plane with the same axes."""
    sides = {"s": source, "t": target}
    parts = {f"{n}{k}": f(g["orientation"]) for n, g in sides.items() for k, f in (("r", row_axis), ("c", column_axis), ("n", plane_normal))}
    axes = F.struct(*[c.alias(n) for n, c in parts.items()])

    def same(x: Column) -> Column:
        near = [1 - dot(x["s" + k], x["t" + k]) <= orientation for k in "rcn"]
        return near[0] & near[1] & near[2] & (F.abs(dot(subtract(target["position"], source["position"]), x["sn"])) <= plane)

    return F.when(F.coalesce(let(axes, same), F.lit(False)), in_plane_transform(source, target))


def map_pixel(t: Column, row: Column, column: Column) -> Column:
    return F.array(*[t["origin"][i] + row * t["row_step"][i] + column * t["column_step"][i] for i in (0, 1)])


def grids_overlap(source: Column, target: Column, t: Column) -> Column:
    """Whether the target's corners, mapped, reach into the source grid grown by half a pixel."""
    last = [F.greatest(target[c] - 1, F.lit(0)).cast("double") for c in ("rows", "columns")]

    def overlap(t: Column) -> Column:
        corners = [map_pixel(t, r, c) for r in (F.lit(0.0), last[0]) for c in (F.lit(0.0), last[1])]
        inside = F.lit(True)
        for axis, size in ((0, "rows"), (1, "columns")):
            at = [p[axis] for p in corners]
            inside = inside & (F.greatest(*at) >= -0.5) & (F.least(*at) <= source[size] - 0.5)
        return inside

    return let(t, overlap)


def pixel_aspect(spacing: Column, ratio: Column) -> Column:
    """[row / column, 1] from spacing, else from the aspect ratio."""
    usable = lambda p: F.coalesce((F.size(p) == 2) & (p[0] > 0) & (p[1] > 0), F.lit(False))
    return F.when(usable(spacing), F.array(spacing[0] / spacing[1], F.lit(1.0))).when(usable(ratio), F.array(ratio[0] / ratio[1], F.lit(1.0)))


def frame_geometry(per_frame: Column, frame: Column, own: Column) -> Column:
    """The frame's own values where it has them, else the file's; null if the result isn't valid."""
    at = F.try_element_at(per_frame, (frame + 1).cast("int"))
    g = F.struct(*[F.coalesce(at[c], own[c]).alias(c) for c in ("position", "orientation", "spacing")], own["rows"].alias("rows"), own["columns"].alias("columns"))
    return F.when(valid_geometry(g), g)


def plane_offsets(frames: DataFrame, by: str = "file_index", frame: str = "frame_index", geometry: str = "geometry") -> DataFrame:
    """Frames -> planes (by, frame, offset, spacing to the next, problem) of a stack, from each file's frame 0.

    problem: first of missing_geometry, axes, shifted, shared_plane; null if the plane is usable.
    """
    w = W.partitionBy(by)
    base = F.first(F.when(F.col(frame) == 0, F.col(geometry)), ignorenulls=True).over(w.orderBy(frame).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = frames.withColumn("_base", base)
    g, b = F.col(geometry), F.col("_base")
    normal = plane_normal(b["orientation"])
    delta = subtract(g["position"], b["position"])
    offset = dot(delta, normal)
    axes = (1 - dot(row_axis(g["orientation"]), row_axis(b["orientation"])) <= ORIENTATION) & (1 - dot(column_axis(g["orientation"]), column_axis(b["orientation"])) <= ORIENTATION)
    near = F.forall(F.zip_with(g["spacing"], b["spacing"], lambda x, y: F.abs(x - y) <= y * SPACING_SHARE), lambda ok: ok)
    drift = magnitude(subtract(delta, scale(normal, offset)))
    rows = rows.withColumn("offset", offset)
    gap = F.lead("offset").over(w.orderBy("offset", frame)) - F.col("offset")
    behind = F.col("offset") - F.lag("offset").over(w.orderBy("offset", frame))
    problem = (
        F.when(g.isNull() | b.isNull() | ~valid_geometry(g), "missing_geometry")
        .when(~(axes & near), "axes")
        .when(drift > IN_PLANE, "shifted")
        .when((gap <= PLANE_DISTANCE) | (behind <= PLANE_DISTANCE), "shared_plane")
    )
    return rows.select(by, frame, "offset", gap.alias("gap"), problem.alias("problem"))


def dose_offsets(offsets: Column, frame_count: Column) -> Column:
    """Offsets from the first one; one frame without a vector lies at 0; null if their number isn't the frames'."""
    own = F.when((F.coalesce(F.size(offsets), F.lit(0)) < 1) & (frame_count == 1), F.array(F.lit(0.0))).otherwise(offsets)
    return F.when(F.size(own) == frame_count, F.transform(own, lambda o: o - own[0]))


def extent(offsets: Column) -> Column:
    """struct(low, high) that ascending offsets span: half the neighbouring spacing beyond both ends, the plane tolerance for one plane."""
    n = F.size(offsets)
    first, last = F.element_at(offsets, 1), F.element_at(offsets, -1)
    one = F.struct((first - PLANE_DISTANCE).alias("low"), (last + PLANE_DISTANCE).alias("high"))
    more = F.struct((first - (F.try_element_at(offsets, F.lit(2)) - first) / 2).alias("low"), (last + (last - F.try_element_at(offsets, F.lit(-2))) / 2).alias("high"))
    return F.when(n == 1, one).when(n > 1, more)


def bracket(offsets: Column, at: Column) -> Column:
    """struct(low, high, weight): the plane positions (from 0) that a position samples; null outside the extent.

    Beyond an end plane, and within SINGLE_PLANE of a plane by weight, that plane stands alone.
    """
    e, n = extent(offsets), F.size(offsets)
    upper = F.size(F.filter(offsets, lambda o: o <= at))
    low, high = F.try_element_at(offsets, upper), F.try_element_at(offsets, upper + 1)
    weight = (at - low) / (high - low)
    alone = lambda i: F.struct(i.cast("int").alias("low"), i.cast("int").alias("high"), F.lit(0.0).alias("weight"))
    pair = F.struct((upper - 1).cast("int").alias("low"), upper.cast("int").alias("high"), weight.alias("weight"))
    inside = F.coalesce(finite(at) & (at >= e["low"]) & (at <= e["high"]), F.lit(False))
    return (
        F.when(~inside, None)
        .when(at <= F.element_at(offsets, 1), alone(F.lit(0)))
        .when(at >= F.element_at(offsets, -1), alone(n - 1))
        .when(weight <= SINGLE_PLANE, alone(upper - 1))
        .when(weight >= 1 - SINGLE_PLANE, alone(upper))
        .otherwise(pair)
    )


def bilinear(values: Column, rows: Column, columns: Column, row: Column, column: Column) -> Column:
    """Bilinear sample of a row-major array at pixel centres; null beyond half a pixel outside or at a non-finite value."""
    top_row, top_column = (rows - 1).cast("double"), (columns - 1).cast("double")
    inside = (row >= -0.5) & (row <= top_row + 0.5) & (column >= -0.5) & (column <= top_column + 0.5)
    r, c = F.least(F.greatest(row, F.lit(0.0)), top_row), F.least(F.greatest(column, F.lit(0.0)), top_column)
    r0, c0 = F.floor(r), F.floor(c)
    r1, c1 = F.least(r0 + 1, (rows - 1).cast("bigint")), F.least(c0 + 1, (columns - 1).cast("bigint"))
    fr, fc = r - r0, c - c0
    at = lambda i, j: F.try_element_at(values, (i * columns + j + 1).cast("int"))
    top = at(r0, c0) * (1 - fc) + at(r0, c1) * fc
    bottom = at(r1, c0) * (1 - fc) + at(r1, c1) * fc
    value = top * (1 - fr) + bottom * fr
    return F.when(F.coalesce(inside & finite(value), F.lit(False)), value)


def resample(planes: np.ndarray, offsets: np.ndarray, origin, row_step, column_step, normal_origin: float, normal_step, rows: int, columns: int, parallel: bool) -> np.ndarray:
    """Trilinear samples of a displayed frame (rows x columns) from ascending planes (n, h, w); NaN outside (FN-24).

    origin, row_step, column_step: displayed pixel to plane pixel; normal_*: displayed pixel to position
    along the normal. A parallel frame has one position for all pixels.
    """
    n, h, w = planes.shape
    i, j = np.mgrid[0:rows, 0:columns].astype(float)
    r = origin[0] + i * row_step[0] + j * column_step[0]
    c = origin[1] + i * row_step[1] + j * column_step[1]
    z = np.full_like(r, normal_origin) if parallel else normal_origin + i * normal_step[0] + j * normal_step[1]
    half = (offsets[1] - offsets[0]) / 2 if n > 1 else PLANE_DISTANCE
    beyond = (offsets[-1] - offsets[-2]) / 2 if n > 1 else PLANE_DISTANCE
    inside = (r >= -0.5) & (r <= h - 0.5) & (c >= -0.5) & (c <= w - 0.5) & np.isfinite(z) & (z >= offsets[0] - half) & (z <= offsets[-1] + beyond)
    zc = np.clip(np.where(np.isfinite(z), z, offsets[0]), offsets[0], offsets[-1])
    upper = np.clip(np.searchsorted(offsets, zc, "right"), 1, max(1, n - 1))
    low, high = upper - 1, np.minimum(upper, n - 1)
    span = offsets[high] - offsets[low]
    weight = np.where(span > 0, (zc - offsets[low]) / np.where(span > 0, span, 1), 0.0)
    low = np.where(weight >= 1 - SINGLE_PLANE, high, low)
    weight = np.where((weight <= SINGLE_PLANE) | (weight >= 1 - SINGLE_PLANE), 0.0, weight)
    rc, cc = np.clip(r, 0, h - 1), np.clip(c, 0, w - 1)
    r0, c0 = np.floor(rc).astype(int), np.floor(cc).astype(int)
    r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    fr, fc = rc - r0, cc - c0

    def flat(k: np.ndarray) -> np.ndarray:
        top = planes[k, r0, c0] * (1 - fc) + planes[k, r0, c1] * fc
        bottom = planes[k, r1, c0] * (1 - fc) + planes[k, r1, c1] * fc
        return top * (1 - fr) + bottom * fr

    with np.errstate(invalid="ignore"):
        value = flat(low)
        value = np.where(weight == 0, value, value * (1 - weight) + flat(high) * weight)
    return np.where(inside & np.isfinite(value), value, np.nan)


def covers_a_pixel(offsets: np.ndarray, h: int, w: int, origin, row_step, column_step, normal_origin: float, normal_step, rows: int, columns: int) -> bool:
    """Whether some displayed pixel lies inside the volume; each row is one interval, no pixel grid is built (FN-26)."""
    n = len(offsets)
    low = offsets[0] - ((offsets[1] - offsets[0]) / 2 if n > 1 else PLANE_DISTANCE)
    high = offsets[-1] + ((offsets[-1] - offsets[-2]) / 2 if n > 1 else PLANE_DISTANCE)
    i = np.arange(rows, dtype=float)
    start, end = np.zeros(rows), np.full(rows, columns - 1.0)
    for at, slope, a, b in (
        (origin[0] + i * row_step[0], column_step[0], -0.5, h - 0.5),
        (origin[1] + i * row_step[1], column_step[1], -0.5, w - 0.5),
        (normal_origin + i * normal_step[0], normal_step[1], low, high),
    ):
        if slope == 0:
            end = np.where((at >= a) & (at <= b), end, -1.0)
        else:
            p, q = (a - at) / slope, (b - at) / slope
            start, end = np.maximum(start, np.minimum(p, q)), np.minimum(end, np.maximum(p, q))
    return bool((np.ceil(start - 1e-9) <= np.floor(end + 1e-9)).any())
