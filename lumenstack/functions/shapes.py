"""Shutters, polygons, overlay bits and boxes (FN-36 to FN-38, FN-54 to FN-60, FN-77, SET-4, CTX-51).

Boxes are arrays [ymin, xmin, ymax, xmax]; points struct(x, y); polygon vertices array<array(row, column)>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenstack.functions.geometry import finite


def in_rectangle(row: Column, column: Column, left: Column, right: Column, upper: Column, lower: Column) -> Column:
    return column.between(left, right) & row.between(upper, lower)


def in_circle(row: Column, column: Column, center_row: Column, center_column: Column, radius: Column, aspect: Column) -> Column:
    """The radius counts pixels along a row, so row offsets are scaled by the pixel aspect."""
    dr, dc = (row - center_row) * aspect, (column - center_column).cast("double")
    return dr * dr + dc * dc <= radius.cast("double") * radius.cast("double")


def in_polygon(vertices: Column, row: Column, column: Column) -> Column:
    """Even-odd rule in integers; edges and vertices are inside. vertices: array<array<bigint>> of (row, column)."""
    n = F.size(vertices)
    edges = F.transform(vertices, lambda v, i: F.struct(v.alias("a"), F.get(vertices, F.pmod(i + 1, n).cast("int")).alias("b")))

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        line = (b[0] - a[0]) * (column - a[1]) - (b[1] - a[1]) * (row - a[0])
        return (line == 0) & row.between(F.least(a[0], b[0]), F.greatest(a[0], b[0])) & column.between(F.least(a[1], b[1]), F.greatest(a[1], b[1]))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        span = b[0] - a[0]
        left, right = (column - a[1]) * span, (row - a[0]) * (b[1] - a[1])
        return ((a[0] > row) != (b[0] > row)) & (((span > 0) & (left < right)) | ((span < 0) & (left > right)))

    return F.exists(edges, on) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def inside_opening(tests: list[Column]) -> Column:
    """A pixel is visible if it lies in the opening of every shape."""
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def overlay_bit(words: Column, rows: Column, columns: Column, origin_row: Column, origin_column: Column, overlay_frame: Column, image_row: Column, image_column: Column) -> Column:
    """Whether an overlay covers an image pixel (from 0): bits in 16-bit words, lowest first; origin from 1."""
    r, c = image_row - (origin_row - 1), image_column - (origin_column - 1)
    bit = overlay_frame * rows * columns + r * columns + c
    word = F.get(words, F.floor(bit / 16).cast("int"))
    inside = (r >= 0) & (r < rows) & (c >= 0) & (c < columns)
    return F.coalesce(inside & (F.call_function("bit_get", word.cast("bigint"), (bit % 16).cast("int")) == 1), F.lit(False))


def quantize(x: Column) -> Column:
    """To a thousandth, halves away from zero; zero is positive; what is not finite or too large stays."""
    scaled = x * 1000.0
    rounded = F.round(scaled) / 1000.0
    usable = finite(scaled) & (F.abs(x) < 9e15)
    return F.when(usable, F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)).otherwise(x)


def clamped(x: Column, limit: Column, snap: str = "pixel_edges") -> Column:
    """struct(value, rounded, moved): snapped to pixel edges or thousandths, then clamped to 0..limit."""
    snapped = F.round(x) if snap == "pixel_edges" else quantize(x)
    kept = F.least(F.greatest(snapped, F.lit(0.0)), limit.cast("double"))
    kept = F.when(kept == 0, F.lit(0.0)).otherwise(kept)
    ok = finite(x)
    return F.struct(F.when(ok, kept).otherwise(x).alias("value"), (ok & (snapped != x)).alias("rounded"), (ok & (kept != snapped)).alias("moved"))


def rectangle_of(box: Column) -> Column:
    return F.struct(*[box[i].cast("double").alias(n) for i, n in ((1, "x0"), (0, "y0"), (3, "x1"), (2, "y1"))])


def box_of(rect: Column) -> Column:
    """The least whole box around a rectangle, within unsigned 32 bits; NaN counts as 0."""
    edge = lambda v: F.least(F.greatest(F.when(F.isnan(v), F.lit(0.0)).otherwise(v), F.lit(0.0)), F.lit(4294967295.0)).cast("bigint")
    return F.array(edge(F.floor(rect["y0"]).cast("double")), edge(F.floor(rect["x0"]).cast("double")), edge(F.ceil(rect["y1"]).cast("double")), edge(F.ceil(rect["x1"]).cast("double")))


def canonical_box(box: Column) -> Column:
    """Corners in order."""
    return F.array(F.least(box[0], box[2]), F.least(box[1], box[3]), F.greatest(box[0], box[2]), F.greatest(box[1], box[3]))


def box_problem(box: Column, rows: Column, columns: Column) -> Column:
    """no_dimensions, empty or out_of_bounds of a canonical box; null if it can be saved."""
    return F.when((rows <= 0) | (columns <= 0), "no_dimensions").when((box[0] == box[2]) | (box[1] == box[3]), "empty").when((box[2] > rows) | (box[3] > columns), "out_of_bounds")


def bounds(points: Column) -> Column:
    """struct(x0, y0, x1, y1) of an array of points; null if empty."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def hit_test(boxes: Column, x: Column, y: Column, zoom: Column) -> Column:
    """struct(index, handle): the last-listed box with a handle near the point or the point inside its closed bounds; null if none."""
    near = F.greatest(F.lit(3.0), 8 / F.greatest(zoom, F.lit(0.2)))

    def one(box: Column, i: Column) -> Column:
        b = canonical_box(box)
        x0, x1, y0, y1 = b[1], b[3], b[0], b[2]
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        handle = F.lit(None).cast("string")
        for name, hx, hy in reversed([("nw", x0, y0), ("n", cx, y0), ("ne", x1, y0), ("e", x1, cy), ("se", x1, y1), ("s", cx, y1), ("sw", x0, y1), ("w", x0, cy)]):
            handle = F.when((F.abs(x - hx) <= near) & (F.abs(y - hy) <= near), F.lit(name)).otherwise(handle)
        inside = x.between(x0, x1) & y.between(y0, y1)
        return F.when(handle.isNotNull() | inside, F.struct(i.alias("index"), handle.alias("handle")))

    hits = F.filter(F.transform(boxes, one), lambda h: h.isNotNull())
    return F.try_element_at(hits, F.lit(-1))


def moved_box(box: Column, dx: Column, dy: Column, rows: Column, columns: Column) -> Column:
    """The box moved by whole pixels, kept inside the image."""
    h, w = box[2] - box[0], box[3] - box[1]
    half_up = lambda v: F.floor(v + 0.5)
    y = F.least(F.greatest(half_up(box[0] + dy), F.lit(0)), F.greatest(F.lit(0), rows - h))
    x = F.least(F.greatest(half_up(box[1] + dx), F.lit(0)), F.greatest(F.lit(0), columns - w))
    return F.array(y, x, y + h, x + w)


def resized_box(box: Column, handle: str, x: Column, y: Column, rows: Column, columns: Column) -> Column:
    """One or two edges moved to a point; null if nothing is left."""
    half_up = lambda v, top: F.least(F.greatest(F.floor(v + 0.5), F.lit(0)), top)
    px, py = half_up(x, columns), half_up(y, rows)
    edges = [py if "n" in handle else box[0], px if "w" in handle else box[1], py if "s" in handle else box[2], px if "e" in handle else box[3]]
    out = canonical_box(F.array(*edges))
    return F.when((out[0] < out[2]) & (out[1] < out[3]), out)


def visible_frames(roi_frames: Column, index: Column, frame: Column) -> Column:
    """An absent or empty outer list means all frames; a box's own empty list matches none."""
    return F.when(F.coalesce(F.size(roi_frames), F.lit(0)) < 1, True).otherwise(F.coalesce(F.array_contains(F.get(roi_frames, index), frame), F.lit(False)))


def frame_scope(roi_frames: Column, index: Column, scope: str, frame: Column, frame_count: Column) -> Column:
    """The frame lists with one box's set to the current frame or to every frame."""
    every = F.sequence(F.lit(0), frame_count - 1)
    return F.transform(roi_frames, lambda own, i: F.when(i == index, every if scope == "all" else F.array(frame)).otherwise(own))


def redacted(value: Column, boxes: Column, row: Column, column: Column, fill: Column) -> Column:
    """The fill value where any box (half-open) holds the pixel."""
    return F.when(F.exists(boxes, lambda b: (row >= b[0]) & (row < b[2]) & (column >= b[1]) & (column < b[3])), fill).otherwise(value)
