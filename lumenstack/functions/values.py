"""Real-world value maps, read-outs and colours (FN-12 to FN-16, FN-27 to FN-34, CTX-7, CTX-46 to CTX-49).

A map is struct(first, last, slope, intercept: double, lut: array<double>).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenstack.functions.geometry import finite

MAPS_A_FRAME = 16
#: The nine stops of the perceptual colour map (viridis), red, green, blue.
COLOR_STOPS = [
    (68, 1, 84),
    (71, 44, 122),
    (59, 81, 139),
    (44, 113, 142),
    (33, 144, 141),
    (39, 173, 129),
    (92, 200, 99),
    (170, 220, 50),
    (253, 231, 37),
]
#: Colours of segments without a recommended one, cycled by number.
SEGMENT_PALETTE = [(255, 79, 132), (42, 211, 199), (255, 190, 92), (136, 132, 255), (114, 218, 111), (255, 126, 92)]


def valid_map(m: Column, units: Column) -> Column:
    """First and last finite and in order, a finite linear transform or a table, and units present."""
    span = finite(m["first"]) & finite(m["last"]) & (m["first"] <= m["last"])
    linear = finite(m["slope"]) & finite(m["intercept"])
    return F.coalesce(span & (linear | (F.coalesce(F.size(m["lut"]), F.lit(0)) > 0)) & units.isNotNull(), F.lit(False))


def mapped_value(m: Column, stored: Column, integers_only: bool = False) -> Column:
    """The real-world value, or null outside the mapped range. A table's offset is rounded; the read-out form takes integers only."""
    outside = F.coalesce((stored < m["first"]) | (stored > m["last"]), F.lit(False))
    start = F.coalesce(m["first"], F.lit(0.0))
    offset = F.round(stored - start)
    entry = F.when(offset >= 0, F.try_element_at(m["lut"], (offset + 1).cast("int")))
    if integers_only:
        entry = F.when(stored == F.floor(stored), entry)
    linear = F.coalesce(m["slope"].isNotNull() & m["intercept"].isNotNull(), F.lit(False))
    value = F.when(linear, stored * m["slope"] + m["intercept"]).otherwise(entry)
    return F.when(~outside & finite(stored) if integers_only else ~outside, value)


def dose_map(scaling: Column) -> Column:
    """A dose grid's scaling as a linear map, null unless finite and positive."""
    empty = F.array().cast("array<double>")
    none = F.lit(None).cast("double")
    m = F.struct(none.alias("first"), none.alias("last"), scaling.alias("slope"), F.lit(0.0).alias("intercept"), empty.alias("lut"))
    return F.when(finite(scaling) & (scaling > 0), m)


def preferred_maps(frame_maps: Column, file_maps: Column) -> Column:
    """The frame's own list if there is one, else the file's; at most 16."""
    return F.slice(F.coalesce(frame_maps, file_maps), 1, MAPS_A_FRAME)


def read_out(value: Column) -> Column:
    """Integers below 1e9 as they are, else five significant digits; null if not finite."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e9)
    return F.when(finite(value), F.when(whole, F.format_string("%d", value.cast("bigint"))).otherwise(F.format_string("%.5g", value)))


def mapped_window(center: Column, width: Column, slope: Column, intercept: Column) -> Column:
    """A window in real-world units expressed in stored units."""
    return F.struct(((center - intercept) / slope).alias("center"), (width / F.abs(slope)).alias("width"))


def pixel_at(x: Column, y: Column, rows: Column, columns: Column) -> Column:
    """struct(row, column) under a point, null outside."""
    r, c = F.floor(y), F.floor(x)
    return F.when((r >= 0) & (c >= 0) & (r < rows) & (c < columns), F.struct(r.cast("int").alias("row"), c.cast("int").alias("column")))


def sample_index(pixel: Column, columns: Column, pixels: Column, samples: int, channel: int, planar: Column) -> Column:
    """Position of a channel's sample, from 0, in interleaved (planar 0) or planar (1) order."""
    at = pixel["row"] * columns + pixel["column"]
    return F.when(planar == 1, pixels * channel + at).otherwise(at * samples + channel)


def _palette(colors, index: Column, channel: int) -> Column:
    return F.element_at(F.array(*[F.lit(c[channel]) for c in colors]), (index + 1).cast("int"))


def colormap(position: Column) -> Column:
    """array(r, g, b) of a position in 0..1 along the stops; not finite counts as 0."""
    last = len(COLOR_STOPS) - 1
    scaled = F.when(finite(position), F.least(F.greatest(position, F.lit(0.0)), F.lit(1.0)) * last).otherwise(0.0)
    low = F.floor(scaled)
    high, share = F.least(low + 1, F.lit(last)), scaled - low
    mix = lambda k: _palette(COLOR_STOPS, low, k) + (_palette(COLOR_STOPS, high, k) - _palette(COLOR_STOPS, low, k)) * share
    return F.array(*[F.round(mix(k)).cast("int") for k in range(3)])


def color_wash(value: Column, low: Column, high: Column, floor: Column | None = None) -> Column:
    """array(r, g, b, a): transparent where not finite or at or below the floor, else opaque along low..high."""
    hidden = ~finite(value)
    if floor is not None:
        hidden = hidden | F.coalesce(value <= floor, F.lit(False))
    span = high - low
    position = F.when(span > 0, (value - low) / F.nullif(span, F.lit(0.0))).otherwise(0.0)
    return F.when(hidden, F.array(*[F.lit(0)] * 4)).otherwise(F.concat(colormap(position), F.array(F.lit(255))))


def byte(x: Column) -> Column:
    return F.least(F.greatest(F.round(x), F.lit(0.0)), F.lit(255.0)).cast("int")


def ybr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    cb, cr = cb - 128.0, cr - 128.0
    return F.array(byte(y + 1.402 * cr), byte(y - 0.344136 * cb - 0.714136 * cr), byte(y + 1.772 * cb))


def cielab_to_rgb(l: Column, a: Column, b: Column) -> Column:
    """16-bit CIELab values (D50 white) to 8-bit sRGB by the Bradford-adapted matrix."""
    fy = (l * 100.0 / 65535.0 + 16) / 116
    delta = 6.0 / 29.0
    back = lambda t: F.when(t > delta, t * t * t).otherwise(3 * delta * delta * (t - 4.0 / 29.0))
    x = 0.96422 * back(fy + (a * 255.0 / 65535.0 - 128) / 500)
    y, z = back(fy), 0.82521 * back(fy - (b * 255.0 / 65535.0 - 128) / 200)
    rows = [(3.1338561, -1.6168667, -0.4906146), (-0.9787684, 1.9161415, 0.0334540), (0.0719453, -0.2289911, 1.4052427)]
    out = []
    for p, q, r in rows:
        c = F.least(F.greatest(p * x + q * y + r * z, F.lit(0.0)), F.lit(1.0))
        out.append(byte(F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055) * 255))
    return F.array(*out)


def segment_color(number: Column, cielab: Column, gray: Column) -> Column:
    """struct(rgb, source): the recommended CIELab colour, else the recommended gray, else the palette."""
    level = F.round(gray * 255.0 / 65535.0).cast("int")
    at = F.pmod(F.greatest(number - 1, F.lit(0)), F.lit(len(SEGMENT_PALETTE)))
    own = F.array(*[_palette(SEGMENT_PALETTE, at, k) for k in range(3)])
    lab = F.coalesce(F.size(cielab) == 3, F.lit(False))
    rgb = F.when(lab, cielab_to_rgb(cielab[0], F.get(cielab, F.lit(1)), F.get(cielab, F.lit(2)))).when(gray.isNotNull(), F.array(level, level, level)).otherwise(own)
    return F.struct(rgb.alias("rgb"), F.when(lab, "recommended_cielab").when(gray.isNotNull(), "recommended_grayscale").otherwise("palette").alias("source"))


def segment_pixel(value: Column, rgb: Column, top: Column | None = None) -> Column:
    """array(r, g, b, a) of a mask sample: binary 178, fractional value x 204 / top in integers; 0 is transparent."""
    alpha = F.lit(178) if top is None else F.call_function("div", (value * 204).cast("bigint"), top.cast("bigint")).cast("int")
    return F.when(value > 0, F.concat(rgb, F.array(alpha))).otherwise(F.array(*[F.lit(0)] * 4))


def interleave(samples: Column, pixels: Column, channels: int = 3) -> Column:
    """Planar samples to interleaved order; other lengths are null."""
    at = F.transform(F.sequence(F.lit(0), pixels * channels - 1), lambda i: F.get(samples, ((i % channels) * pixels + F.floor(i / channels)).cast("int")))
    return F.when((F.size(samples) == pixels * channels) & (pixels > 0), at)


def palette_lookup(index: Column, first: Column, red: Column, green: Column, blue: Column) -> Column:
    """array(r, g, b) by index minus first, clamped at both ends; null unless the channels agree in length."""
    at = F.least(F.greatest(index - first, F.lit(0)), F.size(red) - 1)
    same = (F.size(red) == F.size(green)) & (F.size(green) == F.size(blue)) & (F.size(red) > 0)
    return F.when(same, F.array(*[F.get(c, at.cast("int")) for c in (red, green, blue)]))
