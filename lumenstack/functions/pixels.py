"""Sample values: modality transform, intensity windows, lookup tables, padding (FN-1 to FN-11, FN-35, FLT-13).

Everything is a Column built from built-in functions. A lookup table is a struct column or literal
(first: int, bits: int, entries: array<int>). A window is struct(center, width: double).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LINEAR, EXACT = "linear", "exact"


def lut_literal(first: int, bits: int, entries: Sequence[int]) -> Column:
    return F.struct(F.lit(first).alias("first"), F.lit(bits).alias("bits"), F.array(*[F.lit(int(e)) for e in entries]).alias("entries"))


def has_entries(lut: Column) -> Column:
    return F.coalesce(F.size(lut["entries"]) > 0, F.lit(False))


def lut_entry(lut: Column, value: Column) -> Column:
    """The entry for a value: truncated toward zero, clamped to the table's ends."""
    at = value.cast("bigint") - lut["first"].cast("bigint")
    at = F.least(F.greatest(at, F.lit(0)), F.size(lut["entries"]).cast("bigint") - 1)
    return F.try_element_at(lut["entries"], (at + 1).cast("int"))


def modality_value(stored: Column, slope: Column, intercept: Column, lut: Column | None = None) -> Column:
    """The modality table if it has entries, else slope x stored + intercept."""
    linear = stored.cast("double") * slope + intercept
    return linear if lut is None else F.when(has_entries(lut), lut_entry(lut, stored).cast("double")).otherwise(linear)


def window_function(float_samples: Column, has_lut: Column, slope: Column, intercept: Column) -> Column:
    """exact for float samples or a fractional rescale without table, else linear."""
    fractional = (slope != F.floor(slope)) | (intercept != F.floor(intercept))
    return F.when(float_samples | (~has_lut & fractional), EXACT).otherwise(LINEAR)


def linear_byte(sample: Column, center: Column, width: Column) -> Column:
    """The linear function: half-unit bounds around center - 0.5, width 1 as threshold, halves rounded away from zero."""
    width = F.greatest(width.cast("double"), F.lit(1.0))
    low, high = center - 0.5 - (width - 1) / 2, center - 0.5 + (width - 1) / 2
    inside = F.round(((sample - (center - 0.5)) / F.nullif(width - 1, F.lit(0.0)) + 0.5) * 255)
    return F.when(sample <= low, 0).when((sample > high) | (width == 1), 255).otherwise(inside.cast("int"))


def exact_byte(sample: Column, center: Column, width: Column) -> Column:
    """The continuous function: clamp((x - (c - w/2)) / w, 0, 1) x 255."""
    share = (sample - (center - width / 2)) / width
    return F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def window_byte(function: Column, sample: Column, center: Column, width: Column) -> Column:
    return F.when(function == EXACT, exact_byte(sample, center, width)).otherwise(linear_byte(sample, center, width))


def applied_width(function: Column, width: Column) -> Column:
    return F.when(function == EXACT, width).otherwise(F.greatest(width, F.lit(1.0)))


def voi_lut_byte(lut: Column, value: Column) -> Column:
    """A presentation table's entry scaled to 8 bits in integers: (out x 255 + max / 2) / max."""
    top = F.expr("1L").cast("bigint") * 0 + F.when(lut["bits"] == 16, 65535).otherwise(F.pow(F.lit(2), lut["bits"]).cast("bigint") - 1)
    return F.call_function("div", lut_entry(lut, value).cast("bigint") * 255 + F.call_function("div", top, F.lit(2).cast("bigint")), top).cast("int")


def voi_lut_selected(mode: Column, wc: Column, ww: Column, stored_window: Column, lut: Column) -> Column:
    """A presentation table replaces the window only in default mode, with neither a requested nor a stored window, at 8 or 16 bits."""
    free = (mode == "default") & wc.isNull() & ww.isNull() & stored_window.isNull()
    return free & has_entries(lut) & F.coalesce(lut["bits"].isin(8, 16), F.lit(False))


def span_window(low: Column, high: Column, function: Column | None = None) -> Column:
    """Centre and width of a span: at least 1 wide for linear, 1 for an empty span for exact."""
    span = high - low
    width = F.greatest(span, F.lit(1.0))
    if function is not None:
        width = F.when(function == EXACT, F.when(span > 0, span).otherwise(1.0)).otherwise(width)
    return F.struct((low + width / 2).alias("center"), width.alias("width"))


def resolve_window(mode: Column, wc: Column, ww: Column, stored: Column, percentile: Column, full: Column) -> Column:
    """full_dynamic: the full range. default: both requested values, else the stored window, else percentiles."""
    asked = F.when(wc.isNotNull() & ww.isNotNull(), F.struct(wc.cast("double").alias("center"), ww.cast("double").alias("width")))
    return F.when(mode == "full_dynamic", full).otherwise(F.coalesce(asked, stored, percentile))


def is_padding(stored: Column, value: Column, limit: Column | None = None) -> Column:
    """In the closed padding range, whose bounds may come in either order; no range, no padding."""
    other = value if limit is None else F.coalesce(limit, value)
    return F.coalesce(stored.between(F.least(value, other), F.greatest(value, other)), F.lit(False))


def finish_byte(byte: Column, photometric: Column, padding: Column) -> Column:
    """MONOCHROME1 is inverted, then padding is black whatever the photometric interpretation."""
    return F.when(padding, 0).when(photometric == "MONOCHROME1", 255 - byte).otherwise(byte)


def p_value_byte(value: Column) -> Column:
    """A 16-bit presentation value to 8 bits: (v x 255 + 32767) / 65535 in integers."""
    return F.call_function("div", value.cast("bigint") * 255 + 32767, F.lit(65535).cast("bigint")).cast("int")


def stored_value(bits: Column, allocated: int, stored_bits: int, high_bit: int, signed: bool) -> Column:
    """Stored bits of a container: shifted by the low bit, masked, sign-extended (FN-39)."""
    low = high_bit + 1 - stored_bits
    value = F.shiftright(bits.cast("bigint").bitwiseAND(F.lit((1 << allocated) - 1)), low).bitwiseAND(F.lit((1 << stored_bits) - 1))
    return F.when(value >= F.lit(1 << (stored_bits - 1)), value - F.lit(1 << stored_bits)).otherwise(value) if signed else value
