"""Value distributions of frames and volumes (AGG-8 to AGG-15, AGG-25, AGG-26).

Samples are long form: one row a sample. Everything is derived from the distribution, one row a distinct
value, which the partial aggregation already builds on the map side; samples are never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenstack.functions.geometry import finite
from lumenstack.functions.pixels import span_window


def distribution(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, count)."""
    return samples.groupBy(*by, value).agg(F.count("*").alias("count"))


def mapped_distribution(counts: DataFrame, by: Sequence[str], value: str, mapped: Column, padding: Column | None = None) -> DataFrame:
    """A distribution after a function of the value. Padding values are left out, unless a frame has no others."""
    rows = counts.select(*by, mapped.alias("_v"), "count", (F.lit(False) if padding is None else padding).alias("_pad"))
    rows = rows.withColumn("_real", F.sum(F.when(~F.col("_pad"), F.col("count")).otherwise(0)).over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0))))
    rows = rows.where(~F.col("_pad") | (F.col("_real") == 0))
    return rows.groupBy(*by, F.col("_v").alias(value)).agg(F.sum("count").alias("count"))


def order_statistics(counts: DataFrame, by: Sequence[str], value: str, indexes: dict[str, Column]) -> DataFrame:
    """(by, total, one column for each index): the value at an index, from 0, of all samples ascending.

    indexes are expressions over `total`; they are clamped to the last sample.
    """
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    rows = counts.withColumns({"_upto": F.sum("count").over(part.orderBy(value)), "total": F.sum("count").over(part)})
    at = {name: F.min(F.when(F.col("_upto") > F.least(i, F.col("total") - 1), F.col(value))).alias(name) for name, i in indexes.items()}
    return rows.groupBy(*by, "total").agg(*at.values())


def narrowed_statistics(samples: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], margin: float = 0.001) -> DataFrame:
    """As order_statistics, for columns of many distinct values: (by, total, one column for each share).

    The index of a share p is floor(p n) below one half and ceil(p n) above, clamped. A sketch bounds the
    value from both sides (its rank error is a tenth of `margin`, by construction); rows below the lower
    bound are only counted, and only the 2 x margin of the rows between the bounds are ranked. The result
    is exact. No task sorts a key's rows.
    """
    names = list(shares)
    asked = [x for n in names for x in (max(0.0, shares[n] - margin), min(1.0, shares[n] + margin))]
    v = F.col(value)
    bounds = samples.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("total"), F.percentile_approx(v, asked, int(10 / margin)).alias("_b"), F.min(v).alias("_min"), F.max(v).alias("_max"))
    few = F.col("total") * margin < 4  # too few rows for the margin to cover a rank
    spans = F.array(*[F.struct(F.lit(n).alias("name"), F.when(few, F.col("_min")).otherwise(F.get("_b", F.lit(2 * i))).alias("low"), F.when(few, F.col("_max")).otherwise(F.get("_b", F.lit(2 * i + 1))).alias("high"), F.least((F.floor if shares[n] < 0.5 else F.ceil)(F.col("total") * shares[n]), F.col("total") - 1).alias("index")) for i, n in enumerate(names)])
    bounds = bounds.select(*[F.col(c).alias(f"_k_{c}") for c in by], "total", spans.alias("_s"))
    on = F.lit(True)
    for c in by:
        on = on & samples[c].eqNullSafe(F.col(f"_k_{c}"))
    rows = samples.where(v.isNotNull()).select(*by, v.alias("_v")).join(bounds if by else F.broadcast(bounds), on)
    # a row counts for each share whose upper bound it doesn't pass, under its value if it is inside the bounds
    flat = rows.select(*by, "total", "_v", F.explode(F.filter("_s", lambda s: F.col("_v") <= s["high"])).alias("s"))
    inside = F.when(F.col("_v") >= F.col("s.low"), F.col("_v"))
    counts = flat.groupBy(*by, "total", F.col("s.name").alias("name"), F.col("s.index").alias("index"), inside.alias("_v")).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by, "name").orderBy(F.col("_v").asc_nulls_first())
    upto = counts.withColumn("_upto", F.sum("n").over(w)).where(F.col("_v").isNotNull() & (F.col("_upto") > F.col("index")))
    return upto.groupBy(*by, "total").agg(*[F.min(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in names])


def percentile_window(counts: DataFrame, by: Sequence[str], value: str, function: Column | None = None) -> DataFrame:
    """(by, low, high, center, width) of the 1 % and 99 % order statistics: indexes floor(.01 n) and ceil(.99 n), not interpolated."""
    at = order_statistics(counts, by, value, {"low": F.floor(F.col("total") * 0.01), "high": F.ceil(F.col("total") * 0.99)})
    w = span_window(F.col("low"), F.col("high"), function)
    return at.select(*by, "low", "high", w["center"].alias("center"), w["width"].alias("width"))


def percentile_window_of_rows(samples: DataFrame, by: Sequence[str], value: str, function: Column | None = None) -> DataFrame:
    """percentile_window for columns of many distinct values."""
    at = narrowed_statistics(samples, by, value, {"low": 0.01, "high": 0.99})
    w = span_window(F.col("low"), F.col("high"), function)
    return at.select(*by, "low", "high", w["center"].alias("center"), w["width"].alias("width"))


def full_dynamic_window(samples: DataFrame, by: Sequence[str], value: str, function: Column | None = None) -> DataFrame:
    """(by, low, high, center, width) of the least and greatest value, NaN ignored."""
    v = F.when(~F.isnan(value), F.col(value))
    at = samples.groupBy(*by).agg(F.min(v).alias("low"), F.max(v).alias("high"))
    w = span_window(F.col("low"), F.col("high"), function)
    return at.select(*by, "low", "high", w["center"].alias("center"), w["width"].alias("width"))


def value_range(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, low, high) of finite values; null if there are none."""
    v = F.when(finite(F.col(value)), F.col(value))
    return samples.groupBy(*by).agg(F.min(v).alias("low"), F.max(v).alias("high"))


def legend(ranges: DataFrame, kind: str) -> DataFrame:
    """ranges with (min, max, floor): a dose runs from 0, needs a positive maximum and is transparent at 0; others run low to high."""
    if kind == "dose":
        return ranges.where(F.col("high") > 0).withColumns({"min": F.lit(0.0), "max": F.col("high"), "floor": F.lit(0.0)})
    return ranges.where(F.col("low").isNotNull()).withColumns({"min": F.col("low"), "max": F.col("high"), "floor": F.lit(None).cast("double")})


def only_binary(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, binary): whether every sample is 0 or 1."""
    return samples.groupBy(*by).agg(F.bool_and(F.col(value).isin(0, 1)).alias("binary"))


def darkest(samples: DataFrame, by: Sequence[str], value: str, photometric: str) -> DataFrame:
    """(by, darkest): the least value, the greatest for MONOCHROME1; NaN ignored."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return samples.groupBy(*by).agg(F.when(F.first(photometric) == "MONOCHROME1", F.max(v)).otherwise(F.min(v)).alias("darkest"))
