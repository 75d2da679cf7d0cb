"""Gapless numbers over a whole table without one sorting task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenstack.session import materialize


def numbered(rows: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """rows with `name`: start, start + 1, ... in the order of the columns `order`.

    Rows are dealt into ranges, sorted and numbered inside each, and shifted by the ranges before. Range
    bounds are sampled, so the ranges are written once; reading them twice could cut them differently.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    inside = materialize(ranged.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*order))), "numbered")
    sizes = inside.groupBy("_p").agg(F.max("_i").alias("_n"))
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return inside.join(base, "_p").withColumn(name, F.col("_base") + F.col("_i") + (start - 1)).drop("_p", "_i", "_base")
