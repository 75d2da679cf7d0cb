"""Mixing sources to target weights by hash-threshold histograms.

Every row has a hash (60 bits of md5 over id, source and text), uniform and independent of order. Per
source, a target in words is met by taking each row `whole` times, and once more if its hash lies
under the source's threshold. Thresholds come from nested histograms: words are summed by (source,
hash bucket); the bucket in which the cumulative sum passes the budget is the boundary, and only its
rows are summed again by the next bits of the hash, until all 60 bits are used. The rows that share
the last boundary value are taken if that comes nearer to the budget. Nothing is sorted but the
histograms' buckets, which are at most 2^12 a source, then 2^16 or the boundary bucket's rows.

All steps are DataFrame operations; sums are partial before they are shuffled, so a source with a
third of all rows sends a few thousand sums. Text is read once: hash and size are written to the
shared folder, and all later steps read these 3 columns.

Null text has size 0 and is never taken. A null source is a source of its own, last in order. Null
ids are allowed; repeated rows (equal id, source and text) share one decision. An empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenstack.llm.text import SPACED_WORD
from lumenstack.session import materialize

WEIGHTS = (5, 2, 1)
#: Bits of the hash that each level of histograms adds; 60 in all.
LEVELS = (12, 16, 16, 16)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water filling.

    Budget = share x all sizes, dealt by weight; a target stops at most x its source's size and the
    excess is dealt again. With sources by size over weight, the level is the first at which no
    remaining source is above its cap, so one pass of running sums gives the fixed point. The windows
    run over the sources alone, one row each.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", "rank")
    ranked = ranked.select(
        "*",
        (F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))).alias("budget"),
        F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"),
        F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("open"),
    )
    level = F.when((F.col("budget") - F.col("capped")) / F.col("open") <= F.col("ratio"), (F.col("budget") - F.col("capped")) / F.col("open"))
    ranked = ranked.withColumn("level", F.min_by(level, F.when(level.isNotNull(), F.struct("ratio", "rank"))).over(W.partitionBy()))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level")))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, cut): a row is taken `whole` times, and once more if hash < cut."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    state = targets.withColumn("whole", whole)
    state = state.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("bigint"))
    state = materialize(state.withColumn("last", F.lit(0).cast("bigint")), "mix-level")
    used = 0
    for bits in LEVELS:
        shift = sum(LEVELS) - used - bits
        at = state.select(F.col("source").alias("s"), F.col("prefix").alias("p"), "rest")
        inside = rows.join(at, rows["source"].eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + bits) == F.col("p")))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        upto = F.sum("n").over(W.partitionBy("source").orderBy("bucket"))
        edge = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("bucket", "upto", "n"), "bucket").alias("e"))
        edge = edge.select(F.col("source").alias("s"), "e")
        state = state.join(edge, state["source"].eqNullSafe(F.col("s")), "left").select(
            "source",
            "source_size",
            "target",
            "whole",
            (F.col("rest") - F.coalesce(F.col("e.upto") - F.col("e.n"), F.lit(0))).alias("rest"),
            # without an edge (no words at all) the threshold stays at the lowest value
            F.coalesce(F.col("e.bucket"), F.shiftleft("prefix", bits)).alias("prefix"),
            F.coalesce(F.col("e.n"), F.lit(0)).cast("bigint").alias("last"),
        )
        state = materialize(state, "mix-level")
        used += bits
    cut = F.col("prefix") + F.when((F.col("last") > 0) & (F.col("rest") * 2 >= F.col("last")), 1).otherwise(0)
    return state.select("source", "source_size", "target", "whole", cut.alias("cut"))


def row_hash(docs: DataFrame, id_col: str, text_col: str, source_col: str):
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (id_col, source_col, text_col)]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 15), 16, 10).cast("bigint")


def cuts_by_source(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Thresholds of all sources from (source, hash, size) of all rows."""
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    return thresholds(rows.select("source", "hash", "size"), materialize(targets, "mix-targets")).withColumnRenamed("source", "_source")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), row_hash(docs, id_col, text_col, source_col).alias("hash"), size.alias("size"))
    return materialize(rows, "mix-rows")


def copies():
    return F.col("whole") + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0)


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of every row; taken = size x the number of copies of the row in the mix."""
    rows = _sized(docs, id_col, text_col, source_col)
    cuts = cuts_by_source(rows, weights, share, most)
    mixed = rows.join(cuts, rows["source"].eqNullSafe(F.col("_source")))
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    cuts = cuts_by_source(_sized(docs, id_col, text_col, source_col), weights, share, most)
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), row_hash(docs, id_col, text_col, source_col).alias("hash"))
    mixed = rows.join(cuts, rows["source"].eqNullSafe(F.col("_source"))).select("row", copies().cast("int").alias("n")).where("n > 0")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select("row.*")
