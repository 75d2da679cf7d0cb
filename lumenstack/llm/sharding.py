"""Shards of near-equal bytes by Karmarkar-Karp differencing over groups of equal texts.

A group (all rows with one text) is indivisible. Groups are dealt by hash into blocks of bounded
size; each block is partitioned by multiway differencing: of all partial partitions, the two with
the largest spread are combined, oppositely ordered, until one is left. The blocks' results are
themselves partial partitions (one sum per shard), and the driver combines those the same way. It
sees `blocks x shards` sums, of which there are at most MAX_BLOCKS x shards, never groups or rows.

Slots number the rows of a shard without gaps: rows are dealt by hash into bins, numbered inside
(bin, shard), and shifted by the count of the bins before.

Null text: no bytes, crc32 0, one group of its own. Null ids are kept; repeated rows are separate
rows of one group; an empty table gives an empty result; other columns are not read. A group larger
than a shard's fair share fills one shard alone as far as the others allow.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenstack.session import materialize

GROUPS_A_BLOCK = 20_000
MAX_BLOCKS = 65_536
ROWS_A_BIN = 100_000
#: Rows of the (block, part) -> shard table up to which it is broadcast.
BROADCAST_ROWS = 200_000


def difference(partials: Iterable[tuple[list[int], object]]) -> tuple[list[int], list]:
    """Combine partial partitions (sums, members: one of each for each part) into one; both ascending by sum."""
    heap = [(s[0] - s[-1], i, s, m) for i, (s, m) in enumerate(partials)]
    heapq.heapify(heap)
    at = len(heap)
    while len(heap) > 1:
        _, _, s1, m1 = heapq.heappop(heap)
        _, _, s2, m2 = heapq.heappop(heap)
        # the first's smallest sum meets the second's largest
        both = sorted(((a + b, i, (x, y)) for i, (a, b, x, y) in enumerate(zip(s1, reversed(s2), m1, reversed(m2)))), key=lambda t: t[:2])
        sums, members = [t[0] for t in both], [t[2] for t in both]
        heapq.heappush(heap, (sums[0] - sums[-1], at, sums, members))
        at += 1
    return (heap[0][2], heap[0][3]) if heap else ([], [])


def leaves(tree: object) -> list:
    """The items below a member: nested pairs whose leaves are items or None."""
    found, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += x
        elif x is not None:
            found.append(x)
    return found


def partition(sizes: list[int], parts: int) -> list[int]:
    """The part (0 to parts - 1) of every item by multiway differencing."""
    pad_s, pad_m = [0] * (parts - 1), [None] * (parts - 1)
    _, members = difference(([*pad_s, s], [*pad_m, i]) for i, s in enumerate(sizes))
    out = [0] * len(sizes)
    for part, tree in enumerate(members):
        for i in leaves(tree):
            out[i] = part
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(raw).alias("crc"),
        F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("key"),
    )
    rows = materialize(rows, "shard-rows")
    n = rows.count()

    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    blocks = max(1, min(MAX_BLOCKS, -(-groups.count() // GROUPS_A_BLOCK)))

    def split(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("key", "ascending")])
        part = partition(t.column("size").to_pylist(), shards)
        return t.append_column("part", pa.array(part, pa.int32()))

    dealt = groups.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    dealt = dealt.groupBy("block").applyInArrow(split, "key binary, size bigint, block int, part int")
    dealt = materialize(dealt, "shard-parts")

    sums: dict[int, list[int]] = {}
    for r in dealt.groupBy("block", "part").agg(F.sum("size").alias("size")).toLocalIterator():
        sums.setdefault(r["block"], [0] * shards)[r["part"]] = r["size"]
    partials = []
    for block, s in sorted(sums.items()):
        order = sorted(range(shards), key=lambda p: (s[p], p))
        partials.append(([s[p] for p in order], [block * shards + p for p in order]))
    _, members = difference(partials)
    where = [(x // shards, x % shards, shard) for shard, tree in enumerate(members) for x in leaves(tree)]
    to = spark.createDataFrame(where or [(0, 0, 0)], "block int, part int, shard int")
    to = F.broadcast(to) if len(where) <= BROADCAST_ROWS else to

    # A text that a third of the rows share makes one key hot in this join; adaptive execution splits it.
    placed = rows.join(dealt.join(to, ["block", "part"]).select("key", "shard"), "key")
    bins = max(1, -(-n // ROWS_A_BIN))
    placed = placed.select("id", "size", "crc", "shard", F.pmod(F.xxhash64("id", "crc", "size"), F.lit(bins)).cast("int").alias("bin"))
    placed = materialize(placed, "shard-placed")
    before = W.partitionBy("shard").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    base = placed.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    base = base.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("shard", "bin").orderBy("id", "crc", "size")
    return placed.join(base, ["shard", "bin"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("base") + F.row_number().over(inside) - 1).cast("bigint").alias("slot"),
    )
