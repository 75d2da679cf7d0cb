"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edges; both sides of the join are shuffled by
node, and adaptive execution splits a node that holds many edges. The edges are written to the
shared folder after each round, so lineage stays short and a lost executor costs one reread. Rounds
grow with the logarithm of a component's size. The driver sees two numbers a round.

Before the first round, edges are dealt into tasks of about HELD, each of which keeps what connects: a
star for each part that it sees. A node then has at most one edge a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenstack.session import materialize

HELD = 1 << 20


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, least node of its part), of the parts that a bounded number of edges make."""
    root: dict = {}

    def find(x):
        while (r := root.setdefault(x, x)) != x:
            root[x] = x = root[r]
        return x

    def stars(kind: pa.DataType) -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(root)]
        pairs = [(x, r) for x, r in pairs if x != r]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i in (0, 1)], names=["u", "v"])

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) >= HELD:
            yield stars(kind)
    if root:
        yield stars(kind)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (u, v, of one type) that isn't the least of its component; root is the least."""
    e = materialize(edges.select("u", "v").where("u != v"), "components")
    e = e.repartition(1 + e.count() // HELD).mapInArrow(_stars, e.schema)
    e = materialize(e.distinct(), "components")
    state = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or tuple(now) == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(now)
        e = materialize(_small_star(_large_star(e)), "components")
