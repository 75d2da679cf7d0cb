"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint has bit i set if over half of the text's shingle hashes have it set. Fingerprints link
if they differ in at most `radius` bits. Candidates come from 2^(radius+1) - 1 bit masks built so
that every pair within the radius agrees under some mask: each bit position gets a non-zero vector
of radius + 1 bits, and mask v holds the positions whose vector has an odd inner product with v. At
most `radius` differing positions leave some v orthogonal to all their vectors: no link is lost.

Only distinct fingerprints are linked, so exact copies cost nothing. They are shuffled once, by
(mask, masked bits), and sorted; a task streams over the buckets and links inside each one exactly,
emitting one edge from each fingerprint to a near one found before it, never all pairs. The 27 free
bits of a bucket allow for 2^27 fingerprints in theory; one with more than BUCKET distinct ones is split
by the same construction over its free bits, until they are too few to split: 12 bits, or 15 at radius 4.

Near-duplicates verified by their shingles (`keep_one_each`) are texts whose SimHash links put them in
one family and whose shingle sets are similar. A family is compared in blocks of about BLOCK_WORDS
words, however many texts it has, and only edges that connect are emitted.

Null and wordless texts have fingerprint zero and link like others. Null ids are kept; a component
of null ids only has a null id. Repeated rows are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenstack.llm.components import connected_components
from lumenstack.llm.substrings import ODD, mix
from lumenstack.llm.text import word_chunks
from lumenstack.session import materialize

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Words of a shingle, radius and number of fingerprints by which candidates for verified near-duplicates are found; words and Jaccard similarity that they must have.
CANDIDATES, VERIFY = (1, 4, 6), (5, 0.8)
BUCKET = 4096
#: Words of a family that one task compares, and numbers a batch on the way there.
BLOCK_WORDS, BATCH_NUMBERS = 1 << 19, 1 << 20


def shingle_hashes(text: str | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles in order, a bounded number at a time; of the whole text if it has fewer words."""
    from xxhash import xxh64_intdigest as h

    total, last = 0, []
    for words in word_chunks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = last + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            starts = list(accumulate((len(w) + 1 for w in words), initial=0))
            n = len(words) - shingle + 1
            hashes = np.fromiter((h(joined[a : b - 1], seed) for a, b in zip(starts, starts[shingle:])), np.uint64, n)
            yield from (hashes[at : at + (1 << 15)] for at in range(0, n, 1 << 15))
            total += n
        last = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not total and last:
        yield np.array([h(b" ".join(last), seed)], np.uint64)


def majority(blocks: Iterable[np.ndarray]) -> int:
    """64 bits, each set if it is set in over half the hashes."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in blocks:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        total += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def text_fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash over all shingles of the text, repeats included."""
    return majority(shingle_hashes(text, shingle, seed))


def distinct_fingerprints(text: str | None, shingle: int, prints: int, seed: int = SEED) -> tuple[int, list[int]]:
    """The number of shingles, and `prints` independent SimHashes over the distinct ones."""
    found = list(shingle_hashes(text, shingle, seed))
    own = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    steps = (np.uint64(i * int(ODD) % (1 << 64)) for i in range(1, prints))
    return sum(map(len, found)), [majority([own]), *(majority([mix(own + s)]) for s in steps)]


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """Masks over the given bit positions: any `radius` positions are all missing from at least one mask."""
    top = (1 << (radius + 1)) - 1
    vectors = {p: i % top + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p, x in vectors.items() if (x & v).bit_count() % 2) for v in range(1, top + 1)]


def spread_positions() -> list[int]:
    """The 64 bit positions in a fixed scattered order."""
    return [i * 37 % 64 for i in range(64)]


def _parts(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges (index, index) that connect each part of one bucket: every member is linked to a near one found before it."""
    order = np.argsort(fps, kind="stable")
    while len(order) > 1:
        frontier, order = order[:1], order[1:]
        while len(frontier) and len(order):
            best, parent = np.full(len(order), 65), np.zeros(len(order), np.int64)
            for at in range(0, len(frontier), 64):
                block = frontier[at : at + 64]
                far = np.bitwise_count(fps[block][:, None] ^ fps[order][None, :])
                near, least = far.argmin(axis=0), far.min(axis=0)
                closer = least < best
                best[closer], parent[closer] = least[closer], block[near[closer]]
            linked = best <= radius
            yield from zip(order[linked].tolist(), parent[linked].tolist())
            frontier, order = order[linked], order[~linked]


def link_bucket(fps: np.ndarray, mask: int, radius: int, bucket: int = BUCKET) -> Iterator[tuple[int, int]]:
    """Edges (index, index) that connect all linked fingerprints of one bucket (unsigned, equal under `mask`)."""
    if len(fps) == 2:
        if int(fps[0] ^ fps[1]).bit_count() <= radius:
            yield 1, 0
        return
    own, first, place = np.unique(fps, return_index=True, return_inverse=True)
    if len(own) < len(fps):
        # equal fingerprints are linked to the first of them, which stands for all
        copies = np.flatnonzero(first[place] != np.arange(len(fps)))
        yield from zip(copies.tolist(), first[place][copies].tolist())
        yield from ((int(first[i]), int(first[j])) for i, j in link_bucket(own, mask, radius, bucket))
        return
    free = [p for p in spread_positions() if not mask >> p & 1]
    subs = covering_masks(radius, free)
    # an empty sub-mask splits nothing off: there are fewer free positions than vectors, at most 2^len(free) fingerprints
    if len(fps) <= bucket or len(free) <= 12 or not all(subs):
        yield from _parts(fps, radius)
        return
    for sub in subs:
        keys = fps & np.uint64(sub)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                yield from ((int(part[i]), int(part[j])) for i, j in link_bucket(fps[part], mask | sub, radius, bucket))


def link_fingerprints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (i, u, v) that connect all fingerprints of one kind within the radius. nodes: distinct (i int, fp bigint); i is the kind."""
    masks = covering_masks(radius, spread_positions())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    each = F.array(*[F.col("i") * len(masks) + t for t in range(len(masks))])
    # the masked bits are computed on both sides of the shuffle and not carried through it
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(signed(m)) for m in masks]), F.col("t") % len(masks) + 1))
    rows = nodes.select(F.explode(each).alias("t"), "fp")
    rows = rows.repartition("t", key).sortWithinPartitions("t", key, "fp").select("t", key.alias("key"), "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def link(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = (np.diff(t) != 0) | (np.diff(key) != 0)
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(fp)]])
            more = np.flatnonzero(np.diff(cuts) > 1)
            found = [(a, a + i, a + j) for a, b in zip(cuts[more].tolist(), cuts[more + 1].tolist()) for i, j in link_bucket(fp[a:b].view(np.uint64), masks[t[a] % len(masks)], radius)]
            at = np.array(found, np.int64).reshape(-1, 3)
            pairs = fp[at[:, 1:]]
            return pa.RecordBatch.from_arrays([pa.array((t[at[:, 0]] // len(masks)).astype(np.int32)), pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], names=["i", "u", "v"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not batch.num_rows:
                continue
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns)]
            # the last bucket may go on in the next batch
            same = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            at = len(same) - int(same.sum())
            if at:
                yield link(*(c[:at] for c in columns))
            rest = [c[at:] for c in columns]
        if rest is not None:
            yield link(*rest)

    return rows.mapInArrow(run, "i int, u bigint, v bigint")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row; component_id is the least id reachable by links."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([texts.schema["id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((text_fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=schema.names)

    rows = materialize(texts.mapInArrow(run, schema), "simhash-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))
    nodes = materialize(rows.groupBy("fp").agg(first.alias("least")), "simhash-nodes")
    found = connected_components(link_fingerprints(nodes.select(F.lit(0).alias("i"), "fp"), radius))
    roots = materialize(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = roots.select("fp", "root").join(roots.groupBy("root").agg(F.min("least").alias("least")), "root")
    out = rows.join(least, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.id").alias("component_id"))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; of the whole text if it has fewer words."""
    found = list(shingle_hashes(text, shingle, 0))
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


def link_similar(sets: list[np.ndarray], similarity: float, group: Sequence | None = None, asks: Sequence[int] | None = None) -> Iterator[tuple[int, int]]:
    """Edges (index, index) that connect all groups with a pair of similar sets; members of a group count as connected.

    A set is compared with all others by the places of its own elements. What two groups have in common
    is seen from either, so members of the largest group needn't ask. With `asks`, just these ask, and only
    pairs with one of them count.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    ranks = np.cumsum(np.append(False, flat[1:] != flat[:-1])[: len(flat)], dtype=np.int32)
    code = np.empty(len(order), np.int32)
    code[order] = ranks
    ends = np.concatenate([[0], np.cumsum(size)])
    holder = np.repeat(np.arange(n, dtype=np.int32), size)[order]
    often = np.bincount(ranks)
    starts = np.concatenate([[0], np.cumsum(often)])

    def near(at: int) -> list[int]:
        own = code[ends[at] : ends[at + 1]]
        own = own[often[own] > 1]
        held = np.concatenate([holder[starts[c] : starts[c + 1]] for c in own.tolist()]) if len(own) else holder[:0]
        common = np.bincount(held, minlength=n)
        common[at] = size[at]
        return np.flatnonzero(common >= similarity * (size[at] + size - common) - 1e-9).tolist()

    root, weight = list(range(n)), [1] * n

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def joined(i: int, j: int) -> bool:
        i, j = find(i), find(j)
        if i == j:
            return False
        i, j = (i, j) if weight[i] >= weight[j] else (j, i)
        root[j], weight[i] = i, weight[i] + weight[j]
        return True

    first: dict = {}
    for i, g in enumerate(group if group is not None else ()):
        joined(first.setdefault(g, i), i)
    left = list(range(n) if asks is None else asks)
    largest = find(max(range(n), key=lambda i: weight[find(i)])) if n else 0
    while left:
        later = []
        for at in left:
            if weight[largest] == n:
                return
            if asks is None and find(at) == largest and weight[largest] > 1:
                later.append(at)
                continue
            for i in near(at):
                if joined(at, i):
                    yield at, i
            if weight[mine := find(at)] > weight[largest := find(largest)]:
                largest = mine
        # another group may have become the largest since
        left = [at for at in later if find(at) != find(largest)]


def similar_edges(texts: DataFrame, shingle: int, similarity: float, block: int = BLOCK_WORDS) -> DataFrame:
    """Edges (u, v) of keys that connect all pairs of texts of one family with similar shingle sets. texts: (family, blocks, words, key, text).

    A family of one block is compared at once. Of one with more, each block is compared by itself, together
    with pivots, of which there are an eighth of a block's words. Then what isn't in the family's largest
    group is compared with the whole family, one chunk with one block a task. So a family of any size never
    meets in one task, and moves in proportion to its size unless a large part of it is like nothing else.
    """

    def numbers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at, held = [], 0, 0
            for i, t in enumerate(batch.column(batch.num_columns - 1)):
                own.append(shingle_set(t.as_py(), shingle))
                held += len(own[-1])
                if held >= BATCH_NUMBERS or i == batch.num_rows - 1:
                    part = batch.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(own, pa.list_(pa.int64()))], names=[*part.schema.names[:-1], "own"])
                    own, at, held = [], i + 1, 0

    def compare(table: pa.Table) -> pa.Table:
        sets = [np.asarray(x.values) for x in table.column("own")]
        names, asks = table.column("key"), None
        group = table.column("grp").to_pylist()
        if table.column("ask").null_count == 0:
            asks = np.flatnonzero(table.column("ask").to_numpy()).tolist()
        found = np.array(list(link_similar(sets, similarity, group, asks)), np.int64).reshape(-1, 2)
        return pa.table({"u": names.take(pa.array(found[:, 0])), "v": names.take(pa.array(found[:, 1]))})

    part = F.pmod(F.xxhash64("key"), F.col("blocks"))
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("key", F.lit("pivot")), F.col("blocks") * 8) == 0)
    at = F.when(pivot, F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array(part))
    sets = texts.select("family", "blocks", "key", "text").mapInArrow(numbers, "family bigint, blocks bigint, key string, own array<bigint>")
    rows = sets.select("family", F.explode(at).alias("block"), "key", "own", F.col("key").alias("grp"), F.lit(None).cast("boolean").alias("ask"))
    edges = materialize(rows.groupBy("family", "block").applyInArrow(compare, "u string, v string"), "simhash-edges")

    large = texts.where("blocks > 1")
    names = materialize(large.select("family", "blocks", "words", "key"), "simhash-large")
    if names.isEmpty():
        return edges
    found = connected_components(edges)
    names = names.join(found, F.col("key") == F.col("node"), "left").withColumn("grp", F.coalesce("root", "key"))
    most = names.groupBy("family", "grp").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("grp", F.struct("n", "grp")).alias("most"))
    names = materialize(names.join(most, "family").select("family", "blocks", "words", "key", "grp", (F.col("grp") != F.col("most")).alias("rest")), "simhash-large")
    chunks = names.where("rest").groupBy("family").agg(F.ceil(F.sum("words") / F.lit(block)).cast("bigint").alias("chunks"))
    names = materialize(names.join(chunks, "family").select("key", "grp", "rest", "chunks"), "simhash-rest")
    sets = large.join(names, "key").select("family", "blocks", "chunks", "grp", "rest", "key", "text").mapInArrow(numbers, "family bigint, blocks bigint, chunks bigint, grp string, rest boolean, key string, own array<bigint>")
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    side = lambda chunk, block, ask: F.struct(chunk.cast("bigint").alias("chunk"), block.cast("bigint").alias("block"), F.lit(ask).alias("ask"))
    every = F.transform(upto("chunks"), lambda c: side(c, part, False))
    asked = F.transform(upto("blocks"), lambda b: side(F.pmod(F.xxhash64("key", F.lit("chunk")), F.col("chunks")), b, True))
    rows = sets.select("family", "grp", "key", "own", F.explode(F.when(F.col("rest"), F.concat(every, asked)).otherwise(every)).alias("at")).select("family", "at.*", "key", "own", "grp")
    more = rows.groupBy("family", "chunk", "block").applyInArrow(compare, "u string, v string").where("u != v")
    return edges.union(materialize(more, "simhash-edges"))


def families(nodes: DataFrame, radius: int) -> DataFrame:
    """(n, family) of the nodes (n bigint, fp array) that SimHash links connect with another: one of their fingerprints is near, or equal."""
    own = nodes.select("n", F.posexplode("fp").alias("i", "fp"))
    prints = materialize(own.groupBy("i", "fp").agg(F.min("n").alias("rep"), F.max("n").alias("last")), "simhash-prints")
    near = materialize(link_fingerprints(prints.select("i", "fp"), radius).distinct(), "simhash-near")
    rep = prints.select("i", "fp", "rep")
    links = near.join(rep.select("i", F.col("fp").alias("u"), F.col("rep").alias("a")), ["i", "u"]).join(rep.select("i", F.col("fp").alias("v"), F.col("rep").alias("b")), ["i", "v"]).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    equal = own.join(prints.where("rep < last"), ["i", "fp"]).select(F.col("n").alias("u"), F.col("rep").alias("v"))
    found = connected_components(links.union(equal))
    return found.select(F.col("node").alias("n"), F.col("root").alias("family")).union(found.select(F.col("root").alias("n"), F.col("root").alias("family")).distinct())


def keep_one_each(docs: DataFrame, shingle: int = CANDIDATES[0], radius: int = CANDIDATES[1], prints: int = CANDIDATES[2], verify: tuple[int, float] = VERIFY, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs without near-duplicates: of each group, the row of least id stays (null ids last, then by other columns).

    Texts of one family (see `families`) are grouped by all pairs of them whose sets of shingles, of
    `verify` = (words, similarity), are that similar. Equal texts, and all texts without words (null, too),
    are one group. Texts are told apart by 128-bit hashes. Any other columns are kept as they are; repeated
    rows are reduced to one; an empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.to_json(F.struct(*others)) if others else F.lit(0)).alias("other"))
    key = F.coalesce(F.md5(text.cast("binary")), F.lit(""))
    rows = docs.select(key.alias("key"), order.alias("order"), text.alias("text"))
    schema = T.StructType([rows.schema["key"], rows.schema["order"], T.StructField("words", T.LongType()), T.StructField("fp", T.ArrayType(T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct_fingerprints(t.as_py(), shingle, prints, seed) for t in batch.column(2)]
            fps = np.array([f for _, f in found], np.uint64).reshape(-1, prints).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array(list(fps), pa.list_(pa.int64()))], names=schema.names)

    nodes = rows.mapInArrow(run, schema).groupBy("key").agg(F.min("order").alias("least"), F.min("words").alias("words"), F.min("fp").alias("fp"))
    nodes = materialize(nodes.withColumn("n", F.xxhash64("key")), "simhash-nodes")
    met = materialize(nodes.select("key", "least", "words", "n").join(families(nodes, radius), "n"), "simhash-met")
    size = met.groupBy("family").agg(F.greatest(F.lit(1), F.ceil(F.sum("words") / F.lit(block))).cast("bigint").alias("blocks"))
    met = materialize(met.join(size, "family").select("key", "least", "words", "family", "blocks"), "simhash-met")

    # One row of each text, combined before the shuffle; the join needs no other.
    first = docs.select(key.alias("key"), order.alias("order"), F.struct("*").alias("row")).groupBy("key").agg(F.min_by("row", "order").alias("row"))
    texts = materialize(first.join(met.drop("least"), "key", "left"), "simhash-texts")
    own = texts.where(F.col("family").isNotNull())
    found = connected_components(similar_edges(own.select("family", "blocks", "words", "key", F.col("row")[text_col].cast("string").alias("text")), *verify, block))
    group = met.join(found, F.col("key") == F.col("node")).select("key", "least", "root")
    group = materialize(group.union(met.join(found.select("root").distinct(), F.col("key") == F.col("root")).select("key", "least", "root")), "simhash-groups")
    kept = group.groupBy("root").agg(F.min(F.struct("least", "key"))["key"].alias("kept"))
    gone = materialize(group.join(kept, "root").where("key != kept").select("key"), "simhash-gone")
    return texts.where(F.col("family").isNull()).select("row.*").union(own.join(gone, "key", "left_anti").select("row.*"))
