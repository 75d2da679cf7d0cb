"""Substring deduplication by super-k-mer partitioning.

A window is `window` consecutive words of one document. Its minimiser is the least hash of the
`minimiser`-word runs inside it. Consecutive windows that share a minimiser travel together, as one
packed string (a super-k-mer), to the minimiser's bucket. All windows of equal words have the same
minimiser, so each bucket sees every occurrence of its windows: sorting them there, by hash and then
word by word, counts them exactly. A word is removed if a window that covers it occurs more than once.

Map side: the words of a batch are numbered, equal super-k-mers of a batch are merged into one with
a list of places, and each bucket gets one compressed block a batch (vocabulary, numbers, places).
Buckets hold BUCKET_BYTES of text on average, so their number grows with the input.

Hot minimisers, of a passage that a large share of the documents holds, are known from a routing
sample of documents (whole texts; it decides the route, never the result). Their super-k-mers are
salted over at least SALTS buckets, and over as many as their share of all windows fills. There, each
window that occurs once leaves one record with its place, and each that occurs more often one record
without; a second grouping, by the window's words, gets at most one record a salt of any window, however
often it occurs.

Null texts have no words. Null ids are kept; repeated rows are duplicates of each other. Documents of
fewer words than a window are kept whole. An empty table gives an empty result. Other columns are
not read. Very long texts are cut into segments that overlap by window - 1 words, which changes
nothing in the result.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenstack.llm.text import word_chunks
from lumenstack.session import materialize

WINDOW, MINIMISER = 35, 4
#: Words that are numbered together on the map side.
BATCH_WORDS = 2_000_000
SEGMENT_WORDS = 500_000
BUCKET_BYTES = 16 << 20
#: Of ROUTE_PART documents one is looked at for hot minimisers; at ROUTE_SHARE of a bucket's mean,
#: and ROUTE_FLOOR windows, a minimiser is hot.
ROUTE_PART, ROUTE_SHARE, ROUTE_FLOOR, SALTS = 64, 0.5, 64, 64
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` words from the words' hashes, by doubling: about 2 log2(length) passes."""
    power = lambda n: np.uint64(pow(int(ODD), n, 1 << 64))
    out, done, block, size = None, 0, words, 1
    n = len(words) - length + 1
    while True:
        if length & size:
            own = block[length - done - size :][:n]
            # runs are built from their end: the new block stands before what is done
            out = own.copy() if out is None else out + own * power(done)
            done += size
        if done == length:
            return mix(out)
        block = block[: len(block) - size] * power(size) + block[size:]
        size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def word_hash(words: Iterable[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64)


@dataclass
class Block:
    """Super-k-mers of one bucket: words by number, and the places (document, offset) of each."""

    vocabulary: list[bytes]
    numbers: np.ndarray  # of all super-k-mers, one after the other
    lengths: np.ndarray  # in words
    times: np.ndarray  # number of places
    docs: np.ndarray  # of each place: index into keys
    offsets: np.ndarray
    keys: np.ndarray  # 16 bytes each

    def pack(self) -> bytes:
        import zstandard

        words = b"\n".join(self.vocabulary)
        kind = np.uint16 if len(self.vocabulary) <= 1 << 16 else np.uint32
        parts = [words, self.numbers.astype(kind).tobytes(), *(x.astype(np.uint32).tobytes() for x in (self.lengths, self.times, self.docs, self.offsets)), self.keys.tobytes()]
        return struct.pack("<7I", *map(len, parts)) + zstandard.ZstdCompressor(level=3).compress(b"".join(parts))

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        import zstandard

        sizes = struct.unpack_from("<7I", data)
        raw, at, parts = zstandard.ZstdDecompressor().decompress(data[28:], max_output_size=sum(sizes)), 0, []
        for n in sizes:
            parts.append(raw[at : at + n])
            at += n
        words = parts[0].split(b"\n")
        kind = np.uint16 if len(words) <= 1 << 16 else np.uint32
        ints = [np.frombuffer(p, np.uint32).astype(np.int64) for p in parts[2:6]]
        return cls(words, np.frombuffer(parts[1], kind).astype(np.int32), *ints, np.frombuffer(parts[6], "V16"))


class Batch:
    """Documents of one batch, their words numbered."""

    def __init__(self, window: int, minimiser: int):
        self.window, self.minimiser = window, minimiser
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.segments: list[np.ndarray] = []
        self.docs: list[int] = []
        self.bases: list[int] = []
        self.keys: list[bytes] = []
        self.n = 0

    def add(self, key: bytes, text: str) -> None:
        number, parts = self.number.__getitem__, []
        for words in word_chunks(text.encode("utf-8", "surrogatepass")):
            parts.append(np.fromiter(map(number, words), np.int32, len(words)))
        ids = np.concatenate(parts) if len(parts) != 1 else parts[0]
        if len(ids) < self.window:
            return
        for at in range(0, len(ids) - self.window + 1, SEGMENT_WORDS):
            segment = ids[at : at + SEGMENT_WORDS + self.window - 1]
            self.segments.append(segment)
            self.docs.append(len(self.keys))
            self.bases.append(at)
            self.n += len(segment)
        self.keys.append(key)

    def super_kmers(self):
        """(numbers, starts, windows, minimisers, segment) of all super-k-mers, and hashes of all windows by start."""
        numbers = np.concatenate(self.segments)
        sizes = np.fromiter(map(len, self.segments), np.int64)
        firsts = np.cumsum(sizes) - sizes
        words = word_hash(self.number)[numbers]
        least = sliding_min(run_hashes(words, self.minimiser), self.window - self.minimiser + 1)
        at = ragged(firsts, sizes - self.window + 1)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])
        cuts = np.flatnonzero(new)
        starts, windows = at[cuts], np.diff(np.append(cuts, len(at)))
        return numbers, starts, windows, least[starts], np.searchsorted(firsts, starts, "right") - 1, firsts, run_hashes(words, self.window)

    def blocks(self, buckets: int, hot: np.ndarray, salts: np.ndarray, salt: int) -> Iterator[tuple[int, bool, bytes]]:
        """(bucket, salted, block) of the batch; hot minimisers (ascending) go to a bucket chosen by salt, modulo their number of salts, too."""
        if not self.segments:
            return
        numbers, starts, windows, least, segment, firsts, hashes = self.super_kmers()
        extra = self.window - 1
        docs = np.array(self.docs)[segment]
        offsets = starts - firsts[segment] + np.array(self.bases)[segment]
        # Equal super-k-mers are found by the hash of their first and last window and compared word by word.
        like = mix(hashes[starts] * ODD + hashes[starts + windows - 1] + windows.astype(np.uint64))
        salted = np.isin(least, hot)
        own = np.zeros(len(least), np.uint64)
        if len(hot):
            own[salted] = np.uint64(salt) % salts[np.searchsorted(hot, least[salted])] + np.uint64(1)
        bucket = (mix(least + own * ODD) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((like, salted, bucket))
        head = np.ones(len(order), bool)
        head[1:] = like[order[1:]] != like[order[:-1]]
        head[1:] |= (windows[order[1:]] != windows[order[:-1]]) | (bucket[order[1:]] != bucket[order[:-1]]) | (salted[order[1:]] != salted[order[:-1]])
        rest = np.flatnonzero(~head)
        if len(rest):
            lead = np.flatnonzero(head)[np.cumsum(head)[rest] - 1]
            n = windows[order[rest]] + extra
            same = numbers[ragged(starts[order[rest]], n)] == numbers[ragged(starts[order[lead]], n)]
            head[rest[~np.logical_and.reduceat(same, np.cumsum(n) - n)]] = True
        # Words are numbered anew in byte order, so that a block's vocabulary is sorted and compresses better.
        words = list(self.number)
        by_word = np.array(sorted(range(len(words)), key=words.__getitem__))
        words, keys = np.array(words, object)[by_word], np.array(self.keys, "V16")
        place = np.empty(len(words), np.int32)
        place[by_word] = np.arange(len(words), dtype=np.int32)
        numbers = place[numbers]
        mark = np.zeros(len(words), bool)
        edges = np.flatnonzero(np.diff(bucket[order] * 2 + salted[order])) + 1
        for own in np.split(np.arange(len(order)), edges):
            rows, first = order[own], head[own].copy()
            first[0] = True
            heads = rows[first]
            flat = numbers[ragged(starts[heads], windows[heads] + extra)]
            mark[flat] = True
            used = np.flatnonzero(mark)
            local = (np.cumsum(mark) - 1)[flat]
            mark[used] = False
            known, doc = np.unique(docs[rows], return_inverse=True)
            times = np.diff(np.append(np.flatnonzero(first), len(rows)))
            block = Block(words[used].tolist(), local, windows[heads] + extra, times, doc, offsets[rows], keys[known])
            yield int(bucket[rows[0]]), bool(salted[rows[0]]), block.pack()


class Bucket:
    """All super-k-mers of one bucket; finds the windows that occur more than once."""

    def __init__(self, window: int):
        self.window, self.number, self.blocks, self.hashes = window, defaultdict(count().__next__), [], []

    def add(self, data: bytes) -> None:
        """Number the block's words and hash its windows; only hashes and places are kept for the whole bucket."""
        block = Block.unpack(data)
        words = word_hash(block.vocabulary)[block.numbers]
        firsts = np.cumsum(block.lengths) - block.lengths
        self.hashes.append(run_hashes(words, self.window)[ragged(firsts, block.lengths - self.window + 1)])
        to = np.fromiter(map(self.number.__getitem__, block.vocabulary), np.int32, len(block.vocabulary))
        block.numbers, block.vocabulary = to[block.numbers], []
        self.blocks.append(block)

    def _equal(self, flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        span, out = np.arange(self.window), np.empty(len(a), bool)
        for at in range(0, len(a), 1 << 16):
            s = slice(at, at + (1 << 16))
            out[s] = (flat[a[s, None] + span] == flat[b[s, None] + span]).all(axis=1)
        return out

    def counts(self) -> tuple[np.ndarray, ...]:
        """(flat numbers, super-k-mer of each window, its position, class of equal windows, occurrences of the class)."""
        flat = np.concatenate([b.numbers for b in self.blocks])
        lengths = np.concatenate([b.lengths for b in self.blocks])
        times = np.concatenate([b.times for b in self.blocks])
        firsts = np.cumsum(lengths) - lengths
        windows = lengths - self.window + 1
        at, row = ragged(firsts, windows), np.repeat(np.arange(len(lengths)), windows)
        hashes = np.concatenate(self.hashes)
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        again = np.flatnonzero(~new)
        wrong = again[~self._equal(flat, at[order[again]], at[order[again - 1]])] if len(again) else again
        group = np.cumsum(new) - 1
        for g in np.unique(group[wrong]):  # different words under one hash: told apart by their numbers
            own, seen = np.flatnonzero(group == g), {}
            for i in own:
                group[i] = seen.setdefault(flat[at[order[i]] :][: self.window].tobytes(), g if not seen else group[-1] + len(order) + i)
        if len(wrong):
            _, group = np.unique(group, return_inverse=True)
        classes = np.empty(len(order), np.int64)
        classes[order] = group
        total = np.bincount(classes, weights=times[row]).astype(np.int64)
        return flat, row, at, classes, total

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, offset) of all places, ordered by super-k-mer; first place and number of places of each super-k-mer."""
        keys = np.concatenate([b.keys[b.docs] for b in self.blocks])
        offsets = np.concatenate([b.offsets for b in self.blocks])
        times = np.concatenate([b.times for b in self.blocks])
        return keys, offsets, np.cumsum(times) - times, times

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, start, end) of the words that repeated windows cover."""
        _, row, _, classes, total = self.counts()
        keys, offsets, first, times = self.places()
        twice = total[classes] > 1
        # runs of repeated windows in one super-k-mer
        start = np.flatnonzero(twice & np.append(True, ~twice[:-1] | (np.diff(row) != 0)))
        end = np.flatnonzero(twice & np.append(~twice[1:] | (np.diff(row) != 0), True))
        base = np.searchsorted(row, row[start])
        n = times[row[start]]
        at = ragged(first[row[start]], n)
        return keys[at], offsets[at] + np.repeat(start - base, n), offsets[at] + np.repeat(end - base + self.window, n)

    def records(self) -> Iterator[tuple[bytes, bytes | None, int]]:
        """For the second grouping of salted buckets: (words, key, offset) of each window; no key if it occurs more than once here."""
        flat, row, at, classes, total = self.counts()
        keys, offsets, first, _ = self.places()
        words = list(self.number)
        base = np.searchsorted(row, row)
        _, rep = np.unique(classes, return_index=True)
        for i in rep.tolist():
            text = b" ".join(words[j] for j in flat[at[i] : at[i] + self.window])
            place = first[row[i]]
            yield (text, None, 0) if total[classes[i]] > 1 else (text, keys[place].tobytes(), int(offsets[place] + i - base[i]))


def bucket_count(rows: DataFrame) -> int:
    """As many buckets as BUCKET_BYTES of text need, and at least one a shuffle partition."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def repeated_spans(rows: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """(key, start, end): word ranges covered by windows that occur more than once. rows: (key binary(16), text)."""
    buckets = bucket_count(rows)

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(window, minimiser)
            for key, text in zip(batch.column(0), batch.column(1)):
                if (t := text.as_py()) is not None:
                    b.add(key.as_py(), t)
            if b.segments:
                _, _, windows, least, *_ = b.super_kmers()
                found, inverse = np.unique(least, return_inverse=True)
                n = np.bincount(inverse, weights=windows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["least", "n"])

    routing = rows.where(F.pmod(F.xxhash64("key"), F.lit(ROUTE_PART)) == 0).mapInArrow(sample, "least bigint, n bigint")
    routing = routing.groupBy("least").agg(F.sum("n").alias("n"))
    # The share of one bucket: at most buckets / ROUTE_SHARE minimisers can be above it.
    routing = materialize(routing, "substring-routing")
    total = routing.agg(F.sum("n")).first()[0] or 0
    bar = max(ROUTE_FLOOR, ROUTE_SHARE * total / buckets)
    # at most 2 x buckets rows, and buckets are at least BUCKET_BYTES of text
    found = [(r["least"], r["n"]) for r in routing.where(F.col("n") >= bar).collect()]
    hot = np.array([x for x, _ in found], np.int64).view(np.uint64)
    order = np.argsort(hot)
    salts = np.array([max(SALTS, -(-n * buckets // max(1, total))) for _, n in found], np.uint64)[order]
    hot = hot[order]

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        salt = context.partitionId() if context else 0

        def emit(b: Batch) -> Iterator[pa.RecordBatch]:
            for bucket, salted, data in b.blocks(buckets, hot, salts, salt):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([salted]), pa.array([data], pa.binary())], names=["bucket", "salted", "block"])
            b.clear()

        b = Batch(window, minimiser)
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                if (t := text.as_py()) is not None:
                    b.add(key.as_py(), t)
                    if b.n >= BATCH_WORDS:
                        yield from emit(b)
        yield from emit(b)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "start", "end", "words"]
        both = {False: Bucket(window), True: Bucket(window)}
        for batch in batches:
            for salted, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                both[salted].add(data.as_py())
        for salted, bucket in both.items():
            if not bucket.blocks:
                continue
            keys, start, end = bucket.spans()
            for at in range(0, len(keys), 1 << 16):
                s = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys[s]], pa.binary()), pa.array(start[s]), pa.array(end[s]), pa.nulls(len(keys[s]), pa.binary())], names=names)
            if salted:
                part: list = []
                for words, key, offset in bucket.records():
                    part.append((key, offset, offset + window, words))
                    if len(part) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=names)
                        part = []
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=names)
            bucket.blocks, bucket.hashes = [], []

    blocks = rows.mapInArrow(split, "bucket int, salted boolean, block binary")
    found = blocks.repartitionById(buckets, "bucket").mapInArrow(find, "key binary, start bigint, end bigint, words binary")
    if not len(hot):
        return found.select("key", "start", "end")
    found = materialize(found, "substring-found")
    plain = found.where("words is null").select("key", "start", "end")
    single = found.where("words is not null").groupBy("words").agg(
        (F.count("*") - F.count("key")).alias("marks"), F.count("key").alias("n"), F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "start", "end"))).alias("at")
    )  # at most one record a salt and window
    again = single.where("n + marks > 1").select(F.explode("at").alias("s")).select("s.*")
    return plain.union(again)


def text_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """(part, block): rows (key, id, text) of each batch by the key's part, as one compressed Arrow stream each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            part = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(part, kind="stable")
            own = pa.RecordBatch.from_arrays(batch.columns[1:], names=["key", "id", "text"]).take(pa.array(order))
            edges = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a < b:
                    # a slice alone would write the whole batch's buffers
                    piece = own.slice(a, b - a)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, piece.schema) as writer:
                        writer.write_batch(piece)
                    data = pack.compress(sink.getvalue().to_pybytes())
                    yield pa.RecordBatch.from_arrays([pa.array([part[order[a]]], pa.int32()), pa.array([data], pa.binary())], names=["part", "block"])

    return rows.select(part_of("key", parts), "key", "id", "text").mapInArrow(run, "part int, block binary")


def part_of(key: str, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")


def without_spans(text: str, spans: list[tuple[int, int]], texts: bool) -> tuple:
    """(words, removed, sha256 of the kept words, kept words) of one text, a bounded number of words at a time."""
    digest, kept_words, n, removed, first = hashlib.sha256(), [], 0, 0, True
    for words in word_chunks(text.encode("utf-8", "surrogatepass")):
        kept = words
        if spans:
            keep = np.ones(len(words), bool)
            for a, b in spans:
                if b > n and a < n + len(words):
                    keep[max(0, a - n) : b - n] = False
            kept = [w for w, k in zip(words, keep.tolist()) if k]
        n += len(words)
        removed += len(words) - len(kept)
        part = b" ".join(kept)
        if part:
            digest.update(part if first else b" " + part)
            first = False
            if texts:
                kept_words.append(part)
    return n, removed, digest.hexdigest(), b" ".join(kept_words).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) of every row; `kept` is the kept words joined by one space.

    Texts and spans meet by parts of BUCKET_BYTES of text. Texts travel compressed, so the texts' shuffle
    is less than half of what it would be as rows.
    """
    text = F.col(text_col).cast("string")
    key = F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.coalesce(text, F.lit("\x00"))).cast("binary")))
    rows = docs.select(key.alias("key"), F.col(id_col).alias("id"), text.alias("text"))
    parts = bucket_count(rows)
    spans = repeated_spans(rows.select("key", "text"), window, minimiser).select(part_of("key", parts), "key", "start", "end")
    long = T.LongType()
    fields = [rows.schema["id"], T.StructField("n_words", long), T.StructField("n_removed", long), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("kept", T.StringType())] * texts)

    def run(blocks: pa.Table, spans: pa.Table) -> pa.Table:
        import zstandard

        covered: dict[bytes, list] = defaultdict(list)
        for k, a, b in zip(spans.column("key").to_pylist(), spans.column("start").to_pylist(), spans.column("end").to_pylist()):
            covered[k].append((a, b))
        unpack, out = zstandard.ZstdDecompressor(), []
        for block in blocks.column("block"):
            with pa.ipc.open_stream(unpack.decompress(block.as_py())) as stream:
                for batch in stream:
                    found = [without_spans(t.as_py() or "", sorted(set(covered.get(k.as_py(), ()))), texts) for k, t in zip(batch.column(0), batch.column(2))]
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 3 + texts]
                    out.append(pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=schema.names))
        return pa.Table.from_batches(out) if out else empty.slice(0)

    empty = pa.table({f.name: pa.array([], _arrow_type(f.dataType)) for f in schema.fields})
    found = text_blocks(rows, parts).groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(run, schema)
    return found.withColumnRenamed("id", id_col)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
