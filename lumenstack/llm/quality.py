"""Quality classifier: nearest-neighbour voting in latent-semantic space.

Terms are word shapes (upper case, lower case, digits, each other character; runs collapsed), pairs of
consecutive shapes, lower-cased words, and repetition (a word equal to the one 1, 2 or 3 places before). Fit, on a sample of at most `sample` labelled rows (those of
least hash): the `terms` most frequent terms of the sample, their inverse document frequencies, and
the leading eigenvectors of the weighted term matrix; the sample's rows, projected to `rank`
dimensions, are the labelled vectors. Both are broadcast; their size is bounded by these parameters
(about 2 MB as they stand). Score, for every document over its whole text: exact cosines to all
labelled vectors in blocks, and the mean label of the `neighbours` nearest ones, weighted by a power of
similarity.

Statistics of terms are gathered where the texts are; the driver gets `terms` terms and the sample's
counts of them. Null, empty and wordless texts score the sample's mean label. Labels of null quality
are skipped, repeated labels of one id count once (the highest). Without any label every score is
0.5. Null ids are kept, repeated rows scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenstack.llm.text import word_chunks

SAMPLE, TERMS, RANK, NEIGHBOURS, POWER = 6000, 2000, 48, 25, 8
LAGS = (1, 2, 3)
SHAPE = bytes(b if b in b" \t\n\x0b\x0c\r" else 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))


def shapes(data: bytes) -> list[bytes]:
    """The shape of each word, in order."""
    codes = np.frombuffer(data.translate(SHAPE), np.uint8)
    if not len(codes):
        return []
    return codes[np.append(True, codes[1:] != codes[:-1])].tobytes().split()


def repeats(words: list[bytes]) -> list[int]:
    """How many words equal the one LAGS places before."""
    return [sum(map(eq, words, words[lag:])) for lag in LAGS]


def term_counts(text: str | None) -> Counter:
    """Counts of all terms: b's'+shape, b'p'+pair of shapes, b'w'+word, b'r'+lag of a repetition."""
    counts: Counter = Counter()
    for words in word_chunks((text or "").encode("utf-8", "surrogatepass")):
        own = shapes(b" ".join(words))
        counts.update(b"s" + s for s in own)
        counts.update(b"p" + a + b" " + b for a, b in zip(own, own[1:]))
        counts.update(b"w" + w.lower() for w in words)
        counts.update({b"r%d" % lag: n for lag, n in zip(LAGS, repeats(words)) if n})
    return counts


@dataclass
class Model:
    terms: list[bytes]
    idf: np.ndarray
    axes: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled rows x rank, of length 1
    labels: np.ndarray

    def __post_init__(self):
        number = {t: i for i, t in enumerate(self.terms)}
        self.words = {t[1:]: i for t, i in number.items() if t[:1] == b"w"}
        pairs = {tuple(t[1:].split(b" ")): i for t, i in number.items() if t[:1] == b"p"}
        known = {t[1:] for t in number if t[:1] == b"s"} | {s for p in pairs for s in p}
        self.shapes = {s: i + 1 for i, s in enumerate(sorted(known))}  # 0: any other
        self.lags = [number.get(b"r%d" % lag, len(self.terms)) for lag in LAGS]
        self.alone = np.full(len(self.shapes) + 1, len(self.terms))
        self.pairs = np.full((len(self.shapes) + 1, len(self.shapes) + 1), len(self.terms))
        for s, i in self.shapes.items():
            self.alone[i] = number.get(b"s" + s, len(self.terms))
        for (a, b), i in pairs.items():
            self.pairs[self.shapes[a], self.shapes[b]] = i

    def count(self, text: str | None) -> np.ndarray:
        """Counts of the model's terms; the same as term_counts, without its table."""
        n, out = len(self.terms), np.zeros(len(self.terms) + 1)
        for words in word_chunks((text or "").encode("utf-8", "surrogatepass")):
            joined = b" ".join(words)
            own = np.fromiter((self.shapes.get(s, 0) for s in shapes(joined)), np.int64)
            found = np.fromiter((self.words.get(w, n) for w in joined.lower().split()), np.int64)
            for ids in (self.alone[own], self.pairs[own[:-1], own[1:]], found):
                out += np.bincount(ids, minlength=n + 1)
            np.add.at(out, self.lags, repeats(words))
        return out[:n]

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = weighted(counts, self.idf) @ self.axes
        return unit(x)

    def scores(self, texts: Iterable[str | None], block: int = 256) -> Iterator[float]:
        batch: list[np.ndarray] = []
        for text in texts:
            batch.append(self.count(text))
            if len(batch) == block:
                yield from self.vote(np.array(batch))
                batch = []
        if batch:
            yield from self.vote(np.array(batch))

    def vote(self, counts: np.ndarray) -> list[float]:
        near = self.project(counts) @ self.vectors.T
        k = min(near.shape[1], NEIGHBOURS)
        best = np.argpartition(near, -k, axis=1)[:, -k:]
        weight = np.clip(np.take_along_axis(near, best, axis=1), 0, None) ** POWER
        total = weight.sum(axis=1)
        mean = (weight * self.labels[best]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.round(np.where(total > 0, mean, self.labels.mean()), 6).clip(0, 1).tolist()


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1, keepdims=True)
    return unit(np.sqrt(counts / np.where(total > 0, total, 1)) * idf)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def leading_axes(x: np.ndarray, rank: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular vectors of x by subspace iteration from a fixed start."""
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(x.shape[1], rank + 16))).astype(x.dtype)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, terms: int = TERMS, rank: int = RANK, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """The model learned from labelled rows; `learn` is a condition on the labels' id column."""
    own = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    own = own.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame([(r["id"], r["label"]) for r in chosen], own.schema)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id")

    def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by document: a term's table is as long as the document
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(list(term_counts(text.as_py())), pa.binary())], names=["term"])

    df = rows.mapInArrow(seen, "term binary").groupBy("term").agg(F.count("*").alias("n"))
    top = df.where("n > 1").orderBy(F.col("n").desc(), "term").limit(terms).collect()
    vocabulary = [bytes(r["term"]) for r in top]
    bare = Model(vocabulary, np.ones(len(vocabulary)), np.zeros((len(vocabulary), 1)), np.zeros((1, 1)), np.zeros(1))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label")):
                found = bare.count(text.as_py())
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([label_array([label.as_py()]), pa.array([at.astype(np.int32).tobytes()]), pa.array([found[at].tobytes()])], names=["label", "terms", "counts"])

    def label_array(x: list) -> pa.Array:
        return pa.array(x, pa.float64())

    # At most `sample` rows of `terms` counts, if ids are unique; repeated rows of an id count once.
    found = rows.dropDuplicates(["id"]).mapInArrow(counted, "label double, terms binary, counts binary").collect()
    found.sort(key=lambda r: (r["label"], bytes(r["terms"]), bytes(r["counts"])))
    if not found or not vocabulary:
        return None
    counts = np.zeros((len(found), len(vocabulary)), np.float32)
    for i, r in enumerate(found):
        counts[i, np.frombuffer(r["terms"], np.int32)] = np.frombuffer(r["counts"], np.float64)
    idf = np.log((1 + len(found)) / (1 + (counts > 0).sum(axis=0))) + 1
    x = weighted(counts, idf.astype(np.float32))
    axes = leading_axes(x, rank)
    return Model(vocabulary, idf, axes, unit(x @ axes), np.array([r["label"] for r in found]))


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, score) of every row, with `keep` (row, score), where `row` holds all columns of docs: one narrow pass.

    Only the text goes to Python and only the score comes back; the other columns stay in the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            yield pa.array(model.scores(t.as_py() for t in texts) if model else [0.5] * len(texts), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    score = F.arrow_udf(run, "double")(F.col(text_col).cast("string"))
    return docs.select(F.struct("*").alias("row") if keep else id_col, score.alias("score"))
