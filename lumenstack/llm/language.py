"""Language identification by cross-parsing entropy.

For each learned language a suffix automaton is built over a bounded sample of its labelled text. A
text is parsed greedily, from left to right, into the longest phrases that occur in a language's
sample. A phrase weighs the logarithm of that sample's length, which makes counts of samples of different
lengths comparable; a letter that the sample doesn't hold weighs UNKNOWN, whatever the sample. The language
of the least weight wins; the score is the share of exp(-weight).

Texts are lower-cased, letters stand for themselves and any run of other characters for one space.
Whole texts are parsed, in blocks of BLOCK characters (a phrase doesn't cross a block's end), so that
many blocks advance together, one array operation a character.

Fit: of each language the documents of least hash, at most `documents` of them, give equal parts of
`chars` characters together (of a language with less text, all of it; repeated rows count once, rows of
null id not at all). Every letter of a sample counts: the DENSE most frequent ones by a full table of
transitions, all others by a sorted list of theirs.

Text that is null or has no letter is `und` with score 0, and so is every text if nothing was learned;
a sample without letters is left out. A tie goes to the language first in order of code. Null ids are
kept, repeated rows are judged one by one, an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS, CHARS, BLOCK = 200, 24_000, 512
DENSE = 100
LANES = 4096
UNKNOWN = float(np.log(0x110000))


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Automaton:
    """Suffix automaton of a sequence of small integers."""

    def __init__(self, sequence: Iterable[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last, nxt = [-1], [0], 0, self.next
        for c in sequence:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def table(self, rare: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """Transitions by (state, class below `rare`), and (state, class, next state) of all others.

        A transition is next state x 2, plus 1 where a new phrase begins. The last state stands for "no
        phrase is open": at the start, and after a character of no phrase, which is a phrase by itself.
        The last class, of padding, changes nothing.
        """
        none = len(self.next)
        root = self.next[0]
        out = np.empty((none + 1, classes), np.int64)
        out[:] = [root.get(c, none) * 2 + 1 for c in range(classes)]
        others = []
        for s, own in enumerate(self.next):
            for c, t in own.items():
                if c < rare:
                    out[s, c] = t * 2
                else:
                    others.append((s, c, t))
        out[:, classes - 1] = np.arange(none + 1) * 2
        return out, np.array(others, np.int64).reshape(-1, 3)


class Identifier:
    """Parses texts against the samples of all languages at once."""

    def __init__(self, samples: dict[str, str]):
        self.letter = letters()
        points = {k: code_points(s) for k, s in samples.items()}
        points = {k: p for k, p in points.items() if self.letter[p].any()}  # a sample without letters tells nothing
        self.languages = sorted(points)
        freq: Counter = Counter()
        for p in points.values():
            freq.update(p[self.letter[p]].tolist())
        self.classes = np.zeros(0x110000, np.int32)  # 0: space, 1: letter of no sample
        self.classes[self.letter] = 1
        known = [c for c, _ in sorted(freq.items(), key=lambda x: (-x[1], x[0]))]
        self.classes[known] = np.arange(2, 2 + len(known))
        self.total, self.rare = 2 + len(known), 2 + min(DENSE, len(known))
        n = self.rare + 2  # the classes of the table: `rare` stands for all rare letters, the last one for padding
        coded = [self.coded(points[k])[0] for k in self.languages]
        self.weights = np.log(np.maximum(2, [len(c) for c in coded]))
        held = np.zeros((len(coded), self.total), bool)
        for own, c in zip(held, coded):
            own[c] = True
        self.missing = (~held).astype(np.int64)
        tables = [Automaton(c.tolist()).table(self.rare, n) for c in coded]
        bases = np.cumsum([0, *(len(t) for t, _ in tables)])
        # the states of language k lie bases[k] further on, and all are counted in rows of the table
        kind = np.int32 if bases[-1] * n * 2 < 1 << 31 else np.int64
        move = lambda t, b: (((t >> 1) + b) * n * 2 + (t & 1)).astype(kind).ravel()
        self.table = np.concatenate([move(t, b) for (t, _), b in zip(tables, bases)]) if tables else np.zeros(0, kind)
        self.roots, self.starts = bases[:-1], ((bases[1:] - 1) * n).astype(kind)
        others = np.concatenate([o + [b, 0, b] for (_, o), b in zip(tables, bases)]) if tables else np.zeros((0, 3), np.int64)
        keys = others[:, 0] * self.total + others[:, 1]
        order = np.argsort(keys)
        self.keys, self.nexts, self.n = np.append(keys[order], -1), np.append(others[order, 2], -1), n

    def coded(self, points: np.ndarray) -> tuple[np.ndarray, bool]:
        """Classes of a text with one space at both ends and for each run of non-letters; whether it has a letter."""
        c = np.concatenate([[0], self.classes[points], [0]]).astype(np.int32)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        return c[keep], bool(c.any())

    def _seek(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Next states by rare letters, -1 if there is none."""
        want = states * self.total + classes
        at = np.searchsorted(self.keys[:-1], want)
        return np.where(self.keys[at] == want, self.nexts[at], -1)

    def _rare(self, state: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Transitions of lanes (languages x lanes) whose next character is a rare letter."""
        own = self._seek(state.astype(np.int64) // self.n, classes)
        first = self._seek(self.roots[:, None], classes[None, :])
        first = np.where(first >= 0, first * self.n, self.starts[:, None])
        return np.where(own >= 0, own * self.n * 2, first * 2 + 1)

    def phrases(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The number of phrases by language of each text, and that of its letters that the sample lacks; None if it has no letter."""
        blocks: list[np.ndarray] = []
        owner: list[int] = []
        out: list[tuple[np.ndarray, np.ndarray] | None] = []

        def parse() -> None:
            lanes = np.full((len(blocks), BLOCK), self.n - 1, np.int32)
            for i, b in enumerate(blocks):
                lanes[i, : len(b)] = b
            if self.total > self.rare:
                true = np.full_like(lanes, -1)
                for i, b in enumerate(blocks):
                    true[i, : len(b)] = b
                lanes[true >= self.rare] = self.rare
            steps = np.ascontiguousarray(lanes.T)
            state = np.repeat(self.starts[:, None], len(blocks), axis=1)
            found = np.zeros(state.shape, np.int32)
            for k, c in enumerate(steps):
                v = self.table.take(state + c)
                if self.total > self.rare and len(at := np.flatnonzero(c == self.rare)):
                    v[:, at] = self._rare(state[:, at], true[at, k].astype(np.int64))
                found += (v & 1).astype(np.int32)
                state = v >> 1
            for i, o in enumerate(owner):
                out[o][0][:] += found[:, i]
            blocks.clear()
            owner.clear()

        for text in texts:
            c, any_letter = self.coded(code_points(text or ""))
            if not any_letter:
                out.append(None)
                continue
            out.append((np.zeros(len(self.languages), np.int64), self.missing @ np.bincount(c, minlength=self.total)))
            for at in range(0, len(c), BLOCK):
                blocks.append(c[at : at + BLOCK])
                owner.append(len(out) - 1)
                if len(blocks) == LANES:
                    parse()
        if blocks:
            parse()
        yield from out

    def identify(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        if not self.languages:
            yield from (("und", 0.0) for _ in texts)
            return
        for both in self.phrases(texts):
            if both is None:
                yield "und", 0.0
            else:
                found, missing = both
                weight = (found - missing) * self.weights + missing * UNKNOWN
                best = int(np.argmin(weight))
                yield self.languages[best], round(float(1 / np.exp(weight[best] - weight).sum()), 6)


def learn_samples(docs: DataFrame, learn: Column, documents: int = DOCUMENTS, chars: int = CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Language -> sample text. Ids are chosen first, without texts; each document gives an equal part, cut from its middle.

    What is collected is bounded by `documents` parts, of 2 x `chars` characters together, a language.
    """
    own = docs.where(learn & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    # repeated rows share a rank
    ranked = own.withColumn("n", F.dense_rank().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))).where(F.col("n") <= documents)
    first = ranked.groupBy("lang", "id").agg(F.min("n").alias("n"))
    part = F.greatest(F.lit(chars // 100), F.ceil(F.lit(chars) / F.max("n").over(W.partitionBy("lang")))).cast("int")
    first = first.select("lang", "id", part.alias("part"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    text = F.col("text")
    cut = F.substring(text, F.greatest(F.lit(1), ((F.char_length(text) - F.col("part")) / 2).cast("int")), F.col("part"))
    found = rows.join(F.broadcast(first), ["id", "lang"]).groupBy("lang", "id").agg(F.min(cut).alias("cut")).collect()
    texts: dict[str, list] = {}
    for r in found:
        texts.setdefault(r["lang"], []).append((str(r["id"]), r["cut"] or ""))
    return {k: "\n".join(t for _, t in sorted(v))[: 4 * chars] for k, v in texts.items()}


def identify_language(docs: DataFrame, samples: dict[str, str], chars: int = CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: one narrow pass. Workers build the automata from the samples once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast({k: s[:chars] for k, s in samples.items()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = None
        for batch in batches:
            identifier = identifier or Identifier(shared.value)
            found = list(identifier.identify(t.as_py() for t in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
