"""Token counts by heap-and-linked-list byte-pair merging.

A piece starts as one symbol per byte; the adjacent pair of lowest rank (leftmost on ties) is
popped from a heap and merged until no pair has a rank. The count is the number of initial
symbols minus the number of merges; identifiers are never looked up.

Pieces repeat, so each worker keeps the counts of pieces it has seen, in a table that is emptied
when it reaches a fixed number of entries: memory is bounded and results don't depend on it.

Null text counts as empty (0 bytes, 0 tokens). Null ids are kept; repeated rows are counted one
by one; an empty table gives an empty result. Only the id and text columns are read, so other
columns may have any name.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pre-tokenizer pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 400_000
LONG_TEXT = 1 << 21


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PairMerger(dict):
    """Piece -> number of tokens, filled on first use."""

    def __init__(self, spec: dict):
        super().__init__()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()

    def __missing__(self, piece: str) -> int:
        n = self.merged([self.symbols[b] for b in piece.encode("utf-8", "surrogatepass")])
        self[piece] = n
        return n

    def merged(self, symbols: list[str]) -> int:
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        left = n
        while heap:
            rank, i = heappop(heap)
            if symbols[i] is None or (j := after[i]) >= n or ranks.get((symbols[i], symbols[j])) != rank:
                continue  # one side has been merged since
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heappush(heap, (r, h))
        return left


class TokenCounter:
    """Counts the tokens of texts under a byte-level BPE vocabulary file (tokenizers' JSON format)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer or prefix space is supported")
        self.pieces = regex.compile(PATTERN)
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.counts = PairMerger(spec)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        total, count = len(parts) - 1, self.counts.__getitem__
        for part in parts:
            if len(part) < LONG_TEXT:
                total += sum(map(count, self.pieces.findall(part)))
            else:
                for m in self.pieces.finditer(part):
                    total += count(m.group())
                    if len(self.counts) > CACHE_ENTRIES:
                        self.counts.clear()
        if len(self.counts) > CACHE_ENTRIES:
            self.counts.clear()
        return total


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public vocabularies (on the worker)."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return str(public_tokenizers.path(vocabulary))


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row: one narrow pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary_path(vocabulary))
        for batch in batches:
            texts = batch.column(1)
            tokens = pa.array([counter.count(t.as_py()) for t in texts], pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, tokens, pc.greater(tokens, limit)], names=schema.names)

    return rows.mapInArrow(run, schema)
