"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Every benchmark item gives windows of n consecutive words (an item of fewer words is one window).
The windows' 64-bit hashes go to every task as one hash set; a document's windows are hashed in
place and looked up, without shuffle, and only those found are kept, with their words. Those hits
are then verified by an exact join on the window's words, which also yields the items. Spans or
documents can be removed.

All steps are DataFrame expressions. The set is inlined only if it has at most `set_limit` hashes;
of a larger benchmark, the documents' windows are matched by a join on their hashes, which carries no
words, and the hits are verified in the same way. Results are equal. Hits are summed by row, so a passage in a third of all documents has no hot key but the
window's own, which is on the broadcast side, or is split by adaptive execution.

Words: A-Z lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Null texts and items have no
words and never match. Null ids are kept; repeated rows are judged one by one; a null item id counts
as the empty string. Empty documents give an empty result, an empty benchmark no hit. Other columns
of docs are only carried along, as one struct, when asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.llm.text import LOWER, PLAIN_WORD, UPPER
from lumenstack.session import materialize

N = 10
SET_LIMIT = 50_000


def plain_words(text: Column) -> Column:
    """Array of words. `lower` is the fast way where all characters are ASCII; elsewhere only A-Z may change."""
    low = F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(PLAIN_WORD), F.lit(0)), F.array().cast("array<string>"))


def at_window(length: int) -> str:
    return ", ".join(f"w[i+{j}]" for j in range(length))


def gram_hash(length: int) -> str:
    return f"xxhash64({', '.join(f'g[{j}]' for j in range(length))})"


def positions(length: int) -> str:
    return f"if(size(w) >= {length}, sequence(0, size(w) - {length}), cast(array() as array<int>))"


def item_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(length, gram, hash, items) of every distinct window."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), plain_words(F.col(text_col).cast("string")).alias("w")).where("size(w) > 0")
    long = items.where(f"size(w) >= {n}").selectExpr("item", "w", f"explode({positions(n)}) as i", f"{n} as length")
    short = items.where(f"size(w) < {n}").selectExpr("item", "w", "0 as i", "size(w) as length")
    grams = long.union(short).selectExpr("item", "length", "slice(w, i + 1, length) as g")
    grams = grams.groupBy("length", F.array_join("g", " ").alias("gram")).agg(F.collect_set("item").alias("items"), F.first("g").alias("g"))
    return grams


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", set_limit: int = SET_LIMIT, keep: bool = False) -> DataFrame:
    """(id, n_words, n_hit, spans, items) of every row; `spans` are [start, end) word ranges of hits, merged.

    With `keep`, a struct `row` of all columns of docs.
    """
    grams = materialize(item_windows(benchmark, n, item_col, item_text_col), "decontaminate-grams")
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # at most n values
    count = grams.count()
    inline = count <= set_limit

    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), plain_words(F.col(text_col).cast("string")).alias("w"), *([F.struct("*").alias("row")] if keep else []))
    own = ["row"] if keep else []
    gram = "named_struct('at', {at}, 'length', {length}, 'gram', array_join(slice(w, {at} + 1, {length}), ' '))"
    if inline:
        found = []
        for length in lengths:
            hashes = [r[0] for r in grams.where(F.col("length") == length).selectExpr(f"{gram_hash(length)} as hash").distinct().collect()]
            hits = f"filter({positions(length)}, i -> xxhash64({at_window(length)}) in ({', '.join(map(str, hashes))}))"
            found.append(f"transform({hits}, i -> {gram.format(at='i', length=length)})")
        candidates = f"concat({', '.join(found)})" if found else "cast(array() as array<struct<at:int,length:int,gram:string>>)"
        rows = materialize(rows.selectExpr("id", "uid", "size(w) as n_words", f"{candidates} as candidates", *own), "decontaminate-rows")
        hits = rows.select("uid", F.explode("candidates").alias("c")).select("uid", "c.*")
        rows = rows.drop("candidates")
    else:
        # windows move as hashes; only those that the benchmark has are written out as words
        rows = materialize(rows.selectExpr("id", "uid", "size(w) as n_words", "w", *own), "decontaminate-rows")
        every = ", ".join(f"transform({positions(length)}, i -> named_struct('at', i, 'length', {length}, 'hash', xxhash64({at_window(length)})))" for length in lengths)
        known = reduce(DataFrame.union, [grams.where(F.col("length") == length).selectExpr("length", f"{gram_hash(length)} as hash") for length in lengths])
        windows = rows.selectExpr("uid", f"explode(concat({every})) as c").select("uid", "c.*")
        places = windows.join(known, ["length", "hash"], "left_semi").groupBy("uid").agg(F.collect_list(F.struct("at", "length")).alias("p"))
        hits = rows.select("uid", "w").join(places, "uid").selectExpr("uid", f"explode(transform(p, x -> {gram.format(at='x.at', length='x.length')})) as c").select("uid", "c.*")
        rows = rows.drop("w")

    known = grams.select("length", "gram", "items")
    hits = hits.join(F.broadcast(known) if inline else known, ["length", "gram"])
    spans = hits.groupBy("uid").agg(
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("length")).alias("end")))).alias("found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Spans are sorted by start, so the distinct words that they cover are, too; a span ends where the next word isn't covered.
    spans = spans.selectExpr("uid", "array_distinct(flatten(transform(found, x -> sequence(x.start, x.end - 1)))) as cover", "items")
    starts, ends = "filter(cover, (p, i) -> i = 0 or cover[i - 1] != p - 1)", "filter(cover, (p, i) -> i + 1 = size(cover) or cover[i + 1] != p + 1)"
    spans = spans.selectExpr("uid", f"zip_with({starts}, {ends}, (a, b) -> named_struct('start', a, 'end', b + 1)) as spans", "items")
    out = rows.join(spans, "uid", "left")
    out = out.withColumns({"spans": F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"), "spans", "items", *(["row"] if keep else []))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without any hit, with their columns."""
    return find_hits(docs, benchmark, keep=True, **options).where("n_hit = 0").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All rows of docs; in those with hits, the text is the words outside the hit spans, joined by one space."""
    found = find_hits(docs, benchmark, text_col=text_col, keep=True, **options)
    found = found.select("row", "spans", F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"), F.lit(0)).alias("w"))
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("w") - 1), hit)
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("w"), i)), " ")
    text = F.when(F.size("spans") > 0, kept).otherwise(F.col(f"row.{text_col}"))
    return found.select(F.col("row").withField(text_col, text).alias("row")).select("row.*")
