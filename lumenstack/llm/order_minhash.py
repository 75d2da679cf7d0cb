"""Document fingerprints by Order MinHash, in DataFrame expressions only.

The k-mers of a text are its runs of k consecutive words (a text of fewer words is one k-mer). A text of
over LONG_WORD characters a word, as where a script has no spaces, is cut into pieces instead, the runs of
PIECE characters that start at each character, which then stand for its words. Each
k-mer is numbered by its occurrence, and (k-mer, occurrence) is hashed; the hash's first bits choose
one of `bins` bins, the next ones its rank there. In each bin the `l` k-mers of least rank are taken,
put back into text order, and their tuple is hashed: one entry (bin, tuple hash) of the signature.
Two texts agree in a bin only if they share the minimal k-mers and their order, so likeness (equal
entries over bins that either one fills) falls with edit distance, also where only order differs.

Occurrences are numbered without explode or shuffle: (hash, position) packed in a long are sorted as
primitives, runs of equal hashes are found, and the numbers are the sequences 1..run length.

A text without words has an empty signature; two of them are alike (1.0), one and a text with words
are not (0.0). Null text counts as empty. Texts may have up to 2^26 words or pieces, more are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, L, BINS_LOG2 = 2, 2, 6
POS = 26  # bits of a position
LONG_WORD, PIECE = 32, 4
#: Bytes of text that one ordered bucket should hold.
BUCKET_BYTES = 32 << 20
SPREAD = 4
SPACES = " \t\n\x0b\x0c\r"


def with_signature(df: DataFrame, text: str, out: str, k: int = K, l: int = L, bins_log2: int = BINS_LOG2) -> DataFrame:
    """df with `out`: array<bigint>, one entry of 6 + 26 bits for each filled bin.

    Each step is a projection of its own: an array that a lambda refers to must be a column, or it
    would be computed again for every element.
    """
    if k < 2 or l < 2:
        raise ValueError("k and l must be 2 at least")
    keep = df.columns
    low, bin_shift = (1 << POS) - 1, 64 - bins_log2
    top = -(1 << bin_shift)
    pos = f"{low}L"
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    df = df.withColumns({"_w": words, "_x": trimmed})
    length = F.char_length("_x")
    unspaced = (length > LONG_WORD * F.size("_w")) & (length > PIECE)
    df = df.withColumn("_c", F.when(unspaced, F.regexp_extract_all("_x", F.lit("(?s)."), F.lit(0))))
    piece = ", ".join(f"_c[i+{j}]" for j in range(PIECE))
    df = df.selectExpr(*keep, f"if(_c is null, _w, transform(sequence(0, size(_c) - {PIECE}), i -> concat({piece}))) as _w")
    kmer = ", ".join(f"_w[i+{j}]" for j in range(k))
    packed = f"""case when size(_w) > {1 << POS} then raise_error('a text has over 2^{POS} words or pieces')
                      when size(_w) >= {k} then transform(sequence(0, size(_w) - {k}), i -> (xxhash64({kmer}) & ~{pos}) | i)
                      when size(_w) > 0 then array(xxhash64(array_join(_w, ' ')) & ~{pos})
                      else cast(array() as array<bigint>) end"""
    df = df.selectExpr(*keep, f"{packed} as _p")
    df = df.selectExpr(*keep, "sort_array(_p) as _s")
    starts = f"if(size(_s) > 0, filter(sequence(0, size(_s) - 1), j -> j = 0 or shiftright(_s[j], {POS}) != shiftright(_s[j - 1], {POS})), cast(array() as array<int>))"
    df = df.selectExpr(*keep, "_s", f"{starts} as _r")
    runs = "flatten(transform(_r, (r, j) -> sequence(1, if(j + 1 < size(_r), _r[j + 1], size(_s)) - r)))"
    df = df.selectExpr(*keep, "_s", f"if(size(_r) = size(_s), array_repeat(1, size(_s)), {runs}) as _o")
    df = df.selectExpr(*keep, f"sort_array(zip_with(_s, _o, (x, o) -> (xxhash64(shiftright(x, {POS}), o) & ~{pos}) | (x & {pos}))) as _v")
    df = df.selectExpr(*keep, f"filter(_v, (x, j) -> j < {l} or shiftright(_v[j - {l}], {bin_shift}) != shiftright(x, {bin_shift})) as _m")
    # bin, then position, then rank: text order inside a bin
    rank_bits = bin_shift - POS
    rank = (1 << rank_bits) - 1
    df = df.selectExpr(*keep, f"sort_array(transform(_m, x -> (x & {top}L) | shiftleft(x & {pos}, {rank_bits}) | (shiftright(x, {POS}) & {rank}L))) as _t")
    same = lambda d: f"j + {d} < size(_t) and shiftright(_t[j + {d}], {bin_shift}) = shiftright(_t[j], {bin_shift})"
    members = ", ".join([f"_t[j] & {rank}L", *(f"if({same(d)}, _t[j + {d}] & {rank}L, null)" for d in range(1, l))])
    first = f"filter(sequence(0, size(_t) - 1), j -> j = 0 or shiftright(_t[j - 1], {bin_shift}) != shiftright(_t[j], {bin_shift}))"
    entry = f"shiftleft(shiftrightunsigned(_t[j], {bin_shift}), 26) | shiftrightunsigned(xxhash64({members}), 38)"
    return df.selectExpr(*keep, f"if(size(_t) > 0, transform({first}, j -> {entry}), cast(array() as array<bigint>)) as {out}")


def fingerprint(signature: Column) -> Column:
    """Eight hex digits for each entry; the empty string if there is none."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 26)), F.transform(b, lambda x: F.shiftright(x, 26))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def buckets_by_id(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[tuple[int, object, int]]]:
    """docs with `bucket` (id ranges of about BUCKET_BYTES, descending) and (bucket, first id, bucket before) of each bucket.

    Cut points are approximate percentiles of the id. A row finds its bucket by the equal-width cell of
    its id, whose few cut points are looked up in a table of one row a cell.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("b"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
    # several buckets a partition, so that no partition is much larger than the others
    n = max(1, SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["b"] or 0) // BUCKET_BYTES))
    if size["lo"] is None:
        cut = docs.withColumn("bucket", F.lit(0))
    else:
        points = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("p")).first()["p"]
        points = sorted(set(points))
        width = max(1, (size["hi"] - size["lo"]) // n + 1)
        cells: list[list[int]] = [[] for _ in range(n)]
        for p in points:
            cells[(p - size["lo"]) // width].append(p)
        rows, above = [], len(points)
        for c, own in enumerate(cells):
            rows.append((c, above, own))
            above -= len(own)
        # Buckets count downwards: the highest ids are in bucket 0; nulls come last.
        table = F.broadcast(spark.createDataFrame(rows, "cell bigint, above int, cuts array<bigint>"))  # as many rows as buckets
        cell = F.floor((F.col(id_col) - F.lit(size["lo"])) / F.lit(width)).cast("bigint")
        cut = docs.withColumn("cell", cell).join(table, "cell", "left")
        below = F.size(F.filter("cuts", lambda p: p <= F.col(id_col)))
        cut = cut.withColumn("bucket", F.when(F.col(id_col).isNull(), len(points) + 1).otherwise(F.col("above") - below)).drop("cell", "above", "cuts")
    heads = sorted((r["bucket"], r["top"]) for r in cut.groupBy("bucket").agg(F.max(id_col).alias("top")).collect())
    return cut, [(b, top, heads[i - 1][0]) for i, (b, top) in enumerate(heads)]


def with_next(docs: DataFrame, id_col: str, text_col: str, signature: str) -> DataFrame:
    """docs with `next_text` and `next_signature`: of the next row by descending id, nulls last (after the last: the first).

    Each bucket gets a copy of the following bucket's first row, so one shuffle by bucket is enough.
    """
    cut, heads = buckets_by_id(docs.select(id_col, text_col), id_col, text_col)
    order = [F.col(id_col).desc_nulls_last(), F.xxhash64(text_col), F.col(text_col)]
    spark = docs.sparkSession
    rows = cut.withColumn("ghost", F.lit(False))
    if heads:
        firsts = F.broadcast(spark.createDataFrame(heads, "b int, top bigint, to int"))  # as many rows as buckets
        copies = cut.join(firsts, (F.col("bucket") == F.col("b")) & F.col(id_col).eqNullSafe(F.col("top")))
        first = copies.groupBy("to").agg(F.min_by(F.struct(id_col, text_col), F.struct(F.xxhash64(text_col), F.col(text_col))).alias("r"))
        rows = rows.unionByName(first.select(f"r.{id_col}", f"r.{text_col}", F.col("to").alias("bucket"), F.lit(True).alias("ghost")))
    rows = with_signature(rows, text_col, signature)
    w = W.partitionBy("bucket").orderBy("ghost", *order)
    rows = rows.withColumns({"next_text": F.lead(text_col).over(w), "next_signature": F.lead(signature).over(w)})
    return rows.where(~F.col("ghost")).drop("ghost", "bucket")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, signature, fingerprint) of every row: one narrow pass."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_signature(rows, "text", "signature")
    return rows.select(F.col("id").alias(id_col), F.char_length("text").cast("bigint").alias("n_chars"), "signature", fingerprint(F.col("signature")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose last half is replaced by the next one's start.

    Null ids are last in order; rows of equal id are ordered by their text; repeated rows are kept.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows, "id", "text", "signature")
    rows = rows.withColumn("n_chars", F.char_length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars") - half), F.left("next_text", half))
    rows = rows.select("id", "n_chars", "signature", "next_signature", edited.alias("edited"))
    rows = with_signature(rows, "edited", "edited_signature")
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("signature")).alias("fingerprint"),
        fingerprint(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
