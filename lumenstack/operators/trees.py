"""Tag trees: flat rows, selection by path, paging and search (FN-63 to FN-65, FLT-10, FLT-19, CTX-21 to CTX-23, CTX-50).

A tree is flat: file_index, key (path of places, `-0:item1-2`), depth, tag, keyword, vr, type, value
(variant or text), parent key. Trees of JSON documents are flattened by a recursive SQL query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstack.functions.text import tag_steps
from lumenstack.operators.filters import page

DEPTH = 4


def preview(kind: Column, text: Column, length: Column, total: Column) -> Column:
    """What a row shows of its value: text as it is, binary by length, sequences by count."""
    more = F.when(total > length, F.concat(F.lit(" of "), total.cast("string"))).otherwise("")
    return F.when(kind == "binary", F.concat(length.cast("string"), F.lit(" bytes"))).when(kind == "sequence", F.concat(length.cast("string"), F.lit(" item(s)"), more)).otherwise(text)


def copy_text(kind: Column, text: Column, length: Column) -> Column:
    return F.when(kind == "binary", F.concat(F.lit("[binary: "), length.cast("string"), F.lit(" bytes]"))).when(kind == "sequence", F.concat(F.lit("[sequence: "), length.cast("string"), F.lit(" item(s)]"))).otherwise(text)


def matches(needle: str) -> Column:
    """The needle in `tag keyword vr preview`, without case."""
    return F.contains(F.lower(F.concat_ws(" ", "tag", "keyword", "vr", "preview")), F.lit(needle.strip().lower()))


def search_rows(rows: DataFrame, needle: str) -> DataFrame:
    """Rows that match, and the rows above them. Ancestors are found by an equi-join on the keys above each match."""
    if not needle.strip():
        return rows
    hits = rows.where(matches(needle)).select("file_index", "ancestors", "key")
    keys = hits.select("file_index", F.explode(F.concat("ancestors", F.array("key"))).alias("key")).distinct()
    return rows.join(keys, ["file_index", "key"], "left_semi")


def open_rows(rows: DataFrame, toggled: list[str]) -> DataFrame:
    """Rows whose ancestors all show their children: sequences once opened, groups unless closed."""
    is_open = F.when(F.col("type") == "sequence", (F.col("vr") != "SQ") != F.col("key").isin(toggled)).otherwise(True)
    closed = rows.where(~is_open).select("file_index", F.col("key").alias("above"))
    below = rows.select("file_index", "key", F.explode("ancestors").alias("above")).join(closed, ["file_index", "above"]).select("file_index", "key").distinct()
    return rows.join(below, ["file_index", "key"], "left_anti")


def json_rows(df: DataFrame, file: str, text: str, depth: int = DEPTH) -> DataFrame:
    """(file_index, key, ancestors, depth, tag, type, value) of JSON objects, a level at a time down to `depth`."""
    level = df.select(F.col(file).alias("file_index"), F.lit("").alias("prefix"), F.array().cast("array<string>").alias("ancestors"), F.try_parse_json(text).alias("v"))
    out = None
    for d in range(depth):
        exploded = level.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col("v").outer())).where(F.col("pos").isNotNull())
        key = F.concat("prefix", F.lit("-"), F.col("pos").cast("string"))
        kind = F.schema_of_variant("value")
        rows = exploded.select("file_index", key.alias("key"), "ancestors", F.lit(d).alias("depth"), F.coalesce("key", F.col("pos").cast("string")).alias("tag"), kind.alias("kind"), F.col("value").alias("node"))
        nested = F.startswith("kind", F.lit("OBJECT")) | F.startswith("kind", F.lit("ARRAY"))
        flat = rows.select("file_index", "key", "ancestors", "depth", "tag", F.when(nested, "sequence").when(F.col("kind") == "STRING", "string").otherwise("number").alias("type"), F.when(~nested, F.col("node").cast("string")).alias("value"))
        out = flat if out is None else out.union(flat)
        level = rows.where(nested).select("file_index", F.col("key").alias("prefix"), F.concat("ancestors", F.array("key")).alias("ancestors"), F.col("node").alias("v"))
    return out


def select_path(variant: Column, selector: str, offset: int = 0, limit: int = 64) -> Column:
    """struct(value, items, truncated, total) of the element at `(gggg,eeee)/item/(gggg,eeee)` in a tree keyed by `gggg,eeee`."""
    path = "$"
    for group, element, item in tag_steps(selector):
        path += f"['{group:04X},{element:04X}']" + (f"[{item}]" if item is not None else "")
    own = F.try_variant_get(variant, path, "variant")
    items = F.try_variant_get(variant, path, "array<variant>")
    paged = page(items, offset, min(limit, 256))
    return F.struct(own.alias("value"), paged["items"].alias("items"), paged["truncated"].alias("truncated"), paged["total"].alias("total"))


def select_node(nodes: DataFrame, tag: str, keyword: str, place: int) -> DataFrame:
    """The node `TAG.Keyword[n]` of each file's metadata: the n-th, from 0, of that tag and keyword in order (CTX-23)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("file_index").orderBy("key")
    return nodes.where((F.col("tag") == tag) & (F.col("keyword") == keyword)).withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") == place).drop("_n")
