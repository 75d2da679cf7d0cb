"""Annotation records: visibility, legends, labels, validation and list forms (FLT-11, AGG-16 to AGG-18, JOIN-20, CTX-28 to CTX-31, CTX-39 to CTX-43)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenstack.functions.shapes import box_of

LEVELS = ("patient", "study", "series", "file", "frame", "folder")
DRAWN = ("point", "line", "polyline", "polygon", "rect", "ellipse")


def visible_shapes(records: DataFrame, layers: DataFrame, classes: DataFrame, frame: Column, hidden_layers: list[str] = [], hidden_classes: list[str] = []) -> DataFrame:
    """Drawn records on a frame without hidden layers or classes, with their colour (the layer's, else the class's)."""
    shown = records.where(~F.col("layer").isin(hidden_layers) & ~F.col("class").isin(hidden_classes) & F.col("type").isin(*DRAWN))
    shown = shown.where(F.col("all_frames") | F.coalesce(F.array_contains("frames", frame), F.lit(False)))
    own = layers.select(F.col("id").alias("layer"), F.col("color").alias("_layer"))
    kinds = classes.select(F.col("id").alias("class"), F.col("color").alias("_class"), F.col("name").alias("class_name"))
    return shown.join(own, "layer", "left").join(kinds, "class", "left").withColumn("color", F.coalesce("_layer", "_class")).drop("_layer", "_class")


def class_legend(records: DataFrame, classes: DataFrame, order: str) -> DataFrame:
    """(class, name, count, not_drawn, place): classes in use, in schema order, then unknown ones by first appearance."""
    used = records.groupBy("class").agg(F.count("*").alias("count"), F.count_if(~F.col("type").isin(*DRAWN)).alias("not_drawn"), F.min(order).alias("_first"))
    known = classes.select(F.col("id").alias("class"), "name", F.col("place").alias("_place"))
    rows = used.join(known, "class", "left")
    place = F.row_number().over(W.orderBy(F.col("_place").asc_nulls_last(), "_first"))
    return rows.select("class", F.coalesce("name", "class").alias("name"), "count", "not_drawn", place.alias("place"))


def layer_entries(records: DataFrame, layers: DataFrame) -> DataFrame:
    """Every layer with the number of its records, 0 included."""
    counts = records.groupBy("layer").agg(F.count("*").alias("count"))
    return layers.join(counts, layers["id"] == counts["layer"], "left").select(layers["*"], F.coalesce("count", F.lit(0)).alias("count"))


def label_groups(labels: DataFrame, frame: int | None = None, hidden_layers: list[str] = []) -> DataFrame:
    """(level, rank, labels): visible labels by target level, broadest first; frame labels only on the frame, if given."""
    rows = labels.where(~F.col("layer").isin(hidden_layers))
    if frame is not None:
        rows = rows.where((F.col("target_kind") != "frame") | (F.col("target_frame") == frame))
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("target_kind"))
    out = rows.groupBy(F.col("target_kind").alias("level"), rank.alias("rank")).agg(F.array_sort(F.collect_list(F.struct("id", "field", "value"))).alias("labels"))
    return out.orderBy("rank")


def match_rects(records: DataFrame, rects: DataFrame) -> DataFrame:
    """records whose list index and box are those of a shown rectangle (JOIN-20)."""
    box = box_of(F.col("rect"))
    own = records.withColumns({n: box[i] for i, n in enumerate(("ymin", "xmin", "ymax", "xmax"))})
    return own.join(rects, ["index", "ymin", "xmin", "ymax", "xmax"], "left_semi")


def list_view(records: DataFrame, files: DataFrame) -> DataFrame:
    """(file_key, num_roi, roi_coords, roi_frames): live rectangles in order; no frame lists if all apply to every frame (CTX-29, CTX-30)."""
    rows = records.where(~F.col("deleted") & (F.col("type") == "rect")).join(files.select("file_key", "frame_count"), "file_key")
    every = F.when(F.col("frame_count") > 0, F.sequence(F.lit(0), F.col("frame_count") - 1)).otherwise(F.array().cast("array<int>"))
    item = F.struct("position", box_of(F.col("rect")).alias("box"), "all_frames", F.when(F.col("all_frames"), every).otherwise(F.col("frames")).alias("frames"))
    out = rows.groupBy("file_key").agg(F.array_sort(F.collect_list(item)).alias("items"))
    frames = F.when(F.forall("items", lambda i: i["all_frames"]), F.array().cast("array<array<int>>")).otherwise(F.transform("items", lambda i: i["frames"]))
    return out.select("file_key", F.size("items").alias("num_roi"), F.transform("items", lambda i: i["box"]).alias("roi_coords"), frames.alias("roi_frames"))


def rows_as_creates(rows: DataFrame, layer: str, author: str, stamp: str) -> DataFrame:
    """(file, place, op): one create operation for each box of a list, as JSON (CTX-31)."""
    flat = rows.select("file_key", "roi_frames", F.posexplode("roi_coords").alias("place", "box"))
    frames = F.when(F.coalesce(F.size("roi_frames"), F.lit(0)) > 0, F.get("roi_frames", F.col("place")))
    rect = F.struct(F.lit("rect").alias("type"), *[F.col("box")[i].cast("double").alias(n) for i, n in ((1, "x0"), (0, "y0"), (3, "x1"), (2, "y1"))])
    record = F.struct(
        F.concat_ws("-", "file_key", F.col("place").cast("string")).alias("id"),
        F.col("file_key").alias("file"),
        F.lit(layer).alias("layer"),
        F.lit("roi").alias("class"),
        rect.alias("geometry"),
        frames.alias("frames"),
        F.lit(author).alias("created_by"),
        F.lit(stamp).alias("created_at"),
    )
    return flat.select(F.col("file_key").alias("file"), "place", F.to_json(F.struct(F.lit("create_annotation").alias("type"), record.alias("annotation"))).alias("op"))


def violation(broken: Column, code: str, path: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(True)), F.struct(F.lit(code).alias("code"), F.lit(path).alias("path")))


def violations(*rules: Column, limit: int = 64) -> Column:
    """Array of (code, path) of the broken rules, at most `limit` (a bounded report)."""
    return F.slice(F.filter(F.array(*rules), lambda v: v.isNotNull()), 1, limit)


def label_violations(v: Column, f: Column) -> Column:
    """Rules of a label's value against its field (CTX-39).

    v: struct(type, text, number, flag, items); f: struct(type, options, min, max, step, integer, max_length).
    """
    number, text = v["number"], v["text"]
    want = F.when(f["type"] == "category", "text").when(f["type"] == "multi_category", "items").when(f["type"] == "boolean", "flag").otherwise(f["type"])
    typed = F.coalesce(v["type"] == want, F.lit(False))
    on = lambda kind, bad: typed & (f["type"] == kind) & F.coalesce(bad, F.lit(False))
    return violations(
        violation(~typed, "wrong_type", "/value"),
        violation(on("number", F.isnan(number) | (F.abs(number) == float("inf"))), "non_finite", "/value"),
        violation(on("number", number < f["min"]), "below_min", "/value"),
        violation(on("number", number > f["max"]), "above_max", "/value"),
        violation(on("number", f["integer"] & (number != F.floor(number))), "not_integer", "/value"),
        violation(on("text", F.octet_length(text) > f["max_length"]), "too_long", "/value"),
        violation(on("category", ~F.array_contains(f["options"], text)), "unknown_option", "/value"),
        violation(on("multi_category", F.size(F.array_except(v["items"], f["options"])) > 0), "unknown_option", "/value"),
        violation(on("multi_category", F.size(F.array_distinct(v["items"])) < F.size(v["items"])), "repeated_option", "/value"),
    )


def annotation_violations(a: Column, c: Column, size: Column) -> Column:
    """Rules of a record against its class (null if the schema lacks it) and its file's size (CTX-40)."""
    numbers = F.flatten(F.transform(a["points"], lambda p: F.array(p["x"], p["y"])))
    return violations(
        violation(c["id"].isNull(), "unknown_class", "/class"),
        violation(c["id"].isNotNull() & ~F.coalesce(F.array_contains(c["geometry"], a["type"]), F.lit(True)), "geometry_not_allowed", "/geometry"),
        violation(F.exists(numbers, lambda n: F.isnan(n) | (F.abs(n) == float("inf"))), "non_finite", "/geometry"),
        violation(F.exists(a["points"], lambda p: (p["x"] < 0) | (p["y"] < 0) | (p["x"] > size["columns"]) | (p["y"] > size["rows"])), "out_of_bounds", "/geometry"),
        violation(~a["all_frames"] & F.exists(a["frames"], lambda f: (f < 0) | (f >= size["frames"])), "frame_out_of_range", "/frames"),
        violation(~a["all_frames"] & (F.size(F.array_distinct(a["frames"])) < F.size(a["frames"])), "repeated_frame", "/frames"),
    )


def tile_violation(column: Column, row: Column, tile: int, columns: Column, rows: Column) -> Column:
    """A mask tile must start inside the image (CTX-42)."""
    return violation((column < 0) | (row < 0) | (column * tile >= columns) | (row * tile >= rows), "tile_out_of_bounds", "/tile")


def document_violations(files: DataFrame, layers: DataFrame, records: DataFrame, labels: DataFrame) -> DataFrame:
    """(code, path, id): repeated keys and records on a layer that doesn't exist (CTX-41)."""

    def repeated(df: DataFrame, key: str, path: str) -> DataFrame:
        return df.groupBy(key).count().where("count > 1").select(F.lit("duplicate_id").alias("code"), F.lit(path).alias("path"), F.col(key).cast("string").alias("id"))

    known = layers.select(F.col("id").alias("layer"))
    loose = lambda df, path: df.join(known, "layer", "left_anti").select(F.lit("unknown_layer").alias("code"), F.lit(path).alias("path"), F.col("id").cast("string").alias("id"))
    parts = [repeated(files, "key", "/files"), repeated(layers, "id", "/layers"), repeated(records, "id", "/annotations"), repeated(labels, "id", "/labels"), loose(records, "/annotations"), loose(labels, "/labels")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def patched(record: Column, patch: Column, present: dict[str, str]) -> Column:
    """record with the members that a patch names; `present` maps a member to the patch's presence flag (CTX-43)."""
    for member, flag in present.items():
        record = record.withField(member, F.when(patch[flag], patch[member]).otherwise(record[member]))
    return record


def queue_keys(op: Column) -> Column:
    """Distinct queue keys of an envelope's operations, in order of first touch (SET-2)."""
    return F.array_distinct(F.transform(op, lambda o: F.coalesce(o["file"], o["target"], o["layer"])))


def frame_set(frames: Column) -> Column:
    """Canonical frame set: ascending, without repeats (SET-3)."""
    return F.array_sort(F.array_distinct(frames))
