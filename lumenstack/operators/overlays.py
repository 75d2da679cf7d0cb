"""Overlays and contexts of derived objects (JOIN-7, JOIN-8, JOIN-10, JOIN-11, JOIN-16, JOIN-17, CTX-1 to CTX-6, CTX-12 to CTX-20).

Frames are rows (file_index, frame_index, sop_instance_uid, frame_of_reference_uid, geometry). Every
pairing of frames is an equi-join (on declared identifiers or the frame of reference) with the geometry
test as its residual.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenstack.functions.geometry import coplanar_transform, covers_a_pixel, grids_overlap, let, resample
from lumenstack.functions.values import color_wash, mapped_value, valid_map

OVERLAY_FRAMES = 4096
#: Context of each object kind.
CONTEXTS = {"segmentation": "segmentation", "parametric_map": "parametric_map", "presentation_state": "presentation_state", "whole_slide_microscopy": "whole_slide"}


def context_kind(object_kind: Column, is_dose: Column) -> Column:
    """The context that an object has, else not_applicable."""
    out = F.when(is_dose, "dose")
    for kind, context in CONTEXTS.items():
        out = out.when(object_kind == kind, context)
    return out.otherwise("not_applicable")


def compatible(segment: Column, source: Column, segment_ref: Column, source_ref: Column) -> Column:
    """One frame of reference, coplanar grids that overlap."""
    same = (segment_ref != "") & (segment_ref == source_ref)
    fits = let(coplanar_transform(segment, source), lambda t: t.isNotNull() & grids_overlap(segment, source, t))
    return F.coalesce(same & fits, F.lit(False))


def segment_sources(segments: DataFrame, declared: DataFrame, frames: DataFrame) -> DataFrame:
    """(file_index, frame_index, method, status, sources): mapping of segmentation frames to local source frames.

    segments: file_index, frame_index, geometry, frame_of_reference_uid. declared: file_index, frame_index
    (null for the object's own list), sop_instance_uid, frame_numbers. A frame with declarations of its own
    is mapped by them, and a lone candidate frame is taken even if its geometry disagrees; other frames are
    mapped by geometry to the frames of the object's declared sources.
    """
    f = frames.select(*[F.col(c).alias(f"s_{c}") for c in ("file_index", "frame_index", "sop_instance_uid", "frame_of_reference_uid", "geometry")])
    own = declared.where(F.col("frame_index").isNotNull())
    explicit = segments.join(own.select("file_index", "frame_index").distinct().withColumn("_own", F.lit(True)), ["file_index", "frame_index"], "left")
    ok = compatible(F.col("geometry"), F.col("s_geometry"), F.col("frame_of_reference_uid"), F.col("s_frame_of_reference_uid"))
    listed = (F.size("frame_numbers") == 0) | F.array_contains(F.transform("frame_numbers", lambda n: n - 1), F.col("s_frame_index"))
    a = explicit.where("_own").join(own, ["file_index", "frame_index"]).join(f, (F.col("sop_instance_uid") == F.col("s_sop_instance_uid")) & listed).withColumn("_ok", ok)
    part = W.partitionBy("file_index", "frame_index", "sop_instance_uid", "s_file_index")
    a = a.withColumns({"_any": F.max(F.col("_ok").cast("int")).over(part), "_n": F.count("*").over(part)}).where(F.col("_ok") | ((F.col("_any") == 0) & (F.col("_n") == 1)))
    tops = declared.where(F.col("frame_index").isNull()).select("file_index", "sop_instance_uid").distinct()
    b = explicit.where("_own is null").join(tops, "file_index").join(f, F.col("sop_instance_uid") == F.col("s_sop_instance_uid")).where(ok)
    cols = ["file_index", "frame_index", F.struct(F.col("s_file_index").alias("file_index"), F.col("s_frame_index").alias("frame_index")).alias("s")]
    found = a.select(*cols).union(b.select(*cols)).groupBy("file_index", "frame_index").agg(F.array_sort(F.collect_set("s")).alias("sources"))
    with_top = tops.select("file_index").distinct().withColumn("_top", F.lit(True))
    out = explicit.join(found, ["file_index", "frame_index"], "left").join(with_top, "file_index", "left")
    n = F.coalesce(F.size("sources"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    method = F.when(F.col("_own"), "explicit_derivation").when(F.col("_top"), "declared_source_geometry")
    status = F.when(n == 0, "missing").when(n == 1, "resolved").otherwise("ambiguous")
    return out.select("file_index", "frame_index", method.alias("method"), status.alias("status"), F.coalesce("sources", F.expr("cast(array() as array<struct<file_index:int,frame_index:int>>)")).alias("sources"))


def segmentation_eligibility(mappings: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_index, eligible, reason, source_file_index): the first rule that fails, over all frames (CTX-3).

    mappings: as segment_sources with segment_declared and geometry_ok; files: file_index, frame_count;
    edges: file_index, source (file index of resolved source references).
    """
    first = F.get("sources", F.lit(0))["file_index"]
    rows = mappings.withColumn("_s", first).join(edges.select("file_index", F.col("source").alias("_s")).distinct().withColumn("_closed", F.lit(True)), ["file_index", "_s"], "left")
    out = rows.groupBy("file_index").agg(
        F.bool_and(F.coalesce("segment_declared", F.lit(False))).alias("declared"),
        F.count("*").alias("n"),
        F.bool_and((F.col("status") == "resolved") & (F.size("sources") == 1)).alias("unique"),
        F.bool_and(F.coalesce("geometry_ok", F.lit(False))).alias("geometry"),
        F.bool_and(F.coalesce("_closed", F.lit(False))).alias("closed"),
        F.countDistinct("_s").alias("sources"),
        F.min("_s").alias("source"),
    )
    out = files.select("file_index", "frame_count").join(out, "file_index", "left")
    reason = (
        F.when(F.coalesce(~F.col("declared"), F.lit(False)), "undeclared_segment")
        .when(F.coalesce(F.col("n"), F.lit(0)) != F.col("frame_count"), "incomplete_mapping")
        .when(~F.col("unique"), "not_unique")
        .when(~F.col("geometry"), "incompatible_geometry")
        .when(~F.col("closed"), "not_closed_by_reference")
    )
    return out.select("file_index", reason.isNull().alias("eligible"), reason.alias("reason"), F.when(reason.isNull() & (F.col("sources") == 1), F.col("source")).alias("source_file_index"))


def covered_frames(volumes: DataFrame, frames: DataFrame, declared: DataFrame, limit: int = OVERLAY_FRAMES) -> tuple[DataFrame, DataFrame]:
    """Image frames that each volume covers (at most `limit`, in order), and (volume, frames, files, source) of the volume.

    volumes: volume, frame_of_reference_uid, sop_class_uid, base (geometry), offsets (ascending). The frame
    of reference is the join key; the coverage test is an Arrow function over the pairs.
    declared: volume, file_index of resolved source images.
    """
    other = frames.where("has_pixels")
    pairs = volumes.withColumnRenamed("sop_class_uid", "v_class").where("frame_of_reference_uid <> ''").join(other, "frame_of_reference_uid").where((F.col("volume") != F.col("file_index")) & (F.col("v_class") != F.col("sop_class_uid")) & F.col("geometry").isNotNull())
    pairs = pairs.select("volume", "file_index", "frame_index", "base", "offsets", "geometry")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r in batch.select(["base", "offsets", "geometry"]).to_pylist():
                plan = sampling_plan(r["base"], r["geometry"], True)
                keep.append(plan is not None and covers_a_pixel(np.array(r["offsets"]), r["base"]["rows"], r["base"]["columns"], *plan[:5], r["geometry"]["rows"], r["geometry"]["columns"]))
            yield batch.select(["volume", "file_index", "frame_index"]).filter(pa.array(keep, pa.bool_()))

    kinds = dict(pairs.dtypes)
    covered = pairs.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("volume", "file_index", "frame_index")))
    w = W.partitionBy("volume").orderBy("file_index", "frame_index")
    shown = covered.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    named = covered.join(declared.distinct().withColumn("_d", F.lit(True)), ["volume", "file_index"], "left")
    files = named.groupBy("volume").agg(F.count("*").alias("frames"), F.countDistinct("file_index").alias("files"), F.countDistinct(F.when(F.col("_d"), F.col("file_index"))).alias("_nd"), F.min(F.when(F.col("_d"), F.col("file_index"))).alias("_sd"), F.min("file_index").alias("_s"))
    source = F.when(F.col("_nd") == 1, F.col("_sd")).when(F.col("files") == 1, F.col("_s"))
    return shown, files.select("volume", "frames", "files", source.alias("source"))


def _unit(v: np.ndarray) -> np.ndarray | None:
    n = np.linalg.norm(v)
    return v / n if np.isfinite(n) and n > 2.0**-52 else None


def sampling_plan(base: dict, target: dict, snap: bool) -> tuple | None:
    """(origin, row step, column step, normal origin, normal step, parallel) of a displayed frame in a volume; null if degenerate."""
    axes = [_unit(np.array(g["orientation"][a : a + 3])) for g in (base, target) for a in (0, 3)]
    if any(a is None for a in axes):
        return None
    br, bc, tr, tc = axes
    normal, other = _unit(np.cross(br, bc)), _unit(np.cross(tr, tc))
    if normal is None or other is None:
        return None
    delta = np.array(target["position"]) - np.array(base["position"])
    place = lambda v: (float(v @ bc) / base["spacing"][0], float(v @ br) / base["spacing"][1])
    down, right = tc * target["spacing"][0], tr * target["spacing"][1]
    parallel = snap and 1 - abs(normal @ other) <= 1e-5
    step = (0.0, 0.0) if parallel else (float(down @ normal), float(right @ normal))
    return place(delta), place(down), place(right), float(delta @ normal), step, parallel


def overlay_values(volumes: DataFrame, planes: DataFrame, targets: DataFrame) -> DataFrame:
    """(volume, file_index, frame_index, values): each volume resampled onto its target frames, NaN outside (CTX-18, FN-24).

    planes: volume, offset, values (mapped, row-major). A volume and its targets meet in one group; volumes
    are the unit of parallelism, and a volume's planes are its own size, not the corpus's.
    """
    packed = planes.groupBy("volume").agg(F.array_sort(F.collect_list(F.struct("offset", "values"))).alias("planes"))
    rows = targets.join(volumes.select("volume", "base"), "volume").join(packed, "volume").select("volume", "file_index", "frame_index", "geometry", "base", "planes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                h, w = r["base"]["rows"], r["base"]["columns"]
                stack = np.array([p["values"] for p in r["planes"]], float).reshape(-1, h, w)
                plan = sampling_plan(r["base"], r["geometry"], True)
                offsets = np.array([p["offset"] for p in r["planes"]])
                out.append(None if plan is None else resample(stack, offsets, *plan[:5], r["geometry"]["rows"], r["geometry"]["columns"], plan[5]).ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("volume", "file_index", "frame_index")), pa.array(out, pa.list_(pa.float64()))], names=["volume", "file_index", "frame_index", "values"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("volume", "file_index", "frame_index")) + ", values array<double>")


def overlay_colors(values: DataFrame, legends: DataFrame) -> DataFrame:
    """values with `rgba`: one colour a pixel along the volume's legend (CTX-18, FN-28)."""
    rows = values.join(legends.select("volume", "min", "max", "floor"), "volume")
    return rows.withColumn("rgba", F.transform("values", lambda v: color_wash(v, F.col("min"), F.col("max"), F.col("floor")))).drop("min", "max", "floor")


def mapped_frames(frames: DataFrame, maps: DataFrame) -> DataFrame:
    """Frames in real-world units: each sample by its frame's map, NaN outside the mapped range (CTX-19)."""
    rows = frames.join(maps.select("file_index", "frame_index", "map"), ["file_index", "frame_index"])
    return rows.withColumn("values", F.transform("samples", lambda s: F.coalesce(mapped_value(F.col("map"), s), F.lit(float("nan"))))).drop("map")


def map_instances(references: DataFrame, images: DataFrame) -> DataFrame:
    """(file_index, item, frames): images that mapping items name; a reference without frames means every frame (JOIN-16).

    references: item, sop_instance_uid, frame_numbers. An item whose frames are all out of range names nothing.
    """
    rows = references.join(images.select("file_index", "sop_instance_uid", "frame_count"), "sop_instance_uid")
    inside = F.filter(F.transform("frame_numbers", lambda n: n - 1), lambda i: (i >= 0) & (i < F.col("frame_count")))
    rows = rows.withColumns({"_all": F.size("frame_numbers") == 0, "_in": inside})
    out = rows.groupBy("file_index", "item").agg(F.bool_or("_all").alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_in")))).alias("frames"))
    return out.where(F.col("all") | (F.size("frames") > 0)).select("file_index", "item", F.when(~F.col("all"), F.col("frames")).alias("frames"))


def map_status(mappings: DataFrame, references: DataFrame, instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_index, status) and (file_index, sop_instance_uid, warning) of parametric maps (CTX-4).

    mappings: file_index, source (embedded or referenced), sop_instance_uid, map, units. references: file_index,
    sop_instance_uid of referenced mapping instances. instances: sop_instance_uid of local files, one row each.
    """
    counts = instances.groupBy("sop_instance_uid").agg(F.count("*").alias("n"))
    used = mappings.where(F.col("source") == "referenced").groupBy("file_index", "sop_instance_uid").agg(F.count("*").alias("m"))
    rows = references.join(counts, "sop_instance_uid", "left").join(used, ["file_index", "sop_instance_uid"], "left")
    warning = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(F.coalesce("m", F.lit(0)) == 0, "no_usable_mapping")
    status = mappings.groupBy("file_index").agg(F.when(F.bool_or(valid_map(F.col("map"), F.col("units"))), "mapping_available").otherwise("incompatible_mapping").alias("status"))
    warned = rows.select("file_index", "sop_instance_uid", warning.alias("warning")).where("warning is not null")
    return status, warned


def state_frames(items: DataFrame, images: DataFrame) -> DataFrame:
    """(state, item, file_index, frame_index): frames that annotation items apply to, distinct (JOIN-17).

    items: state, item, targets (array of struct(sop_instance_uid, frame_numbers); null: the state's own list in `series_targets`).
    """
    flat = items.select("state", "item", F.explode(F.coalesce("targets", "series_targets")).alias("t")).select("state", "item", F.col("t.sop_instance_uid").alias("sop_instance_uid"), F.col("t.frame_numbers").alias("numbers"))
    rows = flat.join(images.where("has_pixels").select("file_index", "sop_instance_uid", "frame_count"), "sop_instance_uid")
    every = F.sequence(F.lit(0), F.col("frame_count") - 1)
    own = F.filter(F.transform("numbers", lambda n: n - 1), lambda i: (i >= 0) & (i < F.col("frame_count")))
    return rows.select("state", "item", "file_index", F.explode(F.when(F.size("numbers") == 0, every).otherwise(own)).alias("frame_index")).distinct()


def state_context(items: DataFrame, frames: DataFrame) -> DataFrame:
    """(state, item, first_frame, frame_count, drawn): each item's first frame and number of frames (CTX-13)."""
    found = frames.groupBy("state", "item").agg(F.min(F.struct("file_index", "frame_index")).alias("first_frame"), F.count("*").alias("frame_count"))
    drawn = F.size("graphics") + F.size("texts")
    return items.join(found, ["state", "item"], "left").select("state", "item", "first_frame", F.coalesce("frame_count", F.lit(0)).alias("frame_count"), drawn.alias("drawn"))


def graphics_of_frame(items: DataFrame, sop_instance_uid: str, frame: int) -> DataFrame:
    """Items that apply to one image frame, with their objects (CTX-14, CTX-16)."""
    covers = F.exists(F.coalesce("targets", "series_targets"), lambda t: (t["sop_instance_uid"] == sop_instance_uid) & ((F.size(t["frame_numbers"]) == 0) | F.array_contains(t["frame_numbers"], frame + 1)))
    return items.where(F.coalesce(covers, F.lit(False)))


def graphic_object(units: Column, kind: Column, data: Column, declared: Column) -> Column:
    """struct(skip, points): points of an object in pixel units, or why it isn't drawn (FN-79).

    data: array<double> of parsed values; declared: how many values the element states.
    """
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(data) / 2).cast("int") - 1), lambda i: F.array(F.get(data, 2 * i), F.get(data, 2 * i + 1)))
    even = (F.size(data) == declared) & (F.size(data) % 2 == 0) & (F.size(data) > 0) & F.forall(data, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    n = F.size(data) / 2
    valid = F.when(kind == "POINT", n == 1).when(kind.isin("POLYLINE", "INTERPOLATED"), n >= 2).when(kind == "CIRCLE", n == 2).when(kind == "ELLIPSE", n == 4).otherwise(False)
    skip = F.when(units == "DISPLAY", "display_units").when(units == "MATRIX", "matrix_units").when(F.coalesce(units != "PIXEL", F.lit(True)) | ~F.coalesce(even & valid, F.lit(False)), "malformed")
    return F.struct(skip.alias("skip"), F.when(skip.isNull(), pairs).alias("points"))


def presentation_pixel(visible: Column, overlay: Column, shutter_gray: Column, overlay_gray: Column, boxed: Column) -> Column:
    """array(r, g, b, a): shutter and overlays in opaque gray, redaction boxes black on top, else transparent (CTX-20)."""
    gray = lambda g: F.array(g, g, g, F.lit(255))
    return F.when(boxed, gray(F.lit(0))).when(overlay, gray(overlay_gray)).when(~visible, gray(shutter_gray)).otherwise(F.array(*[F.lit(0)] * 4))
