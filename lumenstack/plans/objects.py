"""Object queries: headers from bytes, stored frames, overlays and their contexts, tag trees, labels, document files."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.functions import privacy, samples
from lumenstack.operators import annotations, histogram, links, oplog, overlays, series, trees
from lumenstack.plans.annotations import envelopes
from lumenstack.plans.columns import doubles, grid, listed, part, pick
from lumenstack.registry import query
from lumenstack.session import shared_dir, table
from lumenstack.sources import documents, scan

K = F.col  # the columns of the tables, by name


def named(key: str) -> Column:
    return F.concat(F.lit("u"), K(key).cast("string"))


def raw(data: bytes) -> Column:
    return F.lit(bytearray(data))


def number(value: Column, width: int, little: bool = False) -> Column:
    """A non-negative integer as so many bytes."""
    text = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
    if little:
        text = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.unhex(text)


def element(group: int, item: int, vr: str, value: Column) -> Column:
    """An explicit little-endian element with a short length."""
    value = value if vr == "US" else F.encode(value, "UTF-8")
    padded = F.when(F.octet_length(value) % 2 == 1, F.concat(value, raw(b"\0" if vr == "UI" else b" "))).otherwise(value)
    return F.concat(raw(struct.pack("<HH", group, item) + vr.encode()), number(F.octet_length(padded), 2, True), padded)


def object_bytes() -> Column:
    """A small object with a header and eight bytes of pixels; every 19th lacks its mark, every 17th is cut."""
    text = lambda c: c.cast("string")
    parts = [
        raw(b"\0" * 128),
        F.when(K("p_partkey") % 19 == 0, raw(b"NONE")).otherwise(raw(b"DICM")),
        element(0x0002, 0x0010, "UI", F.lit("1.2.840.10008.1.2.1")),
        element(0x0008, 0x0016, "UI", F.lit("1.2.840.10008.5.1.4.1.1.2")),
        element(0x0008, 0x0018, "UI", F.concat(F.lit("1.2."), text(K("p_partkey")))),
        element(0x0008, 0x0060, "CS", pick(K("p_partkey"), "CT", "MR", "US")),
        element(0x0010, 0x0010, "PN", K("p_name")),
        element(0x0020, 0x0032, "DS", F.concat(F.lit("1\\2\\"), text(K("p_size")))),
        element(0x0028, 0x0008, "IS", text(K("p_size") % 4)),
        element(0x0028, 0x0010, "US", number(K("p_size"), 2, True)),
        element(0x0028, 0x0100, "US", F.when(K("p_size") % 2 == 0, number(F.lit(16), 2, True)).otherwise(raw(b""))),
        element(0x0028, 0x1052, "DS", F.lit("-1024\\5")),
        raw(struct.pack("<HH2s2xI", 0x7FE0, 0x0010, b"OW", 8) + bytes(8)),
    ]
    whole = F.concat(*parts)
    return F.when(K("p_partkey") % 17 == 0, F.substring(whole, F.lit(1), F.lit(150))).otherwise(whole)


def raster_bytes() -> Column:
    """PNG and JPEG headers in turn; every 11th JPEG has no frame header."""
    w, h = K("p_size"), K("p_partkey") % 500 + 1
    png = F.concat(raw(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"), number(w, 4), number(h, 4), raw(b"\x08"), pick(K("p_size"), *map(bytearray, (b"\0", b"\2", b"\6"))), raw(bytes(7)))
    start = raw(b"\xff\xd8\xff\xe0\0\4ab")
    jpeg = F.concat(start, raw(b"\xff\xc0\0\x0b\x08"), number(h, 2), number(w, 2), raw(b"\1\1\x11\0"))
    return F.when(K("p_partkey") % 2 == 0, png).when(K("p_partkey") % 11 == 0, start).otherwise(jpeg)


def files_of(spark: SparkSession, sf_dir: str, content: Column, folder: str) -> DataFrame:
    rows = part(spark, sf_dir, content.alias("content"))
    return rows.select(F.concat(F.lit(f"/{folder}/"), K("p_partkey").cast("string")).alias("path"), F.octet_length("content").cast("bigint").alias("length"), "content")


@query(
    "object_headers",
    """
    SELECT '/objects/' || p_partkey AS path, '1.2.' || p_partkey AS instance, ['CT', 'MR', 'US'][p_partkey % 3 + 1] AS modality, p_name AS patient, p_size AS rows,
           p_size % 4 AS frames, CASE WHEN p_size % 2 = 0 THEN 16 ELSE 8 END AS bits, -1024.0::DOUBLE AS intercept, 1.0::DOUBLE AS slope, p_size::DOUBLE AS z, 1 AS channels,
           '1.2.840.10008.1.2.1' AS syntax, true AS has_pixels, 8 AS pixel_length
    FROM part WHERE p_partkey % 19 <> 0 AND p_partkey % 17 <> 0
    """,
)
def object_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers read from bytes: first values, defaults, vectors (SRC-6, SRC-7, CTX-56)."""
    files, _ = scan.classify(files_of(spark, sf_dir, object_bytes(), "objects"))
    return files.select(
        "path", K("sop_instance_uid").alias("instance"), "modality", K("patient_name").alias("patient"), K("rows").cast("int").alias("rows"), K("frame_count").cast("int").alias("frames"),
        K("bits_allocated").cast("int").alias("bits"), K("rescale_intercept").alias("intercept"), K("rescale_slope").alias("slope"), K("position")[2].alias("z"),
        K("samples_per_pixel").cast("int").alias("channels"), K("transfer_syntax_uid").alias("syntax"), "has_pixels", K("pixel_length").cast("int").alias("pixel_length"),
    )


@query(
    "scan_dispositions",
    """
    SELECT '/objects/' || p_partkey AS path,
           CASE WHEN p_partkey % 19 = 0 OR p_partkey % 17 = 0 THEN 'skipped' WHEN p_partkey % 3 = 0 THEN 'selected' ELSE 'filtered' END AS disposition,
           CASE WHEN p_partkey % 19 = 0 THEN 'unrecognized_format' WHEN p_partkey % 17 = 0 THEN 'dicom_parse_failed' WHEN p_partkey % 3 = 0 THEN 'valid_dicom' ELSE 'filter_mismatch' END AS reason
    FROM part
    UNION ALL SELECT '/images/' || p_partkey, 'skipped', 'format_not_selected' FROM part
    """,
)
def scan_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One disposition for every file of a scan with a filter and an allow-list (SRC-2, SRC-5)."""
    files = files_of(spark, sf_dir, object_bytes(), "objects").union(files_of(spark, sf_dir, raster_bytes(), "images"))
    _, records = scan.classify(files, ["Modality=ct"], ["dicom"])
    return records


@query(
    "raster_headers",
    """
    SELECT '/images/' || p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN 'png' ELSE 'jpeg' END AS format, p_partkey % 500 + 1 AS rows, p_size AS columns,
           CASE WHEN p_partkey % 2 = 0 THEN [1, 3, 4][p_size % 3 + 1] ELSE 1 END AS channels, 8 AS bits, 1 AS frames
    FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 11 <> 0
    """,
)
def raster_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, channels and pages of plain images; broken ones are left out (SRC-11)."""
    files, _ = scan.classify(files_of(spark, sf_dir, raster_bytes(), "images"))
    return files.select("path", "format", "rows", K("columns").cast("int").alias("columns"), K("samples_per_pixel").cast("int").alias("channels"), K("bits_allocated").cast("int").alias("bits"), K("frame_count").cast("int").alias("frames"))


def decoded(spark: SparkSession, sf_dir: str, data: Column, **layout) -> DataFrame:
    """Frames of the parts decoded; `layout` overrides one row of eight plain bytes."""
    own = {"encoding": "native", "rows": 1, "columns": 8, "samples": 1, "bits": 8, "bits_stored": 8, "high_bit": 7, "signed": False, "kind": "integer", "planar": 0, "big_endian": False, "photometric": "MONOCHROME2"} | layout
    frames = part(spark, sf_dir, data.alias("data"), *[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in own.items()])
    return samples.decode_frames(frames.select(K("p_partkey").alias("file_index"), F.lit(0).alias("frame_index"), "data", *own))


@query(
    "stored_samples",
    """
    SELECT p_partkey, CASE WHEN a >= 2048 THEN a - 4096 ELSE a END::DOUBLE AS first, CASE WHEN b >= 2048 THEN b - 4096 ELSE b END::DOUBLE AS second
    FROM (SELECT p_partkey, p_partkey * 37 % 65536 % 4096 AS a, p_size * 1311 % 4096 AS b FROM part)
    """,
)
def stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two 16-bit words of either byte order, cut to twelve signed bits (FN-39, FN-40, FN-43)."""
    big = K("p_partkey") % 2 == 0
    a, b = K("p_partkey") * 37 % 65536, K("p_size") * 1311 % 65536
    data = F.when(big, F.concat(number(a, 2), number(b, 2))).otherwise(F.concat(number(a, 2, True), number(b, 2, True)))
    out = decoded(spark, sf_dir, data, columns=2, bits=16, bits_stored=12, high_bit=11, signed=True, big_endian=big)
    return out.select(K("file_index").alias("p_partkey"), K("samples")[0].alias("first"), K("samples")[1].alias("second"))


@query(
    "run_length_frames",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 23 <> 0 THEN concat_ws(',', p_partkey % 256, p_partkey * 3 % 256, p_partkey * 5 % 256, 7, p_size, p_size, p_size, p_size) END AS samples,
           CASE WHEN p_partkey % 23 = 0 THEN 'wrong run length' END AS error
    FROM part
    """,
)
def run_length_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal run of four and a repeated run of four; a literal run over the repeated one is an error (FN-44)."""
    bytes_ = F.concat(*[number(K("p_partkey") * m % 256, 1) for m in (1, 3, 5)], raw(b"\7"))
    control = F.when(K("p_partkey") % 23 == 0, raw(b"\5")).otherwise(raw(b"\3"))
    data = F.concat(raw(struct.pack("<16I", 1, 64, *[0] * 14)), control, bytes_, raw(b"\xfd"), number(K("p_size"), 1))
    out = decoded(spark, sf_dir, data, encoding="rle", rows=2, columns=4)
    return out.select(K("file_index").alias("p_partkey"), F.array_join(F.transform("samples", lambda x: x.cast("int").cast("string")), ",").alias("samples"), "error")


@query("bit_frames", "SELECT p_partkey, array_to_string([(p_partkey % 256 >> i) & 1 for i in range(8)], '') AS bits FROM part")
def bit_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight one-bit samples, lowest bit first, plain and deflated in turn (FN-41, FN-45)."""
    own = number(K("p_partkey") % 256, 1)
    deflated = K("p_partkey") % 2 == 0
    data = F.when(deflated, F.concat(raw(b"\1\1\0\xfe\xff"), own)).otherwise(own)
    out = decoded(spark, sf_dir, data, encoding=F.when(deflated, "deflated").otherwise("native"), rows=2, columns=4, bits=1, bits_stored=1, high_bit=0)
    return out.select(K("file_index").alias("p_partkey"), F.array_join(F.transform("samples", lambda x: x.cast("int").cast("string")), "").alias("bits"))


@query(
    "shared_chroma",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN concat_ws(',', p_partkey % 256, 9, p_size, p_partkey * 3 % 256, 9, p_size) END AS samples,
           CASE WHEN p_partkey % 11 = 0 THEN 'not a 4:2:2 frame' END AS error
    FROM part
    """,
)
def shared_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two luma samples that share their chroma become two pixels; odd widths are errors (FN-42)."""
    data = F.concat(number(K("p_partkey") % 256, 1), number(K("p_partkey") * 3 % 256, 1), raw(b"\x09"), number(K("p_size"), 1))
    out = decoded(spark, sf_dir, data, columns=F.when(K("p_partkey") % 11 == 0, 3).otherwise(2), samples=3, photometric="YBR_FULL_422")
    return out.select(K("file_index").alias("p_partkey"), F.array_join(F.transform("samples", lambda x: x.cast("int").cast("string")), ",").alias("samples"), "error")


@query(
    "probed_pixels",
    "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN concat_ws(',', (p_partkey + 10) % 256, (p_partkey + 30) % 256, (p_partkey + 50) % 256) END AS pixel FROM part",
)
def probed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of pixel (1, 0) of planar frames, in colour order; null outside (FN-33, FN-78)."""
    data = F.concat(*[number((K("p_partkey") + 5 * j) % 256, 1) for j in range(12)])
    out = decoded(spark, sf_dir, data, rows=2, columns=2, samples=3, planar=1)
    sized = out.withColumns({"samples_per_pixel": F.lit(3), "columns": F.lit(2), "rows": F.when(K("file_index") % 7 == 0, 1).otherwise(2)})
    pixel = F.transform("pixel", lambda x: x.cast("int").cast("string"))
    return samples.pixel_probe(sized, 1, 0).select(K("file_index").alias("p_partkey"), F.array_join(pixel, ",").alias("pixel"))


@query("darkest_samples", "SELECT l_suppkey, CASE WHEN l_suppkey % 2 = 1 THEN max(l_extendedprice) ELSE min(l_extendedprice) END AS darkest FROM lineitem GROUP BY l_suppkey")
def darkest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample shown darkest: the least, or the greatest where the scale is inverted (AGG-26)."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", pick(K("l_suppkey"), "MONOCHROME2", "MONOCHROME1").alias("photometric"))
    return histogram.darkest(rows, ["l_suppkey"], "l_extendedprice", "photometric")


@query("binary_masks", "SELECT l_orderkey, bool_and(l_linenumber <= 1) AS \"binary\" FROM lineitem GROUP BY l_orderkey")
def binary_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all samples of a mask are 0 or 1 (AGG-25)."""
    return histogram.only_binary(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query(
    "dose_legends",
    """
    SELECT c_nationkey, 0.0::DOUBLE AS min, max(x) AS max, 0.0::DOUBLE AS floor FROM (SELECT c_nationkey, CASE WHEN c_nationkey % 5 = 0 THEN -abs(c_acctbal) ELSE c_acctbal END AS x FROM customer)
    GROUP BY c_nationkey HAVING max(x) > 0
    """,
)
def dose_legends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doses run from a transparent 0 to a positive maximum, or have no legend (AGG-15)."""
    x = F.when(K("c_nationkey") % 5 == 0, -F.abs("c_acctbal")).otherwise(K("c_acctbal"))
    ranges = histogram.value_range(table(spark, sf_dir, "customer").select("c_nationkey", x.alias("x")), ["c_nationkey"], "x")
    return histogram.legend(ranges, "dose").select("c_nationkey", "min", "max", "floor")


@query(
    "context_kinds",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'dose' ELSE
           ['segmentation', 'parametric_map', 'presentation_state', 'whole_slide', 'not_applicable'][p_partkey % 5 + 1] END AS context FROM part
    """,
)
def context_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which context an object has (CTX-1)."""
    kind = pick(K("p_partkey"), "segmentation", "parametric_map", "presentation_state", "whole_slide_microscopy", "image")
    return part(spark, sf_dir, overlays.context_kind(kind, K("p_partkey") % 7 == 0).alias("context"))


@query(
    "graphic_objects",
    """
    SELECT p_partkey, skip, CASE WHEN skip IS NULL THEN n // 2 END AS points FROM (SELECT *,
        CASE WHEN units = 'DISPLAY' THEN 'display_units' WHEN units = 'MATRIX' THEN 'matrix_units'
             WHEN coalesce(units, '') <> 'PIXEL' OR p_partkey % 5 = 0 OR n % 2 = 1 OR n = 0
               OR NOT CASE kind WHEN 'POINT' THEN n = 2 WHEN 'CIRCLE' THEN n = 4 WHEN 'ELLIPSE' THEN n = 8 WHEN 'OTHER' THEN false ELSE n >= 4 END THEN 'malformed' END AS skip
      FROM (SELECT p_partkey, p_size % 9 AS n, ['PIXEL', 'PIXEL', 'DISPLAY', 'MATRIX', NULL, 'PIXEL', 'PIXEL'][p_partkey % 7 + 1] AS units,
                   ['POINT', 'POLYLINE', 'INTERPOLATED', 'CIRCLE', 'ELLIPSE', 'OTHER'][p_partkey % 6 + 1] AS kind FROM part))
    """,
)
def graphic_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn objects in pixel units with as many values as stated and as their kind needs (FN-79, CTX-15)."""
    n = K("p_size") % 9
    data = F.slice(doubles(*range(8)), F.lit(1), n)
    units = pick(K("p_partkey"), "PIXEL", "PIXEL", "DISPLAY", "MATRIX", None, "PIXEL", "PIXEL")
    kind = pick(K("p_partkey"), "POINT", "POLYLINE", "INTERPOLATED", "CIRCLE", "ELLIPSE", "OTHER")
    g = overlays.graphic_object(units, kind, data, F.when(K("p_partkey") % 5 == 0, n + 1).otherwise(n))
    return part(spark, sf_dir, g["skip"].alias("skip"), F.when(g["points"].isNotNull(), F.size(g["points"])).alias("points"))


@query(
    "presentation_pixels",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN '0,0,0,255' WHEN p_partkey % 5 = 0 THEN concat_ws(',', p_size, p_size, p_size, 255)
           WHEN p_partkey % 3 = 0 THEN '40,40,40,255' ELSE '0,0,0,0' END AS rgba FROM part
    """,
)
def presentation_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redaction over overlay over shutter, else transparent (CTX-20)."""
    k = K("p_partkey")
    return part(spark, sf_dir, listed(overlays.presentation_pixel(k % 3 != 0, k % 5 == 0, F.lit(40), K("p_size"), k % 13 == 0)).alias("rgba"))


@query(
    "mapped_frames",
    "SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 40 THEN p_size * 0.5 + 1 ELSE -1 END::DOUBLE AS first, CASE WHEN p_size % 20 >= 10 THEN p_size % 20 * 0.5 + 1 ELSE -1 END::DOUBLE AS second FROM part",
)
def mapped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in real-world units, NaN (here -1) outside the mapped range (CTX-19)."""
    m = F.struct(F.lit(10.0).alias("first"), F.lit(40.0).alias("last"), F.lit(0.5).alias("slope"), F.lit(1.0).alias("intercept"), F.array().cast("array<double>").alias("lut"))
    frames = part(spark, sf_dir, K("p_partkey").alias("file_index"), F.lit(0).alias("frame_index"), doubles(K("p_size"), K("p_size") % 20).alias("samples"), m.alias("map"))
    out = overlays.mapped_frames(frames.drop("map"), frames.select("file_index", "frame_index", "map"))
    return out.select("p_partkey", *[F.nanvl(K("values")[i], F.lit(-1.0)).alias(n) for i, n in enumerate(("first", "second"))])


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part(spark, sf_dir, K("p_partkey").alias("file_index"), named("p_partkey").alias("sop_instance_uid"), (K("p_size") % 5 + 1).alias("frame_count"), (K("p_partkey") % 6 != 0).alias("has_pixels"))


@query(
    "map_instances",
    """
    WITH r AS (SELECT l_partkey AS file_index, l_linenumber AS item, l_quantity::INT AS q, p_size % 5 + 1 AS n FROM lineitem JOIN part ON p_partkey = l_partkey),
         f AS (SELECT DISTINCT file_index, item, unnest([q % 7 - 1, q % 4 - 1]) AS frame, n FROM r WHERE q % 3 <> 0),
         i AS (SELECT file_index, item, string_agg(frame, ',' ORDER BY frame) AS frames FROM f WHERE frame >= 0 AND frame < n GROUP BY ALL),
         a AS (SELECT DISTINCT file_index, item FROM r WHERE q % 3 = 0)
    SELECT file_index, item, NULL AS frames FROM a UNION ALL SELECT * FROM i ANTI JOIN a USING (file_index, item)
    """,
)
def map_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that value mappings name, with the frames in range (JOIN-16)."""
    q = K("l_quantity").cast("int")
    numbers = F.when(q % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(q % 7, q % 4))
    refs = table(spark, sf_dir, "lineitem").select(K("l_linenumber").alias("item"), named("l_partkey").alias("sop_instance_uid"), numbers.alias("frame_numbers"))
    out = overlays.map_instances(refs, images(spark, sf_dir))
    return out.select("file_index", "item", listed(K("frames")).alias("frames"))


@query(
    "map_warnings",
    """
    SELECT p_partkey AS file_index, 'u' || (p_partkey % 40) AS sop_instance_uid,
           CASE WHEN p_partkey % 40 >= 30 THEN 'missing' WHEN p_partkey % 40 >= 20 THEN 'ambiguous' ELSE 'no_usable_mapping' END AS warning
    FROM part WHERE p_partkey % 40 >= 20 OR p_partkey % 3 = 0
    """,
)
def map_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referenced mapping objects that are missing, ambiguous or of no use (CTX-4)."""
    uid = F.concat(F.lit("u"), (K("p_partkey") % 40).cast("string"))
    rows = part(spark, sf_dir, K("p_partkey").alias("file_index"), uid.alias("sop_instance_uid"))
    m = F.struct(F.lit(0.0).alias("first"), F.lit(1.0).alias("last"), F.lit(1.0).alias("slope"), F.lit(0.0).alias("intercept"), F.array().cast("array<double>").alias("lut"))
    mappings = rows.where(K("p_partkey") % 3 != 0).select("file_index", F.lit("referenced").alias("source"), "sop_instance_uid", m.alias("map"), F.lit("mm").alias("units"))
    held = spark.range(30).select(F.explode(F.when(K("id") >= 20, F.array(K("id"), K("id"))).otherwise(F.array("id"))).alias("i")).select(named("i").alias("sop_instance_uid"))
    return overlays.map_status(mappings, rows.select("file_index", "sop_instance_uid"), held)[1]


def state_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation items of states: of their own targets, or of the state's list."""
    numbers = F.when(K("o_orderkey") % 2 == 0, F.array((K("o_orderkey") % 5).cast("int"), (K("o_orderkey") % 3 + 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    own = F.array(F.struct(F.concat(F.lit("u"), (K("o_orderkey") % 1000).cast("string")).alias("sop_instance_uid"), numbers.alias("frame_numbers")))
    state = F.array(F.struct(F.concat(F.lit("u"), (K("o_custkey") % 10).cast("string")).alias("sop_instance_uid"), F.array().cast("array<int>").alias("frame_numbers")))
    dots = lambda n: F.array_repeat(F.lit("."), n.cast("int"))
    return table(spark, sf_dir, "orders").select(
        K("o_custkey").alias("state"), K("o_orderkey").alias("item"), F.when(K("o_orderkey") % 4 != 0, own).alias("targets"), state.alias("series_targets"),
        dots(K("o_orderkey") % 3).alias("graphics"), dots(K("o_orderkey") % 2).alias("texts"),
    )


STATE_FRAMES = """
    SELECT o_custkey AS state, o_orderkey AS item, p_partkey AS file_index, unnest(CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 2 = 1 THEN range(p_size % 5 + 1)
           ELSE list_distinct([x for x in [o_orderkey % 5 - 1, o_orderkey % 3] if x >= 0 AND x < p_size % 5 + 1]) END) AS frame_index
    FROM orders JOIN part ON p_partkey = CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 10 ELSE o_orderkey % 1000 END WHERE p_partkey % 6 <> 0
"""


@query("state_frames", STATE_FRAMES)
def state_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that annotation items apply to (JOIN-17)."""
    return overlays.state_frames(state_items(spark, sf_dir), images(spark, sf_dir))


@query(
    "state_contexts",
    f"""
    SELECT o_custkey AS state, o_orderkey AS item, first.file_index AS file_index, first.frame_index AS frame_index, coalesce(n, 0) AS frame_count, o_orderkey % 3 + o_orderkey % 2 AS drawn
    FROM orders LEFT JOIN (SELECT item, min({{'file_index': file_index, 'frame_index': frame_index}}) AS first, count(*) AS n FROM ({STATE_FRAMES}) GROUP BY item) ON item = o_orderkey
    """,
)
def state_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's first frame, number of frames and drawn objects (CTX-13)."""
    items = state_items(spark, sf_dir)
    out = overlays.state_context(items, overlays.state_frames(items, images(spark, sf_dir)))
    return out.select("state", "item", K("first_frame.file_index").alias("file_index"), K("first_frame.frame_index").cast("bigint").alias("frame_index"), "frame_count", K("drawn").cast("bigint").alias("drawn"))


@query(
    "graphics_of_a_frame",
    """
    SELECT o_custkey AS state, o_orderkey AS item FROM orders WHERE CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 10 = 7
        ELSE o_orderkey % 1000 = 7 AND (o_orderkey % 2 = 1 OR o_orderkey % 5 = 2 OR o_orderkey % 3 = 1) END
    """,
)
def graphics_of_a_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that apply to the second frame of one image (CTX-14, CTX-16)."""
    return overlays.graphics_of_frame(state_items(spark, sf_dir), "u7", 1).select("state", "item")


@query(
    "segment_sources",
    """
    SELECT p_partkey AS file_index, CASE p_partkey % 3 WHEN 0 THEN 'explicit_derivation' WHEN 1 THEN 'declared_source_geometry' END AS method,
           CASE WHEN frame IS NULL THEN 'missing' ELSE 'resolved' END AS status, frame
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 0 WHEN p_partkey % 3 < 2 AND p_size % 4 < 3 THEN p_size % 4 END AS frame FROM part)
    """,
)
def segment_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask frames mapped to their declared frames, or by geometry to those of declared objects; a lone declared frame is taken as it is (JOIN-7, JOIN-8)."""
    uid = F.concat(F.lit("s"), (K("p_partkey") % 50).cast("string"))
    masks = part(spark, sf_dir, K("p_partkey").alias("file_index"), F.lit(0).alias("frame_index"), grid(doubles(0, 0, K("p_size") % 4)).alias("geometry"), F.lit("r").alias("frame_of_reference_uid"), uid.alias("sop_instance_uid"))
    numbers = F.when((K("file_index") % 2 == 1) & (K("file_index") % 3 == 0), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    declared = masks.where(K("file_index") % 3 != 2).select("file_index", F.when(K("file_index") % 3 == 0, 0).alias("frame_index"), "sop_instance_uid", numbers.alias("frame_numbers"))
    frames = spark.range(150).select(F.floor(K("id") / 3).alias("s"), (K("id") % 3).cast("int").alias("frame_index")).select(
        K("s").alias("file_index"), "frame_index", F.concat(F.lit("s"), K("s").cast("string")).alias("sop_instance_uid"), F.lit("r").alias("frame_of_reference_uid"), grid(doubles(0, 0, K("frame_index"))).alias("geometry")
    )
    masks = masks.drop("sop_instance_uid")
    out = overlays.segment_sources(masks, declared, frames.withColumn("file_index", K("file_index").cast("int")))
    return out.select("file_index", "method", "status", F.get("sources", F.lit(0))["frame_index"].alias("frame"))


@query(
    "segment_eligibility",
    """
    WITH m AS (SELECT l_orderkey AS f, bool_and(l_discount < 0.1) AS declared, count(*) AS n, bool_and(l_tax < 0.08) AS once, bool_and(l_quantity < 50) AS geometry,
                      bool_and(l_suppkey % 20 <> 0) AS closed, count(DISTINCT l_suppkey) AS sources, min(l_suppkey) AS source FROM lineitem GROUP BY l_orderkey)
    SELECT f AS file_index, reason IS NULL AS eligible, reason, CASE WHEN reason IS NULL AND sources = 1 THEN source END AS source_file_index
    FROM (SELECT *, CASE WHEN NOT declared THEN 'undeclared_segment' WHEN f % 9 = 0 THEN 'incomplete_mapping' WHEN NOT once THEN 'not_unique' WHEN NOT geometry THEN 'incompatible_geometry'
                         WHEN NOT closed THEN 'not_closed_by_reference' END AS reason FROM m)
    """,
)
def segment_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that keeps a mask from being drawn (CTX-3)."""
    rows = table(spark, sf_dir, "lineitem")
    sources = F.array(F.struct(K("l_suppkey").alias("file_index"), F.lit(0).alias("frame_index")))
    status = F.when(K("l_tax") < 0.08, "resolved").otherwise("ambiguous")
    mappings = rows.select(K("l_orderkey").alias("file_index"), status.alias("status"), sources.alias("sources"), (K("l_discount") < 0.1).alias("segment_declared"), (K("l_quantity") < 50).alias("geometry_ok"))
    edges = rows.where(K("l_suppkey") % 20 != 0).select(K("l_orderkey").alias("file_index"), K("l_suppkey").alias("source"))
    files = rows.groupBy(K("l_orderkey").alias("file_index")).agg(F.count("*").alias("n")).select("file_index", F.when(K("file_index") % 9 == 0, K("n") + 1).otherwise(K("n")).alias("frame_count"))
    return overlays.segmentation_eligibility(mappings, files, edges)


@query("tag_previews", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || ' bytes' WHEN 1 THEN p_size || ' item(s)' || CASE WHEN p_size < 20 THEN ' of 20' ELSE '' END ELSE p_name END AS preview, CASE p_partkey % 3 WHEN 0 THEN '[binary: ' || p_size || ' bytes]' WHEN 1 THEN '[sequence: ' || p_size || ' item(s)]' ELSE p_name END AS copied FROM part")
def tag_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a row shows and copies of its value (CTX-21, CTX-50)."""
    kind = pick(K("p_partkey"), "binary", "sequence", "text")
    return part(spark, sf_dir, trees.preview(kind, K("p_name"), K("p_size"), F.lit(20)).alias("preview"), trees.copy_text(kind, K("p_name"), K("p_size")).alias("copied"))


def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence for each order and its lines below it."""
    none = F.array().cast("array<string>")
    root = table(spark, sf_dir, "orders").select(K("o_orderkey").alias("file_index"), F.lit("-0").alias("key"), none.alias("ancestors"), F.lit("0040,0275").alias("tag"), F.lit("RequestAttributes").alias("keyword"), pick(K("o_orderkey"), "SQ", "UN").alias("vr"), F.lit("sequence").alias("type"), K("o_orderstatus").alias("preview"))
    key = F.concat(F.lit("-0:0-"), K("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    below = lines.select(K("l_orderkey").alias("file_index"), key.alias("key"), F.array(F.lit("-0")).alias("ancestors"), F.lit("0040,0009").alias("tag"), F.lit("StepID").alias("keyword"), F.lit("SH").alias("vr"), F.lit("string").alias("type"), F.concat(F.lit("Flag "), "flag").alias("preview"))
    return root.union(below)


@query(
    "tag_search",
    """
    WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL) WHERE flag = 'R')
    SELECT l_orderkey AS file_index, '-0:0-' || l_linenumber AS key FROM l UNION ALL SELECT DISTINCT l_orderkey, '-0' FROM l SEMI JOIN orders ON o_orderkey = l_orderkey
    """,
)
def tag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that hold a needle, and the rows above them (FLT-10)."""
    return trees.search_rows(tag_rows(spark, sf_dir), " stepid sh FLAG r ").select("file_index", "key")


@query(
    "open_tags",
    """
    SELECT o_orderkey AS file_index, '-0' AS key FROM orders UNION ALL
    SELECT DISTINCT l_orderkey, '-0:0-' || l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    """,
)
def open_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows below sequences that are open (FN-65)."""
    return trees.open_rows(tag_rows(spark, sf_dir), ["-0"]).select("file_index", "key")


@query("selected_tags", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS value, 3 AS held, true AS truncated FROM part")
def selected_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tag below the second item of a sequence, and a page of the sequence (FN-63, FN-64, CTX-22)."""
    item = lambda x: F.concat(F.lit('{"0020,000D":'), x.cast("string"), F.lit("}"))
    tree = F.parse_json(F.concat(F.lit('{"0010,0020":['), F.concat_ws(",", *[item(x) for x in (F.lit(0), K("p_size"), F.lit(1), F.lit(2))]), F.lit("]}")))
    one, all_ = trees.select_path(tree, "(0010,0020)/1/(0020,000D)"), trees.select_path(tree, "(0010,0020)", 0, 3)
    return part(spark, sf_dir, one["value"].cast("string").alias("value"), F.size(all_["items"]).alias("held"), all_["truncated"].alias("truncated"))


@query("metadata_nodes", "SELECT l_orderkey AS file_index, n AS key FROM (SELECT l_orderkey, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE r = 2")
def metadata_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second node of a tag and keyword (CTX-23)."""
    nodes = table(spark, sf_dir, "lineitem").select(K("l_orderkey").alias("file_index"), K("l_linenumber").alias("key"), F.lit("t").alias("tag"), F.lit("k").alias("keyword")).distinct()
    return trees.select_node(nodes, "t", "k", 1).select("file_index", "key")


@query(
    "folded_records",
    """
    WITH e AS (SELECT user_id, event_id % 5 AS r, event_type, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) AS n FROM events),
         s AS (SELECT user_id, r, min(n) FILTER (event_type = 'purchase' AND n > 1) AS gone, max(n) AS n FROM e GROUP BY ALL)
    SELECT CAST(user_id AS VARCHAR) AS store, 'annotation' AS kind, 'u' || user_id || '-' || r AS id, coalesce(gone, n) AS rev, gone IS NOT NULL AS deleted FROM s
    UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), 'layer', 'default', 1, false FROM events
    """,
)
def folded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log of creates, updates and deletes leaves; later envelopes of a deleted record change nothing (ST-8, ST-9)."""
    return oplog.folded_state(envelopes(spark, sf_dir)).select("store", "kind", "id", "rev", "deleted")


@query(
    "list_save_steps",
    """
    WITH o AS (SELECT DISTINCT conv_id, turn FROM conversations),
         a AS (SELECT *, turn % 3 = 1 AS gone, turn % 3 <> 1 AND turn % 5 = 2 AS edited FROM o),
         g AS (SELECT *, sum((NOT gone AND NOT edited)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM a),
         r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, gap ORDER BY turn) AS nth FROM g WHERE gone OR edited),
         w AS (SELECT conv_id, gap, turn AS new, row_number() OVER (PARTITION BY conv_id, gap ORDER BY turn) AS nth FROM r WHERE edited)
    SELECT CAST(conv_id AS VARCHAR) AS file, CASE WHEN new IS NULL THEN 'delete' ELSE 'update' END AS op, CAST(turn AS VARCHAR) AS old, 'edited-' || new AS new
    FROM r LEFT JOIN w USING (conv_id, gap, nth)
    """,
)
def list_save_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved lists of distinct items: between kept items, the earliest old ones take the edits and the rest go (ST-14, ST-15)."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("turn")).alias("all"))
    had = F.transform("all", lambda t: t.cast("string"))
    wanted = F.transform(F.filter("all", lambda t: t % 3 != 1), lambda t: F.when(t % 5 == 2, F.concat(F.lit("edited-"), t.cast("string"))).otherwise(t.cast("string")))
    return oplog.replacement_ops(rows.select(K("conv_id").alias("file"), had.alias("had"), wanted.alias("wanted"))).select("file", "op", "old", "new")


@query(
    "labels_on_files",
    """
    WITH l AS (SELECT event_id, ['f' || user_id, 'patient:p' || (user_id % 20), 'study:missing:f' || user_id, 'series:s' || (user_id % 30), 'f' || user_id, 'folder'][event_id % 6 + 1] AS target, event_type FROM events WHERE event_type <> 'error')
    SELECT event_id, c_custkey AS file_index FROM l JOIN customer ON target IN ('f' || c_custkey, 'patient:p' || (c_custkey % 20), 'study:missing:f' || c_custkey, 'series:s' || (c_custkey % 30))
    """,
)
def labels_on_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels on a file, its frames, patient, study and series; cleared ones and folders don't count (JOIN-21)."""
    tail = lambda key, n: (K(key) % n).cast("string")
    f = F.concat(F.lit("f"), K("user_id").cast("string"))
    target = F.element_at(F.array(f, F.concat(F.lit("patient:p"), tail("user_id", 20)), F.concat(F.lit("study:missing:"), f), F.concat(F.lit("series:s"), tail("user_id", 30)), F.concat(f, F.lit("#3")), F.lit("folder")), (K("event_id") % 6 + 1).cast("int"))
    labels = table(spark, sf_dir, "events").select("event_id", target.alias("target"), pick(K("event_id"), "file", "patient", "study", "series", "frame", "folder").alias("target_kind"), F.when(K("event_type") != "error", K("event_type")).alias("value"))
    files = table(spark, sf_dir, "customer").select(
        K("c_custkey").alias("file_index"), F.concat(F.lit("f"), K("c_custkey").cast("string")).alias("file_key"), F.concat(F.lit("p"), tail("c_custkey", 20)).alias("patient_id"),
        F.lit("").alias("study_instance_uid"), F.concat(F.lit("s"), tail("c_custkey", 30)).alias("series_instance_uid"),
    )
    return links.labels_of_file(labels, files, ["event_id"])


@query("paths_to_files", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN l_partkey WHEN p_partkey IS NOT NULL THEN l_partkey END AS file_index FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def paths_to_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed paths, relative and with dots, to the files of their normal or canonical form (JOIN-12, SET-1)."""
    path = F.concat(F.when(K("l_partkey") % 2 == 0, " a/../b/./").otherwise("/real/"), K("l_partkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", path.alias("path"))
    at = lambda folder: F.concat(F.lit(folder), K("p_partkey").cast("string"))
    files = part(spark, sf_dir, K("p_partkey").alias("file_index"), at("/work/b/").alias("path"), at("/real/").alias("canonical"))
    return links.path_join(rows, files, "/work", canonical="canonical").drop("path")


@query(
    "navigation_kinds",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'concatenation' WHEN p_partkey % 3 <> 0 THEN 'ordinary' WHEN p_size % 2 = 0 THEN 'pyramid_level' ELSE 'companion' END AS kind,
           CASE WHEN p_partkey % 4 = 0 THEN 'c' || (p_partkey % 8) WHEN p_partkey % 3 <> 0 THEN NULL WHEN p_size % 2 = 0 THEN 'y' ELSE 'u' || p_partkey END AS kind_uid,
           CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 = 0 THEN 'VOLUME' END AS kind_role,
           CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 = 0 AND p_size % 2 = 0 THEN p_size END AS kind_rows
    FROM part
    """,
)
def navigation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kind of stack a file belongs to (AGG-2, CTX-25)."""
    k = K("p_partkey")
    rows = part(spark, sf_dir, F.when(k % 4 == 0, F.concat(F.lit("c"), (k % 8).cast("string"))).alias("concatenation_uid"), F.when(K("p_size") % 2 == 0, "y").otherwise("").alias("pyramid_uid"),
                F.when(k % 3 == 0, links.SLIDE).otherwise("1.2").alias("sop_class_uid"), named("p_partkey").alias("sop_instance_uid"), F.array(*map(F.lit, ("ORIGINAL", "PRIMARY", "VOLUME"))).alias("image_type"),
                K("p_size").alias("matrix_rows"), K("p_size").alias("matrix_columns"))
    return series.with_kind(rows).select("p_partkey", "kind", "kind_uid", "kind_role", "kind_rows")


@query("near_frames", "SELECT l_orderkey, n, (SELECT string_agg(x, ',') FROM unnest([i for i in range(1, 200) if abs(i - n) <= 2 AND i <= total]) t(x)) AS near FROM (SELECT l_orderkey, unnest(range(1, count(*) + 1)) AS n, count(*) AS total FROM lineitem GROUP BY l_orderkey)")
def near_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames within two places in a stack (WIN-8)."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"))
    stack = sizes.select("l_orderkey", F.explode(F.sequence(F.lit(1).cast("bigint"), "total")).alias("n"))
    return series.neighbours(stack, 2, ["l_orderkey"], "n").select("l_orderkey", "n", listed(F.array_sort("near")).alias("near"))


@query(
    "classified_references",
    """
    SELECT p_partkey, CASE WHEN o = 'parametric_map' THEN 'source_image' WHEN o = 'segmentation' THEN CASE WHEN p_size % 2 = 0 THEN 'source_image_for_segmentation' ELSE 'source_image' END
           WHEN o = 'blending_state' THEN 'blending_source' WHEN o = 'rt_plan' THEN 'referenced_structure_set' WHEN o = 'rt_dose' THEN 'source_structure_set' ELSE 'unknown' END AS relationship
    FROM (SELECT *, ['parametric_map', 'segmentation', 'blending_state', 'rt_plan', 'rt_dose', 'other'][p_partkey % 6 + 1] AS o FROM part) WHERE o <> 'parametric_map' OR p_size % 3 <> 0
    """,
)
def classified_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships by the owner's class and the sequences above a reference (JOIN-6)."""
    path = lambda *names: F.array(*map(F.lit, names))
    owner = pick(K("p_partkey"), "parametric_map", "segmentation", "blending_state", "rt_plan", "rt_dose", "other")
    way = (
        F.when(owner == "parametric_map", F.when(K("p_size") % 3 == 0, path("Other")).otherwise(path("SourceImageSequence")))
        .when(owner == "segmentation", path("ReferencedSeriesSequence", "ReferencedInstanceSequence"))
        .when(owner == "blending_state", path("BlendingSequence", "ReferencedImageSequence"))
        .otherwise(path("ReferencedStructureSetSequence"))
    )
    refs = part(spark, sf_dir, K("p_partkey").alias("file_index"), F.lit(0).alias("ref"), owner.alias("owner"), way.alias("path"), F.when(K("p_size") % 2 == 0, links.SLIDE).otherwise("1.2").alias("sop_class"), named("p_partkey").alias("sop_instance"), F.array().cast("array<int>").alias("segment_numbers"))
    return links.classify_references(refs).select("p_partkey", "relationship")


@query(
    "enriched_edges",
    """
    WITH e AS (SELECT DISTINCT l_orderkey AS f, l_suppkey AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'r' || (l_suppkey % 5) END AS series FROM lineitem)
    SELECT f AS file_index, 'u' || s AS sop_instance, max(series) AS series FROM e GROUP BY f, s
    """,
)
def enriched_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of one file to one instance fill each other's series; repeats are one (JOIN-5, AGG-20)."""
    name = F.when(K("l_linenumber") % 2 == 0, F.concat(F.lit("r"), (K("l_suppkey") % 5).cast("string")))
    edges = table(spark, sf_dir, "lineitem").select(
        K("l_orderkey").alias("file_index"), K("l_linenumber").alias("edge_id"), F.lit("source_image").alias("relationship"), F.lit("1.2").alias("sop_class"), named("l_suppkey").alias("sop_instance"),
        name.alias("series"), F.array().cast("array<int>").alias("frame_numbers"),
    )
    return links.enrich_edges(edges).select("file_index", "sop_instance", "series")


@query(
    "list_views",
    """
    WITH r AS (SELECT l_orderkey AS f, l_partkey, l_linenumber, l_quantity::INT AS q, l_suppkey % 4 <> 0 AS every FROM lineitem WHERE l_returnflag <> 'R')
    SELECT 'f' || f AS file_key, count(*) AS num_roi, sum(q) AS least_rows, CASE WHEN bool_and(every) THEN 0 ELSE count(*) END AS lists, CASE WHEN bool_and(every) THEN 0 ELSE sum(CASE WHEN every THEN 3 ELSE 1 END) END AS frames FROM r GROUP BY f
    """,
)
def list_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rectangles as region lists, with frame lists where one is limited (CTX-29, CTX-30)."""
    key = F.concat(F.lit("f"), K("l_orderkey").cast("string"))
    q = K("l_quantity")
    rect = F.struct((q + 0.25).alias("x0"), (q + 0.5).alias("y0"), (q + 7.25).alias("x1"), (q + 9.5).alias("y1"))
    rows = table(spark, sf_dir, "lineitem").select(key.alias("file_key"), (K("l_returnflag") == "R").alias("deleted"), F.lit("rect").alias("type"), K("l_linenumber").alias("position"), rect.alias("rect"), (K("l_suppkey") % 4 != 0).alias("all_frames"), F.array(F.lit(1)).alias("frames"))
    files = rows.select("file_key").distinct().withColumn("frame_count", F.lit(3))
    total = lambda c, f: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + f(x))
    out = annotations.list_view(rows, files)
    return out.select("file_key", "num_roi", total("roi_coords", lambda b: b[0]).alias("least_rows"), F.size("roi_frames").alias("lists"), total("roi_frames", lambda x: F.size(x)).alias("frames"))


@query("hashed_fields", "SELECT p_partkey, h AS own_uid, [h, ''] AS some_uids, h AS inner_uid, '1.9.' || p_partkey AS plain FROM (SELECT p_partkey, '2.25.' || CAST(CAST('0x' || substr(h, 1, 16) AS UHUGEINT) % 9223372036854775807 * 4294967296 + CAST('0x' || substr(h, 17, 16) AS UHUGEINT) % 4294967296 AS VARCHAR) AS h FROM (SELECT p_partkey, sha256('k' || chr(31) || 'uid' || chr(31) || '1.9.' || p_partkey) AS h FROM part))")
def hashed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers hashed wherever a field's name says that it holds one (FN-73)."""
    uid = F.concat(F.lit("1.9."), K("p_partkey").cast("string"))
    rows = part(spark, sf_dir, uid.alias("own_uid"), F.array(uid, F.lit("")).alias("some_uids"), F.array(F.struct(uid.alias("inner_uid"), uid.alias("plain"))).alias("nested"))
    out = privacy.masked_uids(rows, "k")
    return out.select("p_partkey", "own_uid", "some_uids", K("nested")[0]["inner_uid"].alias("inner_uid"), K("nested")[0]["plain"].alias("plain"))


@query("document_lines", "SELECT 'annotation' AS kind, 'n' || n_nationkey AS id, n_name AS class FROM nation UNION ALL SELECT 'layer', 'r' || r_regionkey, r_name FROM region")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as a line document and read back (SRC-17, SRC-18)."""
    return round_trip(spark, sf_dir, documents.write_json_lines, documents.read_json_lines)


@query("document_json", "SELECT 'annotation' AS kind, 'n' || n_nationkey AS id, n_name AS class FROM nation UNION ALL SELECT 'layer', 'r' || r_regionkey, r_name FROM region")
def document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as one JSON document and read back (SRC-16, SRC-18, SRC-23)."""
    return round_trip(spark, sf_dir, documents.write_json, documents.read_json)


def round_trip(spark: SparkSession, sf_dir: str, write, read) -> DataFrame:
    def records(name: str, key: str, text: str, kind: str, mark: str) -> DataFrame:
        own = F.struct(F.concat(F.lit(mark), K(key).cast("string")).alias("id"), K(text).alias("class"))
        return table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), K(key).cast("int").alias("place"), F.to_variant_object(own).alias("record"))

    path = f"{shared_dir(spark)}/document-{uuid.uuid4().hex}"
    write({"format": documents.FORMAT, "version": "1.0"}, records("nation", "n_nationkey", "n_name", "annotation", "n").union(records("region", "r_regionkey", "r_name", "layer", "r")), path)
    field = lambda name: F.try_variant_get("record", f"$.{name}", "string").alias(name)
    return read(spark, path)[1].select("kind", field("id"), field("class"))
