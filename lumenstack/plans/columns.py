"""Column queries: support rules, windows, shapes, tiles, geometry, texts and keys over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.functions import geometry, pixels, shapes, text, tiles, values
from lumenstack.operators import annotations, filters, identity, links, series
from lumenstack.registry import query
from lumenstack.session import table
from lumenstack.sources import scan

K = F.col  # the columns of the tables, by name


def part(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *columns)


def pick(key: Column, *options) -> Column:
    """The option at key modulo their number."""
    return F.element_at(F.array(*[F.lit(x) for x in options]), (key % len(options) + 1).cast("int"))


def listed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


def doubles(*xs) -> Column:
    return F.array(*[x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in xs])


@query(
    "pixel_support",
    """
    WITH f AS (SELECT p_partkey,
               CASE WHEN p_partkey % 13 = 0 THEN 'png' ELSE 'dicom' END AS format, CASE WHEN p_partkey % 26 = 0 THEN 'unsupported_color' END AS raster,
               p_partkey % 17 <> 0 AS pixels,
               ['1.2.840.10008.1.2.1', '1.2.840.10008.1.2.8.1', '1.2.840.10008.1.2.4.50', '1.2.840.10008.1.2.4.57', '1.2.840.10008.1.2.4.90', '1.2.840.10008.1.2.4.80', '1.2.840.10008.1.2.4.110',
                '1.2.840.10008.1.2.5', '1.2.840.10008.1.2.4.81', '1.2.840.10008.1.2.4.111', '1.2.840.10008.1.2.4.112', '1.2.840.10008.1.2.4.51'][p_partkey % 12 + 1] AS syntax,
               p_partkey % 19 AS nrows, [1, 3, 1, 3, 0, 4, 3][p_partkey % 7 + 1] AS samples, [8, 16, 8, 1, 32, 64, 8, 12][p_size % 8 + 1] AS bits, p_partkey % 3 = 0 AS signed,
               ['integer', NULL, 'float32', 'integer', 'float64', 'integer'][p_size % 6 + 1] AS kind,
               ['MONOCHROME2', 'RGB', 'ybr_full', 'PALETTE COLOR', ' MONOCHROME1 ', 'YBR_FULL_422', 'YBR_ICT', 'YBR_RCT', 'HSV', 'monochrome2'][(p_partkey // 7) % 10 + 1] AS photo FROM part),
         g AS (SELECT *, upper(trim(photo)) AS name, coalesce(kind, 'integer') AS k FROM f),
         s AS (SELECT *, CASE
            WHEN format = 'png' THEN CASE WHEN raster IS NULL THEN 'ok' ELSE 'raster.' || raster END
            WHEN NOT pixels THEN 'pixel_data.absent_or_unrecognized'
            WHEN syntax LIKE '%.4.81' THEN 'transfer_syntax.jpeg_ls_not_supported'
            WHEN syntax LIKE '%.4.111' OR syntax LIKE '%.4.112' THEN 'transfer_syntax.jpeg_xl_not_supported'
            WHEN syntax LIKE '%.4.51' THEN 'transfer_syntax.not_supported'
            WHEN syntax LIKE '%.2.8.1' THEN CASE WHEN nrows > 0 AND bits = 1 AND NOT signed AND samples = 1 AND trim(photo) IN ('MONOCHROME1', 'MONOCHROME2') THEN 'ok' ELSE 'pixel_layout.bit_packed_not_supported' END
            WHEN nrows = 0 THEN 'pixel_layout.invalid_geometry'
            WHEN samples = 0 THEN 'pixel_layout.samples_per_pixel_not_supported'
            WHEN NOT (CASE WHEN syntax LIKE '%.1.2.1' THEN (k = 'integer' AND bits IN (1, 8, 16, 32)) OR (k = 'float32' AND bits = 32) OR (k = 'float64' AND bits = 64) ELSE k = 'integer' AND bits IN (8, 16) END)
                THEN CASE WHEN bits = 1 THEN 'pixel_layout.bit_packed_not_supported' ELSE 'pixel_layout.numeric_precision_not_supported' END
            WHEN samples = 1 AND name IN ('MONOCHROME1', 'MONOCHROME2') THEN 'ok'
            WHEN samples = 1 AND name = 'PALETTE COLOR' THEN CASE WHEN bits = 8 AND (syntax LIKE '%.1.2.1' OR syntax LIKE '%.1.2.5') THEN 'ok' ELSE 'pixel_layout.palette_color_not_supported' END
            WHEN samples = 1 THEN 'pixel_layout.photometric_interpretation_not_supported'
            WHEN samples = 3 AND bits = 8 AND (syntax LIKE '%.1.2.1' OR syntax LIKE '%.4.50' OR syntax LIKE '%.1.2.5') AND name IN ('RGB', 'YBR_FULL', 'YBR_FULL_422') THEN 'ok'
            WHEN samples = 3 AND bits = 8 AND syntax LIKE '%.4.57' AND name IN ('RGB', 'YBR_FULL') THEN 'ok'
            WHEN samples = 3 AND bits IN (8, 16) AND syntax LIKE '%.4.90' AND name IN ('RGB', 'YBR_RCT', 'YBR_ICT') THEN 'ok'
            WHEN samples = 3 AND bits = 8 AND syntax LIKE '%.4.110' AND name IN ('RGB', 'YBR_RCT', 'YBR_FULL') THEN 'ok'
            WHEN samples = 3 AND name IN ('RGB', 'YBR_FULL', 'YBR_FULL_422', 'YBR_ICT', 'YBR_RCT') THEN 'pixel_layout.generic_color_rendering_only'
            ELSE 'pixel_layout.samples_per_pixel_not_supported' END AS r FROM g)
    SELECT p_partkey, CASE WHEN r = 'ok' THEN 'renderable' WHEN r LIKE 'pixel_data%' THEN 'metadata_only' ELSE 'unsupported' END AS state, CASE WHEN r <> 'ok' THEN r END AS reason FROM s
    """,
)
def pixel_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and reason of every layout, by codec, precision, samples and colour (FLT-17, FLT-18)."""
    k, size = K("p_partkey"), K("p_size")
    uid = "1.2.840.10008.1.2"
    f = F.struct(
        F.when(k % 13 == 0, "png").otherwise("dicom").alias("format"),
        F.when(k % 26 == 0, "unsupported_color").alias("raster_unsupported"),
        (k % 17 != 0).alias("has_pixels"),
        pick(k, *[uid + x for x in (".1", ".8.1", ".4.50", ".4.57", ".4.90", ".4.80", ".4.110", ".5", ".4.81", ".4.111", ".4.112", ".4.51")]).alias("syntax"),
        (k % 19).alias("rows"),
        F.lit(5).alias("columns"),
        pick(k, 1, 3, 1, 3, 0, 4, 3).alias("samples"),
        pick(size, 8, 16, 8, 1, 32, 64, 8, 12).alias("bits"),
        (k % 3 == 0).alias("signed"),
        pick(size, "integer", None, "float32", "integer", "float64", "integer").alias("kind"),
        pick(F.floor(k / 7), "MONOCHROME2", "RGB", "ybr_full", "PALETTE COLOR", " MONOCHROME1 ", "YBR_FULL_422", "YBR_ICT", "YBR_RCT", "HSV", "monochrome2").alias("photometric"),
    )
    return part(spark, sf_dir, filters.pixel_support(f).alias("s")).select("p_partkey", "s.state", "s.reason")


@query(
    "object_kinds",
    """
    SELECT p_partkey, ['classic_image', 'segmentation', 'parametric_map', 'whole_slide_microscopy', 'unknown', 'image', 'radiation_therapy', 'presentation_state', 'unknown', 'encapsulated_pdf'][p_partkey % 10 + 1] AS kind FROM part
    """,
)
def object_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by exactly equal storage class; rasters are images (FLT-16, FLT-8)."""
    below = "1.2.840.10008.5.1.4.1.1"
    uid = pick(K("p_partkey"), *[below + x for x in (".2", ".66.4", ".30", ".77.1.6", ".2.9", ".2", ".481.2", ".11.1", "", ".104.1")])
    return part(spark, sf_dir, filters.object_kind(uid, F.when(K("p_partkey") % 10 == 5, "png").otherwise("dicom")).alias("kind"))


@query("frame_scopes", "SELECT event_id, event_id % 4 = 0 OR event_id % 6 IN (1, user_id % 6) AS inside FROM events")
def frame_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames, or one of a list (FLT-12)."""
    scope = filters.in_frame_scope(K("event_id") % 4 == 0, F.array(F.lit(1), (K("user_id") % 6).cast("int")), (K("event_id") % 6).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", scope.alias("inside"))


@query(
    "paged_items",
    """
    SELECT p_partkey, array_to_string([x FOR x IN range(p_size % 9 + 1) IF x >= p_size % 4 AND x < p_size % 4 + 3], ',') AS items, p_size % 4 > 0 OR p_size % 9 + 1 > 3 AS truncated,
           CASE WHEN p_size % 4 > 0 OR p_size % 9 + 1 > 3 THEN (p_size % 9 + 1)::BIGINT END AS total FROM part WHERE p_size % 4 <= p_size % 9
    """,
)
def paged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip and take; the total only where the page isn't everything (FLT-19)."""
    rows = table(spark, sf_dir, "part").where("p_size % 4 <= p_size % 9")
    items = F.transform(F.sequence(F.lit(0), K("p_size") % 9), lambda x: x.cast("bigint"))
    pages = [F.when(K("p_size") % 4 == o, filters.page(items, o, 3)) for o in range(4)]
    return rows.select("p_partkey", F.coalesce(*pages).alias("p")).select("p_partkey", listed(F.col("p.items")).alias("items"), "p.truncated", F.col("p.total").cast("bigint").alias("total"))


@query("presentation_bytes", "SELECT p_partkey, (((p_partkey * 7919) % 65536) * 255 + 32767) // 65535 AS byte FROM part")
def presentation_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit presentation values to bytes (FN-35)."""
    return part(spark, sf_dir, pixels.p_value_byte((K("p_partkey") * 7919) % 65536).cast("bigint").alias("byte"))


@query("window_functions", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity % 7 = 0 OR (l_quantity % 3 <> 0 AND (l_discount <> floor(l_discount) OR l_tax <> floor(l_tax))) THEN 'exact' ELSE 'linear' END AS function FROM lineitem")
def window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact for float samples and fractional rescaling (FN-5)."""
    chosen = pixels.window_function(K("l_quantity") % 7 == 0, K("l_quantity") % 3 == 0, K("l_discount").cast("double"), K("l_tax").cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", chosen.alias("function"))


@query(
    "window_ladder",
    """
    SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 1000.0 WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN p_size::DOUBLE WHEN p_size % 7 = 0 THEN 40.0 ELSE 7.0 END AS center,
           CASE WHEN p_size % 5 = 0 THEN 2000.0 WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 2.0 * p_size::DOUBLE WHEN p_size % 7 = 0 THEN 400.0 ELSE 9.0 END AS width FROM part
    """,
)
def window_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full range, both requested values, the stored window, percentiles (FN-8, CTX-45)."""
    s = K("p_size")
    window = lambda c, w: F.struct(F.lit(c).alias("center"), F.lit(w).alias("width"))
    found = pixels.resolve_window(F.when(s % 5 == 0, "full_dynamic").otherwise("default"), F.when(s % 2 == 0, s), F.when(s % 3 == 0, s * 2), F.when(s % 7 == 0, window(40.0, 400.0)), window(7.0, 9.0), window(1000.0, 2000.0))
    return part(spark, sf_dir, found.alias("w")).select("p_partkey", "w.center", "w.width")


@query("stored_bits", "SELECT p_partkey, CASE WHEN v >= 2048 THEN v - 4096 ELSE v END AS stored FROM (SELECT p_partkey, (((p_partkey * 40503) % 65536) // 4) % 4096 AS v FROM part)")
def stored_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 signed bits below bit 13 of a 16-bit container (FN-39)."""
    return part(spark, sf_dir, pixels.stored_value((K("p_partkey") * 40503) % 65536, 16, 12, 13, True).cast("bigint").alias("stored"))


@query(
    "points_in_shapes",
    """
    SELECT p_partkey, c BETWEEN 5 AND 15 AND r BETWEEN 3 AND 12 AS rectangle, (r - 10) * 2 * ((r - 10) * 2) + (c - 10) * (c - 10) <= 64 AS circle, r + c <= 20 AS triangle,
           r <= 20 AND c <= 20 AND (r <= 10 OR c <= 10) AS corner
    FROM (SELECT p_partkey, p_partkey % 24 AS r, (p_partkey // 24) % 24 AS c FROM part)
    """,
)
def points_in_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles, circles scaled by the pixel aspect, and polygons with their edges (FN-36, FN-37)."""
    r, c = K("p_partkey") % 24, F.floor(K("p_partkey") / 24) % 24
    points = lambda *ps: F.array(*[F.array(*[F.lit(x).cast("bigint") for x in p]) for p in ps])
    return part(
        spark,
        sf_dir,
        shapes.in_rectangle(r, c, F.lit(5), F.lit(15), F.lit(3), F.lit(12)).alias("rectangle"),
        shapes.in_circle(r, c, F.lit(10), F.lit(10), F.lit(8), F.lit(2.0)).alias("circle"),
        shapes.in_polygon(points((0, 0), (0, 20), (20, 0)), r, c).alias("triangle"),
        shapes.in_polygon(points((0, 0), (0, 20), (10, 20), (10, 10), (20, 10), (20, 0)), r, c).alias("corner"),
    )


@query(
    "overlay_bits",
    """
    SELECT p_partkey, r BETWEEN 1 AND 4 AND c BETWEEN 2 AND 5 AND (word >> greatest(0, least(15, (r - 1) * 4 + c - 2))) & 1 = 1 AS covered
    FROM (SELECT p_partkey, p_partkey % 7 AS r, (p_partkey // 7) % 7 AS c, (p_partkey * 30011) % 65536 AS word FROM part)
    """,
)
def overlay_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 4 x 4 overlay that begins at row 2, column 3 (FN-38)."""
    one = F.lit(4)
    found = shapes.overlay_bit(F.array(((K("p_partkey") * 30011) % 65536).cast("bigint")), one, one, F.lit(2), F.lit(3), F.lit(0), K("p_partkey") % 7, F.floor(K("p_partkey") / 7) % 7)
    return part(spark, sf_dir, found.alias("covered"))


@query(
    "edited_boxes",
    """
    WITH b AS (SELECT p_partkey, p_size % 30 AS y0, p_partkey % 40 AS x0, p_size % 30 + 5 + p_size % 3 AS y1, p_partkey % 40 + 8 AS x1 FROM part)
    SELECT p_partkey, greatest(0, least(y0 + 3, 50 - (y1 - y0)))::BIGINT AS moved_y, greatest(0, least(x0 - 9, 45 - (x1 - x0)))::BIGINT AS moved_x,
           CASE WHEN y1 > 30 OR x1 > 45 THEN 'out_of_bounds' END AS problem, least(y1, y0 + 2)::BIGINT AS top, greatest(y1, y0 + 2)::BIGINT AS bottom FROM b
    """,
)
def edited_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes moved inside the image, checked, and resized by an edge (FN-57, FN-60)."""
    s, k = K("p_size") % 30, K("p_partkey") % 40
    box = F.array(*[x.cast("bigint") for x in (s, k, s + 5 + K("p_size") % 3, k + 8)])
    moved = shapes.moved_box(box, F.lit(-9.0), F.lit(3.0), F.lit(50), F.lit(45))
    resized = shapes.resized_box(box, "n", F.lit(0.0), (s + 2).cast("double"), F.lit(50), F.lit(45))
    # the dragged edge stops at 2 rows below the old one, above the other edge
    return part(spark, sf_dir, moved[0].alias("moved_y"), moved[1].alias("moved_x"), shapes.box_problem(shapes.canonical_box(box), F.lit(30), F.lit(45)).alias("problem"), resized[0].alias("top"), resized[2].alias("bottom"))


@query("outer_boxes", "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_tax * 100 + 0.25)::BIGINT AS y0, ceil(l_quantity * 1.5)::BIGINT AS x1 FROM lineitem")
def outer_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least whole box around a rectangle (FN-56)."""
    rect = F.struct(F.lit(0.5).alias("x0"), (K("l_tax") * 100 + 0.25).cast("double").alias("y0"), (K("l_quantity") * 1.5).cast("double").alias("x1"), F.lit(50.0).alias("y1"))
    box = shapes.box_of(rect)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box[0].alias("y0"), box[3].alias("x1"))


@query("roi_frames_in_force", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN event_id % 5 = user_id % 5 ELSE false END AS shown FROM events")
def roi_frames_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No outer list is every frame, an empty own list none (FLT-14)."""
    none = F.array().cast("array<array<int>>")
    lists = F.when(K("event_id") % 3 == 0, none).when(K("event_id") % 3 == 1, F.array(F.array((K("user_id") % 5).cast("int")))).otherwise(F.array(F.array().cast("array<int>")))
    return table(spark, sf_dir, "events").select("event_id", shapes.visible_frames(lists, F.lit(0), (K("event_id") % 5).cast("int")).alias("shown"))


@query("mask_alpha", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 178 END AS solid, CASE WHEN p_partkey % 256 = 0 THEN 0 ELSE (p_partkey % 256) * 204 // 255 END AS shade FROM part")
def mask_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opacity of binary and fractional masks (FN-29)."""
    rgb = F.array(F.lit(1), F.lit(2), F.lit(3))
    solid, shade = values.segment_pixel(K("p_size") % 4, rgb), values.segment_pixel(K("p_partkey") % 256, rgb, F.lit(255))
    return part(spark, sf_dir, solid[3].alias("solid"), shade[3].cast("bigint").alias("shade"))


@query(
    "segment_colors",
    """
    SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN round(p_partkey * 31 % 65536 * 255.0 / 65535.0)::INTEGER ELSE [255, 42, 255, 136, 114, 255][greatest(p_size - 1, 0) % 6 + 1] END AS red,
           CASE WHEN p_size % 5 = 0 THEN 'recommended_grayscale' ELSE 'palette' END AS source FROM part
    """,
)
def segment_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommended grays, else the palette by number (FN-30)."""
    color = values.segment_color(K("p_size"), F.lit(None).cast("array<double>"), F.when(K("p_size") % 5 == 0, K("p_partkey") * 31 % 65536))
    return part(spark, sf_dir, color.alias("c")).select("p_partkey", F.col("c.rgb")[0].alias("red"), "c.source")


@query(
    "ybr_colors",
    """
    SELECT p_partkey, least(greatest(round(y + 1.402::DOUBLE * (cr - 128)), 0), 255)::INTEGER AS red, least(greatest(round(y + 1.772::DOUBLE * (cb - 128)), 0), 255)::INTEGER AS blue
    FROM (SELECT p_partkey, p_partkey % 256 AS y, p_partkey * 7 % 256 AS cb, p_partkey * 13 % 256 AS cr FROM part)
    """,
)
def ybr_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-range YCbCr to RGB (FN-32)."""
    k = K("p_partkey").cast("double")
    rgb = values.ybr_to_rgb(k % 256, k * 7 % 256, k * 13 % 256)
    return part(spark, sf_dir, rgb.alias("c")).select("p_partkey", F.col("c")[0].alias("red"), F.col("c")[2].alias("blue"))


@query("palette_colors", "SELECT p_partkey, [10, 20, 30, 40][greatest(least(p_size - 5, 3), 0) + 1] AS red, [1, 2, 3, 4][greatest(least(p_size - 5, 3), 0) + 1] AS blue FROM part")
def palette_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette entries by index minus the first, clamped (FN-34)."""
    table_of = lambda *xs: F.array(*[F.lit(x) for x in xs])
    rgb = values.palette_lookup(K("p_size"), F.lit(5), table_of(10, 20, 30, 40), table_of(5, 6, 7, 8), table_of(1, 2, 3, 4))
    return part(spark, sf_dir, rgb.alias("c")).select("p_partkey", F.col("c")[0].alias("red"), F.col("c")[2].alias("blue"))


@query("planar_samples", "SELECT p_partkey, array_to_string([k, k + 3, k + 6, k + 1, k + 4, k + 7, k + 2, k + 5, k + 8], ',') AS samples FROM (SELECT p_partkey, p_partkey % 100 AS k FROM part)")
def planar_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three planes of three pixels to interleaved order (FN-33)."""
    own = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: K("p_partkey") % 100 + i)
    return part(spark, sf_dir, listed(values.interleave(own, F.lit(3))).alias("samples"))


@query("wash_alpha", "SELECT event_id, CASE WHEN value <= 20 THEN 0 ELSE 255 END AS alpha FROM events")
def wash_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour wash is transparent at and below its floor (FN-28)."""
    return table(spark, sf_dir, "events").select("event_id", values.color_wash(K("value"), F.lit(0.0), F.lit(100.0), F.lit(20.0))[3].alias("alpha"))


@query("dose_maps", "SELECT p_partkey, CASE WHEN p_size % 6 > 0 THEN (p_size % 6) * 0.5 * p_partkey::DOUBLE END AS dose FROM part")
def dose_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dose grid's scaling as a linear map, none where it isn't positive (FN-14)."""
    m = values.dose_map((K("p_size") % 6) * F.lit(0.5))
    return part(spark, sf_dir, F.when(m.isNotNull(), values.mapped_value(m, K("p_partkey").cast("double"))).alias("dose"))


@query("valid_maps", "SELECT p_partkey, p_size % 4 <> 0 AND p_partkey % 10 <= p_size AND p_size % 3 <> 0 AS valid FROM part")
def valid_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps with a finite ordered range, a transform and units (CTX-7)."""
    s = K("p_size").cast("double")
    m = F.struct((K("p_partkey") % 10).cast("double").alias("first"), s.alias("last"), F.when(s % 4 != 0, s).alias("slope"), F.lit(0.0).alias("intercept"), F.array().cast("array<double>").alias("lut"))
    return part(spark, sf_dir, values.valid_map(m, F.when(K("p_size") % 3 != 0, "mm")).alias("valid"))


@query("mapped_windows", "SELECT p_partkey, (p_partkey - 10.0) / 4 AS center, p_size / 4.0 AS width FROM part")
def mapped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows in real-world units as stored units (CTX-46)."""
    w = values.mapped_window(K("p_partkey").cast("double"), K("p_size").cast("double"), F.lit(4.0), F.lit(10.0))
    return part(spark, sf_dir, w.alias("w")).select("p_partkey", "w.center", "w.width")


@query(
    "pixels_under_cursor",
    """
    SELECT p_partkey, CASE WHEN ok THEN floor(y)::BIGINT * 30 + floor(x)::BIGINT END AS pixel, CASE WHEN ok THEN (floor(y)::BIGINT * 30 + floor(x)::BIGINT) * 3 + 2 END AS sample
    FROM (SELECT *, x >= 0 AND y >= 0 AND x < 30 AND y < 20 AS ok FROM (SELECT p_partkey, p_size - 10.5 AS x, p_partkey % 25 - 2.25 AS y FROM part))
    """,
)
def pixels_under_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel under a point and the position of a channel's sample (CTX-48, CTX-49)."""
    at = values.pixel_at((K("p_size") - 10.5).cast("double"), (K("p_partkey") % 25 - 2.25).cast("double"), F.lit(20), F.lit(30))
    index = lambda n, c: values.sample_index(at, F.lit(30), F.lit(600), n, c, F.lit(0)).cast("bigint")
    return part(spark, sf_dir, index(1, 0).alias("pixel"), index(3, 2).alias("sample"))


@query(
    "sparse_tiles",
    """
    SELECT p_partkey, CASE WHEN ok THEN x END::BIGINT AS x, CASE WHEN ok THEN least(8, 40 - x) END::BIGINT AS width, CASE WHEN ok AND x % 8 = 0 THEN x // 8 END::BIGINT AS tile_column
    FROM (SELECT *, x >= 0 AND y >= 0 AND x < 40 AND y < 30 AS ok FROM (SELECT p_partkey, p_size - 1 AS x, p_partkey % 35 - 1 AS y FROM part))
    """,
)
def sparse_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles placed by a position from 1, clipped, numbered only on the grid (FN-75)."""
    t = tiles.sparse_tile((K("p_partkey") % 35).cast("bigint"), K("p_size").cast("bigint"), F.lit(30), F.lit(40), F.lit(8), F.lit(8))
    return part(spark, sf_dir, t.alias("t")).select("p_partkey", *[F.col(f"t.{n}").cast("bigint").alias(n) for n in ("x", "width", "tile_column")])


@query(
    "reduction_shifts",
    """
    SELECT p_partkey, CASE WHEN (c >> 3) >= 200 AND (r >> 3) >= 100 THEN 3 WHEN (c >> 2) >= 200 AND (r >> 2) >= 100 THEN 2 WHEN (c >> 1) >= 200 AND (r >> 1) >= 100 THEN 1 END AS shift
    FROM (SELECT p_partkey, p_size * 60 AS c, (p_partkey % 50) * 40 AS r FROM part)
    """,
)
def reduction_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest reduction that leaves twice the thumbnail (FN-49)."""
    shift = tiles.reduction_shift(((K("p_partkey") % 50) * 40).cast("bigint"), (K("p_size") * 60).cast("bigint"), F.struct(F.lit(100).alias("width"), F.lit(50).alias("height")), 3)
    return part(spark, sf_dir, shift.alias("shift"))


@query("focal_planes", "SELECT p_partkey, CASE WHEN p_size % 5 < 4 THEN (p_size % 5)::BIGINT END AS plane FROM part")
def focal_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of a depth among the distinct ones (AGG-22)."""
    return part(spark, sf_dir, tiles.focal_index(doubles(3, 0, 1, 1, 2, 3), (K("p_size") % 5).cast("double")).cast("bigint").alias("plane"))


def grid(position: Column, rows: int | Column = 50, spacing: Column | float = 1.0) -> Column:
    return F.struct(position.alias("position"), doubles(1, 0, 0, 0, 1, 0).alias("orientation"), doubles(spacing, spacing).alias("spacing"), F.lit(rows).alias("rows"), F.lit(60).alias("columns"))


@query("valid_grids", "SELECT p_partkey, p_size % 4 <> 0 AND p_partkey % 3 <> 0 AS valid FROM part")
def valid_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids need positive sizes and spacing (FN-19)."""
    return part(spark, sf_dir, geometry.valid_geometry(grid(doubles(1, 2, 3), K("p_size") % 4, (K("p_partkey") % 3).cast("double"))).alias("valid"))


@query(
    "grid_transforms",
    """
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size / 2.0 END AS flat_row, p_size / 2.0 AS row, (p_partkey % 7) / 2.0 AS col FROM part
    """,
)
def grid_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a target's first pixel lies in a source grid, with and without one common plane (FN-20, FN-21)."""
    source, target = grid(doubles(0, 0, 0), 50, 2.0), grid(doubles(K("p_partkey") % 7, K("p_size"), K("p_size") % 3))
    flat, free = geometry.coplanar_transform(source, target), geometry.in_plane_transform(source, target)
    return part(spark, sf_dir, flat["origin"][0].alias("flat_row"), free["origin"][0].alias("row"), free["origin"][1].alias("col"))


@query("pixel_aspects", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN (p_size % 3) / 2.0 WHEN p_partkey % 2 = 1 THEN 0.75 END AS aspect FROM part")
def pixel_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspect from spacing, else from the ratio (CTX-54)."""
    found = geometry.pixel_aspect(doubles(K("p_size") % 3, 2), F.when(K("p_partkey") % 2 == 1, doubles(3, 4)))
    return part(spark, sf_dir, found[0].alias("aspect"))


@query("volume_extents", "SELECT p_partkey, (p_size - 1)::DOUBLE AS low, (p_size + 8)::DOUBLE AS high, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS second FROM part")
def volume_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a spacing beyond both ends; dose offsets count from the first one (FN-25, CTX-8)."""
    s = K("p_size")
    e = geometry.extent(doubles(s, s + 2, s + 6))
    dose = geometry.dose_offsets(doubles(3, s + 3), F.when(s % 2 == 0, 2).otherwise(3))
    return part(spark, sf_dir, e["low"].alias("low"), e["high"].alias("high"), dose[1].alias("second"))


@query("named_frames", "SELECT event_id, array_to_string(CASE WHEN event_id % 3 = 0 THEN [0, 1, 2, 3] ELSE [x - 1 FOR x IN [user_id % 7, 2] IF x BETWEEN 1 AND 4 AND NOT (x = 2 AND user_id % 7 = 2)] || CASE WHEN user_id % 7 = 2 THEN [1] ELSE [] END END, ',') AS frames FROM events")
def named_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame numbers from 1 to distinct indexes in range; none named is all (JOIN-4)."""
    numbers = F.when(K("event_id") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((K("user_id") % 7).cast("int"), F.lit(2)))
    return table(spark, sf_dir, "events").select("event_id", listed(links.navigable_frames(numbers, F.lit(4))).alias("frames"))


@query("prefetched_frames", "SELECT p_partkey, array_to_string([x FOR x IN CASE WHEN p_partkey % 2 = 0 THEN [c + 1, c - 1, c + 2, c - 2] ELSE [c - 1, c + 1, c - 2, c + 2] END IF x >= 0 AND x < 20], ',') AS frames FROM (SELECT p_partkey, p_size % 20 AS c FROM part)")
def prefetched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by distance, the preferred direction first (WIN-7)."""
    return part(spark, sf_dir, listed(series.prefetch_order((K("p_size") % 20).cast("int"), F.lit(20), 2, K("p_partkey") % 2 == 0)).alias("frames"))


@query("prefetch_plans", "SELECT p_partkey, CASE WHEN p_size <= 25 THEN 9 WHEN p_size % 2 = 0 THEN 3 ELSE least(c, 2) + least(9 - c, 2) END AS n FROM (SELECT p_partkey, p_size, p_partkey % 10 AS c FROM part)")
def prefetch_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stack if it fits, the frames ahead in cine mode, else the neighbours (CTX-52)."""
    plan = series.prefetch_plan((K("p_partkey") % 10).cast("int"), F.lit(10), K("p_size") * 10, 2500, 2, F.when(K("p_size") % 2 == 0, 3), F.lit(True))
    return part(spark, sf_dir, F.size(plan).cast("bigint").alias("n"))


@query("key_schemes", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'sop' WHEN 1 THEN 'content' END AS scheme FROM part")
def key_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by identifier and by content; ill-formed ones have no scheme (FN-52)."""
    key = pick(K("p_partkey"), "sop:1.2.3_a-b", "b3:" + "0f" * 32, "sop:", "b3:" + "0F" * 32, "sop:" + "1" * 129)
    return part(spark, sf_dir, identity.key_scheme(key).alias("scheme"))


@query(
    "display_texts",
    """
    SELECT o_orderkey, CASE WHEN length(o_orderkey || '.' || o_custkey || '.123456789') <= 18 THEN o_orderkey || '.' || o_custkey || '.123456789' ELSE '...' || right(o_orderkey || '.' || o_custkey || '.123456789', 15) END AS uid,
           strftime(o_orderdate, '%Y-%m-%d') AS day, 'Doe ' || o_custkey AS name FROM orders
    """,
)
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortened identifiers, dates and person names (FN-53)."""
    uid = F.concat_ws(".", K("o_orderkey").cast("string"), K("o_custkey").cast("string"), F.lit("123456789"))
    day = text.date_text(F.date_format("o_orderdate", "yyyyMMdd"))
    name = text.person_name(F.concat(F.lit(" Doe^"), K("o_custkey").cast("string"), F.lit("^^ ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.short_uid(uid).alias("uid"), day.alias("day"), name.alias("name"))


@query("normal_paths", "SELECT o_orderkey, '/data/' || o_orderkey || '/x' AS path FROM orders")
def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dots in paths are resolved as text (FN-61)."""
    path = F.concat(F.lit("/data/./"), K("o_custkey").cast("string"), F.lit("/../"), K("o_orderkey").cast("string"), F.lit("//y/../x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.normalized_path(path).alias("path"))


@query("shared_folder", "SELECT n_regionkey, CASE WHEN min(n_nationkey) = max(n_nationkey) THEN '/data/' || n_regionkey || '/' || min(n_nationkey) ELSE '/data/' || n_regionkey END AS folder FROM nation GROUP BY n_regionkey")
def shared_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest folder that all files of a group share, from the least and the greatest one (FN-62)."""
    folder = F.array(F.lit("data"), K("n_regionkey").cast("string"), K("n_nationkey").cast("string"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(text.common_prefix(F.min(folder), F.max(folder)).alias("parts"))
    return rows.select("n_regionkey", F.concat(F.lit("/"), F.array_join("parts", "/")).alias("folder"))


@query("numeric_text_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size % 3 = 0), CASE WHEN p_size % 3 <> 0 THEN p_size / 2.0 END, p_partkey) AS place FROM part")
def numeric_text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that begin with a number come first, by that number (SORT-8)."""
    from pyspark.sql import Window as W

    value = F.when(K("p_size") % 3 == 0, "series").otherwise(F.concat((K("p_size") / 2.0).cast("string"), F.lit(" mm")))
    rows = part(spark, sf_dir, K("p_brand"), value.alias("v"))
    return rows.select("p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy(*text.numeric_first(F.col("v")), "p_partkey")).cast("bigint").alias("place"))


@query("present_frames", "SELECT p_partkey, greatest(1, CASE WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 2 = 0 THEN least(b, 6) ELSE least(b, p_partkey % 90 // 8) END) AS frames FROM (SELECT *, CASE WHEN p_size % 3 > 0 THEN least(p_partkey % 12, p_size % 3 * 4) ELSE p_partkey % 12 END AS b FROM part)")
def present_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that a file can hold: declared, itemised, and by the length of its pixels (SRC-8)."""
    found = scan.present_frames(K("p_partkey") % 12, K("p_size") % 3 * 4, K("p_size") % 5 != 0, F.when(K("p_size") % 2 == 0, 6), K("p_partkey") % 90)
    return part(spark, sf_dir, found.cast("bigint").alias("frames"))


@query("frame_fallbacks", "SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN 1 WHEN p_size % 3 = 0 THEN 5 ELSE 9 END)::DOUBLE AS first, 2::DOUBLE AS second FROM part")
def frame_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's own value, else the shared one, else the file's (SRC-9)."""
    own = F.array(F.when(K("p_size") % 2 == 0, 1.0), F.lit(2.0))
    found = scan.frame_values(own, F.when(K("p_size") % 3 == 0, 5.0), F.lit(9.0))
    return part(spark, sf_dir, found[0].alias("first"), found[1].alias("second"))


@query("file_labels", "SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN p_name ELSE concat_ws(' · ', CASE WHEN p_size % 2 <> 0 THEN p_brand END, CASE WHEN p_size % 3 <> 0 THEN p_type END) END AS label FROM part")
def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the fields that are there, else the name (SRC-12)."""
    label = text.label(F.when(K("p_size") % 2 != 0, K("p_brand")).otherwise(""), F.when(K("p_size") % 3 != 0, K("p_type")).otherwise(""), F.lit(""), K("p_name"))
    return part(spark, sf_dir, label.alias("label"))


@query("format_sniff", "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'dicom' WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'tiff' WHEN 4 THEN 'webp' WHEN 5 THEN 'dicom' END AS format FROM pages")
def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by the first 132 bytes, the mark at offset 128 above all signatures (SRC-4)."""
    head = pick(K("page_id"), "00" * 128 + "4449434D", "89504E470D0A1A0A", "FFD8FFE0", "4D4D002A", "524946461122334457454250", "FFD8FF" + "00" * 125 + "4449434D", "00")
    content = F.concat(F.unhex(head), F.encode("html", "utf-8"))
    return table(spark, sf_dir, "pages").select("page_id", scan.sniff(content).alias("format"))


@query("first_digests", "SELECT o_custkey::VARCHAR AS key, (o_orderkey % 3)::BIGINT AS frame, arg_min(o_orderpriority, o_orderkey) AS digest FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1, 2")
def first_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a key's copies, the first listed that has a digest of the frame (CTX-38)."""
    copies = table(spark, sf_dir, "orders").select(K("o_custkey").cast("string").alias("key"), (K("o_orderkey") % 3).cast("bigint").alias("frame"), K("o_orderkey").alias("position"), F.when(K("o_orderkey") % 4 != 0, K("o_orderpriority")).alias("digest"))
    return identity.first_digests(copies)


@query("agreed_profiles", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS profile FROM orders GROUP BY 1")
def agreed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile counts only where every occurrence is identical (CTX-55)."""
    return identity.one_profile(table(spark, sf_dir, "orders").select("o_custkey", K("o_orderstatus").alias("profile")), "o_custkey")


@query("key_holders", "SELECT o_custkey AS key, min(o_orderkey) AS seq FROM orders GROUP BY 1")
def key_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first holder of each shown key (CTX-37)."""
    return identity.file_for_key(table(spark, sf_dir, "orders").select(K("o_custkey").alias("key"), K("o_orderkey").alias("seq")))


@query(
    "shapes_on_a_frame",
    """
    SELECT event_id, CASE WHEN event_type = 'view' THEN 'red' WHEN event_type = 'click' THEN 'green' END AS color FROM events
    WHERE event_type <> 'purchase' AND user_id % 4 <> 1 AND event_id % 3 <> 0 AND (event_id % 2 = 0 OR user_id % 5 = 2)
    """,
)
def shapes_on_a_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of a frame without hidden layers and classes, coloured by layer, else by class (FLT-11)."""
    rows = table(spark, sf_dir, "events").select("event_id", K("event_type").alias("class"), (K("user_id") % 4).cast("string").alias("layer"), F.when(K("event_id") % 3 == 0, "mask").otherwise("rect").alias("type"), (K("event_id") % 2 == 0).alias("all_frames"), F.array((K("user_id") % 5).cast("int")).alias("frames"))
    layers = spark.createDataFrame([("9", "blue")], "id string, color string")
    classes = spark.createDataFrame([("view", "red", "View"), ("click", "green", "Click")], "id string, color string, name string")
    return annotations.visible_shapes(rows, layers, classes, F.lit(2), ["1"], ["purchase"]).select("event_id", "color")
