"""Array queries: distributions, windows, lookup tables, value maps, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.functions import geometry, pixels, tiles, values
from lumenstack.operators import histogram
from lumenstack.registry import query
from lumenstack.session import table

SPAN = "low + greatest(high - low, 1.0) / 2.0 AS center, greatest(high - low, 1.0) AS width"
#: The linear function of a sample x, centre c and width w as SQL.
LINEAR_SQL = """CASE WHEN {x} <= {c} - 0.5 - ({w} - 1) / 2.0 THEN 0 WHEN {x} > {c} - 0.5 + ({w} - 1) / 2.0 OR {w} = 1 THEN 255
                     ELSE CAST(round((({x} - ({c} - 0.5)) / nullif({w} - 1, 0) + 0.5) * 255) AS INTEGER) END"""


@query("value_histogram", "SELECT l_quantity AS value, count(*) AS n, sum(count(*)) OVER (ORDER BY l_quantity)::BIGINT AS upto FROM lineitem GROUP BY l_quantity")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values, counts and running counts (AGG-8, AGG-9); the window runs over distinct values only."""
    from pyspark.sql import Window as W

    counts = histogram.distribution(table(spark, sf_dir, "lineitem"), [], "l_quantity")
    return counts.select(F.col("l_quantity").alias("value"), F.col("count").alias("n"), F.sum("count").over(W.orderBy("l_quantity")).alias("upto"))


@query(
    "percentile_window",
    f"""
    WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
         p AS (SELECT l_returnflag, max(v) FILTER (i = floor(n * 0.01)) AS low, max(v) FILTER (i = least(ceil(n * 0.99), n - 1)) AS high FROM r GROUP BY l_returnflag)
    SELECT l_returnflag, low, high, {SPAN} FROM p
    """,
)
def percentile_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1 % and 99 % order statistics by index (AGG-10, FN-9), over a column of many distinct values."""
    return histogram.percentile_window_of_rows(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")


@query(
    "percentile_window_stored",
    f"""
    WITH r AS (SELECT l_returnflag, l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
         p AS (SELECT l_returnflag, max(v) FILTER (i = floor(n * 0.01)) AS low, max(v) FILTER (i = least(ceil(n * 0.99), n - 1)) AS high FROM r GROUP BY l_returnflag)
    SELECT l_returnflag, low, high, {SPAN} FROM p
    """,
)
def percentile_window_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over few distinct values, from their distribution (AGG-8 to AGG-10)."""
    counts = histogram.distribution(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return histogram.percentile_window(counts, ["l_returnflag"], "l_quantity")


@query("full_dynamic_window", f"SELECT event_type, low, high, {SPAN} FROM (SELECT event_type, min(value) AS low, max(value) AS high FROM events GROUP BY event_type)")
def full_dynamic_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact least and greatest value (AGG-11)."""
    return histogram.full_dynamic_window(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("linear_window_bytes", f"SELECT byte, count(*) AS n FROM (SELECT {LINEAR_SQL.format(x='l_quantity', c='25.0', w='30.0')} AS byte FROM lineitem) GROUP BY byte")
def linear_window_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear function by distinct value, as a histogram of bytes (FN-3)."""
    counts = histogram.distribution(table(spark, sf_dir, "lineitem"), [], "l_quantity")
    byte = pixels.linear_byte(F.col("l_quantity"), F.lit(25.0), F.lit(30.0))
    return counts.groupBy(byte.alias("byte")).agg(F.sum("count").alias("n"))


@query("exact_window_bytes", "SELECT CAST(round(least(greatest((value - (50.0 - 80.0 / 2)) / 80.0, 0.0), 1.0) * 255) AS INTEGER) AS byte, count(*) AS n FROM events GROUP BY 1")
def exact_window_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The continuous function (FN-4)."""
    byte = pixels.exact_byte(F.col("value"), F.lit(50.0), F.lit(80.0))
    return table(spark, sf_dir, "events").groupBy(byte.alias("byte")).agg(F.count("*").alias("n"))


@query(
    "modality_lut",
    "SELECT l_linenumber, ([0, 1024, 2048, 4095])[least(greatest(l_linenumber - 2, 0), 3) + 1]::DOUBLE AS value, count(*) AS n FROM lineitem GROUP BY l_linenumber",
)
def modality_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup table clamped at both ends replaces slope and intercept (FN-1, FN-2)."""
    lut = pixels.lut_literal(2, 16, [0, 1024, 2048, 4095])
    counts = histogram.distribution(table(spark, sf_dir, "lineitem"), [], "l_linenumber")
    return counts.select("l_linenumber", pixels.modality_value(F.col("l_linenumber"), F.lit(99.0), F.lit(-20.0), lut).alias("value"), F.col("count").alias("n"))


@query(
    "voi_lut_scaled",
    "SELECT l_linenumber, CAST((([0, 17, 80, 4000, 65535])[least(greatest(l_linenumber - 1, 0), 4) + 1] * 255 + 65535 // 2) // 65535 AS INTEGER) AS byte, count(*) AS n FROM lineitem GROUP BY l_linenumber",
)
def voi_lut_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A presentation table scaled to 8 bits in integers (FN-6)."""
    lut = pixels.lut_literal(1, 16, [0, 17, 80, 4000, 65535])
    counts = histogram.distribution(table(spark, sf_dir, "lineitem"), [], "l_linenumber")
    return counts.select("l_linenumber", pixels.voi_lut_byte(lut, F.col("l_linenumber")).alias("byte"), F.col("count").alias("n"))


@query(
    "padding_exclusion",
    f"""
    WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n
               FROM lineitem WHERE NOT (l_extendedprice BETWEEN 0 AND 5000)),
         p AS (SELECT l_returnflag, max(v) FILTER (i = floor(n * 0.01)) AS low, max(v) FILTER (i = least(ceil(n * 0.99), n - 1)) AS high FROM r GROUP BY l_returnflag)
    SELECT l_returnflag, low, high, {SPAN} FROM p
    """,
)
def padding_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic windows ignore padding, whose range may come in either order (FLT-13, AGG-13)."""
    counts = histogram.distribution(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    padding = pixels.is_padding(F.col("l_extendedprice"), F.lit(5000.0), F.lit(0.0))
    mapped = histogram.mapped_distribution(counts, ["l_returnflag"], "value", F.col("l_extendedprice"), padding)
    return histogram.percentile_window(mapped, ["l_returnflag"], "value")


@query(
    "monochrome_inversion",
    f"SELECT byte, count(*) AS n FROM (SELECT CASE WHEN l_discount >= 0.09 THEN 0 WHEN l_returnflag = 'R' THEN 255 - b ELSE b END AS byte FROM (SELECT l_discount, l_returnflag, {LINEAR_SQL.format(x='l_quantity', c='25.0', w='30.0')} AS b FROM lineitem)) GROUP BY byte",
)
def monochrome_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inversion, then padding as black whatever the interpretation (FN-10, FN-11)."""
    photometric = F.when(F.col("l_returnflag") == "R", "MONOCHROME1").otherwise("MONOCHROME2")
    byte = pixels.finish_byte(pixels.linear_byte(F.col("l_quantity"), F.lit(25.0), F.lit(30.0)), photometric, F.col("l_discount") >= 0.09)
    return table(spark, sf_dir, "lineitem").groupBy(byte.alias("byte")).agg(F.count("*").alias("n"))


@query("real_world_map", "SELECT l_quantity, CASE WHEN l_quantity BETWEEN 10 AND 40 THEN round(l_quantity * 0.25 - 1.5, 6) END AS value, count(*) AS n FROM lineitem GROUP BY l_quantity")
def real_world_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear map, null outside its range (FN-12)."""
    m = F.struct(F.lit(10.0).alias("first"), F.lit(40.0).alias("last"), F.lit(0.25).alias("slope"), F.lit(-1.5).alias("intercept"), F.array().cast("array<double>").alias("lut"))
    counts = histogram.distribution(table(spark, sf_dir, "lineitem"), [], "l_quantity")
    return counts.select("l_quantity", F.round(values.mapped_value(m, F.col("l_quantity")), 6).alias("value"), F.col("count").alias("n"))


@query("legend_range", "SELECT label, min(x)::DOUBLE AS low, max(x)::DOUBLE AS high FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY label")
def legend_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite range of all samples of a volume (AGG-14); each row's own range is taken before the shuffle."""
    own = table(spark, sf_dir, "embeddings").select("label", F.explode(F.transform(F.array(F.array_min("embedding"), F.array_max("embedding")), lambda x: x.cast("double"))).alias("x"))
    return histogram.value_range(own, ["label"], "x")


def _stops(k: int) -> str:
    return "[" + ", ".join(str(c[k]) for c in values.COLOR_STOPS) + "]"


_COLOR_SQL = ", ".join(f"CAST(round(({_stops(k)})[lo + 1] + (({_stops(k)})[least(lo + 1, 8) + 1] - ({_stops(k)})[lo + 1]) * (p * 8 - lo)) AS INTEGER) AS {c}" for k, c in enumerate("rgb"))


@query("colormap_rgb", f"SELECT l_quantity, {_COLOR_SQL} FROM (SELECT DISTINCT l_quantity, least(greatest(l_quantity / 50.0, 0), 1) AS p, least(CAST(floor(least(greatest(l_quantity / 50.0, 0), 1) * 8) AS INTEGER), 8) AS lo FROM lineitem)")
def colormap_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours along the stops, linear between them (FN-27)."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity").distinct().withColumn("c", values.colormap(F.col("l_quantity") / 50.0))
    return rows.select("l_quantity", *[F.col("c")[k].alias(n) for k, n in enumerate("rgb")])


@query(
    "bilinear_grid",
    """
    WITH g AS (SELECT n_nationkey // 5 AS r, n_nationkey % 5 AS c, CAST(n_regionkey * 10 + n_nationkey AS DOUBLE) AS v FROM nation),
         q AS (SELECT p_partkey, (p_partkey % 41) / 10.0 AS row, (p_partkey % 37) / 9.0 AS col FROM part),
         f AS (SELECT p_partkey, row, col, floor(row) AS r0, floor(col) AS c0, least(floor(row) + 1, 4) AS r1, least(floor(col) + 1, 4) AS c1 FROM q)
    SELECT p_partkey, round((a.v * (1 - (col - c0)) + b.v * (col - c0)) * (1 - (row - r0)) + (d.v * (1 - (col - c0)) + e.v * (col - c0)) * (row - r0), 6) AS value
    FROM f JOIN g a ON a.r = r0 AND a.c = c0 JOIN g b ON b.r = r0 AND b.c = c1 JOIN g d ON d.r = r1 AND d.c = c0 JOIN g e ON e.r = r1 AND e.c = c1
    """,
)
def bilinear_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear samples of a 5 x 5 grid, held as one array (FN-23)."""
    grid = table(spark, sf_dir, "nation").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", (F.col("n_regionkey") * 10 + F.col("n_nationkey")).cast("double").alias("v")))), lambda x: x["v"]).alias("grid"))
    points = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 41 / 10.0).alias("row"), (F.col("p_partkey") % 37 / 9.0).alias("col"))
    value = geometry.bilinear(F.col("grid"), F.lit(5), F.lit(5), F.col("row"), F.col("col"))
    return points.join(F.broadcast(grid)).select("p_partkey", F.round(value, 6).alias("value"))


@query(
    "tile_placement",
    """
    WITH t AS (SELECT event_id, event_id % 63 AS spatial FROM events WHERE event_id < 63 * 2 * 3)
    SELECT event_id, spatial // 9 AS tile_row, spatial % 9 AS tile_column, CAST(event_id // 63 % 2 AS INTEGER) AS path, CAST(event_id // 126 AS INTEGER) AS plane,
           least(100, 850 - spatial % 9 * 100) AS width, least(50, 330 - spatial // 9 * 50) AS height FROM t
    """,
)
def tile_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a 7 x 9 tile grid in raster order, with clipped edge tiles (FN-74)."""
    placed = tiles.tiled_full(F.col("event_id"), F.lit(330), F.lit(850), F.lit(50), F.lit(100), F.lit(2), F.lit(3))
    rows = table(spark, sf_dir, "events").select("event_id", placed.alias("t")).where("t is not null")
    return rows.select("event_id", *[F.col(f"t.{c}").alias(c) for c in ("tile_row", "tile_column", "path", "plane", "width", "height")])


@query(
    "vector_geometry",
    """
    WITH v AS (SELECT vec_id, embedding[1]::DOUBLE a1, embedding[2]::DOUBLE a2, embedding[3]::DOUBLE a3, embedding[4]::DOUBLE b1, embedding[5]::DOUBLE b2, embedding[6]::DOUBLE b3 FROM embeddings),
         n AS (SELECT vec_id, a1 / sqrt(a1*a1 + a2*a2 + a3*a3) a1, a2 / sqrt(a1*a1 + a2*a2 + a3*a3) a2, a3 / sqrt(a1*a1 + a2*a2 + a3*a3) a3,
                      b1 / sqrt(b1*b1 + b2*b2 + b3*b3) b1, b2 / sqrt(b1*b1 + b2*b2 + b3*b3) b2, b3 / sqrt(b1*b1 + b2*b2 + b3*b3) b3 FROM v),
         c AS (SELECT vec_id, a2*b3 - a3*b2 AS x, a3*b1 - a1*b3 AS y, a1*b2 - a2*b1 AS z FROM n)
    SELECT vec_id, round(x / sqrt(x*x + y*y + z*z), 6) AS nx, round(y / sqrt(x*x + y*y + z*z), 6) AS ny, round(z / sqrt(x*x + y*y + z*z), 6) AS nz FROM c
    """,
)
def vector_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane normals of six direction cosines (FN-17, FN-18)."""
    normal = geometry.plane_normal(F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", normal.alias("n"))
    return rows.select("vec_id", *[F.round(F.col("n")[i], 6).alias(f"n{a}") for i, a in enumerate("xyz")])


@query(
    "thumbnail_sizes",
    """
    WITH b AS (SELECT p_partkey, p_size * 37 AS r, p_partkey % 900 + 20 AS c, (p_size % 4 + 1) / 2.0 AS ratio FROM part),
         s AS (SELECT *, c * least(1 / ratio, 1.0) AS w, r * least(ratio, 1.0) AS h FROM b)
    SELECT p_partkey, CAST(least(greatest(round(w * least(256 / greatest(w, h), 1.0)), 1), 256) AS INTEGER) AS width,
           CAST(least(greatest(round(h * least(256 / greatest(w, h), 1.0)), 1), 256) AS INTEGER) AS height FROM s
    """,
)
def thumbnail_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thumbnails keep the physical shape and are never enlarged (FN-47, FN-48)."""
    size = tiles.thumbnail_size(F.col("p_size") * 37, F.col("p_partkey") % 900 + 20, (F.col("p_size") % 4 + 1) / 2.0, tiles.thumbnail_bucket(F.lit(200)))
    rows = table(spark, sf_dir, "part").select("p_partkey", size.alias("t"))
    return rows.select("p_partkey", "t.width", "t.height")
