import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack.functions import geometry as G
from lumenstack.functions import pixels as P
from lumenstack.functions import privacy, shapes, text, tiles, values


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(row) == 1 else tuple(row)


def test_linear_window_bounds(spark):
    xs = [-1.0, 0.0, 0.4, 0.5, 1.0, 2.0, 3.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(P.linear_byte(F.col("x"), F.lit(2.0), F.lit(3.0)).alias("b")).collect()
    def want(x, c=2.0, w=3.0):
        low, high = c - 0.5 - (w - 1) / 2, c - 0.5 + (w - 1) / 2
        return 0 if x <= low else 255 if x > high else int(np.floor(((x - (c - 0.5)) / (w - 1) + 0.5) * 255 + 0.5))
    assert [r.b for r in got] == [want(x) for x in xs]
    # width 1 (and below) is a threshold
    assert one(spark, P.linear_byte(F.lit(5.0), F.lit(5.5), F.lit(0.2)), P.linear_byte(F.lit(5.1), F.lit(5.5), F.lit(1.0))) == (0, 255)


def test_luts_clamp_and_scale(spark):
    lut = P.lut_literal(10, 8, [1, 2, 255])
    assert one(spark, P.lut_entry(lut, F.lit(-5.0)), P.lut_entry(lut, F.lit(11.9)), P.lut_entry(lut, F.lit(99.0))) == (1, 2, 255)
    assert one(spark, P.voi_lut_byte(P.lut_literal(0, 16, [0, 32768, 65535]), F.lit(1)), P.voi_lut_byte(lut, F.lit(12))) == (128, 255)


def test_window_choices(spark):
    none = F.lit(None).cast("double")
    stored = F.struct(F.lit(1.0).alias("center"), F.lit(2.0).alias("width"))
    auto = F.struct(F.lit(3.0).alias("center"), F.lit(4.0).alias("width"))
    full = F.struct(F.lit(5.0).alias("center"), F.lit(6.0).alias("width"))
    pick = lambda mode, wc, ww, s: P.resolve_window(F.lit(mode), wc, ww, s, auto, full)["center"]
    no = F.when(F.lit(False), stored)
    assert one(spark, pick("default", F.lit(9.0), F.lit(8.0), stored), pick("default", F.lit(9.0), none, stored), pick("default", none, none, no), pick("full_dynamic", F.lit(9.0), F.lit(8.0), stored)) == (9.0, 1.0, 3.0, 5.0)
    assert one(spark, P.window_function(F.lit(False), F.lit(False), F.lit(1.0), F.lit(0.5)), P.window_function(F.lit(False), F.lit(True), F.lit(1.0), F.lit(0.5))) == ("exact", "linear")


def test_stored_bits(spark):
    assert one(spark, P.stored_value(F.lit(0xFFF0), 16, 12, 15, True), P.stored_value(F.lit(0x0FFF), 16, 12, 11, False), P.p_value_byte(F.lit(65535))) == (-1, 4095, 255)


def test_value_maps(spark):
    m = lambda first, last, slope, intercept, lut: F.struct(F.lit(first).cast("double").alias("first"), F.lit(last).cast("double").alias("last"), F.lit(slope).cast("double").alias("slope"), F.lit(intercept).cast("double").alias("intercept"), F.array(*[F.lit(float(x)) for x in lut]).cast("array<double>").alias("lut"))
    table = m(10, 12, None, None, [1, 2, 3])
    assert one(spark, values.mapped_value(table, F.lit(11.4)), values.mapped_value(table, F.lit(9.0)), values.mapped_value(table, F.lit(11.4), True), values.mapped_value(m(None, None, 2, 1, []), F.lit(4.0))) == (2.0, None, None, 9.0)
    assert one(spark, values.read_out(F.lit(12.0)), values.read_out(F.lit(0.123456789))) == ("12", "0.12346")


def test_colours(spark):
    assert one(spark, values.colormap(F.lit(0.0))) == [68, 1, 84]
    assert one(spark, values.colormap(F.lit(float("nan")))) == [68, 1, 84]
    assert one(spark, values.colormap(F.lit(2.0))) == [253, 231, 37]
    assert one(spark, values.color_wash(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == [0, 0, 0, 0]
    assert one(spark, values.ybr_to_rgb(F.lit(128.0), F.lit(128.0), F.lit(128.0))) == [128, 128, 128]
    white = one(spark, values.cielab_to_rgb(F.lit(65535.0), F.lit(32896.0), F.lit(32896.0)))
    assert all(abs(c - 255) <= 1 for c in white)
    assert one(spark, values.segment_color(F.lit(7), F.lit(None).cast("array<double>"), F.lit(None).cast("double"))["source"]) == "palette"


def test_polygons_and_boxes(spark):
    square = F.array(*[F.array(F.lit(r), F.lit(c)) for r, c in ((1, 1), (1, 5), (5, 5), (5, 1))])
    inside = lambda r, c: shapes.in_polygon(square, F.lit(r), F.lit(c))
    assert one(spark, inside(3, 3), inside(1, 3), inside(5, 5), inside(6, 3), inside(3, 0)) == (True, True, True, False, False)
    box = lambda *b: F.array(*[F.lit(x) for x in b])
    assert one(spark, shapes.canonical_box(box(5, 9, 2, 1))) == [2, 1, 5, 9]
    assert one(spark, shapes.moved_box(box(2, 2, 4, 4), F.lit(100.0), F.lit(-9.0), F.lit(10), F.lit(10))) == [0, 8, 2, 10]
    hit = shapes.hit_test(F.array(box(0, 0, 40, 40), box(10, 10, 30, 30)), F.lit(20.0), F.lit(20.0), F.lit(1.0))
    assert one(spark, hit["index"], hit["handle"]) == (1, None)
    corner = shapes.hit_test(F.array(box(0, 0, 40, 40)), F.lit(39.0), F.lit(1.0), F.lit(1.0))
    assert one(spark, corner["handle"]) == "ne"
    assert one(spark, shapes.quantize(F.lit(12.3456)), shapes.quantize(F.lit(-0.0004)), shapes.quantize(F.lit(float("inf")))) == (12.346, 0.0, float("inf"))


def test_overlay_bits(spark):
    words = F.array(F.lit(0b10), F.lit(0))
    bit = lambda r, c: shapes.overlay_bit(words, F.lit(2), F.lit(4), F.lit(1), F.lit(1), F.lit(0), F.lit(r), F.lit(c))
    assert one(spark, bit(0, 1), bit(0, 0), bit(5, 5)) == (True, False, False)


def test_geometry(spark):
    g = lambda z, spacing=(1.0, 2.0): F.struct(F.array(F.lit(0.0), F.lit(0.0), F.lit(z)).alias("position"), F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)]).alias("orientation"), F.array(*[F.lit(x) for x in spacing]).alias("spacing"), F.lit(4).alias("rows"), F.lit(4).alias("columns"))
    assert one(spark, G.plane_normal(g(0.0)["orientation"])) == [0.0, 0.0, 1.0]
    assert one(spark, G.map_pixel(G.in_plane_transform(g(0.0), g(9.0, (2.0, 2.0))), F.lit(1.0), F.lit(3.0))) == [2.0, 3.0]
    assert one(spark, G.coplanar_transform(g(0.0), g(1.0)).isNull(), G.coplanar_transform(g(0.0), g(0.0005)).isNull()) == (True, False)
    assert one(spark, G.grids_overlap(g(0.0), g(0.0), G.in_plane_transform(g(0.0), g(0.0)))) is True
    offsets = F.array(*[F.lit(x) for x in (0.0, 2.0, 6.0)])
    at = lambda x: G.bracket(offsets, F.lit(x))
    got = one(spark, at(3.0), at(-0.9), at(-1.1), at(2.0), at(8.0), at(8.1))
    assert [tuple(r) if r else None for r in got] == [(1, 2, 0.25), (0, 0, 0.0), None, (1, 1, 0.0), (2, 2, 0.0), None]


def test_resampling_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    planes, offsets = rng.random((3, 4, 5)), np.array([0.0, 2.0, 6.0])
    args = ((0.3, -0.2), (0.9, 0.1), (-0.1, 1.1), -0.5, (0.4, 0.7))
    got = G.resample(planes, offsets, *args, 5, 6, False)

    def flat(k, r, c):
        r, c = min(max(r, 0), 3), min(max(c, 0), 4)
        r0, c0 = int(r), int(c)
        r1, c1 = min(r0 + 1, 3), min(c0 + 1, 4)
        top = planes[k, r0, c0] * (1 - c + c0) + planes[k, r0, c1] * (c - c0)
        low = planes[k, r1, c0] * (1 - c + c0) + planes[k, r1, c1] * (c - c0)
        return top * (1 - r + r0) + low * (r - r0)

    for i in range(5):
        for j in range(6):
            r, c = 0.3 + i * 0.9 - j * 0.1, -0.2 + i * 0.1 + j * 1.1
            z = -0.5 + i * 0.4 + j * 0.7
            if not (-0.5 <= r <= 3.5 and -0.5 <= c <= 4.5 and -1 <= z <= 8):
                assert np.isnan(got[i, j])
                continue
            zc = min(max(z, 0), 6)
            k = 0 if zc < 2 else 1
            w = (zc - offsets[k]) / (offsets[k + 1] - offsets[k])
            assert got[i, j] == pytest.approx(flat(k, r, c) * (1 - w) + flat(k + 1, r, c) * w)
    assert G.covers_a_pixel(offsets, 4, 5, *args, 5, 6) == bool(np.isfinite(got).any())


def test_text(spark):
    names = ["img10", "img9", "IMG1", "b", "", "a2c"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(*text.known_first(F.col("n"))).collect()] == ["a2c", "b", "IMG1", "img9", "img10", ""]
    assert one(spark, text.normalized_path(F.lit("/a/./b/../c")), text.short_uid(F.lit("1.2.3.4.5.6.7.8.9.10.11")), text.date_text(F.lit("20240131"))) == ("/a/c", "...5.6.7.8.9.10.11", "2024-01-31")
    assert text.tag_steps("(0008,1111)/0/0010,0020") == [(8, 0x1111, 0), (0x10, 0x20, None)]
    assert text.byte_size("2MiB") == 2 << 20
    for bad in ("2 MiB", "", "99999999999999999999"):
        with pytest.raises(ValueError):
            text.byte_size(bad)


def test_masking(spark):
    shift = lambda v, d=-3: privacy.shifted_date(F.lit(v), F.lit(d))
    assert one(spark, shift("20240301120000"), shift("20240230"), shift(" "), shift("2024")) == ("20240227120000", "[masked]", "", "[masked]")
    assert one(spark, privacy.capped_age(F.lit("095Y")), privacy.capped_age(F.lit("089Y")), privacy.capped_age(F.lit("12M"))) == ("089Y", "089Y", "12M")
    days = [r.d for r in spark.range(500).select(privacy.shift_days("k", F.col("id").cast("string")).alias("d")).collect()]
    assert 0 not in days and min(days) >= -365 and max(days) <= 365 and len(set(days)) > 200
    a, b, c = one(spark, privacy.masked_uid("k", F.lit("1.2.3")), privacy.masked_uid("j", F.lit("1.2.3")), privacy.masked_uid("k", F.lit("1.2.840.10008.5")))
    assert a.startswith("2.25.") and a != b and c == "1.2.840.10008.5"


def test_no_planted_identifier_survives(spark):
    secret = "ZQSECRET"
    files = spark.createDataFrame([(i, secret, secret + "^X", "20240101", f"1.9.{i}", f"1.8.{i}", f"1.7.{i}", "dicom", ["A", "B", "LABEL"], f"{secret}.dcm", None) for i in range(3)], "file_index int, patient_id string, patient_name string, study_date string, study_instance_uid string, series_instance_uid string, sop_instance_uid string, format string, image_type array<string>, display_name string, support_reason string")
    rows = privacy.masked_summary(files, "k").collect()
    assert secret not in str(rows) and "1.9.1" not in str(rows)
    assert {r.patient_id for r in rows} == {"MASKED-0001"} and {r.support_reason for r in rows} == {"masked_label_image"}
    nested = spark.createDataFrame([("1.9.9", (("1.9.8", ["1.9.7"]),))], "sop_uid string, d struct<e:struct<study_uid:string,ref_uids:array<string>>>")
    assert "1.9." not in str(privacy.masked_uids(nested, "k").collect()).replace("2.25.", "")


def test_tiles(spark):
    t = tiles.tiled_full(F.lit(64), F.lit(330), F.lit(850), F.lit(50), F.lit(100), F.lit(2), F.lit(3))
    assert one(spark, t["tile_row"], t["tile_column"], t["path"], t["plane"]) == (0, 1, 1, 0)
    assert one(spark, tiles.tiled_full(F.lit(378), F.lit(330), F.lit(850), F.lit(50), F.lit(100), F.lit(2), F.lit(3)).isNull()) is True
    assert one(spark, tiles.thumbnail_bucket(F.lit(65)), tiles.thumbnail_bucket(F.lit(0)), tiles.thumbnail_bucket(F.lit(9999)), tiles.thumbnail_bucket(F.lit(None).cast("int"))) == (128, None, None, 256)
    assert one(spark, tiles.focal_index(F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0 + 1e-10)), F.lit(2.0))) == 1
