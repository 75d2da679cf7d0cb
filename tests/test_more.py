import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack.functions import samples as S
from lumenstack.operators import overlays
from lumenstack.sources import documents, synthetic


def test_blake3_known_digests():
    # published test vectors: input bytes 0, 1, ..., 250, 0, 1, ...
    data = bytes(i % 251 for i in range(4096))
    assert S.blake3(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert S.blake3(data[:1]) == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert S.blake3(data[:1024]) == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert S.blake3(data[:1025]) == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"


def test_samples():
    assert S.numeric_samples(struct.pack(">2h", -2, 5), 16, True, big=True).tolist() == [-2.0, 5.0]
    assert S.unpack_bits(bytes([0b101, 0b1]), 1, 3).tolist() == [0, 0, 0]
    assert S.unpack_bits(bytes([0b101]), 0, 3).tolist() == [1, 0, 1]
    assert S.stored_field(np.array([0xFFF0, 0x0010]), 12, 15, True).tolist() == [-1, 1]
    assert S.interleaved(b"rrggbb", 2, 3, 1, 1) == b"rgbrgb"
    assert S.expand_422(bytes([1, 2, 3, 4]), 1, 2) == bytes([1, 3, 4, 2, 3, 4])
    assert S.swap_pairs(b"abcde") == b"badce"
    assert S.packbits(bytes([2, 7, 8, 9, 254, 5, 128]), 6) == bytes([7, 8, 9, 5, 5, 5])
    for bad in (bytes([5, 1]), bytes([255]), b""):
        with pytest.raises(S.Undecodable):
            S.packbits(bad, 2)


def test_rle_round_trip(spark):
    x = np.arange(12, dtype="<u2") * 300
    planes = [(x >> 8).astype(np.uint8).tobytes(), (x & 255).astype(np.uint8).tobytes()]
    segments = [bytes([len(p) - 1]) + p for p in planes]
    header = struct.pack("<16I", 2, 64, 64 + len(segments[0]), *[0] * 13)
    data = header + b"".join(segments)
    assert S.rle_frame(data, 3, 4, 1, 16) == x.tobytes()
    with pytest.raises(S.Undecodable):
        S.rle_frame(data[:70], 3, 4, 1, 16)
    c = zlib.compressobj(wbits=-15)
    deflated = c.compress(bytes([0b1010, 0b1])) + c.flush()
    base = {"rows": 3, "columns": 4, "samples": 1, "bits": 16, "bits_stored": 16, "high_bit": 15, "signed": False, "kind": None, "planar": 0, "big_endian": False, "photometric": "MONOCHROME2"}
    rows = [{"file_index": 0, "frame_index": 0, "data": data, "encoding": "rle", **base}, {"file_index": 1, "frame_index": 0, "data": deflated, "encoding": "deflated", **base}, {"file_index": 2, "frame_index": 0, "data": b"xx", "encoding": "native", **base}]
    schema = "file_index int, frame_index int, data binary, encoding string, rows int, columns int, samples int, bits int, bits_stored int, high_bit int, signed boolean, kind string, planar int, big_endian boolean, photometric string"
    got = {r.file_index: r for r in S.decode_frames(spark.createDataFrame(rows, schema)).collect()}
    assert got[0].samples == x.astype(float).tolist() and got[1].samples[:4] == [0.0, 1.0, 0.0, 1.0] and got[2].error == "wrong length"


GEOMETRY = "struct<position:array<double>,orientation:array<double>,spacing:array<double>,rows:int,columns:int>"


def geometry(z, x=0.0, rows=4, columns=4):
    return ([x, 0.0, z], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [1.0, 1.0], rows, columns)


def test_segment_sources(spark):
    segments = spark.createDataFrame([(9, i, geometry(float(i)), "fr") for i in range(3)], f"file_index int, frame_index int, geometry {GEOMETRY}, frame_of_reference_uid string")
    frames = spark.createDataFrame([(1, i, "u1", "fr", geometry(float(i))) for i in range(2)] + [(2, 0, "u2", "fr", geometry(50.0))], f"file_index int, frame_index int, sop_instance_uid string, frame_of_reference_uid string, geometry {GEOMETRY}")
    declared = spark.createDataFrame([(9, None, "u1", []), (9, 2, "u2", [1])], "file_index int, frame_index int, sop_instance_uid string, frame_numbers array<int>")
    got = {r.frame_index: (r.method, r.status, [tuple(s) for s in r.sources]) for r in overlays.segment_sources(segments, declared, frames).collect()}
    assert got == {0: ("declared_source_geometry", "resolved", [(1, 0)]), 1: ("declared_source_geometry", "resolved", [(1, 1)]), 2: ("explicit_derivation", "resolved", [(2, 0)])}
    mappings = overlays.segment_sources(segments, declared, frames).withColumns({"segment_declared": F.lit(True), "geometry_ok": F.col("frame_index") < 2})
    files = spark.createDataFrame([(9, 3), (8, 1)], "file_index int, frame_count int")
    edges = spark.createDataFrame([(9, 1), (9, 2)], "file_index int, source int")
    assert {r.file_index: r.reason for r in overlays.segmentation_eligibility(mappings, files, edges).collect()} == {9: "incompatible_geometry", 8: "incomplete_mapping"}


def test_volume_overlay(spark):
    volumes = spark.createDataFrame([(7, "fr", "dose", geometry(0.0), [0.0, 4.0])], f"volume int, frame_of_reference_uid string, sop_class_uid string, base {GEOMETRY}, offsets array<double>")
    frames = spark.createDataFrame([(1, i, "fr", "ct", True, geometry(z)) for i, z in enumerate([0.0, 1.0, 9.0])] + [(2, 0, "other", "ct", True, geometry(0.0))], f"file_index int, frame_index int, frame_of_reference_uid string, sop_class_uid string, has_pixels boolean, geometry {GEOMETRY}")
    shown, summary = overlays.covered_frames(volumes, frames, spark.createDataFrame([(7, 1)], "volume int, file_index int"))
    assert sorted((r.file_index, r.frame_index) for r in shown.collect()) == [(1, 0), (1, 1)]
    assert tuple(summary.first()) == (7, 2, 1, 1)
    planes = spark.createDataFrame([(7, 0.0, [0.0] * 16), (7, 4.0, [8.0] * 16)], "volume int, offset double, values array<double>")
    targets = shown.join(frames, ["file_index", "frame_index"]).select("volume", "file_index", "frame_index", "geometry")
    got = {r.frame_index: r["values"] for r in overlays.overlay_values(volumes, planes, targets).collect()}
    assert got == {0: [0.0] * 16, 1: [2.0] * 16}
    legends = spark.createDataFrame([(7, 0.0, 8.0, 0.0)], "volume int, min double, max double, floor double")
    colors = {r.frame_index: r.rgba[0] for r in overlays.overlay_colors(overlays.overlay_values(volumes, planes, targets), legends).collect()}
    assert colors[0] == [0, 0, 0, 0] and colors[1][3] == 255


def test_presentation_states(spark):
    target = "array<struct<sop_instance_uid:string,frame_numbers:array<int>>>"
    items = spark.createDataFrame([(5, 0, [("u", [2, 9])], [], ["g"], []), (5, 1, None, [("u", [])], [], [])], f"state int, item int, targets {target}, series_targets {target}, graphics array<string>, texts array<string>")
    images = spark.createDataFrame([(1, "u", 3, True), (2, "u", 1, False)], "file_index int, sop_instance_uid string, frame_count int, has_pixels boolean")
    frames = overlays.state_frames(items, images)
    assert sorted(map(tuple, frames.collect())) == [(5, 0, 1, 1), (5, 1, 1, 0), (5, 1, 1, 1), (5, 1, 1, 2)]
    assert {r.item: (tuple(r.first_frame), r.frame_count) for r in overlays.state_context(items, frames).collect()} == {0: ((1, 1), 1), 1: ((1, 0), 3)}
    assert [r.item for r in overlays.graphics_of_frame(items, "u", 0).collect()] == [1]
    nums = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    pick = lambda u, k, d, n: overlays.graphic_object(F.lit(u), F.lit(k), d, F.lit(n))
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate([pick("PIXEL", "POLYLINE", nums(1, 2, 3, 4), 4), pick("DISPLAY", "POINT", nums(1, 2), 2), pick("PIXEL", "CIRCLE", nums(1, 2), 2), pick("PIXEL", "POINT", nums(1, 2), 3)])]).first()
    assert [r.skip for r in row] == [None, "display_units", "malformed", "malformed"] and row[0].points == [[1.0, 2.0], [3.0, 4.0]]


def test_map_instances(spark):
    refs = spark.createDataFrame([(0, "u", [1, 9]), (1, "u", []), (2, "u", [7])], "item int, sop_instance_uid string, frame_numbers array<int>")
    images = spark.createDataFrame([(4, "u", 3)], "file_index int, sop_instance_uid string, frame_count int")
    assert sorted((r["item"], r.frames) for r in overlays.map_instances(refs, images).collect()) == [(0, [0]), (1, None)]


HEAD = {"format": documents.FORMAT, "version": "1.0", "schema": None}
DOC = {**HEAD, "files": [{"key": "k", "odd": [1, {"x": None}]}], "layers": [{"id": "l"}], "annotations": [{"id": "b"}, {"id": "a", "unknown": 2}], "labels": []}


def as_lists(records):
    out = {}
    for r in records.orderBy("kind", "place").select("kind", F.to_json("record").alias("t")).collect():
        out.setdefault(r.kind, []).append(json.loads(r.t))
    return out


def test_documents_round_trip(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(DOC))
    head, records = documents.read_json(spark, str(tmp_path / "d.json"))
    want = {"file": DOC["files"], "layer": DOC["layers"], "annotation": DOC["annotations"]}
    assert head == HEAD and as_lists(records) == want
    documents.write_json(head, records, str(tmp_path / "out"))
    assert as_lists(documents.read_json(spark, str(tmp_path / "out"))[1]) == want
    documents.write_json_lines(head, records, str(tmp_path / "lines"))
    assert as_lists(documents.read_json_lines(spark, str(tmp_path / "lines"))[1]) == want
    text = "".join(p.read_text() for p in (tmp_path / "lines").glob("part-*")).splitlines()
    (tmp_path / "cut.jsonl").write_text("\n".join(text[:2] + text[3:]))
    with pytest.raises(documents.DocumentRefused, match="counts"):
        documents.read_json_lines(spark, str(tmp_path / "cut.jsonl"))
    with pytest.raises(documents.DocumentRefused, match="over 10"):
        documents.write_json(head, records, str(tmp_path / "big"), 10)


@pytest.mark.parametrize("change", [{"format": "x"}, {"version": "2.0"}, {"version": "1"}, {"version": "1.x"}])
def test_documents_refused(spark, tmp_path, change):
    (tmp_path / "d.json").write_text(json.dumps({**DOC, **change}))
    with pytest.raises(documents.DocumentRefused):
        documents.read_json(spark, str(tmp_path / "d.json"))


def test_adapters():
    registry = documents.default_registry()
    assert registry.sniff(b' \n{"format":"%s"}' % documents.FORMAT.encode()).id == "json"
    assert registry.sniff(b"x,anon_dicom_path,ROI_coords\n").id == "roi-csv" and registry.sniff(b"x,y\n") is None
    registry.register(documents.Adapter("late", lambda head: documents.CERTAIN, print))
    assert registry.sniff(b"x,anon_dicom_path,ROI_coords\n").id == "roi-csv" and registry.sniff(b"zzz").id == "late"


def test_synthetic_catalogs(spark):
    from lumenstack.operators.catalog import folder_tree, navigator_counts, navigator_order, navigator_rows

    files = synthetic.catalog(spark, "study").withColumns({"study_description": F.lit(""), "study_date": F.lit(""), "series_number": F.lit(""), "series_description": F.lit("")})
    counts = navigator_counts(navigator_rows(files)).where("study_key is null").collect()
    assert sum(r.images for r in counts) == 2000 and sum(r.series for r in counts) == 8
    first = navigator_rows(files).orderBy(*navigator_order()).first()
    assert first.patient_key == "patient:P0" and first.instance_number == "0"
    assert folder_tree(files).where("kind = 'file'").count() == 2000


def test_png_and_thumbnails(spark):
    from lumenstack.functions import images
    from lumenstack.sources import raster

    x = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    assert (images.decode_png(images.encode_png(x)) == x).all()
    small = images.box_filter(x, 2, 3)
    want = np.floor(x.reshape(2, 2, 3, 2, 3).mean(axis=(1, 3)) + 0.5)
    assert (small == want).all() and images.box_filter(x, 9, 9).shape == x.shape
    rows = [(1, x.ravel().tolist(), 4, 6, 3, 2, 3)]
    frames = spark.createDataFrame(rows, "k int, pixels array<int>, rows int, columns int, channels int, height int, width int")
    png = bytes(images.png_images(frames, ["k"], thumbnail=True).first().png)
    assert raster.read_header("png", png)["columns"] == 3 and (images.decode_png(png) == small).all()


def test_destinations_and_file_refs(spark):
    from lumenstack.operators.links import destination

    m = lambda *f: F.struct(F.array(*[F.lit(x) for x in f]).cast("array<int>").alias("frame_indices"))
    row = spark.range(1).select(destination(m(7, 2), F.lit(3)).alias("a"), destination(m(), F.lit(3)).alias("b"), destination(m(1), F.lit(0)).alias("c")).first()
    assert tuple(row) == (2, 0, None)
    files = spark.createDataFrame([(1, "k", "/d/a/x", 5), (0, "k", "/d/y", 5), (2, None, "/d/z", 5), (3, "j", "/e/w", 6)], "file_index int, key string, path string, size_bytes int")
    refs = documents.file_refs(files, "/d")
    assert as_lists(refs)["file"] == [{"key": "k", "path": "y", "size_bytes": 5}, {"key": "j", "path": "w", "size_bytes": 6}]
    assert documents.import_status(refs) == {"state": "ready", "counts": {"file": 2}} and documents.import_status(None, "row 3")["state"] == "failed"


def test_command_line():
    from lumenstack.__main__ import parser

    args = parser().parse_args(["/data", "--filter", "Modality=CT", "--formats", "png,dicom", "--view", "counts"])
    assert args.filter[0].column == "modality" and args.formats == ["dicom", "png"] and args.view == "counts"
    with pytest.raises(SystemExit):
        parser().parse_args(["/data", "--filter", "nope"])


def test_pixel_digest_header():
    own = struct.pack("<6I", 1, 2, 1, 16, 1, 0)
    assert S.pixel_digest(1, 2, 1, 16, 1, b"abcd") == S.blake3(own + b"abcd")
    assert S.pixel_digest(1, 2, 1, 16, 0, b"abcd") != S.pixel_digest(1, 2, 1, 16, 1, b"abcd")
    assert S.pixel_digest(1, 2, 1, 16, 1, b"abc") is None and S.pixel_digest(1, 32, 1, 1, 0, b"abcd") is None and S.pixel_digest(0, 2, 1, 8, 0, b"") is None
