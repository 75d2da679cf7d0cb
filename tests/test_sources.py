import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lumenstack.operators.catalog import discovery_counts
from lumenstack.sources import dicom, raster, rois, scan
from lumenstack.streaming import catalog_stream


def element(group, el, vr, value):
    value = value.encode() if isinstance(value, str) else value
    value += (b"\0" if vr == b"UI" else b" ") * (len(value) % 2)
    long = vr in dicom.LONG_FORM
    return struct.pack("<HH", group, el) + vr + (b"\0\0" + struct.pack("<I", len(value)) if long else struct.pack("<H", len(value))) + value


def part10(body, syntax=dicom.EXPLICIT):
    meta = element(2, 0x10, b"UI", syntax)
    if syntax == dicom.DEFLATED:
        c = zlib.compressobj(wbits=-15)
        body = c.compress(body) + c.flush()
    return b"\0" * 128 + b"DICM" + element(2, 0, b"UL", struct.pack("<I", len(meta))) + meta + body


def image(name="Doe^Jane", rows=4, syntax=dicom.EXPLICIT, sop=b"1.2.840.10008.5.1.4.1.1.2"):
    body = element(8, 0x16, b"UI", sop) + element(8, 0x60, b"CS", "CT") + element(0x10, 0x10, b"PN", name) + element(0x20, 0x32, b"DS", "1\\2.5\\x\\3")
    body += element(0x28, 0x10, b"US", struct.pack("<H", rows)) + element(0x28, 0x1053, b"DS", "0.5") + element(0x7FE0, 0x10, b"OW", b"\0" * 32)
    return part10(body, syntax)


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 7, 5, 8, 2, 0, 0, 0) + b"\0\0\0\0" + struct.pack(">I4s", 5, b"tEXt") + b"k\0v w" + b"\0\0\0\0"
TIFF = b"II\x2a\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 9, 0) + struct.pack("<HHIHH", 257, 3, 1, 6, 0) + struct.pack("<I", 0)
JPEG = b"\xff\xd8\xff\xfe\0\x05abc\xff\xc0\0\x0b\x08\0\x03\0\x04\x01\x01\x11\0"
WEBP = b"RIFF\x20\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (8).to_bytes(3, "little") + (4).to_bytes(3, "little")


def test_headers():
    h = dicom.read_header(image())
    assert (h["modality"], h["rows"], h["rescale_slope"], h["rescale_intercept"], h["position"], h["has_pixels"], h["pixel_length"]) == ("CT", 4, 0.5, 0.0, [1.0, 2.5, 3.0], True, 32)
    assert dicom.read_header(image(syntax=dicom.DEFLATED))["rows"] == 4
    assert dicom.read_header(image()[:170])["error"]
    assert [raster.read_header(k, d)["rows"] for k, d in (("png", PNG), ("tiff", TIFF), ("jpeg", JPEG), ("webp", WEBP))] == [5, 6, 3, 5]
    assert raster.read_header("png", PNG[:12])["error"]
    assert raster.metadata_tree("png", PNG)[1] == ("PNG", "tEXt", 5, "k=v w") and raster.metadata_tree("jpeg", JPEG)[0][3] == "abc"


def test_nesting_is_bounded():
    inner = b""
    for _ in range(dicom.DEPTH_CAP + 3):
        item = struct.pack("<HHI", 0xFFFE, 0xE000, len(inner)) + inner
        inner = element(8, 0x1140, b"SQ", item)
    assert dicom.read_header(part10(inner))["error"] == "nested too deep"


def test_tables():
    item = {(0x28, 0x3002): (b"US", struct.pack("<3H", 2, 5, 16), 6), (0x28, 0x3006): (b"OW", struct.pack("<2H", 7, 9), 4)}
    assert dicom.lookup_table(item) == {"first": 5, "bits": 16, "entries": [7, 9]}
    item[(0x28, 0x3002)] = (b"US", struct.pack("<3H", 3, 5, 16), 6)
    assert dicom.lookup_table(item) is None


@pytest.fixture
def folder(tmp_path):
    for name, data in {"a.dcm": image(), "b.txt": image("Roe", rows=8), "c.dcm": b"nothing", "d.png": PNG, "e.dcm": image()[:170], "sub/f.dcm": TIFF, "dir.dcm": image(sop=dicom.MEDIA_DIRECTORY.encode())}.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_scan(spark, folder):
    files, records = scan.discover(spark, [folder, "/no/such/path"], ["PatientName=doe"])
    assert [(r.patient_name, r.label) for r in files.collect()] == [("Doe^Jane", "CT")]
    got = {(os.path.basename(r.path), r.reason) for r in records.collect()}
    assert got == {("a.dcm", "valid_dicom"), ("b.txt", "filter_mismatch"), ("c.dcm", "unrecognized_format"), ("d.png", "filter_mismatch"), ("e.dcm", "dicom_parse_failed"), ("f.dcm", "filter_mismatch"), ("dir.dcm", "unsupported_media_directory"), ("path", "input_path_unavailable")}
    assert {r.disposition: r.n for r in discovery_counts(records).collect()} == {"selected": 1, "filtered": 3, "skipped": 4}
    files, records = scan.discover(spark, [folder], formats=["png"])
    assert [(r.format, r["rows"], r["columns"]) for r in files.collect()] == [("png", 5, 7)]
    assert records.where("reason = 'format_not_selected'").count() == 5


def test_scan_as_stream(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    stream = scan.read_binary(spark, [folder], stream=True)
    query = catalog_stream.append_changes(stream, f"{out}/t", f"{out}/c", ["path"], classify=lambda df: scan.classify(df)[0].select("path", "modality"))
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/t").orderBy("revision").collect()
    assert [r.revision for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == 4
    (lambda d: open(d + "/g.dcm", "wb").write(image("New")))(folder)
    catalog_stream.append_changes(scan.read_binary(spark, [folder], stream=True), f"{out}/t", f"{out}/c", ["path"], classify=lambda df: scan.classify(df)[0].select("path", "modality")).awaitTermination()
    page, state = catalog_stream.page_of(spark, f"{out}/t", ["path"], 4, 10)
    assert [os.path.basename(r.path) for r in page.collect()] == ["g.dcm"] and state == {"revision": 5, "more": False, "reset": False}


def csv(tmp_path, text):
    p = tmp_path / "r.csv"
    p.write_text(text)
    return str(p)


def resolver(spark):
    files = spark.createDataFrame([("/a", 1, 40, 60, 3), ("/b", 2, 40, 60, 3)], "path string, file_index int, rows int, columns int, frame_count int")
    return lambda rows: rows.join(files, "path")


def parse(spark, tmp_path, text):
    return rois.parse_rois(rois.read_csv(spark, csv(tmp_path, text)), resolver(spark))


def test_region_lists(spark, tmp_path):
    text = 'x,anon_dicom_path,num_ROI,ROI_coords,ROI_frames\n1, /a ,2,"[[-1, 2.5, 30, 99],[5,5,5,6]]","[[0,2],[]]"\n2,/zz,oops,[broken,\n3,/b,0,[],[]\n'
    got = rois.checked(parse(spark, tmp_path, text)).orderBy("row").collect()
    assert [r.file_index for r in got] == [1, 2] and got[0].coords == [[0, 3, 30, 99], [5, 5, 5, 6]] and got[0].frames == [[0, 2], []]
    assert [w.code for w in got[0].warnings] == ["negative_coordinate", "non_integer_coordinate", "out_of_range", "zero_area", "frames_empty"]
    report = {r.code: r.n for r in rois.report(parse(spark, tmp_path, text)).collect()}
    assert report["zero_area"] == 1


@pytest.mark.parametrize(
    "row, problem",
    [
        ("/a,1,[[1,2,3]],[]", "roi_coords_entry"),
        ("/a,1,{},[]", "roi_coords"),
        ('/a,1,[[1,2,3,"x"]],[]', "roi_coords"),
        ("/a,2,[[1,2,3,4]],[]", "num_roi_mismatch"),
        ("/a,-1,[[1,2,3,4]],[]", "num_roi"),
        ("/a,1,[[1,2,3,4294967296]],[]", "coordinate_too_large"),
        ("/a,1,[[1,2,3,4]],[[9]]", "frame_out_of_range"),
        ("/a,1,[[1,2,3,4]],[[-1]]", "roi_frames"),
        ("/a,1,[[1,2,3,4]],[[0],[1]]", "roi_frames_length"),
        (" ,1,[[1,2,3,4]],[]", "empty_path"),
        ("/a,1,[[1,2,3,4]],[]|/a,1,[[1,2,3,4]],[]", "duplicate_path"),
    ],
)
def test_refused_lists(spark, tmp_path, row, problem):
    def quoted(line):
        path, n, rest = line.split(",", 2)
        depth, cut = 0, len(rest)
        for i, ch in enumerate(rest):
            depth += (ch in "[{") - (ch in "]}")
            if ch == "," and depth == 0:
                cut = i
                break
        q = lambda s: '"' + s.replace('"', '""') + '"'
        return f"{path},{n},{q(rest[:cut])},{q(rest[cut + 1:])}"

    text = "anon_dicom_path,num_ROI,ROI_coords,ROI_frames\n" + "\n".join(map(quoted, row.split("|"))) + "\n"
    with pytest.raises(rois.ImportRefused, match=f": {problem}$"):
        rois.checked(parse(spark, tmp_path, text))


def test_header_and_round_trip(spark, tmp_path):
    with pytest.raises(rois.ImportRefused, match="ROI_coords"):
        rois.read_csv(spark, csv(tmp_path, "anon_dicom_path,x\n/a,1\n"))
    lists = spark.createDataFrame([("/b", [[1, 2, 3, 4]], [[0]]), ("/a", [[5, 6, 7, 8], [1, 1, 2, 2]], [])], "path string, roi_coords array<array<int>>, roi_frames array<array<int>>")
    rois.write_csv(lists, str(tmp_path / "out"))
    back = rois.read_csv(spark, str(tmp_path / "out"))
    assert [r.anon_dicom_path for r in back.orderBy("row").collect()] == ["/a", "/b"]
    got = rois.parse_rois(back, resolver(spark)).orderBy("file_index").collect()
    assert [r.coords for r in got] == [[[5, 6, 7, 8], [1, 1, 2, 2]], [[1, 2, 3, 4]]]


def test_catalog_facade(spark, folder, tmp_path_factory):
    from lumenstack.api import open_catalog

    c = open_catalog(spark, folder, mask_key="k")
    rows = c.files.orderBy("file_index").collect()
    assert [r.file_index for r in rows] == [0, 1, 2, 3] and c.health() == {"selected": 4, "skipped": 3}
    assert [r.patient_name for r in c.search("patient:doe").collect()] == ["Doe^Jane"]
    assert {r.patient_name for r in c.masked().where("format = 'dicom'").collect()} == {"Patient 0001", "Patient 0002"}
    page, state = c.page(0, 3)
    assert page.count() == 3 and state["more"]
    assert c.counts().where("study_key is null").count() == 4 and c.folders().where("kind = 'file'").count() == 4
    name = next(r.path for r in rows if r.patient_name == "Doe^Jane").removeprefix("file:")
    out = tmp_path_factory.mktemp("rois")
    (out / "r.csv").write_text(f'anon_dicom_path,ROI_coords\n{name},"[[0,0,2,2]]"\n/none,x\n')
    assert [r.coords for r in c.import_rois(str(out / "r.csv")).collect()] == [[[0, 0, 2, 2]]]
    assert len({r.b3 for r in c.digests().collect()}) == 4
