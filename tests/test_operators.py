import itertools
import json

import pytest
from pyspark.sql import functions as F

from lumenstack.operators import annotations, catalog, filters, histogram, identity, links, oplog, series


def test_scan_filters(spark):
    files = spark.createDataFrame([(1, "CT", "dicom", "/a/X.dcm", "ID7"), (2, "MR", "png", "/b/y.png", None)], "file_index int, modality string, format string, path string, patient_id string")
    pick = lambda *f: [r.file_index for r in files.where(filters.scan_filter(f)).collect()]
    assert pick("Modality=ct") == [1] and pick("path=Y.PN") == [2] and pick("format=PNG") == [2] and pick("PatientID=id", "modality=c") == [1] and pick() == [1, 2]
    for bad in ("modality", "modality=", "colour=red", "format=pn"):
        with pytest.raises(ValueError):
            filters.ScanFilter.parse(bad)
    assert filters.format_selection(" PNG,dicom") == ["dicom", "png"]
    with pytest.raises(ValueError):
        filters.format_selection("jpg")


def test_search(spark):
    names = ["patient_id", "patient_name", "study_description", "study_date", "study_instance_uid", "series_description", "series_number", "series_instance_uid", "modality"]
    rows = [(i, p, f, *[v if n == c else "" for n in names]) for i, p, f, c, v in [(1, "/root/a/x.dcm", "dicom", "patient_name", "Doe"), (2, "/root/a/b/y.jpg", "jpeg", "modality", ""), (3, "/root/a/b/z.dcm", "dicom", "modality", "CT")]]
    files = spark.createDataFrame(rows, ["file_index", "path", "format", *names])
    pick = lambda q, paths="directory": sorted(r.file_index for r in filters.filter_files(files, q, paths).collect())
    assert pick("patient:doe") == [1] and pick("jpg") == [2] and pick("format:jpg") == [2] and pick("dicom") == []
    assert pick("b/") == [2, 3] and pick("root") == [] and pick("b/", "hidden") == [] and pick("b/ ct") == [3] and pick("patient:") == [1, 2, 3]


def test_classification(spark):
    assert spark.range(1).select(filters.object_kind(F.lit("1.2.840.10008.5.1.4.1.1.66.4"))).first()[0] == "segmentation"
    assert spark.range(1).select(filters.object_kind(F.lit("1.2.840.10008.5.1.4.1.1.2.9"))).first()[0] == "unknown"


def frames(spark, rows):
    schema = "file_index int, path string, study string, series string, sop_instance_uid string, instance_number int, frame_index int, kind string, kind_uid string, kind_role string, kind_rows int, kind_columns int, concatenation_offset int, in_concatenation_number int, position array<double>, orientation array<double>, own boolean"
    axial = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    full = [(i, f"/p{i}", "st", "se", f"u{i}", n, 0, "ordinary", None, None, None, None, None, None, p, axial if o else None, False) for i, n, p, o in rows]
    return spark.createDataFrame(full, schema)


def test_stack_order_and_warnings(spark):
    rows = [(0, 5, [0.0, 0.0, 4.0], True), (1, 1, [0.0, 0.0, 0.0], True), (2, 2, None, True), (3, 3, [0.0, 1.0, 1.0], True), (4, None, [0.0, 0.0, 1.0], True)]
    got = series.series_stacks(frames(spark, rows)).orderBy("virtual_index").collect()
    assert [r.file_index for r in got] == [1, 3, 4, 0, 2]
    w = series.stack_warnings(frames(spark, rows)).first()
    assert [m.file_index for m in w.missing_positions] == [2]
    assert w.duplicate_positions == [[1.0, 1.0]] and w.adjacent_spacing == [1.0, 3.0] and w.nonuniform_spacing
    assert w.gantry_tilt == pytest.approx(1.0) and w.inconsistent_orientation == []


def test_anchor_groups_are_not_islands(spark):
    xs = [0.0, 0.6, 1.2, 1.8]
    got = spark.range(1).select(series.anchor_groups(F.array(*[F.lit(x) for x in xs]), 1.0)).first()[0]
    assert got == [[0.0, 0.6], [1.2, 1.8]]


def test_resolve_edges(spark):
    edges = spark.createDataFrame([(1, "source_image", None, "u1", None, []), (2, "x", None, None, "s", [2, 9, 2]), (3, "x", "c9", "u1", None, []), (4, "x", None, None, None, [])], "edge_id int, relationship string, sop_class string, sop_instance string, series string, frame_numbers array<int>")
    cand = spark.createDataFrame([(7, "/b", "c1", "u1", "s", 3), (5, "/a", "c1", "u2", "s", 2)], "file_index int, path string, sop_class string, sop_instance string, series string, frame_count int")
    got = {r.edge_id: r for r in links.resolve_edges(edges, cand).collect()}
    assert got[1].frames == [1, 2, 3] and got[1].target_series == "s" and got[1].matches[0].frame_indices == [0, 1, 2]
    assert [(m.file_index, m.frame_indices) for m in got[2].matches] == [(5, [1]), (7, [1])]
    assert got[3].matches == [] and got[4].matches == []


def test_overlap_join_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    spans = [(i, rnd.randrange(3), a := rnd.uniform(0, 100), a + rnd.uniform(0, 40)) for i in range(60)]
    left = spark.createDataFrame(spans, "i int, k int, a double, b double")
    right = left.select(F.col("i").alias("j"), "k", F.col("a").alias("c"), F.col("b").alias("d"))
    got = {(r.i, r.j) for r in links.overlap_join(left, right, ["k"], ("a", "b"), ("c", "d"), 7.0).collect()}
    assert got == {(x[0], y[0]) for x in spans for y in spans if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]}


def test_relationships(spark):
    rows = [
        (1, 0, "registration", ["RegistrationSequence", "ReferencedImageSequence"], "c", "a", []),
        (1, 1, "registration", ["RegistrationSequence", "ReferencedImageSequence"], "c", "b", []),
        (2, 0, "rt_dose", ["ReferencedStructureSetSequence"], "c", "a", []),
        (3, 0, "grayscale_state", ["ReferencedSeriesSequence", "ReferencedImageSequence"], "c", "a", []),
        (3, 1, "grayscale_state", ["GraphicAnnotationSequence", "ReferencedImageSequence"], "c", "a", []),
        (3, 2, "grayscale_state", ["GraphicAnnotationSequence", "ReferencedImageSequence"], "c", "z", []),
        (4, 0, "comprehensive_3d_report", ["ContentSequence"], links.SEGMENTATION, "a", [1]),
        (4, 1, "comprehensive_3d_report", ["ContentSequence"], "c", "b", []),
    ]
    refs = spark.createDataFrame(rows, "file_index int, ref int, owner string, path array<string>, sop_class string, sop_instance string, segment_numbers array<int>")
    got = {(r.file_index, r.ref): r.relationship for r in links.classify_references(refs).collect()}
    assert got == {(1, 0): "registered_target", (1, 1): "moving_source", (2, 0): "source_structure_set", (3, 0): "source_image", (3, 2): "source_image", (4, 0): "referenced_segment", (4, 1): "source_image_for_segmentation"}


def test_delta_page(spark):
    entries = spark.createDataFrame([(i, i + 1) for i in range(5)], "index int, revision int")
    page = lambda since, limit: (lambda p: (sorted(r["index"] for r in p[0].collect()), p[1]))(catalog.delta_page(entries, since, limit))
    assert page(2, 2) == ([2, 3], {"revision": 4, "more": True, "reset": False})
    assert page(3, 2) == ([3, 4], {"revision": 5, "more": False, "reset": False})
    assert page(99, 2)[1] == {"revision": 2, "more": True, "reset": True}
    assert page(None, None)[0] == [0, 1, 2, 3, 4] and page(5, 2)[0] == []


def test_percentile_index_rule(spark):
    for n in (1, 2, 99, 100, 101, 250):
        samples = spark.range(n).select((F.col("id") * 2).cast("double").alias("v"), F.lit(1).alias("k"))
        r = histogram.percentile_window(histogram.distribution(samples, ["k"], "v"), ["k"], "v").first()
        import math

        assert (r.low, r.high) == (2.0 * min(math.floor(n * 0.01), n - 1), 2.0 * min(math.ceil(n * 0.99), n - 1))
        o = histogram.percentile_window_of_rows(samples, ["k"], "v").first()
        assert (o.low, o.high) == (r.low, r.high)
    nan = spark.createDataFrame([(1, 2.0), (1, float("nan")), (1, float("inf"))], "k int, v double")
    assert tuple(histogram.value_range(nan, ["k"], "v").first()) == (1, 2.0, 2.0)


def test_all_padding_falls_back(spark):
    counts = spark.createDataFrame([("a", 0, 3), ("b", 0, 1), ("b", 5, 2)], "k string, v int, count bigint")
    got = {(r.k, r.v) for r in histogram.mapped_distribution(counts, ["k"], "v", F.col("v"), F.col("v") == 0).collect()}
    assert got == {("a", 0), ("b", 5)}


KEY_SCHEMA = "seq int, path string, sop_instance_uid string, size_bytes int, digest string, failure string"


def test_keys_in_every_order(spark):
    files = [("/a", "u", 5, "d1"), ("/b", "u", 5, "d2"), ("/c", "u", 5, "d1"), ("/d", "bad uid", 5, "d9"), ("/e", "v", 5, None)]
    want = {"/a": "b3:d1", "/b": "b3:d2", "/c": "b3:d1", "/d": "b3:d9", "/e": "sop:v"}
    for order in itertools.islice(itertools.permutations(files), 0, 120, 17):
        df = spark.createDataFrame([(i, p, u, s, d, None) for i, (p, u, s, d) in enumerate(order)], KEY_SCHEMA)
        assert {r.path: r.key for r in identity.with_keys(df).collect()} == want


def test_relied_group_keeps_its_key(spark):
    rows = [(0, "/a", "u", 5, "d1", None, True), (1, "/b", "u", 5, "d2", None, False), (2, "/c", "u", 5, None, None, False), (3, "/d", "u", 6, None, None, False)]
    got = {r.seq: (r.key, r.settled) for r in identity.with_keys(spark.createDataFrame(rows, KEY_SCHEMA + ", relied boolean")).collect()}
    assert got == {0: ("sop:u", True), 1: ("b3:d2", True), 2: (None, False), 3: (None, False)}


def test_settle(spark):
    rows = [(0, "/a", "u", 5, "d", None), (1, "/b", "u", 5, None, None), (2, "/c", "w", 5, None, None), (3, "/d", "", 5, None, "unreadable")]
    df = spark.createDataFrame(rows, KEY_SCHEMA)
    got = {r.seq: (r.outcome, r.key) for r in identity.settle(df, df).collect()}
    assert got == {0: ("wanted", None), 1: ("wanted", None), 2: ("final", "sop:w"), 3: ("failed", None)}


def ops(*envelopes):
    return [("s", i, op_id, json.dumps(op)) for i, (op_id, op) in enumerate(envelopes)]


def test_log(spark):
    record = lambda i: {"id": i, "file": "f", "layer": "default"}
    update = lambda rev, **after: {"type": "update_annotation", "id": "a", "file": "f", "base_rev": rev, "after": after}
    rows = ops(
        ("1", {"type": "create_annotation", "annotation": record("a")}),
        ("1", {"type": "create_annotation", "annotation": record("zz")}),
        ("2", {"type": "create_annotation", "annotation": record("a")}),
        ("3", update(1, cls="x")),
        ("4", update(1, cls="y")),
        ("5", {"type": "batch", "ops": [update(2, cls="z"), {"type": "delete_annotation", "id": "none", "base_rev": 1, "snapshot": record("none")}]}),
        ("6", {"type": "delete_annotation", "id": "a", "base_rev": 2, "snapshot": record("a")}),
        ("7", update(3, cls="q")),
        ("8", {"type": "restore_annotation", "id": "a", "base_rev": 3, "snapshot": {"file": "f", "cls": "other"}}),
        ("9", {"type": "delete_layer", "id": "default", "base_rev": 1}),
        ("10", update(4, layer="no")),
    )
    df = spark.createDataFrame(rows, "store string, seq int, op_id string, op string")
    got = [(r.result, r.code, r.rev) for r in oplog.op_results(df).orderBy("seq").collect()]
    assert got == [("ok", None, None), ("ok", None, None), ("invalid", "duplicate_id", None), ("ok", None, None), ("conflict", "current", 2), ("conflict", "missing", None), ("ok", None, None), ("conflict", "deleted", 3), ("ok", None, None), ("invalid", "bad_layer", None), ("invalid", "unknown_layer", None)]
    state = {r.id: (r.rev, r.deleted, json.loads(r.record)) for r in oplog.folded_state(df).where("kind = 'annotation'").collect()}
    assert list(state) == ["a"] and state["a"][:2] == (4, False) and state["a"][2]["cls"] == "x"


def test_masks_and_labels():
    s = oplog.Store()
    s.run("1", {"type": "create_annotation", "annotation": {"id": "m", "file": "f", "layer": "default", "geometry": {"type": "mask", "frames": {}}}})
    tile = lambda after: {"column": 0, "row": 1, "after": after}
    assert s.run("2", {"type": "mask_tiles", "id": "m", "file": "f", "base_rev": 1, "frame": 3, "tiles": [tile("abc")]})["result"] == "ok"
    assert s.tables["annotation"]["m"]["frames"] == [3]
    s.run("3", {"type": "mask_tiles", "id": "m", "file": "f", "base_rev": 2, "frame": 3, "tiles": [tile(None)]})
    assert s.tables["annotation"]["m"]["frames"] == []
    label = lambda i, rev, after: {"type": "set_label", "id": i, "base_rev": rev, "target": "t", "field": "q", "layer": "default", "after": after}
    assert [s.run(str(n), label(*a))["code"] for n, a in enumerate([("l", None, 1), ("l", None, 2), ("k", None, 2), ("l", 1, None), ("l", 1, 5), ("l", 2, 6)], 10)] == [None, "duplicate_id", "duplicate_label", None, "deleted", None]


def best_pairing(had, wanted):
    """All order-preserving pairings in which unpaired new items come last; the best by (equal, pairs, earlier first)."""
    best = None
    for k in range(min(len(had), len(wanted)) + 1):
        for rows in itertools.combinations(range(len(had)), k):
            for cols in [tuple(range(k))]:
                given = [None] * len(had)
                for i, j in zip(rows, cols):
                    given[i] = j
                score = (sum(had[i] == wanted[j] for i, j in zip(rows, cols)), k, [g is not None for g in given])
                if best is None or score > best[0]:
                    best = (score, given)
    return best[1]


def test_pairing_is_the_best_one():
    import random

    rnd = random.Random(5)
    for _ in range(300):
        had = [rnd.choice("abc") for _ in range(rnd.randrange(6))]
        wanted = [rnd.choice("abc") for _ in range(rnd.randrange(6))]
        got, want = oplog.pairing(had, wanted), best_pairing(had, wanted)
        score = lambda g: (sum(had[i] == wanted[j] for i, j in enumerate(g) if j is not None), sum(j is not None for j in g))
        assert score(got) == score(want), (had, wanted, got, want)
    assert oplog.pairing(list("abcdef"), list("abXdef"), cells=4) == [0, 1, 2, 3, 4, 5]


def test_list_view_and_creates(spark):
    rect = "struct<x0:double,y0:double,x1:double,y1:double>"
    records = spark.createDataFrame([("k", 0, "rect", (1.2, 2.0, 3.1, 4.0), True, None, False), ("k", 1, "rect", (0.0, 0.0, 1.0, 1.0), False, [1], False), ("k", 2, "mask", None, True, None, False)], f"file_key string, position int, type string, rect {rect}, all_frames boolean, frames array<int>, deleted boolean")
    got = annotations.list_view(records, spark.createDataFrame([("k", 3)], "file_key string, frame_count int")).first()
    assert got.roi_coords == [[2, 1, 4, 4], [0, 0, 1, 1]] and got.roi_frames == [[0, 1, 2], [1]] and got.num_roi == 2
    made = annotations.rows_as_creates(spark.createDataFrame([got]), "layer", "me", "2024-01-01T00:00:00.000Z").orderBy("place").collect()
    assert [json.loads(r.op)["annotation"]["geometry"]["y1"] for r in made] == [4.0, 1.0]


def test_document_rules(spark):
    files = spark.createDataFrame([("k",), ("k",)], "key string")
    layers = spark.createDataFrame([("l",)], "id string")
    records = spark.createDataFrame([("a", "l"), ("b", "x")], "id string, layer string")
    got = {(r.code, r.id) for r in annotations.document_violations(files, layers, records, records.where("false")).collect()}
    assert got == {("duplicate_id", "k"), ("unknown_layer", "b")}


def test_narrowed_statistics_equal_sorting(spark):
    import math
    import random

    rnd = random.Random(2)
    values = [(rnd.choice("ab"), round(rnd.gauss(0, 1), rnd.choice([1, 6]))) for _ in range(20_000)] + [(None, 5.0), ("a", None)]
    df = spark.createDataFrame(values, "k string, v double")
    got = {r.k: (r.total, r.low, r.mid, r.high) for r in histogram.narrowed_statistics(df, ["k"], "v", {"low": 0.01, "mid": 0.5, "high": 0.99}).collect()}
    for k in ("a", "b", None):
        own = sorted(v for q, v in values if q == k and v is not None)
        n = len(own)
        assert got[k] == (n, own[math.floor(n * 0.01)], own[min(math.ceil(n * 0.5), n - 1)], own[min(math.ceil(n * 0.99), n - 1)])
