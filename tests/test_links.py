"""Link queries on odd rows that the given tables lack or hold at larger sizes only, against their SQL."""

import os

import pytest
from pyspark.sql import functions as F

from lumenstack import registry
from lumenstack.operators import links
from tests.compare import TABLES, duck_rows, spark_rows


@pytest.fixture
def with_tables(spark, sf_dir, tmp_path):
    """A folder of the given tables, some of them replaced."""

    def make(**own):
        for t in TABLES:
            if t in own:
                own[t].coalesce(1).write.parquet(f"{tmp_path}/written/{t}")
                (part,) = [f for f in os.listdir(f"{tmp_path}/written/{t}") if f.endswith(".parquet")]
                os.symlink(f"{tmp_path}/written/{t}/{part}", f"{tmp_path}/{t}.parquet")
            else:
                os.symlink(f"{sf_dir}/{t}.parquet", f"{tmp_path}/{t}.parquet")
        return str(tmp_path)

    return make


def same_as_sql(spark, folder, name):
    got = spark_rows(registry.queries()[name](spark, folder))
    assert got == duck_rows(folder, registry.oracle_sql()[name])
    return got[1]


def test_slash_at_the_end_of_a_path(spark, with_tables):
    urls = ["http://a/en/6", "http://b/en/6/", "http://c//en/6", "http://d/en//6", "x/en/6", "en/6", "/en/6", "en/6//", "http://e/xen/6", "http://e", "/", "", None, "http://f/en/6\n", "http://a/en/6"]
    folder = with_tables(pages=spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string"))
    rows = same_as_sql(spark, folder, "path_suffix_join")
    assert ["/en/6", 6, "en/6"] in rows  # columns by name: first_path, n, name


def test_components_pass_over_empty_ones(spark):
    names = spark.createDataFrame([("en/6",)], "name string")
    files = spark.createDataFrame([("/a/en/6/",), ("/a/en//6",), ("/a/xen/6",)], "path string")
    assert sorted(r.path for r in links.path_suffix_join(names, files).collect()) == ["/a/en//6", "/a/en/6/"]


def most_rows(df):
    """The most rows that a node of the plan made."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *(walk(node.children().apply(i)) for i in range(node.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_many_edges_and_files_of_one_series(spark, with_tables):
    lines = [(i, 6, 5 * i) for i in range(300)] + [(i, n, i) for i in range(40) for n in range(1, 6)] + [(None, 6, 5), (None, 1, 5), (7, None, 5), (50, 2, None), (51, 1, 10**6), (3, 6, 4)]
    parts = [(i, "a", "Brand#1" if i % 2 else "Brand#2", 7) for i in range(600)] + [(i, "b", "Brand#1", 7) for i in range(300)] + [(None, "c", "Brand#1", 7), (900, "d", None, 7), (901, "e", "Brand#1", 8)]
    folder = with_tables(
        lineitem=spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long"),
        part=spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int"),
    )
    rows = same_as_sql(spark, folder, "resolve_edges")
    assert max(r[2] for r in rows) == 600 and [None, None, 0, "missing"] in rows  # columns by name: edge_id, first_match, n_matches, status
    assert most_rows(registry.queries()["resolve_edges"](spark, folder)) < 10_000  # there are 179,400 pairs


def test_edges_equal_brute_force(spark):
    import itertools

    some = lambda *values: [None, *values]
    edges = [(i, "source_image", c, u, s, []) for i, (c, u, s) in enumerate(itertools.product(some("c", "d"), some("u", "v", "w"), some("s", "t")))]
    files = [(i // 2, f"/{i % 3}", c, u, s, i % 3) for i, (c, u, s) in enumerate(list(itertools.product(some("c", "d"), some("u", "v"), some("s", "t"))) * 2)]
    left = spark.createDataFrame(edges, "edge_id int, relationship string, sop_class string, sop_instance string, series string, frame_numbers array<int>")
    right = spark.createDataFrame(files, "file_index int, path string, sop_class string, sop_instance string, series string, frame_count int")
    fits = lambda e, f: (e[3] or e[4]) and all(e[k] is None or e[k] == f[k] for k in (2, 3, 4))
    want = {e[0]: sorted((f[0], f[1]) for f in files if fits(e, f)) for e in edges}
    assert {r.edge_id: [(m.file_index, m.path) for m in r.matches] for r in links.resolve_edges(left, right).collect()} == want
    assert {r.edge_id: (r.n_matches, r.first_match and r.first_match[:2]) for r in links.count_matches(left, right).collect()} == {i: (len(m), m[0] if m else None) for i, m in want.items()}


def labels_and_files(spark, n_labels, n_files):
    """A patient with all labels and files; some labels on frames, one series, a study that is missing, a folder, and one cleared."""
    labels = spark.range(n_labels).selectExpr("id AS event_id", "'patient:p' AS target", "'patient' AS target_kind", "'v' AS value")
    odd = [(-1, "f1#3", "frame", "v"), (-2, "series:s", "series", "w"), (-3, "study:missing:f2", "study", "v"), (-4, "f1", "folder", "v"), (-5, "f1", "file", None), (-6, "f0", "file", "v"), (-6, "f0", "file", "v"), (-7, None, "file", "v"), (-8, "nothing", "file", "v")]
    files = spark.range(n_files).selectExpr("id AS file_index", "'f' || id AS file_key", "'p' AS patient_id", "'' AS study_instance_uid", "if(id % 2 = 0, 's', NULL) AS series_instance_uid")
    return labels.union(spark.createDataFrame(odd, "event_id long, target string, target_kind string, value string")), files


def test_labels_of_targets_in_many_blocks(spark):
    labels, files = labels_and_files(spark, 90, 530)
    wanted = sorted([(i, f) for i in range(90) for f in range(530)] + [(-2, f) for f in range(0, 530, 2)] + [(-1, 1), (-3, 2), (-6, 0), (-6, 0)])
    for block in (4, 300, 4096):
        rows = links.labels_of_file(labels, files, block=block)
        assert rows.columns == ["event_id", "target", "target_kind", "value", "file_index"]
        assert sorted((r.event_id, r.file_index) for r in rows.collect()) == wanted
        assert {tuple(r)[:4] for r in rows.where("event_id IN (-1, -2)").collect()} == {(-1, "f1#3", "frame", "v"), (-2, "series:s", "series", "w")}
    assert links.labels_of_file(labels.where("event_id = -8"), files, ["event_id"]).collect() == []


def test_labels_of_one_target_take_little_space_and_many_tasks(spark, tmp_path):
    labels, files = labels_and_files(spark, 220, 20_000)
    n, out = 220 * 20_000 + 10_000 + 4, f"{tmp_path}/out"
    rows = links.labels_of_file(labels, files).select("event_id", "file_index")
    of_task = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(of_task) == n
    assert max(of_task) < n / 2
    rows.write.parquet(out)
    assert sum(os.path.getsize(f"{out}/{f}") for f in os.listdir(out) if f.endswith(".parquet")) < n / 2
