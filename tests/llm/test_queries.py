import pytest

from lumenstack.llm import queries
from tests.compare import duck_rows, spark_rows

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == duck_rows(sf_dir, SQL[name])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_one_row_a_document(spark, sf_dir, name):
    rows = queries.queries()[name](spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert rows.count() == n and rows.select("doc_id").distinct().count() == n


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline
    from lumenstack.session import materialize, table

    docs = table(spark, sf_dir, "documents")
    columns, counts = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf_dir), "test")
        counts[name] = docs.count()
        if name != "shard":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert counts["quality"] >= counts["near_dedup"] >= counts["decontaminate"] and counts["shard"] == counts["mix"]
    assert sorted(map(tuple, pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, docs.collect()))


def test_native_operators_run_no_python(spark, sf_dir):
    for name in ("op3_mix_sources", "op6_decontaminate", "op8_order_minhash"):
        plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), name
