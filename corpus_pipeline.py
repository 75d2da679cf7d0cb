"""The corpus pipeline: quality filter, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.llm.decontamination import remove_contaminated
from lumenstack.llm.mixing import mixed_rows
from lumenstack.llm.quality import fit, score_quality
from lumenstack.llm.sharding import shard_by_bytes
from lumenstack.llm.simhash import keep_one_each
from lumenstack.llm.text import fold
from lumenstack.session import materialize, table

#: Documents of a lower score are rejected.
QUALITY = 0.7
SHARDS = 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents scored below QUALITY go. Learned from the labels outside the held-out fold.

    Null and empty texts are scored like any other; repeated rows are judged one by one.
    """
    model = fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 2)
    return score_quality(docs, model, keep=True).where(F.col("score") >= QUALITY).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: SimHash families, verified at 0.8 over five-word shingles; the least id of each group stays.

    Texts without words (null, empty) are one group; repeated rows are reduced to one.
    """
    return keep_one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a window of a benchmark item go. Null and empty texts hold none and stay."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each document as often as the mix takes it (0, 1 or 2 times).

    Null sources are one source, the last. Null texts have size 0; repeated rows are taken one by one.
    """
    return mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: doc_id, size, text_crc32, shard and slot of every row of the mix; equal texts share a shard."""
    return shard_by_bytes(docs, SHARDS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: A learned classifier, SimHash over XXH64 and differencing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each one over the written rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
