"""Synthetic catalogs for timing: patients, studies and series by rule (SRC-25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Profile: files, files a series, copies of each, whether all share one identifier, whether they have one.
PROFILES = {
    "small": (16, 16, 1, False, True),
    "study": (2_000, 250, 1, False, True),
    "tree": (20_000, 100, 1, False, True),
    "cohort": (100_000, 200, 1, False, True),
    "duplicated": (10_000, 100, 2, False, True),
    "collision": (10_000, 100, 1, True, True),
    "no_uid": (10_000, 100, 1, False, False),
}


def catalog(spark: SparkSession, profile: str) -> DataFrame:
    n, a_series, copies, shared, named = PROFILES[profile]
    i = F.col("id")
    own = F.floor(i / copies)
    series = F.floor(own / a_series)
    study = F.floor(series / 4)
    uid = F.concat(F.lit("1.9."), F.when(F.lit(shared), F.floor(own / 2)).otherwise(own).cast("string"))
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return spark.range(n).select(
        i.cast("int").alias("file_index"),
        F.concat_ws("/", F.lit("/data"), text("p", F.floor(study / 3)), text("s", study), text("e", series), text("f", i)).alias("path"),
        text("P", F.floor(study / 3)).alias("patient_id"),
        text("Name^", F.floor(study / 3)).alias("patient_name"),
        text("1.7.", study).alias("study_instance_uid"),
        text("1.8.", series).alias("series_instance_uid"),
        (uid if named else F.lit("")).alias("sop_instance_uid"),
        (own % a_series).cast("string").alias("instance_number"),
        F.lit("CT").alias("modality"),
        F.lit("dicom").alias("format"),
        F.lit(5000).alias("size_bytes"),
    )
