"""File keys: provisional, split and settled identities (ST-3 to ST-7, FN-50 to FN-52, CTX-36 to CTX-38).

The key rules are set-based but for one thing: once a key was relied on, it stays, and later files are
compared with the group's first file. Batches carry the registration order as `seq`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable_uid(uid: Column) -> Column:
    """1 to 128 of letters, digits, dot, hyphen, underscore."""
    return F.coalesce(uid.rlike(r"^[A-Za-z0-9._-]{1,128}$"), F.lit(False))


def key_scheme(key: Column) -> Column:
    """sop or content of a well-formed key, else null."""
    return F.when(F.startswith(key, F.lit("sop:")) & usable_uid(F.substring(key, 5, 1 << 20)), "sop").when(key.rlike(r"^b3:[0-9a-f]{64}$"), "content")


def content_key(digest: Column) -> Column:
    return F.concat(F.lit("b3:"), digest)


def with_keys(files: DataFrame) -> DataFrame:
    """files with key, settled, alias_of, required (needs its digest to settle).

    files: seq, path, sop_instance_uid, size_bytes, digest (hex, null if not known), failure (null if
    none), relied (whether the group was relied on before this batch; false if it has no such column).

    1. Without a usable identifier: the content key once the digest is known.
    2. A group whose known sizes and digests agree: sop:<uid>, provisional.
    3. A group with two different files: each one's content key; before its digest is known it keeps
       sop:<uid>, unless reading it failed.
    4. A group relied on: the first file and those equal to it have sop:<uid>, those that differ their
       content key, and those not compared yet none.
    """
    relied = F.col("relied") if "relied" in files.columns else F.lit(False)
    usable = usable_uid(F.col("sop_instance_uid"))
    rows = files.withColumn("_group", F.when(usable, F.col("sop_instance_uid"))).withColumn("_relied", relied)
    # files without a usable identifier, and without a key, have nothing in common: each is a partition of its own
    w = W.partitionBy("_group", F.when(F.col("_group").isNull(), F.col("seq")))
    ordered = w.orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({
        "_sizes": F.min("size_bytes").over(w) != F.max("size_bytes").over(w),
        "_digests": F.min("digest").over(w) != F.max("digest").over(w),
        "_paths": F.min("path").over(w) != F.max("path").over(w),
        "_any": F.max(F.col("_relied").cast("int")).over(w) == 1,
        "_first_seq": F.min("seq").over(w),
        "_first_size": F.first("size_bytes").over(ordered),
        "_first_path": F.first("path").over(ordered),
        "_first_digest": F.first("digest").over(ordered),
    })
    split = F.coalesce(F.col("_sizes") | F.coalesce("_digests", F.lit(False)), F.lit(False)) & ~F.col("_any")
    sop, own = F.concat(F.lit("sop:"), F.col("_group")), F.when(F.col("digest").isNotNull(), content_key(F.col("digest")))
    is_first = (F.col("seq") == F.col("_first_seq")) | (F.col("path") == F.col("_first_path"))
    equal = is_first | F.coalesce(F.col("digest") == F.col("_first_digest"), F.lit(False))
    differs = (F.col("size_bytes") != F.col("_first_size")) | F.coalesce(F.col("digest") != F.col("_first_digest"), F.lit(False))
    key = (
        F.when(F.col("_group").isNull(), own)
        .when(F.col("_any"), F.when(equal, sop).when(differs, own))
        .when(split, F.coalesce(own, F.when(F.col("failure").isNull(), sop)))
        .otherwise(sop)
    )
    rows = rows.withColumns({"key": key, "_kept": split & own.isNull()})
    settled = F.coalesce(F.startswith("key", F.lit("b3:")), F.lit(False)) | (F.col("_any") & F.col("key").isNotNull())
    holder = F.min("seq").over(W.partitionBy("key", F.when(F.col("key").isNull(), F.col("seq"))))
    rows = rows.withColumns({
        "settled": settled,
        "alias_of": F.when(F.col("key").isNotNull() & ~F.col("_kept") & (holder != F.col("seq")), holder),
        "required": ~settled & F.col("digest").isNull() & (F.col("_group").isNull() | split | F.col("_paths")),
    })
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def settle(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(seq, outcome, key) for the files asked for: final, wanted (a digest is missing) or failed (ST-6)."""
    rows = with_keys(files)
    group = F.when(usable_uid(F.col("sop_instance_uid")), F.col("sop_instance_uid"))
    # a file without a usable identifier is final by its own digest or not at all: nothing of other files counts
    w = W.partitionBy(group, F.when(group.isNull(), F.col("seq")))
    first = F.min_by(F.struct("digest", "failure"), "seq").over(w)
    open_ = F.max((F.col("digest").isNull() & F.col("failure").isNull()).cast("int")).over(w) == 1
    alone = F.min("path").over(w) == F.max("path").over(w)
    rows = rows.withColumns({"_first": first, "_open": open_, "_alone": alone, "_g": group})
    sop = F.col("_g").isNotNull() & F.startswith(F.coalesce("key", F.lit("")), F.lit("sop:"))
    ready = F.col("settled") | (sop & (F.col("_alone") | (F.col("digest").isNotNull() & F.col("_first.digest").isNotNull() & ~F.col("_open"))))
    failed = (F.col("digest").isNull() & F.col("failure").isNotNull()) | (F.col("digest").isNotNull() & F.col("_first.digest").isNull() & F.col("_first.failure").isNotNull())
    outcome = F.when(ready, "final").when(failed, "failed").otherwise("wanted")
    return rows.join(wanted.select("seq"), "seq", "left_semi").select("seq", outcome.alias("outcome"), F.when(ready, F.col("key")).alias("key"))


def file_for_key(keys: DataFrame, key: str = "key", index: str = "seq") -> DataFrame:
    """(key, index) of the first holder of each key."""
    return keys.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(index).alias(index))


def first_digests(copies: DataFrame) -> DataFrame:
    """(key, frame, digest): of the copies listed, the first that has one wins (CTX-38)."""
    return copies.where(F.col("digest").isNotNull()).groupBy("key", "frame").agg(F.min_by("digest", "position").alias("digest"))


def one_profile(profiles: DataFrame, by: str) -> DataFrame:
    """(by, profile) where every occurrence is identical (CTX-55)."""
    return profiles.groupBy(by).agg(F.when(F.countDistinct("profile") == 1, F.min("profile")).alias("profile"))
