"""Discovery records, change cursors and trees (AGG-3 to AGG-7, ST-1, ST-2, ST-17 to ST-19, SORT-11, SORT-12, SET-6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenstack.functions.text import common_prefix, first_known, known_first, natural_key, numeric_first, path_parts, person_name
from lumenstack.numbering import numbered

RECENT = 256
#: Reasons of discovery records, in order.
REASONS = (
    "valid_dicom",
    "valid_image",
    "input_path_unavailable",
    "directory_entry_unreadable",
    "unrecognized_format",
    "format_not_selected",
    "raster_header_invalid",
    "dicom_parse_failed",
    "unsupported_media_directory",
    "inspection_failed",
    "filter_mismatch",
)


def discovery_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("disposition").agg(F.count("*").alias("n"))


def reason_rank(reason: Column, reasons: Sequence[str] = REASONS) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in reasons]), reason)


def skip_breakdown(records: DataFrame, reasons: Sequence[str] = REASONS) -> DataFrame:
    """(reason, n) of skipped records in the order of the reasons."""
    counts = records.where(F.col("disposition") == "skipped").groupBy("reason").agg(F.count("*").alias("n"))
    return counts.orderBy(reason_rank(F.col("reason"), reasons), "reason")


def recent_records(records: DataFrame, seq: str, limit: int = RECENT) -> DataFrame:
    """The last records that weren't selected; a bounded list is what this operator is."""
    return records.where(F.col("disposition") != "selected").orderBy(F.col(seq).desc()).limit(limit)


def latest(events: DataFrame, by: Sequence[str], revision: str) -> DataFrame:
    """The row of the highest revision of each key."""
    names = [c for c in events.columns if c not in by]
    return events.groupBy(*by).agg(F.max_by(F.struct(*names), revision).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in names])


def with_revisions(events: DataFrame, order: Sequence[str], start: int = 0) -> DataFrame:
    """events with `revision`, one more for each in order, from start + 1."""
    return numbered(events, order, "revision", start + 1)


def delta_page(entries: DataFrame, since: int | None, limit: int | None, revision: str = "revision") -> tuple[DataFrame, dict]:
    """Entries above a cursor, ascending, at most `limit`, and the page's state: revision, more, reset.

    entries hold one row a key, its latest revision. A cursor ahead of the catalog starts again from 0.
    The page itself is a top-k plan; the state needs one aggregate over the entries and one over the page.
    """
    top = entries.agg(F.max(revision)).first()[0] or 0
    reset = since is not None and since > top
    after = 0 if reset else (since or 0)
    rows = entries.where(F.col(revision) > after)
    if since is None and limit is None:
        return entries, {"revision": top, "more": False, "reset": False}
    if limit is None:
        return rows.orderBy(revision), {"revision": top, "more": False, "reset": reset}
    page = rows.orderBy(revision).limit(limit)
    last, n = page.agg(F.max(revision), F.count("*")).first()
    more = n == limit and rows.where(F.col(revision) > last).limit(1).count() > 0
    return page, {"revision": last if more else top, "more": more, "reset": reset}


def rekeys_between(rekeys: DataFrame, after: int, upto: int) -> DataFrame:
    """Logged key replacements of a page, oldest first."""
    return rekeys.where((F.col("revision") > after) & (F.col("revision") <= upto)).orderBy("revision")


def changed_entries(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of current that previous doesn't hold unchanged."""
    side = lambda df, n: df.select(*keys, F.xxhash64(F.struct(*sorted(df.columns))).alias(n))
    return current.join(side(previous, "_h"), list(keys), "left").where(F.col("_h").isNull() | (F.col("_h") != F.xxhash64(F.struct(*[current[c] for c in sorted(current.columns)])))).drop("_h")


def last_write(writes: DataFrame, key: str = "file_index") -> DataFrame:
    """The boxes in force of each file: the write of the highest revision (ST-18)."""
    return latest(writes, [key], "revision")


def boxes_for_frame(stored: DataFrame, frame: Column) -> DataFrame:
    """stored with `boxes`: those of one frame; without frame lists all, an empty own list none (ST-19)."""
    own = F.transform("roi_coords", lambda b, i: F.when(F.coalesce(F.array_contains(F.get("roi_frames", i), frame), F.get("roi_frames", i).isNull()), b))
    return stored.withColumn("boxes", F.filter(own, lambda b: b.isNotNull()))


def navigator_rows(files: DataFrame) -> DataFrame:
    """files with patient, study and series keys and labels; blank identities fall back to the file itself (AGG-3)."""
    alone = F.concat(F.lit("file-"), F.col("file_index").cast("string"))
    key = lambda prefix, *cols: F.concat(F.lit(prefix + ":"), F.coalesce(first_known(*[F.col(c) for c in cols]), alone))
    patient = key("patient", "patient_id", "patient_name")
    study = F.concat_ws("/", patient, key("study", "study_instance_uid", "study_description", "study_date"))
    series = F.concat_ws("/", study, key("series", "series_instance_uid", "series_number", "series_description"))
    return files.withColumns({
        "patient_key": patient,
        "study_key": study,
        "series_key": series,
        "patient_label": F.coalesce(first_known(person_name(F.col("patient_name")), F.col("patient_id")), F.lit("Unknown Patient")),
        "study_label": F.coalesce(first_known(F.col("study_description")), F.lit("Study")),
    })


def navigator_order() -> list[Column]:
    """Patients by name and id, studies newest first, series by number, images by instance number."""
    return [
        *known_first(person_name(F.col("patient_name"))),
        *known_first(F.col("patient_id")),
        *known_first(F.col("study_date"), descending=True),
        *known_first(F.col("study_description")),
        *numeric_first(F.col("series_number")),
        *known_first(F.col("series_description")),
        *numeric_first(F.col("instance_number")),
        natural_key(F.col("path")).asc(),
        F.col("file_index").asc(),
    ]


def navigator_counts(rows: DataFrame) -> DataFrame:
    """(patient_key, study_key or null, studies, series, images): counts of patients and of their studies (AGG-4)."""
    base = rows.groupBy("patient_key", "study_key", "series_key").agg(F.count("*").alias("n"))
    out = base.rollup("patient_key", "study_key").agg(F.countDistinct("study_key").alias("studies"), F.countDistinct("series_key").alias("series"), F.sum("n").alias("images"), F.grouping_id().alias("level"))
    return out.where(F.col("level") < 3).drop("level")


def folder_tree(files: DataFrame, path: str = "path") -> DataFrame:
    """(parent, label, kind, file_index, files): folders below the deepest shared one, which is kept, and files (AGG-5, SORT-12)."""
    folders = F.slice(path_parts(F.col(path)), F.lit(1), F.greatest(F.size(path_parts(F.col(path))) - 1, F.lit(0)))
    shared = files.agg(F.greatest(F.size(common_prefix(F.min(folders), F.max(folders))) - 1, F.lit(0)).alias("_trim"))
    rows = files.join(F.broadcast(shared)).select("file_index", F.slice(path_parts(F.col(path)), F.col("_trim") + 1, F.lit(1 << 30)).alias("parts"))
    steps = rows.select("file_index", F.size("parts").alias("depth"), "parts", F.posexplode("parts").alias("i", "label"))
    parent = F.array_join(F.when(F.col("i") > 0, F.slice("parts", F.lit(1), F.col("i"))).otherwise(F.array().cast("array<string>")), "/")
    leaf = F.col("i") == F.col("depth") - 1
    nodes = steps.select(parent.alias("parent"), "label", F.when(leaf, "file").otherwise("folder").alias("kind"), F.when(leaf, F.col("file_index")).alias("file_index"))
    return nodes.groupBy("parent", "label", "kind", "file_index").agg(F.count("*").alias("files"))


def folder_order() -> list[Column]:
    return [F.col("parent").asc(), (F.col("kind") == "file").asc(), natural_key(F.col("label")).asc(), F.col("label").asc(), F.col("file_index").asc_nulls_first()]
