"""Pseudonyms, shifted dates, hashed identifiers and the masking ladder (FN-66 to FN-73, AGG-23, CTX-26, CTX-27).

Hashes are keyed SHA-256, so a key gives the same replacements on every executor and in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenstack.functions.text import first_known
from lumenstack.numbering import numbered

MASKED, MAX_AGE, MAX_SHIFT, REGISTERED_ROOT = "[masked]", 89, 365, "1.2.840.10008."
PATIENT_ID, PATIENT_NAME, BIRTH_DATE = (0x0010, 0x0020), (0x0010, 0x0010), (0x0010, 0x0030)


def keyed(key: str, domain: str, value: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(domain), value).cast("binary"), 256)


def patient_key(patient_id: Column, patient_name: Column, study: Column, index: Column) -> Column:
    return F.coalesce(first_known(patient_id, patient_name, study), F.concat(F.lit("file "), index.cast("string")))


def shift_days(key: str, patient: Column) -> Column:
    """-365 to 365 days, never 0, from the patient's hash."""
    at = F.pmod(F.conv(F.substring(keyed(key, "date shift", patient), 1, 12), 16, 10).cast("bigint"), F.lit(2 * MAX_SHIFT))
    return F.when(at < MAX_SHIFT, at - MAX_SHIFT).otherwise(at - MAX_SHIFT + 1).cast("int")


def shifted_date(value: Column, days: Column) -> Column:
    """A date text moved by days, its suffix kept; blank stays blank, no calendar date is masked."""
    t = F.trim(value)
    date = F.try_to_date(F.substring(t, 1, 8), "yyyyMMdd")
    ok = F.substring(t, 1, 8).rlike("^[0-9]{8}$") & date.isNotNull()
    return F.when(t == "", "").when(ok, F.concat(F.date_format(F.date_add(date, days), "yyyyMMdd"), F.substring(t, 9, 1 << 30))).otherwise(MASKED)


def completed_years(born: Column, at: Column) -> Column:
    before = (F.month(at) * 100 + F.dayofmonth(at)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(at) - F.year(born) - before.cast("int")


def birth_date(value: Column, reference: Column, days: Column) -> Column:
    """Blank if it implies an age above 89 at the reference date, else shifted like any date."""
    born = F.try_to_date(F.substring(F.trim(value), 1, 8), "yyyyMMdd")
    return F.when(F.coalesce(completed_years(born, reference) > MAX_AGE, F.lit(False)), "").otherwise(shifted_date(value, days))


def capped_age(value: Column) -> Column:
    t = F.trim(value)
    years = F.regexp_extract(t, r"^\+?([0-9]+)Y$", 1).try_cast("bigint")
    return F.when(F.coalesce(years > MAX_AGE, F.lit(False)), f"{MAX_AGE:03d}Y").otherwise(t)


def masked_uid(key: str, uid: Column) -> Column:
    """`2.25.` and a 128-bit number of the keyed hash; registered and blank identifiers stay."""
    h = keyed(key, "uid", F.trim(uid))
    high, low = (F.conv(F.substring(h, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)") for i in (0, 1))
    # 2^64 as two factors of 2^32 keeps every step inside 38 digits; the top bit is dropped for the same reason
    high = high % F.lit("9223372036854775807").cast("decimal(38,0)")
    number = (high * F.lit(4294967296).cast("decimal(19,0)")).cast("decimal(38,0)")
    text = F.concat(F.lit("2.25."), (number + low % F.lit(4294967296).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string"))
    return F.when((F.trim(uid) == "") | F.startswith(F.trim(uid), F.lit(REGISTERED_ROOT)), uid).otherwise(text)


def pseudonyms(files: DataFrame, patient: Column, index: str) -> DataFrame:
    """(patient, number): patients by first appearance, from 1. One row a patient is numbered, not one a file."""
    first = files.groupBy(patient.alias("patient")).agg(F.min(index).alias("first"))
    return numbered(first, ["first"], "number").select("patient", F.col("number").cast("bigint").alias("number"))


def masked_value(group: Column, element: Column, vr: Column, value: Column, listed: Column, key: str, number: Column, days: Column, reference: Column) -> Column:
    """One text value by the ordered rules: private, identity, value representation, profile list."""
    private = group % 2 == 1
    creator = element.between(0x0010, 0x00FF)
    each = lambda f: F.array_join(F.transform(F.split(value, "; "), f), "; ")
    is_tag = lambda t: (group == t[0]) & (element == t[1])
    return (
        F.when(private & ~creator, MASKED)
        .when(private | (F.trim(value) == ""), value)
        .when(is_tag(PATIENT_ID), F.format_string("MASKED-%04d", number))
        .when(is_tag(PATIENT_NAME), F.format_string("Patient %04d", number))
        .when(is_tag(BIRTH_DATE), birth_date(value, reference, days))
        .when(vr == "UI", each(lambda v: masked_uid(key, v)))
        .when(vr.isin("DA", "DT"), each(lambda v: shifted_date(v, days)))
        .when(vr == "TM", value)
        .when(vr == "AS", each(capped_age))
        .when((vr == "PN") | listed, MASKED)
        .otherwise(value)
    )


def always_listed(group: Column, element: Column) -> Column:
    """Curve data (50xx) and overlay comments (60xx,4000)."""
    family = group.bitwiseAND(F.lit(0xFF00))
    return (family == 0x5000) | ((family == 0x6000) & (element == 0x4000))


def with_listed(tags: DataFrame, profile: DataFrame) -> DataFrame:
    """tags with `listed`: on the profile (group, element: a table the caller brings) or always listed."""
    own = profile.select("group", "element").distinct().withColumn("_on", F.lit(True))
    joined = tags.join(own, ["group", "element"], "left")
    return joined.withColumn("listed", F.coalesce("_on", F.lit(False)) | always_listed(F.col("group"), F.col("element"))).drop("_on")


def masked_uids(df: DataFrame, key: str) -> DataFrame:
    """Every string, or array of strings, under a field named `*_uid` or `*_uids`, at any depth, hashed."""

    def rewrite(c: Column, kind: T.DataType, name: str) -> Column:
        named = name.endswith(("_uid", "_uids"))
        if named and isinstance(kind, T.StringType):
            return masked_uid(key, c)
        if isinstance(kind, T.ArrayType):
            if named and isinstance(kind.elementType, T.StringType):
                return F.transform(c, lambda x: masked_uid(key, x))
            if isinstance(kind.elementType, (T.StructType, T.ArrayType)):
                return F.transform(c, lambda x: rewrite(x, kind.elementType, ""))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[rewrite(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[rewrite(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def masked_summary(files: DataFrame, key: str) -> DataFrame:
    """Catalog rows of a masked session: pseudonyms, shifted dates, hashed identifiers, withheld label images."""
    rows = files.withColumn("_patient", patient_key(F.col("patient_id"), F.col("patient_name"), F.col("study_instance_uid"), F.col("file_index")))
    rows = rows.join(pseudonyms(rows, F.col("_patient"), "file_index"), rows["_patient"] == F.col("patient"))
    days = shift_days(key, F.col("_patient"))
    dicom = F.col("format") == "dicom"
    hidden = F.coalesce(F.trim(F.get("image_type", F.lit(2))).isin("LABEL", "OVERVIEW"), F.lit(False))
    changed = {
        "patient_id": F.when(dicom, F.format_string("MASKED-%04d", "number")).otherwise(F.col("patient_id")),
        "patient_name": F.when(dicom, F.format_string("Patient %04d", "number")).otherwise(F.col("patient_name")),
        "study_date": F.when(dicom, shifted_date(F.col("study_date"), days)).otherwise(F.col("study_date")),
        "display_name": F.concat(F.lit("File "), (F.col("file_index") + 1).cast("string")),
        "support_reason": F.when(hidden, "masked_label_image").otherwise(F.col("support_reason")),
        **{c: masked_uid(key, F.col(c)) for c in ("study_instance_uid", "series_instance_uid", "sop_instance_uid")},
    }
    return rows.withColumns(changed).drop("_patient", "patient", "number")
