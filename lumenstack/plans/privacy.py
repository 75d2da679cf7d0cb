"""Privacy queries: pseudonyms, shifted dates, hashed identifiers, masking rules, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstack.functions import privacy, shapes
from lumenstack.operators import catalog
from lumenstack.registry import query
from lumenstack.session import table

KEY = "session-key"
#: Hex digits of a keyed hash as a number, in SQL.
SHIFT_SQL = "('0x' || substr(sha256('session-key' || chr(31) || 'date shift' || chr(31) || {v}), 1, 12))::BIGINT % 730"
DAYS_SQL = f"CASE WHEN {SHIFT_SQL} < 365 THEN {SHIFT_SQL} - 365 ELSE {SHIFT_SQL} - 364 END"


@query(
    "pseudonym_rank",
    """
    SELECT e.event_id, p.number FROM events e
    JOIN (SELECT user_id, row_number() OVER (ORDER BY first) AS number FROM (SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id)) p USING (user_id)
    """,
)
def pseudonym_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms by order of first appearance (AGG-23)."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    numbers = privacy.pseudonyms(events, F.col("user_id"), "event_id")
    return events.join(numbers, F.col("user_id") == F.col("patient")).select("event_id", "number")


@query(
    "date_shift_mask",
    f"""
    SELECT o_orderkey, strftime(o_orderdate::DATE + ({DAYS_SQL.format(v="CAST(o_custkey AS VARCHAR)")})::INTEGER, '%Y%m%d') || '1200' AS shifted,
           CASE WHEN o_orderkey % 100 > 89 THEN '089Y' ELSE lpad(CAST(o_orderkey % 100 AS VARCHAR), 3, '0') || 'Y' END AS age
    FROM orders
    """,
)
def date_shift_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates moved by the patient's keyed offset with their suffix kept, and capped ages (FN-66, FN-68)."""
    value = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("1200"))
    age = F.concat(F.lpad((F.col("o_orderkey") % 100).cast("string"), 3, "0"), F.lit("Y"))
    days = privacy.shift_days(KEY, F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", privacy.shifted_date(value, days).alias("shifted"), privacy.capped_age(age).alias("age"))


@query(
    "birth_date_blank",
    """
    SELECT o_orderkey, (date_part('year', DATE '2024-06-15') - (1900 + o_orderkey % 120) - CASE WHEN 615 < 700 + o_orderkey % 20 THEN 1 ELSE 0 END > 89) AS blank FROM orders
    """,
)
def birth_date_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Birth dates that imply an age above 89 completed years are blank (FN-67)."""
    born = F.format_string("%04d07%02d", (F.lit(1900) + F.col("o_orderkey") % 120).cast("int"), (F.col("o_orderkey") % 20).cast("int"))
    born = F.when(F.col("o_orderkey") % 20 == 0, F.format_string("%04d0701", (F.lit(1900) + F.col("o_orderkey") % 120).cast("int"))).otherwise(born)
    return table(spark, sf_dir, "orders").select("o_orderkey", (privacy.birth_date(born, F.to_date(F.lit("2024-06-15")), F.lit(7)) == "").alias("blank"))


@query(
    "keyed_uid_hash",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '1.2.840.10008.' || p_partkey ELSE
        '2.25.' || CAST(CAST('0x' || substr(h, 1, 16) AS UHUGEINT) % 9223372036854775807 * 4294967296 + CAST('0x' || substr(h, 17, 16) AS UHUGEINT) % 4294967296 AS VARCHAR) END AS uid
    FROM (SELECT p_partkey, sha256('session-key' || chr(31) || 'uid' || chr(31) || '1.9.' || p_partkey) AS h FROM part)
    """,
)
def keyed_uid_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers hashed under a key; registered ones stay (FN-69)."""
    uid = F.concat(F.when(F.col("p_partkey") % 5 == 0, privacy.REGISTERED_ROOT).otherwise("1.9."), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", privacy.masked_uid(KEY, uid).alias("uid"))


TAGS_SQL = """
    SELECT conv_id * 1000 + turn AS row_id, CASE turn % 4 WHEN 0 THEN 8 WHEN 1 THEN 9 WHEN 2 THEN 16 ELSE 80 * 256 END AS grp, 16 * (conv_id % 5) AS elem,
           CASE conv_id % 4 WHEN 0 THEN 'PN' WHEN 1 THEN 'LO' WHEN 2 THEN 'TM' ELSE 'AS' END AS vr,
           CASE WHEN conv_id % 4 = 3 THEN '095Y' ELSE role END AS value FROM conversations
"""


@query(
    "mask_rule_ladder",
    f"""
    SELECT row_id, CASE WHEN grp % 2 = 1 AND NOT (elem BETWEEN 16 AND 255) THEN '[masked]' WHEN grp % 2 = 1 OR trim(value) = '' THEN value
        WHEN grp = 16 AND elem = 32 THEN 'MASKED-0007' WHEN grp = 16 AND elem = 16 THEN 'Patient 0007' WHEN grp = 16 AND elem = 48 THEN '[masked]'
        WHEN vr = 'TM' THEN value WHEN vr = 'AS' THEN '089Y'
        WHEN vr = 'PN' OR (grp = 8 AND elem IN (16, 48)) OR grp = 20480 THEN '[masked]' ELSE value END AS masked
    FROM ({TAGS_SQL})
    """,
)
def mask_rule_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered masking rules with a profile list joined by group and element (FN-70, FN-71)."""
    turn, conv = F.col("turn") % 4, F.col("conv_id") % 4
    tags = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.when(turn == 0, 8).when(turn == 1, 9).when(turn == 2, 16).otherwise(0x5000).alias("group"),
        (F.col("conv_id") % 5 * 16).cast("int").alias("element"),
        F.when(conv == 0, "PN").when(conv == 1, "LO").when(conv == 2, "TM").otherwise("AS").alias("vr"),
        F.when(conv == 3, "095Y").otherwise(F.col("role")).alias("value"),
    )
    profile = spark.createDataFrame([(8, 16), (8, 48)], "group int, element int")
    rows = privacy.with_listed(tags, profile)
    masked = privacy.masked_value(F.col("group"), F.col("element"), F.col("vr"), F.col("value"), F.col("listed"), KEY, F.lit(7), F.lit(1), F.current_date())
    return rows.select("row_id", masked.alias("masked"))


@query(
    "redaction_boxes",
    """
    SELECT l_linenumber, count(*) AS n, sum(CASE WHEN (l_linenumber >= 2 AND l_linenumber < 5 AND l_quantity >= 10 AND l_quantity < 30) OR (l_linenumber >= 6 AND l_linenumber < 8 AND l_quantity >= 0 AND l_quantity < 5)
        THEN 0 ELSE l_quantity END) AS left_over FROM lineitem GROUP BY l_linenumber
    """,
)
def redaction_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples inside half-open boxes replaced by the fill (ST-18, ST-19, FN-77)."""
    boxes = F.array(*[F.array(*[F.lit(float(x)) for x in b]) for b in ((2, 10, 5, 30), (6, 0, 8, 5))])
    value = shapes.redacted(F.col("l_quantity"), boxes, F.col("l_linenumber"), F.col("l_quantity"), F.lit(0.0))
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum(value).alias("left_over"))


@query(
    "boxes_in_force",
    """
    SELECT user_id AS file_index, max(event_id) AS revision, arg_max(event_id % 3, event_id) AS scope,
           CASE WHEN arg_max(event_id % 3, event_id) = 1 THEN 1 WHEN arg_max(event_id % 3, event_id) = 0 THEN 2 ELSE 0 END AS n_boxes
    FROM events GROUP BY user_id
    """,
)
def boxes_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last saved boxes of each file that apply to frame 1: no lists mean all frames, an empty own list none."""
    two = F.array(F.array(F.lit(0), F.lit(0), F.lit(2), F.lit(2)), F.array(F.lit(1), F.lit(1), F.lit(3), F.lit(3)))
    empty = F.array().cast("array<int>")
    scope = F.col("event_id") % 3
    lists = F.when(scope == 0, F.array().cast("array<array<int>>")).when(scope == 1, F.array(F.array(F.lit(1)), F.array(F.lit(0)))).otherwise(F.array(empty, empty))
    writes = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_index"), F.col("event_id").alias("revision"), scope.alias("scope"), two.alias("roi_coords"), lists.alias("roi_frames"))
    return catalog.boxes_for_frame(catalog.last_write(writes), F.lit(1)).select("file_index", "revision", "scope", F.size("boxes").alias("n_boxes"))
