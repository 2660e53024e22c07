"""Registered queries for scalar functions, casts, null fill and schema operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import nulls, schema
from .queries import PACKETS_CTE
from .registry import query
from .standins import packets, table

_WS_SQL = " || ".join(f"chr({ord(ch)})" for ch in X.WHITESPACE)


@query("fill_nulls", PACKETS_CTE + """
SELECT event_id, COALESCE(ip_src, 'NONE') AS ip_src, COALESCE(port_dst, -1) AS port_dst,
       COALESCE(num_a, -1) AS num_a, COALESCE(payload, 'NONE') AS payload, attack_label,
       port_dst IS NOT NULL AS "port_dst.is_valid", num_a IS NOT NULL AS "num_a.is_valid"
FROM packets""")
def q_fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill nulls by type; numeric columns with nulls get a validity flag."""
    p = packets(spark, sf_dir).select("event_id", "ip_src", "port_dst", "num_a", "payload", "attack_label")
    return nulls.fill_nulls(p)


@query("text_length", f"""
SELECT doc_id, CAST(length(trim(COALESCE(text, ''), {_WS_SQL})) AS BIGINT) AS text_len,
       CAST(length(trim(text, {_WS_SQL})) AS BIGINT) AS text_len_or_null,
       CAST(length(text) AS BIGINT) AS raw_len
FROM documents""")
def q_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed length in characters (null as empty, and null kept), untrimmed length."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.text_length("text", null_as_empty=True).alias("text_len"),
                    X.text_length("text").alias("text_len_or_null"),
                    F.length("text").cast("long").alias("raw_len"))


# Fixed value: the binary coding of event types used by the label-mapping query.
EVENT_LABELS = {"view": 0, "click": 0, "purchase": 0, "signup": 0, "error": 1}
LANG_NAMES = {"en": "english", "de": "german", "fr": "french"}


@query("label_mapping", """
SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 0 WHEN 'purchase' THEN 0
                 WHEN 'signup' THEN 0 WHEN 'error' THEN 1 END AS attack_label,
       event_type = 'error' AS is_error
FROM events""")
def q_label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 strict / C9 / C10: event type -> binary label (unknown raises), equality flag."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", X.map_values("event_type", EVENT_LABELS, strict=True).alias("attack_label"),
                    X.flag_equals("event_type", "error").alias("is_error"))


@query("value_mapping", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french'
               END AS lang_name FROM documents""")
def q_value_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 with default: language code -> name, unknown -> null."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.map_values("lang", LANG_NAMES, default=None).alias("lang_name"))


@query("value_mapping_table", """
SELECT l_orderkey, l_linenumber, p_name AS part_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def q_value_mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 strict through a table: part key -> part name, as many keys as parts."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS key", "p_name AS value")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return X.map_values_by_table(lines, "l_partkey", parts, "part_name", strict=True).drop("l_partkey")


# Capture-time text built from events.ts: ' <year> <time with ns> ', some rows unparseable.
_TIME_TEXT_SPARK = ("CASE WHEN event_id % 17 = 0 THEN 'n/a' "
                    "ELSE ' ' || date_format(ts, 'yyyy HH:mm:ss.SSSSSS') || '000 ' END")
_TIME_TEXT_DUCK = ("CASE WHEN event_id % 17 = 0 THEN 'n/a' "
                   "ELSE ' ' || strftime(ts, '%Y %H:%M:%S.%f') || '000 ' END")


@query("parse_epoch", f"""
WITH t AS (SELECT event_id, {_TIME_TEXT_DUCK} AS frame_time FROM events)
SELECT event_id, epoch_us(try_strptime(trim(frame_time, {_WS_SQL}), '%Y %H:%M:%S.%n')) / 1e6 AS epoch_s,
       try_strptime(trim(frame_time, {_WS_SQL}), '%Y %H:%M:%S.%n') IS NOT NULL AS parseable
FROM t""")
def q_parse_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture time text (year + time of day, ns) -> epoch seconds; parse flag."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_TIME_TEXT_SPARK).alias("frame_time"))
    return e.select("event_id", X.parse_epoch("frame_time").alias("epoch_s"),
                    X.is_parseable("frame_time").alias("parseable"))


@query("parse_date", """
WITH t AS (SELECT l_orderkey, l_linenumber,
                  CASE WHEN l_linenumber = 7 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS d
           FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CAST(try_strptime(d, '%Y-%m-%d') AS DATE) AS VARCHAR) AS ship_date FROM t""")
def q_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date text -> date, lenient (bad text -> null); shown as ISO text."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 7, F.lit("unknown"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("d"))
    return li.select("l_orderkey", "l_linenumber", X.parse_date("d").cast("string").alias("ship_date"))


_HEX_TEXT = ("CASE WHEN event_id % 2 = 0 THEN '0x' || lower(hex(user_id)) ELSE hex(event_id) END")
_MIXED_TEXT = ("CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS STRING) "
               "WHEN event_id % 3 = 1 THEN hex(event_id * 7919) ELSE props END")


@query("hex_and_numbers", f"""
WITH t AS (SELECT event_id, {_HEX_TEXT} AS flags, {_MIXED_TEXT.replace('STRING', 'VARCHAR')} AS msg FROM events)
SELECT event_id,
  TRY_CAST('0x' || regexp_replace(flags, '^0[xX]', '') AS BIGINT) AS flags_num,
  COALESCE(TRY_CAST(msg AS DOUBLE),
           CASE WHEN regexp_matches(msg, '^[0-9a-fA-F]+$') THEN CAST(TRY_CAST('0x' || msg AS BIGINT) AS DOUBLE) END)
    AS msg_num,
  CASE WHEN TRY_CAST(msg AS DOUBLE) IS NULL OR isnan(TRY_CAST(msg AS DOUBLE)) THEN -1.0
       ELSE TRY_CAST(msg AS DOUBLE) END AS msg_or_default
FROM t""")
def q_hex_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex flags -> long (strict), number-else-hex, number-else-default."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_HEX_TEXT).alias("flags"),
                                               F.expr(_MIXED_TEXT).alias("msg"))
    return e.select("event_id", X.hex_to_long("flags").alias("flags_num"),
                    X.number_or_hex("msg").alias("msg_num"),
                    X.number_or_default("msg").alias("msg_or_default"))


_CAST_TEXT = ("CASE event_id % 5 WHEN 0 THEN '12' WHEN 1 THEN '1.5' WHEN 2 THEN ' 7 ' "
              "WHEN 3 THEN 'abc' ELSE CAST(user_id AS STRING) END")


@query("casts", f"""
WITH t AS (SELECT event_id, user_id, {_CAST_TEXT.replace('STRING', 'VARCHAR')} AS raw FROM events)
SELECT event_id, CAST(CAST(user_id AS VARCHAR) AS BIGINT) AS user_id_strict,
  CAST(trunc(COALESCE(TRY_CAST(raw AS DOUBLE), 0.0)) AS BIGINT) AS raw_via_double,
  CASE WHEN regexp_matches(trim(raw), '^-?[0-9]+$') THEN TRY_CAST(raw AS BIGINT) END AS raw_long
FROM t""")
def q_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict cast; lenient cast through double with 0 fill; lenient direct cast."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(_CAST_TEXT).alias("raw"))
    return e.select("event_id", X.cast_strict(F.col("user_id").cast("string"), "long").alias("user_id_strict"),
                    X.cast_lenient("raw", "long", fill=0, via="double").alias("raw_via_double"),
                    X.cast_lenient("raw", "long").alias("raw_long"))


_SENT_A = ("CASE WHEN event_id % 7 = 0 THEN '-' WHEN event_id % 11 = 0 THEN '?' "
           "WHEN event_id % 13 = 0 THEN '' WHEN event_id % 19 = 0 THEN NULL ELSE props END")
_SENT_B = "CASE WHEN event_id % 17 = 0 THEN '#DIV/0!' ELSE event_type END"


def _sentinel_frame(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_SENT_A).alias("a"),
                                                  F.expr(_SENT_B).alias("b"))


@query("missing_rate", f"""
WITH t AS (SELECT event_id, {_SENT_A} AS a, {_SENT_B} AS b FROM events)
SELECT round(AVG(CAST((a IN ('-', '', '?', '#DIV/0!') OR b IN ('-', '', '?', '#DIV/0!')) AS DOUBLE)) * 100, 6)
       AS missing_pct,
       COUNT(*) AS n_rows
FROM t""")
def q_missing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share (%) of rows with a missing-value token in any column (null rows skipped)."""
    t = _sentinel_frame(spark, sf_dir)
    pred = X.missing_sentinel(["a", "b"])
    return t.agg(F.round(F.avg(pred.cast("double")) * 100, 6).alias("missing_pct"),
                 F.count(F.lit(1)).alias("n_rows"))


@query("drop_sentinel_rows", f"""
WITH t AS (SELECT event_id, {_SENT_A} AS a, {_SENT_B} AS b FROM events)
SELECT event_id, a, b FROM t
WHERE NOT (a IN ('-', '', '?', '#DIV/0!') OR b IN ('-', '', '?', '#DIV/0!'))""")
def q_drop_sentinel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep rows without missing tokens (three-valued: unknown rows drop)."""
    t = _sentinel_frame(spark, sf_dir)
    return t.filter(~X.missing_sentinel(["a", "b"])).select("event_id", "a", "b")


def _superfluous_sql(cols: list[str], src: str) -> str:
    parts = [f"SELECT '{n}' AS feature FROM {src} HAVING COUNT({n}) = 0 OR "
             f"(COUNT({n}) = COUNT(*) AND MIN({n}) = MAX({n}))" for n in cols]
    return "\nUNION ALL\n".join(parts)


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("superfluous_columns",
       "WITH f AS (SELECT *, 'k' AS constant, CAST(NULL AS VARCHAR) AS nothing FROM orders)\n"
       + _superfluous_sql([*_ORDER_COLS, "constant", "nothing"], "f"))
def q_superfluous_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of orders, a constant and an all-null one beside them, with at most one distinct value."""
    o = table(spark, sf_dir, "orders").withColumn("constant", F.lit("k")).withColumn("nothing", F.lit(None).cast("string"))
    names = schema.superfluous_columns(o)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("union_supertyped", """
WITH u AS (
  SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey AS BIGINT) AS nation,
         CAST(c_acctbal > 0 AS VARCHAR) AS flag, c_mktsegment AS label FROM customer
  UNION ALL
  SELECT s_suppkey, CAST(s_nationkey AS BIGINT), CAST(s_nationkey AS VARCHAR), s_name FROM supplier)
SELECT flag, id AS nation, label, nation AS id FROM u""")
def q_union_supertyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1/G3 + B2/B3/B8: supertype union (bool+int -> string), swap rename, strict drop, sorted columns."""
    cu = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"),
        (F.col("c_acctbal") > 0).alias("flag"), F.col("c_mktsegment").alias("label"),
        F.col("c_name").alias("extra"))
    su = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("nation"),
        F.col("s_nationkey").alias("flag"), F.col("s_name").alias("label"), F.col("s_name").alias("extra"))
    u = schema.union_supertyped([cu, su])
    u = schema.rename(u, {"id": "nation", "nation": "id"})
    u = schema.drop_columns(u, ["extra"], strict=True)
    return schema.sort_columns(u)


@query("filters", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE (o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))
   OR (NOT (o_orderpriority NOT IN ('5-LOW')) AND o_totalprice IS NOT NULL AND o_custkey = 1)
   OR o_orderdate IS NULL""")
def q_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, inequality, in-list, not-in, null tests, negation, conjunction, disjunction."""
    o = table(spark, sf_dir, "orders")
    cond = (((F.col("o_orderstatus") != "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
            | (~(~F.col("o_orderpriority").isin("5-LOW")) & F.col("o_totalprice").isNotNull()
               & (F.col("o_custkey") == 1))
            | F.col("o_orderdate").isNull())
    return o.filter(cond).select("o_orderkey", "o_orderstatus", "o_orderpriority")
