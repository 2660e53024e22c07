"""Registered queries for profiling aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import schema
from ..operators import sketches as K
from ..session import materialize
from .registry import query
from .standins import table


@query("value_counts", """
SELECT o_orderpriority, COUNT(*) AS count,
       round(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM orders) * 100, 3) AS density_pct
FROM orders GROUP BY o_orderpriority""")
def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts with density (%) of order priorities."""
    return P.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("group_count", """
SELECT l_returnflag, l_linestatus, COUNT(*) AS count FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group count over two keys."""
    return P.group_count(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("label_distribution", """
SELECT quality, COUNT(*) AS count,
       round(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM labels) * 100, 6) AS pct
FROM labels GROUP BY quality""")
def q_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label distribution (count and %)."""
    return P.label_distribution(table(spark, sf_dir, "labels"), "quality")


@query("target_counts", """
SELECT lang, toxic, COUNT(*) AS count
FROM labels JOIN documents USING (doc_id) GROUP BY lang, toxic""")
def q_target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a categorical feature by target (document language by toxicity)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return P.group_count(lab.join(d, "doc_id"), ["lang", "toxic"])


_DESC_COLS = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]
_PCTS = (0.25, 0.5, 0.9, 0.95, 0.99)


def _desc_sql() -> str:
    parts = []
    for n in _DESC_COLS:
        qs = ", ".join(f"round(quantile_cont({n}, {p}), 6) AS p{int(round(p * 100))}" for p in _PCTS)
        parts.append(f"""SELECT l_returnflag, '{n}' AS feature, COUNT({n}) AS count,
  COUNT(*) - COUNT({n}) AS null_count, round(AVG({n}), 6) AS mean, round(STDDEV_SAMP({n}), 6) AS std,
  round(MIN({n}), 6) AS min, {qs}, round(MAX({n}), 6) AS max FROM lineitem GROUP BY l_returnflag""")
    return "\nUNION ALL\n".join(parts)


@query("describe", _desc_sql())
def q_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 (+B6): describe every numeric non-key lineitem column per return flag."""
    li = table(spark, sf_dir, "lineitem")
    cols = schema.columns_where(li, "numeric", exclude=["l_orderkey", "l_partkey", "l_suppkey",
                                                         "l_linenumber"])
    d = P.describe(li, cols, _PCTS, by="l_returnflag")
    num = [x for x in d.columns if x not in ("l_returnflag", "feature", "count", "null_count")]
    return d.select("l_returnflag", "feature", "count", "null_count",
                    *[F.round(x, 6).alias(x) for x in num])


# Spark type names of the profiled orders columns (as the profile reports them).
_ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
                "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


def _profile_sql(src: str, cols: dict[str, str]) -> str:
    parts = []
    for n, t in cols.items():
        parts.append(f"""SELECT '{n}' AS feature, CAST(SUM(cnt) - COALESCE(SUM(CASE WHEN v IS NULL THEN cnt END), 0) AS BIGINT)
    AS observations, CAST(COALESCE(SUM(CASE WHEN v IS NULL THEN cnt END), 0) AS BIGINT) AS missing,
  round(CAST(COALESCE(SUM(CASE WHEN v IS NULL THEN cnt END), 0) AS DOUBLE) / SUM(cnt) * 100, 2) AS missing_rate_pct,
  round(CAST(MAX(cnt) AS DOUBLE) / SUM(cnt) * 100, 3) AS first_density_pct,
  round(round(CAST(MAX(cnt) AS DOUBLE) / SUM(cnt) * 100, 3)
        - round(CAST(COALESCE(list_sort(list(cnt), 'DESC')[2], 0) AS DOUBLE) / SUM(cnt) * 100, 3), 3)
    AS density_gap_pct,
  '{t}' AS variable_type, COUNT(*) AS unique_values,
  CASE WHEN COUNT(*) <= 1 THEN 'Superfluous' WHEN COUNT(*) = 2 THEN 'Flag'
       WHEN COUNT(*) <= 10 THEN 'Categorical' ELSE 'Categorical - High Cardinality' END AS feature_type
FROM (SELECT {n} AS v, COUNT(*) AS cnt FROM {src} GROUP BY {n})""")
    return "\nUNION ALL\n".join(parts)


@query("profile_columns", _profile_sql("orders", _ORDER_TYPES))
def q_profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 (+E3/E4): one-pass column profile of orders."""
    return P.profile_columns(table(spark, sf_dir, "orders"))


@query("profile_columns_sketched", "SELECT * EXCLUDE (unique_values, feature_type) FROM (" + _profile_sql("orders", _ORDER_TYPES) + ")")
def q_profile_columns_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 in two scans: heavy hitters sketched, then counted; the sketched distinct counts are left out here."""
    return K.profile_columns_sketched(table(spark, sf_dir, "orders")).drop("unique_values", "feature_type")


@query("stored_sketches", """
SELECT f.feature, COUNT(*) AS rows, COUNT(*) - COUNT(f.x) AS nulls, MIN(f.x) AS min, MAX(f.x) AS max, TRUE AS distinct_close, TRUE AS median_close
FROM (SELECT 'l_extendedprice' AS feature, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem
      UNION ALL SELECT 'l_quantity', CAST(l_quantity AS DOUBLE) FROM lineitem
      UNION ALL SELECT 'l_partkey', CAST(l_partkey AS DOUBLE) FROM lineitem) f GROUP BY f.feature""")
def q_stored_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 + E5: sketches stored per ship month, read back and merged to the whole; held against exact distinct counts and ranks."""
    cols = ["l_extendedprice", "l_quantity", "l_partkey"]
    li = table(spark, sf_dir, "lineitem")
    months = materialize(K.sketch_table(li.withColumn("month", F.date_format("l_shipdate", "yyyy-MM")), cols, ["month"]), "sketches")
    got = K.sketch_profile(K.merge_sketches(months), (0.5,))
    exact = li.agg(*[F.count_distinct(n).alias(n) for n in cols])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("d")) for n in cols])))
    long = li.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in cols])))
    ranks = (long.join(F.broadcast(got.select("feature", "p50")), "feature").groupBy("feature")
             .agg(F.avg((F.col("x") < F.col("p50")).cast("double")).alias("below"), F.avg((F.col("x") <= F.col("p50")).cast("double")).alias("upto")))
    slack = 2 * K.rank_error()
    return got.join(exact, "feature").join(ranks, "feature").select(
        "feature", "rows", "nulls", "min", "max", (F.abs(F.col("distinct") / F.col("d") - 1) <= 4 * K.distinct_error()).alias("distinct_close"),
        ((F.col("below") <= 0.5 + slack) & (F.col("upto") >= 0.5 - slack)).alias("median_close"))


@query("profile_without_superfluous",
       "WITH f AS (SELECT *, 'k' AS constant, CAST(NULL AS VARCHAR) AS nothing FROM orders), prof AS ("
       + _profile_sql("f", {**_ORDER_TYPES, "constant": "string", "nothing": "string"}) + ") SELECT * FROM prof WHERE unique_values > 1")
def q_profile_without_superfluous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 + B7 + G5: profile of orders with a constant and an all-null column, minus these superfluous ones (anti join)."""
    o = table(spark, sf_dir, "orders").withColumn("constant", F.lit("k")).withColumn("nothing", F.lit(None).cast("string"))
    prof = P.profile_columns(o)
    drop = prof.filter(F.col("feature_type") == "Superfluous").select("feature")
    return P.anti_features(prof, drop)


@query("target_box", """
WITH b AS (SELECT l_returnflag, COUNT(l_extendedprice) AS n,
                  quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY l_returnflag),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)
SELECT f.l_returnflag, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(MIN(CASE WHEN l_extendedprice BETWEEN lo AND hi THEN l_extendedprice END), 6) AS whisker_low,
       round(MAX(CASE WHEN l_extendedprice BETWEEN lo AND hi THEN l_extendedprice END), 6) AS whisker_high,
       COUNT(CASE WHEN l_extendedprice IS NOT NULL AND NOT (l_extendedprice BETWEEN lo AND hi) THEN 1 END)
         AS outliers
FROM f JOIN lineitem l ON l.l_returnflag = f.l_returnflag
GROUP BY f.l_returnflag, n, q1, median, q3""")
def q_target_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box statistics of extended price per return flag (numeric feature)."""
    li = table(spark, sf_dir, "lineitem")
    b = P.target_relationship(li, "l_extendedprice", "l_returnflag")
    return b.select("l_returnflag", "n", *[F.round(x, 6).alias(x) for x in
                                           ("q1", "median", "q3", "whisker_low", "whisker_high")],
                    "outliers")


@query("distinct_values", "SELECT DISTINCT lang FROM documents")
def q_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct languages."""
    return P.distinct_values(table(spark, sf_dir, "documents"), "lang")


@query("top_orders", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def q_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-20 orders by price (the limit is the report)."""
    o = table(spark, sf_dir, "orders")
    return P.top_n(o, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 20).select(
        "o_orderkey", "o_totalprice")


@query("distinct_count", """
SELECT COUNT(DISTINCT l_partkey) + MAX(CASE WHEN l_partkey IS NULL THEN 1 ELSE 0 END) AS l_partkey,
       COUNT(DISTINCT l_suppkey) + MAX(CASE WHEN l_suppkey IS NULL THEN 1 ELSE 0 END) AS l_suppkey,
       COUNT(DISTINCT l_shipdate) + MAX(CASE WHEN l_shipdate IS NULL THEN 1 ELSE 0 END) AS l_shipdate
FROM lineitem""")
def q_distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts (null counted as a value) of three lineitem columns."""
    return P.distinct_count(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey", "l_shipdate"])
