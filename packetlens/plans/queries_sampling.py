"""Registered queries for split and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import sampling as SM
from ..session import materialize
from .queries import SEQ_SQL, _sequences
from .registry import query
from .standins import duckdb_packets, packets

SEED = 42
SAMPLE_N = 100

BASE = (SEQ_SQL.replace("{SESSION}", "stream_id").replace("{L}", "10").replace("{SOURCE}", "packets")
        + f""",
seqrows AS (SELECT event_id, sequence_id, step, sequence_label FROM sized WHERE size = 10),
seqs AS (SELECT sequence_id, MAX(sequence_label) AS sequence_label FROM seqrows GROUP BY sequence_id),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sequence_label
                                       ORDER BY md5('{SEED}|' || sequence_id), sequence_id) AS rnk FROM seqs),
cnt AS (SELECT sequence_label, COUNT(*) AS n_l FROM seqs GROUP BY sequence_label)
""")


def _lr_sql(name: str, total_expr: str, size_col: str, base_expr: str, src: str) -> str:
    """Largest-remainder quota CTE ``name(sequence_label, q)`` over ``src``."""
    return f""",
{name}_a AS (SELECT sequence_label, ({total_expr}) * {size_col} // ({base_expr}) AS fl,
                    ({total_expr}) * {size_col} % ({base_expr}) AS rm, ({total_expr}) AS tot FROM {src}),
{name}_b AS (SELECT *, ROW_NUMBER() OVER (ORDER BY rm DESC, sequence_label) AS pos,
                    tot - SUM(fl) OVER () AS left_over FROM {name}_a),
{name} AS (SELECT sequence_label, fl + CASE WHEN pos <= left_over THEN 1 ELSE 0 END AS q FROM {name}_b)"""


SPLIT_SQL = BASE + """,
tot AS (SELECT SUM(n_l) AS n, CAST(FLOOR(CAST(0.7 AS DOUBLE) * SUM(n_l)) AS BIGINT) AS n_train,
               CAST(FLOOR(CAST(0.15 AS DOUBLE) * SUM(n_l)) AS BIGINT) AS n_val FROM cnt),
cntt AS (SELECT cnt.*, n, n_train, n_val, n - n_train - n_val AS n_test FROM cnt, tot)""" \
    + _lr_sql("tq", "n_test", "n_l", "n", "cntt") + """,
rest AS (SELECT cntt.*, n_l - q AS rest_l FROM cntt JOIN tq USING (sequence_label))""" \
    + _lr_sql("trq", "n_train", "rest_l", "n - n_test", "rest") + """,
assigned AS (
  SELECT r.sequence_id, CASE WHEN r.rnk <= tq.q THEN 'test' WHEN r.rnk <= tq.q + trq.q THEN 'train'
                             ELSE 'val' END AS split
  FROM ranked r JOIN tq USING (sequence_label) JOIN trq USING (sequence_label))
"""


def _written(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The sequence rows' id, label and ``columns``, written once: a draw reads them for its hashes and again for its rows.

    Other columns are not carried through the cut's shuffle.
    """
    return materialize(_sequences(spark, sf_dir).select("sequence_id", "sequence_label", *columns), "sequence-rows")


def _split_rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return SM.stratified_split(_written(spark, sf_dir, *columns), seed=SEED)


@query("stratified_split", SPLIT_SQL + """
SELECT event_id, sequence_id, split FROM seqrows JOIN assigned USING (sequence_id)""")
def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified 70/15/15 train/val/test split of packet sequences by hash rank."""
    return _split_rows(spark, sf_dir, "event_id").select("event_id", "sequence_id", "split")


@query("pos_weight", SPLIT_SQL + """,
tv AS (SELECT s.sequence_id, s.sequence_label FROM seqs s JOIN assigned a USING (sequence_id)
       WHERE a.split IN ('train', 'val'))
SELECT COUNT(CASE WHEN sequence_label = 0 THEN 1 END) AS negatives,
       COUNT(CASE WHEN sequence_label = 1 THEN 1 END) AS positives,
       round(CAST(COUNT(CASE WHEN sequence_label = 0 THEN 1 END) AS DOUBLE)
             / COUNT(CASE WHEN sequence_label = 1 THEN 1 END), 6) AS pos_weight
FROM tv""")
def q_pos_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives / positives over train+val sequences."""
    from pyspark.sql import functions as F
    pw = SM.pos_weight(_split_rows(spark, sf_dir))
    return pw.select("negatives", "positives", F.round("pos_weight", 6).alias("pos_weight"))


@query("balanced_sample", BASE + f"""
SELECT event_id, sequence_id, step, sequence_label FROM seqrows
WHERE sequence_id IN (SELECT sequence_id FROM ranked WHERE rnk <= {SAMPLE_N // 2})""")
def q_balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 sequences per label, those of the smallest hashes."""
    return SM.balanced_sample(_written(spark, sf_dir, "event_id", "step"), SAMPLE_N, SEED).select(
        "event_id", "sequence_id", "step", "sequence_label")


@query("stratified_sample", BASE + """,
cntn AS (SELECT cnt.*, (SELECT SUM(n_l) FROM cnt) AS n FROM cnt)""" + _lr_sql("sq", str(SAMPLE_N), "n_l", "n", "cntn") + """
SELECT event_id, sequence_id, step, sequence_label FROM seqrows
WHERE sequence_id IN (SELECT sequence_id FROM ranked JOIN sq USING (sequence_label) WHERE rnk <= q)""")
def q_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 sequences with label shares kept (largest remainder)."""
    return SM.stratified_sample(_written(spark, sf_dir, "event_id", "step"), SAMPLE_N, SEED).select(
        "event_id", "sequence_id", "step", "sequence_label")


@query("random_sample", BASE + f"""
SELECT event_id, sequence_id, step, sequence_label FROM seqrows
WHERE sequence_id IN (SELECT sequence_id FROM seqs ORDER BY md5('{SEED}|' || sequence_id), sequence_id
                      LIMIT {SAMPLE_N})""")
def q_random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: the 100 sequences with the smallest hash rank (the limit is the sample)."""
    return SM.random_sample(_written(spark, sf_dir, "event_id", "step"), SAMPLE_N, SEED).select(
        "event_id", "sequence_id", "step", "sequence_label")


@query("semi_filter", f"""
WITH packets AS ({duckdb_packets()})
SELECT event_id, stream_id FROM packets WHERE stream_id IN (SELECT stream_id FROM packets WHERE rst = 1)""")
def q_semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: packets of the streams that have a reset, by a table of ids."""
    p = packets(spark, sf_dir)
    return SM.semi_filter(p, p.where("rst = 1").select("stream_id"), "stream_id").select("event_id", "stream_id")
