"""Registered queries: one per inventory item, each with its DuckDB oracle.

Every query reads the driver tables (directly or through the stand-in views
in ``standins``) over their whole extent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import sessions as S
from ..session import materialize
from .registry import query
from .standins import duckdb_packets, packets

PACKETS_CTE = f"WITH packets AS ({duckdb_packets()})"

# Oracle fixture parameters (FIXTURES.md section 3): 6 h timeout in microseconds.
TIMEOUT_US = 6 * 3600 * 1_000_000


def _sessionized(spark: SparkSession, sf_dir: str, after_close: str = "join") -> DataFrame:
    return S.sessionize(packets(spark, sf_dir), key="stream_id", time="ts_us", timeout=TIMEOUT_US,
                        tiebreak=["event_id"], is_tcp=True, syn="syn", ack="ack", fin="fin", rst="rst",
                        after_close=after_close)


SESSION_SQL = PACKETS_CTE + """,
s1 AS (SELECT *, CASE WHEN fin = 1 OR rst = 1 THEN NULL ELSE ts_us END AS eff,
              (syn = 1 AND NOT ack = 1) AS pure_syn FROM packets),
s2 AS (SELECT *, LAG(eff) OVER (PARTITION BY stream_id ORDER BY ts_us, event_id) AS prev,
              LAG(fin = 1 OR rst = 1) OVER (PARTITION BY stream_id ORDER BY ts_us, event_id) AS pcls
       FROM s1),
s3 AS (SELECT *, CASE WHEN {OPEN} THEN 1 ELSE 0 END AS opn FROM s2),
sessions AS (
  SELECT *, stream_id || '_' || CAST(SUM(opn) OVER (PARTITION BY stream_id ORDER BY ts_us, event_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR) AS session_id
  FROM s3)
"""
_OPEN_JOIN = f"prev IS NOT NULL AND (pure_syn OR ts_us - prev > {TIMEOUT_US})"
_OPEN_SPLIT = f"COALESCE(pcls, FALSE) OR ({_OPEN_JOIN})"


@query("sessionize", SESSION_SQL.replace("{OPEN}", _OPEN_JOIN)
       + "SELECT event_id, session_id FROM sessions")
def q_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gap/SYN/FIN sessionization of the packets view (6 h timeout, FIN joins)."""
    return _sessionized(spark, sf_dir).select("event_id", "session_id")


@query("sessionize_split", SESSION_SQL.replace("{OPEN}", _OPEN_SPLIT)
       + "SELECT event_id, session_id FROM sessions")
def q_sessionize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 with after_close='split': the packet after FIN/RST opens a new session."""
    return _sessionized(spark, sf_dir, "split").select("event_id", "session_id")


SEQ_BODY = """
numbered AS (
  SELECT *, CAST(CEIL(ROW_NUMBER() OVER (PARTITION BY {SESSION} ORDER BY ts_us, event_id) / {L}.0) AS BIGINT) AS chunk,
         CAST((ROW_NUMBER() OVER (PARTITION BY {SESSION} ORDER BY ts_us, event_id) - 1) % {L} AS INTEGER) AS step
  FROM {SOURCE}),
seq AS (
  SELECT *, {SESSION} || '||' || CAST(chunk AS VARCHAR) AS sequence_id FROM numbered),
sized AS (
  SELECT *, COUNT(*) OVER (PARTITION BY sequence_id) AS size,
         CAST(SUM(CAST(attack_label AS BIGINT)) OVER (PARTITION BY sequence_id) > 0 AS BIGINT) AS sequence_label
  FROM seq)
"""
SEQ_SQL = PACKETS_CTE + "," + SEQ_BODY


def _sequences(spark: SparkSession, sf_dir: str, length: int = 10) -> DataFrame:
    return S.make_sequences(packets(spark, sf_dir), length, session="stream_id", time="ts_us",
                            label="attack_label", tiebreak=["event_id"])


@query("make_sequences",
       SEQ_SQL.replace("{SESSION}", "stream_id").replace("{L}", "10").replace("{SOURCE}", "packets")
       + "SELECT event_id, sequence_id, step, sequence_label FROM sized WHERE size = 10")
def q_make_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full sequences of 10 packets per stream with their label."""
    return _sequences(spark, sf_dir).select("event_id", "sequence_id", "step", "sequence_label")


@query("sequence_label_counts",
       SESSION_SQL.replace("{OPEN}", _OPEN_JOIN) + ","
       + SEQ_BODY.replace("{SESSION}", "session_id").replace("{L}", "5")
       .replace("{SOURCE}", "sessions")
       + """SELECT sequence_label, COUNT(DISTINCT sequence_id) AS n_sequences
            FROM sized WHERE size = 5 GROUP BY sequence_label""")
def q_sequence_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: sessionize (F5) -> sequences of 5 (F4) -> sequences per label.

    The sessionized table is written once to the shared checkpoint folder: the
    sequence step reads it in two branches (bucket summary and rows), and
    parquet lets the summary branch read only its few columns.
    """
    sess = materialize(_sessionized(spark, sf_dir), "sessions")
    seq = S.make_sequences(sess, 5, session="session_id", time="ts_us", label="attack_label",
                           tiebreak=["event_id"])
    return S.sequence_label_counts(seq)


@query("chunk_index_global", PACKETS_CTE + """
SELECT event_id,
       CAST(CEIL(ROW_NUMBER() OVER (ORDER BY ts_us, event_id) / 10.0) AS BIGINT) AS chunk,
       CAST((ROW_NUMBER() OVER (ORDER BY ts_us, event_id) - 1) % 10 AS INTEGER) AS step
FROM packets""")
def q_chunk_index_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole-table chunk numbering (constant session) without a one-partition window."""
    return S.chunk_index(packets(spark, sf_dir), 10, session=None, time="ts_us",
                         tiebreak=["event_id"]).select("event_id", "chunk", "step")
