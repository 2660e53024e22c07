"""Stand-in inputs derived from the driver tables.

The reference reads packet captures we do not have.  These views only give
rows in the schema the traffic operators expect, computed row by row from
``events`` (and ``lineitem`` for predictions); they do none of the operators'
work.  The same text runs in Spark and in DuckDB (``{US}`` is the engine's
epoch-microsecond expression), so oracle SQL can start from identical input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
DUCKDB_US = "epoch_us(ts)"

PACKETS_SQL = """
SELECT event_id, {US} AS ts_us,
 CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'not-an-ip'
      WHEN event_id % 2 = 0 THEN '192.168.' || CAST(user_id % 3 AS STRING) || '.' || CAST(user_id % 250 + 1 AS STRING)
      ELSE '10.0.' || CAST(user_id % 5 AS STRING) || '.' || CAST(user_id % 200 + 1 AS STRING) END AS ip_src,
 CASE WHEN event_id % 101 = 0 THEN '0.0.0.0'
      WHEN event_id % 2 = 0 THEN '10.0.' || CAST(user_id % 5 AS STRING) || '.' || CAST(user_id % 200 + 1 AS STRING)
      ELSE '192.168.' || CAST(user_id % 3 AS STRING) || '.' || CAST(user_id % 250 + 1 AS STRING) END AS ip_dst,
 CASE WHEN event_id % 2 = 0 THEN 49152 + user_id % 1000
      ELSE CASE user_id % 4 WHEN 0 THEN 1883 WHEN 1 THEN 443 WHEN 2 THEN 8080 ELSE 502 END END AS port_src,
 CASE WHEN event_id % 103 = 0 THEN NULL
      WHEN event_id % 2 = 0 THEN CASE user_id % 4 WHEN 0 THEN 1883 WHEN 1 THEN 443 WHEN 2 THEN 8080 ELSE 502 END
      ELSE 49152 + user_id % 1000 END AS port_dst,
 CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS syn,
 CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS ack,
 CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 1 ELSE 0 END AS fin,
 CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 1 ELSE 0 END AS rst,
 CAST(user_id AS STRING) AS stream_id, event_type AS attack_type,
 CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS attack_label,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS num_a,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE props END AS payload
FROM {events}
"""

# Prediction stand-in: a label and a logit per lineitem row (many tied scores).
PREDICTIONS_SQL = """
SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       (l_quantity - 25) / 10 AS logit,
       l_linestatus AS split{EPOCH}
FROM {lineitem}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return spark.sql(PACKETS_SQL.replace("{US}", SPARK_US), events=events)


def predictions(spark: SparkSession, sf_dir: str, with_epoch: bool = False) -> DataFrame:
    """Predictions per lineitem; ``with_epoch`` adds the line number as an epoch column."""
    text = PREDICTIONS_SQL.replace("{EPOCH}", ", l_linenumber AS epoch" if with_epoch else "")
    return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"))


def duckdb_packets() -> str:
    """The packets view as a DuckDB CTE body."""
    return PACKETS_SQL.replace("{US}", DUCKDB_US).replace("{events}", "events")


def duckdb_predictions(with_epoch: bool = False) -> str:
    return PREDICTIONS_SQL.replace("{EPOCH}", ", l_linenumber AS epoch" if with_epoch else "") \
        .replace("{lineitem}", "lineitem")

# Edge-capture-shaped stand-in: which protocol fields are present follows the
# event type, so every protocol branch occurs.
EDGE_SQL = """
SELECT event_id, ts_us, ip_src, ip_dst,
 CASE WHEN attack_type IN ('purchase', 'signup', 'click') THEN port_src END AS tcp_srcport,
 CASE WHEN attack_type IN ('purchase', 'signup', 'click') THEN port_dst END AS tcp_dstport,
 CASE WHEN attack_type = 'view' AND event_id % 2 = 0 THEN CAST(stream_id AS BIGINT) END AS udp_stream,
 CASE WHEN attack_type = 'view' THEN port_dst END AS udp_port,
 CASE WHEN attack_type = 'error' AND event_id % 4 <> 0 THEN event_id % 65536 END AS icmp_checksum,
 CASE WHEN attack_type = 'error' AND event_id % 3 = 0 THEN event_id % 100 END AS icmp_seq,
 CASE WHEN attack_type = 'error' AND event_id % 4 = 0 AND event_id % 8 <> 0 THEN 1 END AS arp_opcode,
 CASE WHEN attack_type = 'error' AND event_id % 8 = 0 AND event_id % 16 <> 0 THEN 3 END AS mqtt_msgtype,
 CASE WHEN event_id % 16 = 0 THEN event_id END AS mbtcp_trans_id,
 syn, ack, fin, rst, attack_label, attack_type, num_a, payload
FROM {packets}
"""


def edge_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EDGE_SQL, packets=packets(spark, sf_dir))


def duckdb_edge() -> str:
    return EDGE_SQL.replace("{packets}", "packets")
