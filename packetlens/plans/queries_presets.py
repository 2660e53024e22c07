"""Registered queries for sources and presets (A1-A9, K7), rows-only checks.

Each writes capture-format CSV derived from the driver tables to the shared
checkpoint folder and runs the preset on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import captures, presets
from .datasets import dataset_factory, load_data
from .experiments import run_grid
from .queries import PACKETS_CTE, SEQ_BODY
from .queries_encode import STORED_SLOTS_SQL, slot_ctes, stored_slots
from .queries_net import EDGE_CTE, _sql_flags, _sql_ports, _sql_subnet, _sql_valid
from .queries_sampling import SEED, SPLIT_SQL
from .registry import query


def _renamed(sql: str, old: str, new: str) -> str:
    """Fragment ``sql`` with the output names of column ``old`` under the capture's name."""
    return sql.replace(f'AS "{old}.', f'AS "{new}.')


MQTT_SQL = PACKETS_CTE + f"""
SELECT stream_id AS session_id, ts_us / 1e6 AS "timestamp", CAST(event_id % 65536 AS BIGINT) AS "mqtt.msgid",
 CAST(length(coalesce(payload, '')) AS BIGINT) AS "tcp.len", CAST(length(coalesce(payload, '')) + 2 AS BIGINT) AS "mqtt.len",
 '0x' || lower(to_hex(syn * 2 + ack * 16 + fin + rst * 4)) AS "tcp.flags",
 CASE WHEN event_id % 2 = 0 THEN 'MQTT' ELSE '0' END AS "mqtt.protoname", num_a / 1000 AS "tcp.time_delta",
 CASE attack_type WHEN 'error' THEN 'dos' WHEN 'signup' THEN 'flood' ELSE 'legitimate' END AS attack_type,
 attack_type IN ('error', 'signup') AS attack_label,
 CAST(length(trim(coalesce(payload, ''))) AS BIGINT) AS "mqtt.msg.len",
 nullif({_sql_subnet('ip_src', 'ip_dst', 'none')}, 'none') AS "ip.subnet",
 {_renamed(_sql_ports('port_src'), 'port_src', 'tcp.srcport')}, {_renamed(_sql_ports('port_dst'), 'port_dst', 'tcp.dstport')}
FROM packets"""


def _flows_sql() -> str:
    bad = "(event_id % 41 = 0 OR event_id % 43 = 0 OR event_id % 47 = 0)"
    longs = [n for n in presets.FLOW_LONG if n not in ("Scr_port", "Des_port", "timestamp")]
    cols = [f'CASE WHEN NOT {bad} THEN CAST((event_id * {i + 3}) % 5000 AS BIGINT) END AS "{n}"' for i, n in enumerate(longs)]
    cols += [f'CASE WHEN NOT {bad} THEN round(coalesce(num_a, 0.0) * {i + 1} / 7, 4) END AS "{n}"' for i, n in enumerate(presets.FLOW_DOUBLE)]
    return PACKETS_CTE + f"""
SELECT CASE WHEN NOT {bad} THEN ts_us // 1000000 END AS "timestamp", CASE WHEN syn = 1 THEN 'tcp' ELSE 'udp' END AS "Protocol",
 attack_type AS "Service", {", ".join(cols)}, CAST(rst AS BIGINT) AS anomaly_alert, attack_type, CAST(attack_label AS BIGINT) AS attack_label,
 '0' AS session_id, nullif({_sql_subnet('ip_dst', 'ip_src', 'none')}, 'none') AS "IP.Subnet",
 {_renamed(_sql_flags('ip_dst'), 'ip_dst', 'Des_IP')}, {_renamed(_sql_flags('ip_src'), 'ip_src', 'Scr_IP')},
 {_renamed(_sql_ports('port_src'), 'port_src', 'Scr_port')}, {_renamed(_sql_ports('port_dst'), 'port_dst', 'Des_port')}
FROM packets"""


@query("load_mqtt", MQTT_SQL)
def q_load_mqtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + A5 (+B1, B2, B4, C2, C14, C16, B3): MQTT capture folders -> packet table."""
    return presets.load_mqtt(spark, captures.write_mqtt(spark, sf_dir), label_from="dir")


def _edge_sql() -> str:
    """The Edge rows after the numeric fill: every packet looks like TCP, so keys are end points and ports."""
    ips = {"ip.src_host": "src", "ip.dst_host": "dst", "arp.src.proto_ipv4": "arp_src", "arp.dst.proto_ipv4": "arp_dst"}
    flags = ", ".join(_renamed(_sql_flags(x), x, n) for n, x in ips.items())
    filled = {"udp.port": "udp_port", "udp.stream": "udp_stream", "icmp.seq_le": "icmp_seq", "arp.opcode": "arp_opcode", "mqtt.msgtype": "mqtt_msgtype",
              "mbtcp.unit_id": "mbtcp_trans_id % 8", "tcp.ack": "ack", "tcp.ack_raw": "event_id * 31", "tcp.connection.fin": "fin", "tcp.connection.rst": "rst",
              "tcp.connection.syn": "syn", "tcp.connection.synack": "syn * ack", "tcp.flags.ack": "ack", "tcp.len": "length(coalesce(payload, ''))",
              "tcp.seq": "event_id % 1000", "mqtt.len": "CASE WHEN mqtt_msgtype IS NOT NULL THEN 12 END"}
    numbers = ", ".join(f'CAST(COALESCE({e}, 0) AS BIGINT) AS "{n}"' for n, e in filled.items())
    texts = {"tcp.payload": "payload", "tcp.options": "CASE WHEN syn = 1 THEN '020405b4' END",
             "http.request.full_uri": "CASE WHEN kind = 'purchase' THEN 'http://h/' || payload END", "http.request.uri.query": "CAST(NULL AS VARCHAR)",
             "http.file_data": "CASE WHEN kind = 'click' THEN payload END", "mqtt.msg": "CASE WHEN mqtt_msgtype IS NOT NULL THEN payload END"}
    lengths = ", ".join(f'CAST(length(trim({e})) AS BIGINT) AS "{n}.length"' for n, e in texts.items())
    part = lambda n, x: f"COALESCE(',\"{n}\":' || {x}, '')"
    text = lambda x: f"'\"' || {x} || '\"'"
    session = f"""'{{"protocol":"TCP"' || {part('ip1', text('ip1'))} || {part('port1', 'port1')} || {part('ip2', text('ip2'))} || {part('port2', 'port2')} || '}}_'"""
    return EDGE_CTE + f""",
v AS (SELECT *, attack_type AS kind, CASE WHEN {_sql_valid('ip_src')} THEN ip_src END AS src, CASE WHEN {_sql_valid('ip_dst')} THEN ip_dst END AS dst,
  CASE WHEN arp_opcode IS NOT NULL AND {_sql_valid('ip_src')} THEN ip_src END AS arp_src,
  CASE WHEN arp_opcode IS NOT NULL AND {_sql_valid('ip_dst')} THEN ip_dst END AS arp_dst,
  CASE WHEN event_id % 53 <> 0 THEN (epoch_us(date_trunc('year', make_timestamp(ts_us))) + ts_us % 86400000000) / 1e6 END AS t,
  COALESCE(tcp_srcport, 0) AS sport, COALESCE(tcp_dstport, 0) AS dport FROM edge),
e AS (SELECT *, CASE WHEN COALESCE(src <= dst, FALSE) THEN src ELSE dst END AS ip1, CASE WHEN COALESCE(src <= dst, FALSE) THEN dst ELSE src END AS ip2 FROM v),
k AS (SELECT *, CASE WHEN src = ip1 THEN sport WHEN src <> ip1 THEN dport END AS port1,
               CASE WHEN src = ip1 THEN dport WHEN src <> ip1 THEN sport END AS port2 FROM e),
c AS (SELECT *, LAG(CASE WHEN fin = 1 OR rst = 1 THEN NULL ELSE t END) OVER w AS prev FROM k
      WINDOW w AS (PARTITION BY ip1, port1, ip2, port2 ORDER BY t NULLS FIRST, event_id)),
o AS (SELECT *, CASE WHEN prev IS NOT NULL AND ((syn = 1 AND NOT ack = 1) OR t - prev > {presets.SESSION_TIMEOUT_S}) THEN 1 ELSE 0 END AS opn FROM c),
s AS (SELECT *, SUM(opn) OVER (PARTITION BY ip1, port1, ip2, port2 ORDER BY t NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM o)
SELECT {numbers}, CAST(mbtcp_trans_id AS INTEGER) AS "mbtcp.trans_id",
 CASE WHEN udp_port IS NOT NULL THEN 11::BIGINT END AS "dns.qry.name.len", CASE WHEN udp_port IS NOT NULL THEN 'example.org' END AS "dns.qry.name",
 CASE WHEN kind = 'purchase' THEN 'GET' END AS "http.request.method", CASE WHEN kind = 'purchase' THEN 'HTTP/1.1' END AS "http.request.version",
 CAST(NULL AS VARCHAR) AS "http.referer", 0 AS "mqtt.protoname", 0 AS "mqtt.conack.flags", CAST(attack_label AS INTEGER) AS attack_label,
 CASE WHEN attack_label = 1 THEN 'DDoS' ELSE 'Normal' END AS attack_type, {session} || CAST(n AS VARCHAR) AS session_id,
 COALESCE(t, 0.0::DOUBLE) AS "timestamp", t IS NOT NULL AS "frame.time.is_valid", nullif({_sql_subnet('src', 'dst', 'none')}, 'none') AS "ip.subnet",
 {flags}, {lengths} FROM s"""


@query("load_edge", _edge_sql())
def q_load_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + A6 (+C4, B5, C11, C18-C21, F5, C14, C15, C2): Edge capture CSV -> sessionized table."""
    return presets.load_edge(spark, captures.write_edge(spark, sf_dir))


@query("load_flows", _flows_sql())
def q_load_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + A7 (+C3, C5, B5, C11, C14-C16, C23): X-IIoT flow CSV -> flow table."""
    return presets.load_flows(spark, captures.write_flows(spark, sf_dir))


MQTT_FEATURES = {
    **{n: "number" for n in ("mqtt.msgid", "tcp.len", "mqtt.len", "mqtt.msg.len", "tcp.time_delta")},
    **{n: "category" for n in ("tcp.flags", "mqtt.protoname", "ip.subnet", "tcp.srcport.category", "tcp.dstport.category")},
    **{f"tcp.{p}port.is_{x}": "flag" for p in ("src", "dst") for x in ("well_known", "common_service")},
    **{f"{n}.is_valid": "valid" for n in ("tcp.time_delta", "tcp.dstport.is_well_known", "tcp.dstport.is_common_service")}}


def _data_mqtt_sql() -> str:
    """The preset's rows, cut into sequences by time, split and encoded."""
    rows = MQTT_SQL[len(PACKETS_CTE):].replace("SELECT stream_id AS session_id", "SELECT event_id, stream_id AS session_id", 1)
    split = SPLIT_SQL[SPLIT_SQL.index(",\nseqrows AS"):]
    return PACKETS_CTE + f""",
m AS ({rows}), src AS (SELECT *, "timestamp" AS ts_us FROM m),""" + SEQ_BODY.replace("{SESSION}", "session_id").replace("{L}", "10").replace(
        "{SOURCE}", "src") + split + """,
raw AS (SELECT r.sequence_id, r.step, r.sequence_label, a.split, src.* FROM seqrows r JOIN assigned a USING (sequence_id) JOIN src USING (event_id)),
""" + slot_ctes(MQTT_FEATURES) + STORED_SLOTS_SQL


@query("load_data_mqtt", _data_mqtt_sql())
def q_load_data_mqtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + A3 + A8: MQTT preset through both parquet cache levels to the encoded table, one row per stored slot."""
    src = captures.write_mqtt(spark, sf_dir)
    data, _ = load_data(spark, "mqttset", src, captures.fresh_path(spark, "cache"), sequence_length=10,
                        seed=SEED, loader=lambda s, p: presets.load_mqtt(s, p, label_from="dir"))
    return stored_slots(data)


@query("dataset_factory")
def q_dataset_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow dataset's splits of two chosen features, sequences as sparse vectors (shown by size and stored slots)."""
    parts, extra = dataset_factory(spark, "x-iiotd", captures.write_flows(spark, sf_dir), captures.fresh_path(spark, "cache"),
                                   sequence_length=5, seed=SEED, features=["Des_port.category", "Protocol"])
    frames = [df.select("sequence_id", "label", "split", F.col("features.size").alias("size"), F.col("features.indices").alias("slots"),
                        F.lit(float(extra["pos_weight"])).alias("pos_weight")) for df in parts.values()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("experiment_results")
def q_experiment_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7 + A4 (+A9, L1-L5): two datasets by two models with growing seeds, each row written by its key, read back."""
    sources = {"mqttset": (captures.write_mqtt(spark, sf_dir), lambda s, p: presets.load_mqtt(s, p, label_from="dir")),
               "x-iiotd": (captures.write_flows(spark, sf_dir), None)}
    return run_grid(spark, sources, captures.fresh_path(spark, "cache"), captures.fresh_path(spark, "results"), seed=SEED)
