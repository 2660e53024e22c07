"""Raw capture files in the three public formats, written from the driver tables.

The reference reads capture CSVs we do not have.  These writers derive rows
with the captures' column names from ``events`` (through the packets view),
write them as CSV below the shared checkpoint folder and return the path, so
the presets run end to end on files: they only shape input, the presets do
all of the work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_methods, scratch_path
from . import presets
from .standins import edge_packets, packets


def fresh_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"captures/{name}-{uuid.uuid4().hex[:12]}")


def _write_csv(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Write in parallel (every task writes its own part files; no single-task funnel)."""
    bound_methods(df.sparkSession)
    w = df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)
    return path


def mqtt_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    flags = F.col("syn") * 2 + F.col("ack") * 16 + F.col("fin") + F.col("rst") * 4
    cols = {
        "tcp.stream": F.col("stream_id").cast("long"),
        "frame.time_epoch": F.col("ts_us") / 1e6,
        "ip.src": F.col("ip_src"), "ip.dst": F.col("ip_dst"),
        "tcp.srcport": F.col("port_src"), "tcp.dstport": F.col("port_dst"),
        "mqtt.msg": F.col("payload"),
        "mqtt.msgid": F.col("event_id") % 65536,
        "tcp.len": F.length(F.coalesce("payload", F.lit(""))),
        "mqtt.len": F.length(F.coalesce("payload", F.lit(""))) + 2,
        "tcp.flags": F.concat(F.lit("0x"), F.lower(F.hex(flags))),
        "mqtt.protoname": F.when(F.col("event_id") % 2 == 0, "MQTT").otherwise("0"),
        "tcp.time_delta": F.col("num_a") / 1000,
    }
    for n in presets.MQTT_SUPERFLUOUS + presets.MQTT_USELESS:
        cols.setdefault(n, (F.col("event_id") % 7).cast("string"))
    cls = (F.when(F.col("attack_type") == "error", "dos").when(F.col("attack_type") == "signup", "flood")
           .otherwise("legitimate"))
    return p.select(*[v.alias(k) for k, v in cols.items()], cls.alias("class"))


def write_mqtt(spark: SparkSession, sf_dir: str) -> str:
    """One folder per traffic class (``class=legitimate`` ...), CSV inside."""
    return _write_csv(mqtt_frame(spark, sf_dir), fresh_path(spark, "mqtt"), "class")


def edge_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edge_packets(spark, sf_dir)
    tm = F.concat(F.lit(" "), F.date_format(F.timestamp_micros("ts_us"), "yyyy HH:mm:ss.SSSSSS"), F.lit("000 "))
    cols = {
        "frame.time": F.when(F.col("event_id") % 53 == 0, F.lit("bad time")).otherwise(tm),
        "ip.src_host": F.col("ip_src"), "ip.dst_host": F.col("ip_dst"),
        "arp.src.proto_ipv4": F.when(F.col("arp_opcode").isNotNull(), F.col("ip_src")),
        "arp.dst.proto_ipv4": F.when(F.col("arp_opcode").isNotNull(), F.col("ip_dst")),
        "tcp.srcport": F.col("tcp_srcport").cast("string"), "tcp.dstport": F.col("tcp_dstport"),
        "udp.port": F.col("udp_port"), "udp.stream": F.col("udp_stream"), "icmp.seq_le": F.col("icmp_seq"),
        "icmp.checksum": F.col("icmp_checksum"), "arp.opcode": F.col("arp_opcode"),
        "mqtt.msgtype": F.col("mqtt_msgtype"), "mbtcp.unit_id": F.col("mbtcp_trans_id") % 8,
        "mbtcp.trans_id": F.col("mbtcp_trans_id"), "tcp.ack": F.col("ack"), "tcp.ack_raw": F.col("event_id") * 31,
        "tcp.checksum": F.lower(F.hex(F.col("event_id") * 97)), "tcp.connection.fin": F.col("fin"),
        "tcp.connection.rst": F.col("rst"), "tcp.connection.syn": F.col("syn"),
        "tcp.connection.synack": (F.col("syn") * F.col("ack")), "tcp.flags.ack": F.col("ack"),
        "tcp.len": F.length(F.coalesce("payload", F.lit(""))), "tcp.seq": F.col("event_id") % 1000,
        "mqtt.len": F.when(F.col("mqtt_msgtype").isNotNull(), F.lit(12)),
        "dns.qry.name": F.when(F.col("udp_port").isNotNull(), F.lit(11)),
        "dns.qry.name.len": F.when(F.col("udp_port").isNotNull(), F.lit("example.org")),
        "tcp.payload": F.col("payload"), "tcp.options": F.when(F.col("syn") == 1, F.lit(" 020405b4 ")),
        "http.request.full_uri": F.when(F.col("attack_type") == "purchase", F.concat(F.lit("http://h/"), "payload")),
        "http.request.uri.query": F.lit(None).cast("string"),
        "http.file_data": F.when(F.col("attack_type") == "click", F.col("payload")),
        "mqtt.msg": F.when(F.col("mqtt_msgtype").isNotNull(), F.col("payload")),
        "http.request.method": F.when(F.col("attack_type") == "purchase", F.lit("GET")),
        "http.request.version": F.when(F.col("attack_type") == "purchase", F.lit("HTTP/1.1")),
        "http.referer": F.lit(None).cast("string"), "mqtt.protoname": F.lit("0"), "mqtt.conack.flags": F.lit("0"),
        "mqtt.msg_decoded_as": F.lit("0"), "dns.qry.type": F.lit(0), "http.tls_port": F.lit(0),
        "icmp.unused": F.lit(0), "dns.retransmit_request": F.lit(0), "dns.retransmit_request_in": F.lit(0),
        "Attack_label": F.col("attack_label"),
        "Attack_type": F.when(F.col("attack_label") == 1, F.lit("DDoS")).otherwise(F.lit("Normal")),
    }
    return e.select(*[v.alias(k) for k, v in cols.items()])


def write_edge(spark: SparkSession, sf_dir: str) -> str:
    return _write_csv(edge_frame(spark, sf_dir), fresh_path(spark, "edge"))


def flows_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    eid, val = F.col("event_id"), F.coalesce(F.col("num_a"), F.lit(0.0))
    token = (F.when(eid % 41 == 0, F.lit("-")).when(eid % 43 == 0, F.lit("#DIV/0!"))
             .when(eid % 47 == 0, F.lit("?")))
    cols = {
        "Date": F.date_format(F.timestamp_micros("ts_us"), "d/M/yyyy"),
        "Timestamp": F.coalesce(token, (F.col("ts_us") / 1_000_000).cast("long").cast("string")),
        "Scr_IP": F.col("ip_src"), "Des_IP": F.col("ip_dst"),
        "Scr_port": F.col("port_src"), "Des_port": F.col("port_dst"),
        "Protocol": F.when(F.col("syn") == 1, "tcp").otherwise("udp"),
        "Service": F.col("attack_type"),
    }
    for i, n in enumerate(x for x in presets.FLOW_LONG if x not in ("Scr_port", "Des_port", "timestamp")):
        cols[n] = F.coalesce(token, ((eid * (i + 3)) % 5000).cast("string"))
    for i, n in enumerate(presets.FLOW_DOUBLE):
        cols[n] = F.coalesce(token, F.round(val * (i + 1) / 7, 4).cast("string"))
    cols.update({
        "anomaly_alert": F.when(F.col("rst") == 1, "TRUE").otherwise("FALSE"),
        "class1": F.lit("x"), "class2": F.col("attack_type"),
        "class3": F.when(F.col("attack_label") == 1, "Attack").otherwise("Normal"),
        "is_SYN_with_RST": F.lit("0"), "Bad_checksum": F.lit("0"),
    })
    return p.select(*[v.alias(k) for k, v in cols.items()])


def write_flows(spark: SparkSession, sf_dir: str) -> str:
    return _write_csv(flows_frame(spark, sf_dir), fresh_path(spark, "flows"))
