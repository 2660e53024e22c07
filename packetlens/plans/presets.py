"""Dataset presets (inventory A5-A7, A9): raw capture tables -> prepared packet tables.

Each preset is ``clean_*(df) -> DataFrame`` (pure DataFrame plan, testable on
any frame with the capture's columns) plus a ``load_*`` that reads the files.
Column lists below are fixed values taken from the three public capture
formats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import net, ports, protocol, scalar
from ..functions.common import c
from ..operators import schema, sessions
from ..session import bound_methods, materialize
from ..sources.files import read_csv, read_labelled_dir

# ---------------------------------------------------------------- MQTT capture
# Columns removed from the MQTT capture (constant or too specific).
MQTT_SUPERFLUOUS = ["frame.time_invalid", "mqtt.willmsg", "mqtt.willmsg_len", "mqtt.willtopic",
                    "mqtt.willtopic_len", "ip.proto"]
MQTT_USELESS = ["tcp.checksum", "eth.src", "eth.dst", "mqtt.passwd_len", "mqtt.passwd", "mqtt.topic",
                "mqtt.topic_len", "mqtt.clientid", "mqtt.clientid_len", "mqtt.username", "mqtt.username_len",
                "frame.time_delta_displayed", "tcp.window_size_value", "tcp.analysis.initial_rtt",
                "frame.len", "frame.cap_len", "frame.number", "frame.time_relative", "frame.time_delta"]
MQTT_INT_COLUMNS = ["mqtt.msgid", "tcp.len", "mqtt.len"]
MQTT_CONTENT = ["mqtt.msg"]
MQTT_OVERRIDES = {"mqtt.msg": T.StringType()}


def clean_mqtt(df: DataFrame, key_by_class: bool = False) -> DataFrame:
    """A5 body: drop, strict casts, message length, shared subnet, port features, rename.

    ``key_by_class`` keys sessions by (class, stream) instead of the stream
    number alone (equal stream numbers of different capture files merge
    otherwise).
    """
    bound_methods(df.sparkSession)
    df = schema.drop_columns(df, MQTT_SUPERFLUOUS, strict=True)
    df = schema.drop_columns(df, MQTT_USELESS, strict=True)
    df = df.withColumns({n: scalar.cast_strict(n, "long") for n in MQTT_INT_COLUMNS})
    df = net.with_ip_longs(df, "ip.src", "ip.dst")
    df = df.select(
        "*",
        *[scalar.text_length(n, null_as_empty=True).alias(f"{n}.len") for n in MQTT_CONTENT],
        net.shared_subnet_mask("ip.src", "ip.dst", None, "__ip_ip.src", "__ip_ip.dst").alias("ip.subnet"),
        *ports.port_features("tcp.srcport"), *ports.port_features("tcp.dstport"))
    df = df.drop(*MQTT_CONTENT, "ip.src", "ip.dst", "tcp.srcport", "tcp.dstport", "__ip_ip.src", "__ip_ip.dst")
    stream = c("tcp.stream").cast("string")
    if key_by_class:
        stream = F.concat_ws("/", c("attack_type"), stream)
    df = df.withColumn("tcp.stream", stream)
    return schema.rename(df, {"tcp.stream": "session_id", "frame.time_epoch": "timestamp"})


def load_mqtt(spark: SparkSession, directory: str, label_from: str = "file", schema=None, multi_line: bool = False, **kw) -> DataFrame:
    """A5: one CSV per traffic class (file stem = class, 'legitimate*' benign)."""
    raw = read_labelled_dir(spark, directory, "legitimate", MQTT_OVERRIDES, label_from, schema=schema, multi_line=multi_line)
    return clean_mqtt(raw, **kw)


# ----------------------------------------------------------- Edge IIoT capture
# Text columns of the Edge capture, columns it drops, addresses, numbers read as text, texts measured.
EDGE_OVERRIDES = {n: T.StringType() for n in [
    "dns.qry.name.len", "tcp.srcport", "http.request.method", "http.request.full_uri",
    "http.request.version", "http.request.uri.query", "http.file_data", "http.referer"]}
EDGE_SUPERFLUOUS = ["mqtt.msg_decoded_as", "dns.qry.type", "http.tls_port", "icmp.unused"]
EDGE_IP_COLUMNS = ["ip.src_host", "ip.dst_host", "arp.src.proto_ipv4", "arp.dst.proto_ipv4"]
EDGE_NUMERIC_LIKE = ["tcp.srcport", "tcp.dstport", "udp.port", "udp.stream", "icmp.seq_le", "icmp.checksum",
                     "arp.opcode", "mqtt.msgtype", "mbtcp.unit_id", "tcp.ack", "tcp.ack_raw", "tcp.checksum",
                     "tcp.connection.fin", "tcp.connection.rst", "tcp.connection.syn",
                     "tcp.connection.synack", "tcp.flags.ack", "tcp.len", "tcp.seq", "mqtt.len"]
EDGE_TEXT = ["tcp.payload", "tcp.options", "http.request.full_uri", "http.request.uri.query",
             "http.file_data", "mqtt.msg"]
EDGE_DISCARD = ["tcp.checksum", "icmp.checksum", *EDGE_IP_COLUMNS, "dns.retransmit_request_in",
                "dns.retransmit_request", "tcp.srcport", "tcp.dstport"]
SESSION_TIMEOUT_S = 60


def clean_edge(df: DataFrame, timeout: float = SESSION_TIMEOUT_S, infer_before_fill: bool = False,
               after_close: str = "join", bucket_width: float | None = None,
               materialize_typed: bool = True) -> DataFrame:
    """A6 body: swap-rename, parse capture time, lenient numeric casts, IP validation,
    protocol/session keys and sessionization, subnet, IP flags, text lengths.

    By default the numeric fill (null -> 0) runs before protocol inference, as
    in the reference, so every packet looks like TCP; ``infer_before_fill``
    infers the protocol from the raw null pattern instead.

    Sessionization reads its input twice (a narrow summary pass and the row
    pass), so with ``materialize_typed`` the parsed, typed frame is written
    once as parquet to the shared checkpoint folder instead of parsing the
    CSV twice.
    """
    bound_methods(df.sparkSession)
    df = schema.rename(df, {"dns.qry.name.len": "dns.qry.name", "dns.qry.name": "dns.qry.name.len"})
    df = schema.rename(df, {"Attack_label": "attack_label", "Attack_type": "attack_type"})
    df = schema.drop_columns(df, EDGE_SUPERFLUOUS, strict=False)
    fields = protocol.EDGE
    if infer_before_fill:
        df = df.withColumn("__proto", protocol.protocol_type(fields))
    casts = {n: scalar.cast_lenient(n, "long", fill=0, via="double") for n in EDGE_NUMERIC_LIKE}
    casts["frame.time"] = scalar.parse_epoch("frame.time")
    casts["dns.qry.name.len"] = scalar.cast_strict("dns.qry.name.len", "long")
    casts.update({n: net.valid_ipv4(n) for n in EDGE_IP_COLUMNS})
    df = df.withColumns(casts)
    if not infer_before_fill:
        df = df.withColumn("__proto", protocol.protocol_type(fields))
    df = df.withColumn("__key", protocol.session_key(F.col("__proto"), fields))
    df = df.withColumn("__tb", F.xxhash64(*[c(n) for n in df.columns]))
    if materialize_typed:
        df = materialize(df, "edge-typed")
    df = sessions.sessionize(df, "__key", "frame.time", timeout, tiebreak=["__tb"],
                             is_tcp=F.col("__proto") == "TCP", syn="tcp.connection.syn", ack="tcp.flags.ack",
                             fin="tcp.connection.fin", rst="tcp.connection.rst", after_close=after_close,
                             bucket_width=bucket_width)
    df = df.drop("__key", "__proto", "__tb")
    df = net.with_ip_longs(df, *EDGE_IP_COLUMNS)
    df = df.select(
        *[c(n) for n in df.columns if n != "frame.time" and not n.startswith("__ip_")],
        F.coalesce(c("frame.time"), F.lit(0.0)).alias("frame.time"),
        c("frame.time").isNotNull().alias("frame.time.is_valid"),
        net.shared_subnet_mask("ip.src_host", "ip.dst_host", None,
                               "__ip_ip.src_host", "__ip_ip.dst_host").alias("ip.subnet"),
        *[f for n in EDGE_IP_COLUMNS for f in net.ip_flags(n, as_long=f"__ip_{n}")],
        *[scalar.text_length(n).alias(f"{n}.length") for n in EDGE_TEXT])
    df = df.drop("ip.src_host", "ip.dst_host", *EDGE_TEXT)
    df = schema.rename(df, {"frame.time": "timestamp"})
    return schema.drop_columns(df, EDGE_DISCARD, strict=False)


def load_edge(spark: SparkSession, path: str, schema=None, multi_line: bool = False, **kw) -> DataFrame:
    """The Edge IIoT packet CSV."""
    return clean_edge(read_csv(spark, path, EDGE_OVERRIDES, schema, multi_line=multi_line), **kw)


# ------------------------------------------------------------- X-IIoT flows
# Columns of the flow records by type, class and alert labels.
FLOW_DROP = ["is_SYN_with_RST", "Bad_checksum"]
FLOW_LONG = ["Scr_port", "Des_port", "timestamp", "missed_bytes", "Scr_bytes", "Des_bytes", "total_packet",
             "total_bytes", "Scr_pkts", "Scr_ip_bytes", "Des_pkts", "Des_ip_bytes"]
FLOW_DOUBLE = ["Duration", "paket_rate", "byte_rate", "Scr_packts_ratio", "Des_pkts_ratio", "Scr_bytes_ratio",
               "Des_bytes_ratio", "Avg_user_time", "Std_user_time", "Avg_nice_time", "Std_nice_time",
               "Avg_system_time", "Std_system_time", "Avg_iowait_time", "Std_iowait_time", "Avg_ideal_time",
               "Std_ideal_time", "Avg_tps", "Std_tps", "Avg_rtps", "Std_rtps", "Avg_wtps", "Std_wtps",
               "Avg_ldavg_1", "Std_ldavg_1", "Avg_kbmemused", "Std_kbmemused", "Avg_num_Proc/s",
               "Std_num_proc/s", "Avg_num_cswch/s", "std_num_cswch/s"]
FLOW_CLASS = {"Normal": 0, "Attack": 1}
FLOW_ALERT = {"FALSE": 0, "TRUE": 1}
FLOW_DATE_FORMATS = ("d/M/yyyy", "yyyy-MM-dd", "M/d/yyyy")
# Text-valued columns read as text whatever inference would make of them.
FLOW_OVERRIDES = {n: T.StringType() for n in ["Date", "anomaly_alert", "class1", "class2", "class3",
                                              "Scr_IP", "Des_IP", "Protocol", "Service"]}


# Fields hashed into a flow id when flows get their own session (C22), in order.
FLOW_ID_FIELDS = ["Scr_IP", "Scr_port", "Des_IP", "Des_port", "Protocol", "timestamp"]


def clean_flows(df: DataFrame, session: str = "constant") -> DataFrame:
    """A7 body: label from class3, lenient casts, IP validation, session id,
    subnet, IP flags and port features.

    ``session="constant"`` puts every flow in session "0" (the reference
    default; sequences then number the whole table, F6); ``"flow"`` gives each
    flow the SHA-256 id of its 5-tuple and timestamp (C22).
    """
    if session not in ("constant", "flow"):
        raise ValueError("session must be 'constant' or 'flow'")
    bound_methods(df.sparkSession)
    df = schema.drop_columns(df, FLOW_DROP, strict=False)
    df = df.withColumn("attack_label", scalar.map_values("class3", FLOW_CLASS, default=None).cast("long"))
    df = schema.drop_columns(df, ["class3", "class1"], strict=True)
    df = schema.rename(df, {"class2": "attack_type", "Timestamp": "timestamp"})
    casts = {"Date": scalar.parse_date("Date", FLOW_DATE_FORMATS),
             "anomaly_alert": scalar.map_values("anomaly_alert", FLOW_ALERT, default=None).cast("long"),
             "Scr_IP": net.valid_ipv4("Scr_IP"), "Des_IP": net.valid_ipv4("Des_IP")}
    casts.update({n: scalar.cast_lenient(n, "long") for n in FLOW_LONG})
    casts.update({n: scalar.cast_lenient(n, "double") for n in FLOW_DOUBLE})
    df = df.withColumns(casts)
    if session == "constant":
        df = schema.with_literal(df, "session_id", "0")
    else:
        df = df.withColumn("session_id", protocol.flow_session_id(FLOW_ID_FIELDS))
    df = net.with_ip_longs(df, "Des_IP", "Scr_IP")
    df = df.select(
        "*", net.shared_subnet_mask("Des_IP", "Scr_IP", None, "__ip_Des_IP", "__ip_Scr_IP").alias("IP.Subnet"),
        *net.ip_flags("Des_IP", as_long="__ip_Des_IP"), *net.ip_flags("Scr_IP", as_long="__ip_Scr_IP"),
        *ports.port_features("Scr_port"), *ports.port_features("Des_port"))
    return df.drop("Des_IP", "Scr_IP", "Date", "Scr_port", "Des_port", "__ip_Des_IP", "__ip_Scr_IP")


def load_flows(spark: SparkSession, path: str, session: str = "constant", schema=None, multi_line: bool = False) -> DataFrame:
    """The X-IIoT flow CSV (all text columns read leniently)."""
    return clean_flows(read_csv(spark, path, FLOW_OVERRIDES, schema, multi_line=multi_line), session)
