"""Registered queries for the network columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net, ports, protocol
from ..operators import sessions as S
from .queries import PACKETS_CTE, TIMEOUT_US
from .registry import query
from .standins import duckdb_edge, edge_packets, packets

EDGE_CTE = PACKETS_CTE + f", edge AS ({duckdb_edge()})"
STANDIN_FIELDS = protocol.PacketFields(
    ip_src="ip_src", ip_dst="ip_dst", tcp_srcport="tcp_srcport", tcp_dstport="tcp_dstport",
    udp_stream="udp_stream", udp_port="udp_port", icmp_checksum="icmp_checksum", icmp_seq="icmp_seq",
    arp_opcode="arp_opcode", mqtt_msgtype="mqtt_msgtype", mbtcp_trans_id="mbtcp_trans_id")


# ---- oracle SQL fragments (DuckDB) ----
def _sql_valid(x: str) -> str:
    return f"regexp_matches({x}, '{net.IPV4_PATTERN}')"


def _sql_long(x: str) -> str:
    parts = " + ".join(f"CAST(split_part({x}, '.', {i + 1}) AS BIGINT) * {1 << (24 - 8 * i)}"
                       for i in range(4))
    return f"(CASE WHEN {_sql_valid(x)} THEN {parts} END)"


def _sql_text(n: str) -> str:
    return "concat_ws('.', " + ", ".join(f"CAST(({n} >> {s}) & 255 AS VARCHAR)"
                                          for s in (24, 16, 8, 0)) + ")"


def _sql_block(n: str, blk) -> str:
    start = net._addr(blk[0])
    return f"({n} BETWEEN {start} AND {start + (1 << (32 - blk[1])) - 1})"


def _sql_flags(x: str) -> str:
    n = _sql_long(x)
    usable = f"({n} IS NOT NULL AND {x} NOT IN ('', '0', '0.0.0.0'))"
    priv = "(" + " OR ".join(_sql_block(n, b) for b in net.PRIVATE_BLOCKS) + ")"
    priv += "".join(f" AND NOT {_sql_block(n, b)}" for b in net.PRIVATE_EXCEPTIONS)
    out = []
    for name, e in [("is_private", priv), ("is_loopback", _sql_block(n, net.LOOPBACK_BLOCK)),
                    ("is_multicast", _sql_block(n, net.MULTICAST_BLOCK)),
                    ("is_link_local", _sql_block(n, net.LINK_LOCAL_BLOCK))]:
        out.append(f'COALESCE({usable} AND ({e}), FALSE) AS "{x}.{name}"')
    out.append(f'COALESCE({n} = 0, FALSE) AS "{x}.is_unspecified"')
    return ",\n ".join(out)


def _sql_subnet(a: str, b: str, default: str) -> str:
    xa, xb = _sql_long(a), _sql_long(b)
    xr = f"xor({xa}, {xb})"
    hb = f"(CASE WHEN {xr} = 0 THEN 0 ELSE length(bin({xr})) END)"
    mask = f"({net.MASK32} - ((CAST(1 AS BIGINT) << {hb}) - 1))"
    return f"(CASE WHEN {xa} IS NOT NULL AND {xb} IS NOT NULL THEN {_sql_text(mask)} ELSE '{default}' END)"


@query("ip_features", PACKETS_CTE + f"""
SELECT event_id,
 CASE WHEN {_sql_valid('ip_src')} THEN ip_src END AS ip_src_valid,
 {_sql_long('ip_src')} AS ip_src_int,
 {_sql_text(_sql_long('ip_dst'))} AS ip_dst_text,
 {_sql_subnet('ip_src', 'ip_dst', 'null')} AS subnet,
 {_sql_flags('ip_src')},
 {_sql_flags('ip_dst')}
FROM packets""")
def q_ip_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4 validation, integer form and back, shared subnet mask, address flags."""
    p = net.with_ip_longs(packets(spark, sf_dir), "ip_src", "ip_dst")
    return p.select(
        "event_id",
        net.valid_ipv4("ip_src").alias("ip_src_valid"),
        F.col("__ip_ip_src").alias("ip_src_int"),
        net.long_to_ipv4("__ip_ip_dst").alias("ip_dst_text"),
        net.shared_subnet_mask("ip_src", "ip_dst", "null", "__ip_ip_src", "__ip_ip_dst").alias("subnet"),
        *net.ip_flags("ip_src", as_long="__ip_ip_src"), *net.ip_flags("ip_dst", as_long="__ip_ip_dst"))


def _sql_ports(p: str) -> str:
    lst = ", ".join(str(x) for x in ports.COMMON_SERVICE_PORTS)
    return (f"CASE WHEN {p} BETWEEN 0 AND 1023 THEN 'well-known' WHEN {p} BETWEEN 1024 AND 49151 "
            f"THEN 'registered' WHEN {p} BETWEEN 49152 AND 65535 THEN 'dynamic-private' "
            f"ELSE 'invalid' END AS \"{p}.category\", {p} BETWEEN 0 AND 1023 AS \"{p}.is_well_known\", "
            f"{p} IN ({lst}) AS \"{p}.is_common_service\"")


@query("port_features", PACKETS_CTE + f"""
SELECT event_id, {_sql_ports('port_src')}, {_sql_ports('port_dst')} FROM packets""")
def q_port_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Port class, well-known flag and common-service flag for both ports."""
    p = packets(spark, sf_dir)
    return p.select("event_id", *ports.port_features("port_src"), *ports.port_features("port_dst"))


_SQL_PROTO = """CASE WHEN tcp_srcport IS NOT NULL AND tcp_dstport IS NOT NULL THEN 'TCP'
  WHEN udp_stream IS NOT NULL THEN 'UDP' WHEN udp_port IS NOT NULL THEN 'UDP'
  WHEN icmp_checksum IS NOT NULL THEN 'ICMP' WHEN arp_opcode IS NOT NULL THEN 'ARP'
  WHEN mqtt_msgtype IS NOT NULL AND tcp_srcport IS NULL AND udp_port IS NULL AND udp_stream IS NULL
       THEN 'MQTT_OTHER_TRANSPORT'
  WHEN mbtcp_trans_id IS NOT NULL AND tcp_srcport IS NULL THEN 'MBTCP_OTHER_TRANSPORT'
  ELSE 'Unknown' END"""

KEY_SQL = EDGE_CTE + f""",
p AS (SELECT *, {_SQL_PROTO} AS protocol,
        CASE WHEN COALESCE(ip_src <= ip_dst, FALSE) THEN ip_src ELSE ip_dst END AS ip1,
        CASE WHEN COALESCE(ip_src <= ip_dst, FALSE) THEN ip_dst ELSE ip_src END AS ip2 FROM edge),
q AS (SELECT *,
        CASE WHEN protocol = 'TCP' AND ip_src = ip1 THEN tcp_srcport
             WHEN protocol = 'TCP' AND ip_src <> ip1 THEN tcp_dstport END AS port1,
        CASE WHEN protocol = 'TCP' AND ip_src = ip1 THEN tcp_dstport
             WHEN protocol = 'TCP' AND ip_src <> ip1 THEN tcp_srcport END AS port2 FROM p),
k AS (SELECT *,
  CASE WHEN protocol IN ('TCP', 'UDP', 'ICMP') THEN protocol WHEN protocol = 'ARP' THEN 'ARP_PKT'
       ELSE protocol END AS k_protocol,
  CASE WHEN protocol IN ('TCP', 'ICMP', 'ARP') OR (protocol = 'UDP') THEN ip1 ELSE ip_src END AS k_ip1,
  CASE WHEN protocol = 'TCP' THEN port1 END AS k_port1,
  CASE WHEN protocol IN ('TCP', 'ICMP', 'ARP') OR (protocol = 'UDP') THEN ip2 ELSE ip_dst END AS k_ip2,
  CASE WHEN protocol = 'TCP' THEN port2 END AS k_port2,
  CASE WHEN protocol = 'UDP' AND udp_stream IS NOT NULL THEN udp_stream END AS k_udp_stream,
  CASE WHEN protocol = 'UDP' AND udp_stream IS NULL THEN udp_port END AS k_udp_port,
  CASE WHEN protocol = 'ICMP' THEN COALESCE(icmp_seq, -1) END AS k_icmp_id
  FROM q)
"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edge_packets(spark, sf_dir)
    proto = protocol.protocol_type(STANDIN_FIELDS)
    return e.withColumn("protocol", proto).withColumn(
        "key", protocol.session_key(F.col("protocol"), STANDIN_FIELDS))


_KEY_COLS = ["protocol", "ip1", "port1", "ip2", "port2", "udp_stream", "udp_port", "icmp_id"]


@query("protocol_session_key", KEY_SQL + "SELECT event_id, protocol, "
       + ", ".join(f"k_{x} AS key_{x}" for x in _KEY_COLS) + " FROM k")
def q_protocol_session_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocol by field presence, canonical endpoints/ports, uniform session key."""
    k = _keyed(spark, sf_dir)
    return k.select("event_id", "protocol", *[F.col(f"key.{x}").alias(f"key_{x}") for x in _KEY_COLS])


@query("edge_sessions", KEY_SQL + f""",
s1 AS (SELECT *, protocol = 'TCP' AS tcp,
        CASE WHEN protocol = 'TCP' AND (fin = 1 OR rst = 1) THEN NULL ELSE ts_us END AS eff,
        (protocol = 'TCP' AND syn = 1 AND NOT ack = 1) AS pure_syn FROM k),
s2 AS (SELECT *, LAG(eff) OVER w AS prev FROM s1
       WINDOW w AS (PARTITION BY {', '.join('k_' + x for x in _KEY_COLS)} ORDER BY ts_us, event_id)),
s3 AS (SELECT *, CASE WHEN prev IS NOT NULL AND (pure_syn OR ts_us - prev > {TIMEOUT_US}) THEN 1 ELSE 0 END
              AS opn FROM s2)
SELECT event_id, protocol,
  CAST(SUM(opn) OVER (PARTITION BY {', '.join('k_' + x for x in _KEY_COLS)} ORDER BY ts_us, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_no
FROM s3""")
def q_edge_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C18-C21 + F5: sessions per protocol key (TCP rules only for TCP keys)."""
    k = _keyed(spark, sf_dir)
    s = S.sessionize(k, key="key", time="ts_us", timeout=TIMEOUT_US, tiebreak=["event_id"],
                     is_tcp=F.col("protocol") == "TCP", syn="syn", ack="ack", fin="fin", rst="rst")
    return s.select("event_id", "protocol",
                    F.regexp_extract("session_id", r"_(\d+)$", 1).cast("long").alias("session_no"))


_FLOW_COLS = ["ip_src", "port_src", "ip_dst", "port_dst", "attack_type", "ts_us"]


@query("flow_session_id", PACKETS_CTE + """
SELECT event_id, sha256(concat_ws('||', """
       + ", ".join(f"COALESCE(CAST({x} AS VARCHAR), 'NONE')" for x in _FLOW_COLS)
       + ")) AS flow_id FROM packets")
def q_flow_session_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 flow id over six fields (null -> 'NONE', '||' separated)."""
    return packets(spark, sf_dir).select("event_id", protocol.flow_session_id(_FLOW_COLS).alias("flow_id"))
