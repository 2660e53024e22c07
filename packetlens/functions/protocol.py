"""Protocol inference, canonical endpoints and session keys (inventory C18-C22)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import ColumnLike, c


@dataclass(frozen=True)
class PacketFields:
    """Column names of the packet fields the protocol rules read (Edge capture names)."""
    ip_src: str = "ip.src_host"
    ip_dst: str = "ip.dst_host"
    tcp_srcport: str = "tcp.srcport"
    tcp_dstport: str = "tcp.dstport"
    udp_stream: str = "udp.stream"
    udp_port: str = "udp.port"
    icmp_checksum: str = "icmp.checksum"
    icmp_seq: str = "icmp.seq_le"
    arp_opcode: str = "arp.opcode"
    mqtt_msgtype: str = "mqtt.msgtype"
    mbtcp_trans_id: str = "mbtcp.trans_id"


EDGE = PacketFields()


def protocol_type(f: PacketFields = EDGE) -> Column:
    """Protocol from which fields are present; the first matching rule wins."""
    tcp_src, tcp_dst = c(f.tcp_srcport), c(f.tcp_dstport)
    udp_s, udp_p = c(f.udp_stream), c(f.udp_port)
    return (F.when(tcp_src.isNotNull() & tcp_dst.isNotNull(), "TCP")
            .when(udp_s.isNotNull(), "UDP")
            .when(udp_p.isNotNull(), "UDP")
            .when(c(f.icmp_checksum).isNotNull(), "ICMP")
            .when(c(f.arp_opcode).isNotNull(), "ARP")
            .when(c(f.mqtt_msgtype).isNotNull() & tcp_src.isNull() & udp_p.isNull() & udp_s.isNull(),
                  "MQTT_OTHER_TRANSPORT")
            .when(c(f.mbtcp_trans_id).isNotNull() & tcp_src.isNull(), "MBTCP_OTHER_TRANSPORT")
            .otherwise("Unknown"))


def canonical_ips(src: ColumnLike, dst: ColumnLike) -> tuple[Column, Column]:
    """(ip1, ip2) with ip1 <= ip2 as text; a null side gives (dst, src)."""
    s, d = c(src), c(dst)
    le = F.coalesce(s <= d, F.lit(False))
    return F.when(le, s).otherwise(d), F.when(le, d).otherwise(s)


def canonical_ports(protocol: Column, src: ColumnLike, ip1: Column,
                    srcport: ColumnLike, dstport: ColumnLike) -> tuple[Column, Column]:
    """C20: TCP ports in endpoint order (port of ip1 first); null for non-TCP or null src."""
    s = c(src)
    tcp = protocol == "TCP"
    first = F.when(tcp & (s == ip1), c(srcport)).when(tcp & (s != ip1), c(dstport))
    second = F.when(tcp & (s == ip1), c(dstport)).when(tcp & (s != ip1), c(srcport))
    return first, second


def session_key(protocol: Column, f: PacketFields = EDGE) -> Column:
    """One uniform struct per packet naming its conversation.

    TCP: (proto, ip1, port1, ip2, port2); UDP: (proto, ip1, ip2, stream or port);
    ICMP: (proto, ip1, ip2, seq or -1); ARP: ('ARP_PKT', ip1, ip2); anything else
    (proto, raw src, raw dst).  Unused fields are null so every branch has the
    same struct type.
    """
    ip1, ip2 = canonical_ips(f.ip_src, f.ip_dst)
    p1, p2 = canonical_ports(protocol, f.ip_src, ip1, f.tcp_srcport, f.tcp_dstport)
    udp_s, udp_p = c(f.udp_stream).cast("long"), c(f.udp_port).cast("long")
    null_l = F.lit(None).cast("long")
    null_s = F.lit(None).cast("string")

    def key(proto, a, b, port1=null_l, port2=null_l, stream=null_l, uport=null_l, icmp=null_l):
        return F.struct(proto.cast("string").alias("protocol"), a.cast("string").alias("ip1"),
                        port1.cast("long").alias("port1"), b.cast("string").alias("ip2"),
                        port2.cast("long").alias("port2"), stream.alias("udp_stream"),
                        uport.alias("udp_port"), icmp.cast("long").alias("icmp_id"))

    return (F.when(protocol == "TCP", key(protocol, ip1, ip2, p1, p2))
            .when((protocol == "UDP") & udp_s.isNotNull(), key(protocol, ip1, ip2, stream=udp_s))
            .when((protocol == "UDP") & udp_p.isNotNull(), key(protocol, ip1, ip2, uport=udp_p))
            .when(protocol == "ICMP",
                  key(protocol, ip1, ip2, icmp=F.coalesce(c(f.icmp_seq).cast("long"), F.lit(-1))))
            .when(protocol == "ARP", key(F.lit("ARP_PKT"), ip1, ip2))
            .otherwise(key(F.coalesce(protocol, null_s), c(f.ip_src), c(f.ip_dst))))


# Fixed value: text used for a null field inside the flow hash.
FLOW_NULL_TEXT = "NONE"
FLOW_SEPARATOR = "||"


def flow_session_id(columns: Sequence[ColumnLike]) -> Column:
    """SHA-256 hex of the fields as text (null -> 'NONE') joined by '||'."""
    parts = [F.coalesce(c(x).cast("string"), F.lit(FLOW_NULL_TEXT)) for x in columns]
    return F.sha2(F.concat_ws(FLOW_SEPARATOR, *parts), 256)
