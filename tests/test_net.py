"""IPv4, subnet, flags and ports against the standard-library ipaddress module."""

import ipaddress

from pyspark.sql import functions as F

from packetlens.functions import net, ports

IPS = [None, "", "0", "0.0.0.0", "01.2.3.4", "1.2.3", "256.1.1.1", "127.0.0.1", "10.1.2.3",
       "172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0", "169.254.1.1", "224.0.0.1",
       "240.0.0.1", "192.0.2.7", "8.8.8.8", "255.255.255.255", "::1", "192.0.0.9", "100.64.0.1", " 1.2.3.4"]


def _v4(s):
    try:
        return ipaddress.IPv4Address(s)
    except (ipaddress.AddressValueError, ValueError, TypeError):
        return None


def test_valid_and_long(spark):
    df = spark.createDataFrame([(x,) for x in IPS], "ip string")
    rows = df.select("ip", net.valid_ipv4("ip").alias("v"), net.ipv4_to_long("ip").alias("n"),
                     net.long_to_ipv4(net.ipv4_to_long("ip")).alias("back")).collect()
    for r in rows:
        a = _v4(r["ip"]) if r["ip"] is not None else None
        assert (r["v"] is not None) == (a is not None), r
        if a is not None:
            assert r["n"] == int(a) and r["back"] == str(a)


def test_flags(spark):
    df = spark.createDataFrame([(x,) for x in IPS], "ip string")
    rows = df.select("ip", *net.ip_flags("ip")).collect()
    for r in rows:
        ip = r["ip"]
        a = _v4(ip) if ip is not None else None
        placeholder = ip in ("", "0", "0.0.0.0") or ip is None
        exp_priv = bool(a is not None and not placeholder and a.is_private)
        assert r["ip.is_private"] == exp_priv, ip
        assert r["ip.is_loopback"] == bool(a is not None and not placeholder and a.is_loopback), ip
        assert r["ip.is_multicast"] == bool(a is not None and not placeholder and a.is_multicast), ip
        assert r["ip.is_link_local"] == bool(a is not None and not placeholder and a.is_link_local), ip
        assert r["ip.is_unspecified"] == bool(a is not None and a.is_unspecified), ip


def _mask(a, b, default=None):
    x, y = _v4(a) if a else None, _v4(b) if b else None
    if x is None or y is None:
        return default
    xor = int(x) ^ int(y)
    length = 32 if xor == 0 else 32 - xor.bit_length()
    return str(ipaddress.IPv4Address((0xFFFFFFFF << (32 - length)) & 0xFFFFFFFF))


def test_shared_subnet(spark):
    pairs = [("10.0.0.1", "10.0.0.1"), ("10.0.0.1", "10.0.0.0"), ("0.0.0.0", "128.0.0.0"),
             (None, "1.2.3.4"), ("1.2.3.4", None), ("192.168.1.7", "192.168.200.9"), ("bad", "1.1.1.1")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", net.shared_subnet_mask("a", "b", "null").alias("m")).collect()
    for r in got:
        assert r["m"] == _mask(r["a"], r["b"], "null"), r


def test_ports(spark):
    vals = [None, -1, 0, 1023, 1024, 1883, 49151, 49152, 65535, 65536]
    df = spark.createDataFrame([(v,) for v in vals], "p long")
    for r in df.select("p", *ports.port_features("p")).collect():
        p = r["p"]
        if p is None:
            assert r["p.category"] == "invalid" and r["p.is_well_known"] is None
            continue
        exp = ("well-known" if 0 <= p <= 1023 else "registered" if p <= 49151 and p >= 1024
               else "dynamic-private" if 49152 <= p <= 65535 else "invalid")
        assert r["p.category"] == exp
        assert r["p.is_well_known"] == (0 <= p <= 1023)
        assert r["p.is_common_service"] == (p in ports.COMMON_SERVICE_PORTS)
