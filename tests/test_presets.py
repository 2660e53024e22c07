"""Preset cleaning on small literal capture frames (column rules of A5-A7)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlens.plans import presets


def _frame(spark, cols: dict, n: int):
    fields = [T.StructField(k, T.StringType() if isinstance(v[0], str) or v[0] is None else
                            (T.DoubleType() if isinstance(v[0], float) else T.LongType()), True)
              for k, v in cols.items()]
    rows = [tuple(cols[k][i] for k in cols) for i in range(n)]
    return spark.createDataFrame(rows, T.StructType(fields))


def test_clean_mqtt(spark):
    n = 2
    cols = {"tcp.stream": [5, 5], "frame.time_epoch": [1.0, 2.0], "ip.src": ["10.0.0.1", "bad"],
            "ip.dst": ["10.0.0.3", "10.0.0.3"], "tcp.srcport": [1883, 70000], "tcp.dstport": [50000, None],
            "mqtt.msg": ["  hi ", None], "mqtt.msgid": ["7", "8"], "tcp.len": ["1", "2"], "mqtt.len": ["3", "4"],
            "attack_type": ["dos", "dos"]}
    for c in presets.MQTT_SUPERFLUOUS + presets.MQTT_USELESS:
        cols.setdefault(c, ["x", "y"])
    out = presets.clean_mqtt(_frame(spark, cols, n)).orderBy("timestamp").collect()
    assert out[0]["session_id"] == "5" and out[0]["mqtt.msg.len"] == 2 and out[1]["mqtt.msg.len"] == 0
    assert out[0]["ip.subnet"] == "255.255.255.252" and out[1]["ip.subnet"] is None
    assert out[0]["tcp.srcport.category"] == "registered" and out[1]["tcp.srcport.category"] == "invalid"
    assert out[1]["tcp.dstport.is_well_known"] is None
    names = set(out[0].asDict())
    assert not names & {"ip.src", "ip.dst", "mqtt.msg", "tcp.srcport", "frame.len", "tcp.stream"}
    cols.pop("frame.len")
    with pytest.raises(KeyError):
        presets.clean_mqtt(_frame(spark, cols, n))


def test_clean_edge(spark):
    n = 3
    cols = {"frame.time": [" 2021 00:00:01.000000000 ", " 2021 00:00:30.000000000 ", "junk"],
            "ip.src_host": ["10.0.0.1", "10.0.0.1", "10.0.0.2"], "ip.dst_host": ["10.0.0.2", "10.0.0.2", "10.0.0.1"],
            "arp.src.proto_ipv4": [None, None, None], "arp.dst.proto_ipv4": [None, None, None],
            "dns.qry.name": ["11", None, None], "dns.qry.name.len": ["example.org", None, None],
            "Attack_label": [0, 0, 1], "Attack_type": ["Normal", "Normal", "DDoS"],
            "tcp.payload": [" ab ", None, "x"], "mqtt.msg_decoded_as": ["0", "0", "0"]}
    for c in presets.EDGE_NUMERIC_LIKE:
        cols.setdefault(c, ["1.5", None, "bad"])
    cols["tcp.connection.syn"] = ["1", "0", "0"]
    cols["tcp.flags.ack"] = ["0", "1", "1"]
    for c in presets.EDGE_TEXT:
        cols.setdefault(c, [None, None, None])
    cols["mbtcp.trans_id"] = [None, None, None]
    rows = presets.clean_edge(_frame(spark, cols, n), bucket_width=3600.0).orderBy("timestamp").collect()
    assert rows[0]["timestamp"] == 0.0 and rows[0]["frame.time.is_valid"] is False   # unparseable time filled
    assert rows[1]["timestamp"] == pytest.approx(1609459201.0)
    assert rows[0]["dns.qry.name"] is None and rows[1]["dns.qry.name.len"] == 11      # swapped + cast
    assert rows[0]["attack_label"] == 1 and "Attack_label" not in rows[0].asDict()
    assert rows[1]["tcp.payload.length"] == 2 and rows[0]["tcp.payload.length"] == 1
    assert rows[1]["tcp.len"] == 1 and rows[0]["tcp.len"] == 0                          # via double, fill 0
    # after the fill every packet has TCP ports (1 for '1.5', 0 for 'bad' and null):
    # two TCP keys; the two port-0 packets (null time first) share one session
    assert len({r["session_id"] for r in rows}) == 2
    assert rows[0]["session_id"] == rows[2]["session_id"] and rows[0]["session_id"].endswith("_0")
    assert not set(rows[0].asDict()) & set(presets.EDGE_DISCARD + presets.EDGE_TEXT + presets.EDGE_SUPERFLUOUS)


def test_clean_flows(spark):
    n = 3
    cols = {"Date": ["1/2/2020", "-", "3/4/2021"], "Timestamp": ["1580515200", "?", "1617494400"],
            "Scr_IP": ["192.168.1.10", "bad", "10.0.0.1"], "Des_IP": ["192.168.1.20", "8.8.8.8", "0.0.0.0"],
            "Scr_port": ["443", "#DIV/0!", "70000"], "Des_port": ["5683", "1", "2"],
            "class1": ["a", "b", "c"], "class2": ["Normal", "Scan", "Normal"], "class3": ["Normal", "Attack", "Odd"],
            "anomaly_alert": ["FALSE", "TRUE", "-"], "is_SYN_with_RST": ["0", "0", "0"]}
    for c in presets.FLOW_LONG + presets.FLOW_DOUBLE:
        if c not in ("Scr_port", "Des_port", "timestamp"):
            cols.setdefault(c, ["1", "x", "2.5"])
    out = presets.clean_flows(_frame(spark, cols, n)).collect()
    r0, r1, r2 = out
    assert [r["attack_label"] for r in out] == [0, 1, None]
    assert [r["anomaly_alert"] for r in out] == [0, 1, None]
    assert [r["timestamp"] for r in out] == [1580515200, None, 1617494400]
    assert {r["session_id"] for r in out} == {"0"}
    assert r0["IP.Subnet"] == "255.255.255.224" and r1["IP.Subnet"] is None
    assert r2["Des_IP.is_unspecified"] is True and r2["Des_IP.is_private"] is False
    assert r0["Scr_port.category"] == "well-known" and r2["Scr_port.category"] == "invalid"
    assert r1["missed_bytes"] is None and r2["Duration"] == 2.5
    assert not set(r0.asDict()) & {"Des_IP", "Scr_IP", "Date", "Scr_port", "Des_port", "class1", "class3"}


def test_clean_flows_flow_sessions(spark):
    import hashlib

    cols = {"Date": ["1/2/2020"], "Timestamp": ["1580515200"], "Scr_IP": ["10.0.0.1"], "Des_IP": ["bad"],
            "Scr_port": ["443"], "Des_port": ["x"], "Protocol": ["tcp"], "class1": ["a"], "class2": ["Normal"],
            "class3": ["Normal"], "anomaly_alert": ["FALSE"]}
    for c in presets.FLOW_LONG + presets.FLOW_DOUBLE:
        if c not in ("Scr_port", "Des_port", "timestamp"):
            cols.setdefault(c, ["1"])
    r = presets.clean_flows(_frame(spark, cols, 1), session="flow").first()
    expected = hashlib.sha256("10.0.0.1||443||NONE||NONE||tcp||1580515200".encode()).hexdigest()
    assert r["session_id"] == expected
