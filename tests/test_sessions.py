"""Sessionization and sequences against row loops written from the description."""

import random

import pytest

from pyspark.sql import functions as F

from packetlens.operators import sessions as S
from packetlens.operators import ordered
from packetlens.operators.ordered import order_buckets


def _loop_sessions(rows, timeout, after_close="join"):
    """rows: (id, key, t, tcp, syn, ack, fin, rst) -> {id: session_id}"""
    out = {}
    by_key = {}
    for r in rows:
        by_key.setdefault(r[1], []).append(r)
    for key, grp in by_key.items():
        grp.sort(key=lambda r: (r[2] is not None, r[2] if r[2] is not None else 0, r[0]))
        n, last, prev_closed, first = 0, None, False, True
        for rid, _, t, tcp, syn, ack, fin, rst in grp:
            new = False
            if tcp and syn == 1 and ack != 1:
                if last is not None:
                    n += 1
                new = True
            if after_close == "split" and prev_closed and not first and not new:
                n += 1
                new = True
            elif after_close == "split" and prev_closed and not first and new and last is None:
                n += 1
            if not new and last is not None and t is not None and t - last > timeout:
                n += 1
            out[rid] = f"{key}_{n}"
            last = t
            closed = tcp and (fin == 1 or rst == 1)
            if closed:
                last = None
            prev_closed, first = closed, False
    return out


def _random_rows(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = f"k{rnd.randint(0, 4)}"
        t = None if rnd.random() < 0.03 else float(rnd.randint(0, 5000))
        rows.append((i, key, t, key != "k4", int(rnd.random() < 0.1), int(rnd.random() < 0.3),
                     int(rnd.random() < 0.05), int(rnd.random() < 0.03)))
    return rows


SCHEMA = "id long, key string, t double, tcp boolean, syn int, ack int, fin int, rst int"


def test_sessionize_matches_row_loop(spark):
    for seed in (1, 2, 3):
        rows = _random_rows(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        for width in (50.0, 1000.0, 1e9):
            got = S.sessionize(df, "key", "t", 60, tiebreak=["id"], is_tcp=F.col("tcp"), syn="syn",
                               ack="ack", fin="fin", rst="rst", bucket_width=width)
            got = {r["id"]: r["session_id"] for r in got.select("id", "session_id").collect()}
            assert got == _loop_sessions(rows, 60), (seed, width)


def test_sessionize_edge_cases(spark):
    rows = [
        (1, "a", 0.0, True, 1, 0, 0, 0),     # first packet SYN: no new session
        (2, "a", 10.0, True, 1, 1, 0, 0),    # SYN-ACK: not pure
        (3, "a", 70.0, True, 0, 0, 0, 0),    # gap 60 = timeout: same session
        (4, "a", 131.0, True, 0, 0, 1, 0),   # gap 61: new session, FIN
        (5, "a", 500.0, True, 0, 0, 0, 0),   # after FIN: joins (last time cleared)
        (6, "a", 510.0, True, 0, 0, 0, 1),   # RST
        (7, "a", 520.0, True, 1, 0, 0, 0),   # SYN after RST: prev cleared -> no increment
        (8, "b", None, True, 1, 0, 0, 0),    # null time first
        (9, "b", 5.0, True, 0, 0, 0, 0),
        (10, "c", 0.0, False, 0, 0, 1, 0),   # non-TCP FIN is ignored
        (11, "c", 30.0, False, 1, 0, 0, 0),  # non-TCP SYN is ignored
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.sessionize(df, "key", "t", 60, tiebreak=["id"], is_tcp=F.col("tcp"), syn="syn", ack="ack",
                       fin="fin", rst="rst", bucket_width=100.0)
    got = {r["id"]: r["session_id"] for r in got.collect()}
    assert got == _loop_sessions(rows, 60)
    assert got[3] == "a_0" and got[4] == "a_1" and got[5] == "a_1" and got[7] == "a_1"


def test_sequences(spark):
    # sessions of L-1, L, 2L, 2L+1 rows; L = 3; equal timestamps broken by id
    rows, rid = [], 0
    for s, n in [("s1", 2), ("s2", 3), ("s3", 6), ("s4", 7)]:
        for i in range(n):
            rows.append((rid, s, float(i // 2), 1 if (s == "s3" and i == 2) else 0))
            rid += 1
    df = spark.createDataFrame(rows, "id long, session_id string, timestamp double, attack_label int")
    seq = S.make_sequences(df, 3, tiebreak=["id"], bucket_width=1.0).collect()
    by = {}
    for r in seq:
        by.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by) == ["s2||1", "s3||1", "s3||2", "s4||1", "s4||2"]
    assert all(len(v) == 3 for v in by.values())
    assert {k: v[0]["sequence_label"] for k, v in by.items()}["s3||1"] == 1
    assert {k: v[0]["sequence_label"] for k, v in by.items()}["s3||2"] == 0
    assert sorted(r["step"] for r in by["s4||2"]) == [0, 1, 2]


def test_global_chunks_bucket_independent(spark):
    rows = [(i, float(i % 37), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, timestamp double, attack_label int")
    ref = None
    for width in (1.0, 7.0, 1e6):
        got = {r["id"]: (r["chunk"], r["step"]) for r in
               S.chunk_index(df, 10, session=None, tiebreak=["id"], bucket_width=width).collect()}
        ref = ref or got
        assert got == ref
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert {r[0]: (i // 10 + 1, i % 10) for i, r in enumerate(order)} == ref


@pytest.mark.parametrize("make", ["outlier", "nulls", "ties"])
def test_buckets_follow_the_data(spark, make):
    n = 4000
    time = {"outlier": "CASE WHEN id = 0 THEN -1.0 ELSE 1.7e9 + id END", "nulls": "CASE WHEN id % 2 = 0 THEN NULL ELSE 1.7e9 + id END",
            "ties": "CASE WHEN id % 2 = 0 THEN 5.0 ELSE 10.0 + id END"}[make]
    df = spark.range(n).selectExpr("id", f"CAST({time} AS DOUBLE) AS t")
    rows = order_buckets(df, "t", ["id"], rows_per_bucket=200).collect()
    sizes = {}
    for r in rows:
        sizes[r["__bkt"]] = sizes.get(r["__bkt"], 0) + 1
    assert max(sizes.values()) <= 2 * 200 and "__x" not in df.columns
    key = lambda r: (float("-inf") if r["t"] is None else r["t"], r["id"])
    buckets = [r["__bkt"] for r in sorted(rows, key=key)]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_any_key_is_cut_by_any_depth_of_tree(spark, monkeypatch, fan):
    """One time for all rows and a text tie-break, nulls included: slices stay small and follow the order."""
    monkeypatch.setattr(ordered, "FAN", fan)
    df = spark.range(3000).selectExpr("id", "CAST(5 AS DOUBLE) AS t", "if(id % 500 = 0, NULL, md5(cast(id AS string))) AS tie", "CAST(id % 3 AS DECIMAL(9, 1)) AS d")
    rows = ordered.range_buckets(df, ["t", "tie", "d"], rows_per_bucket=100).collect()
    sizes = {}
    for r in rows:
        sizes[r["__bkt"]] = sizes.get(r["__bkt"], 0) + 1
    assert len(sizes) >= 20 and max(sizes.values()) <= 300
    buckets = [r["__bkt"] for r in sorted(rows, key=lambda r: (r["tie"] is not None, r["tie"] or "", r["d"]))]
    assert buckets == sorted(buckets) and len(rows) == 3000


def test_slices_of_the_data_leave_the_results_alone(spark, monkeypatch):
    """Sessions, chunks and sequences are the same in one slice and in many, one key holding a third of the rows."""
    import random
    from functools import partial
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", float(rng.randrange(400)) if i % 17 else None, int(rng.random() < 0.1), int(rng.random() < 0.05))
            for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, session_id string, timestamp double, attack_label int, fin int")
    results = []
    for n in (10_000, 70):
        monkeypatch.setattr(S, "range_buckets", partial(ordered.range_buckets, rows_per_bucket=n))
        s = S.sessionize(df, "session_id", "timestamp", 3.0, tiebreak=["id"], is_tcp=True, fin="fin", out="s").select("id", "s")
        c = S.chunk_index(df, 7, tiebreak=["id"]).select("id", "chunk", "step")
        g = S.chunk_index(df, 7, session=None, tiebreak=["id"]).select("id", "chunk", "step")
        q = S.make_sequences(df, 7, tiebreak=["id"]).select("id", "sequence_id", "step", "sequence_label")
        results.append([sorted(map(tuple, x.collect())) for x in (s, c, g, q)])
    assert results[0] == results[1]


def test_tiebreak_is_mandatory(spark):
    df = spark.createDataFrame([("s", 1, 0)], "session_id string, timestamp long, attack_label int")
    with pytest.raises((ValueError, TypeError)):
        S.make_sequences(df, 2, tiebreak=[])
