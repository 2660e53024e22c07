"""Property tests: bucketed ordered scans give the same answer for any bucket width."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetlens.operators import sessions as S
from packetlens.operators.ordered import bucketed_prefix_sum

from test_sessions import SCHEMA, _loop_sessions

row = st.tuples(st.sampled_from(["a", "b", "c"]), st.one_of(st.none(), st.integers(0, 300)),
                st.booleans(), st.integers(0, 1), st.integers(0, 1), st.integers(0, 1), st.integers(0, 1))


@settings(max_examples=8, deadline=None)
@given(st.lists(row, min_size=1, max_size=60), st.sampled_from([1.0, 13.0, 97.0, 1e6]),
       st.integers(1, 80), st.sampled_from(["join", "split"]))
def test_sessionize_any_width(spark, rows, width, timeout, mode):
    data = [(i, k, None if t is None else float(t), tcp, syn, ack, fin, rst)
            for i, (k, t, tcp, syn, ack, fin, rst) in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    got = S.sessionize(df, "key", "t", timeout, tiebreak=["id"], is_tcp=F.col("tcp"), syn="syn", ack="ack",
                       fin="fin", rst="rst", after_close=mode, bucket_width=width)
    got = {r["id"]: r["session_id"] for r in got.collect()}
    if mode == "join":
        assert got == _loop_sessions(data, timeout)
    else:
        ref = S.sessionize(df, "key", "t", timeout, tiebreak=["id"], is_tcp=F.col("tcp"), syn="syn", ack="ack",
                           fin="fin", rst="rst", after_close=mode, bucket_width=1e12)
        assert got == {r["id"]: r["session_id"] for r in ref.collect()}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]), st.integers(-50, 50), st.integers(0, 5)),
                min_size=1, max_size=80), st.sampled_from([1, 3, 17]))
def test_prefix_sum_any_bucket(spark, rows, nb):
    data = [(i, g, float(v), w) for i, (g, v, w) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, g string, v double, w long")
    out = bucketed_prefix_sum(df, ["g"], [F.col("v"), F.col("id")], F.floor(F.col("v") / nb), F.col("w"), "below")
    got = {r["id"]: r["below"] for r in out.collect()}
    for i, g, v, w in data:
        exp = sum(w2 for j, g2, v2, w2 in data if g2 == g and (v2, j) < (v, i))
        assert got[i] == exp


def _brute_sequences(data, length):
    by = {}
    for rid, sess, t, y in data:
        by.setdefault(sess, []).append((t is not None, t if t is not None else 0, rid, y))
    out = {}
    for sess, rows in by.items():
        rows.sort()
        full = len(rows) // length
        for k in range(full):
            chunk = rows[k * length:(k + 1) * length]
            lab = int(sum(r[3] for r in chunk) > 0)
            for step, r in enumerate(chunk):
                out[r[2]] = (f"{sess}||{k + 1}", step, lab)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "t", "u"]), st.one_of(st.none(), st.integers(0, 60)),
                          st.integers(0, 1)), min_size=1, max_size=90),
       st.sampled_from([1.0, 4.0, 25.0, 1e6]), st.integers(1, 7))
def test_make_sequences_any_width(spark, rows, width, length):
    data = [(i, s, None if t is None else float(t), y) for i, (s, t, y) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, session_id string, timestamp double, attack_label int")
    got = S.make_sequences(df, length, tiebreak=["id"], bucket_width=width).collect()
    got = {r["id"]: (r["sequence_id"], r["step"], r["sequence_label"]) for r in got}
    assert got == _brute_sequences(data, length)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["g1", "g2"]), st.integers(-6, 6), st.integers(0, 1)),
                min_size=2, max_size=120))
def test_keyed_auroc_brute_force(spark, rows):
    import math

    from packetlens.operators import metrics as M
    df = spark.createDataFrame([(g, v / 2.0, y) for g, v, y in rows], "split string, logit double, label int")
    got = {r["split"]: r["auroc"] for r in M.auroc(df, ["split"]).collect()}
    for g in {r[0] for r in rows}:
        sc = [(1 / (1 + math.exp(-v / 2.0)), y) for gg, v, y in rows if gg == g]
        pos = [s for s, y in sc if y == 1]
        neg = [s for s, y in sc if y == 0]
        exp = 0.0 if not pos or not neg else sum(
            1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(got[g] - exp) < 1e-12


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.one_of(st.none(), st.integers(-20, 20))),
                min_size=1, max_size=150))
def test_keyed_quantiles_numpy(spark, rows):
    import numpy as np

    from packetlens.operators.quantiles import exact_quantiles
    probs = (0.1, 0.5, 0.75, 1.0)
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, x double")
    got = {(r["g"], r["p"]): r["value"] for r in exact_quantiles(df, F.col("x"), probs, ["g"]).collect()}
    for g in {r[0] for r in rows}:
        vals = [v for gg, v in rows if gg == g and v is not None]
        for p in probs:
            if not vals:
                assert (g, p) not in got
            else:
                assert abs(got[(g, p)] - float(np.quantile(vals, p, method="linear"))) < 1e-9
