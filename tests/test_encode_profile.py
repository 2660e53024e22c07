"""Encoding and profiling edge cases."""

from pyspark.sql import functions as F

from packetlens.operators import encode as EN
from packetlens.operators import profile as P


def test_onehot_unknown_and_single(spark):
    df = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "test"), ("a", "test")],
                               "cat string, split string")
    cats = EN.fit_categories(df, ["cat"])
    assert cats == {"cat": ["a", "b"]}
    out = EN.apply_onehot(df, cats).orderBy("split", "cat").collect()
    unseen = [r for r in out if r["split"] == "test" and r["cat__0"] == 0 and r["cat__1"] == 0]
    assert len(unseen) == 1
    codes = EN.apply_codes(df, EN.fit_codes(df, ["cat"]), ["cat"])
    assert sorted(map(tuple, codes.collect())) == [("test", -1), ("test", 0), ("train", 0), ("val", 1)]


def test_codes_of_many_values(spark):
    df = spark.range(3000).selectExpr("cast(id % 2500 as string) AS v", "'train' AS split")
    got = {r["v"]: r["v__code"] for r in EN.apply_codes(df.withColumn("w", F.col("v")), EN.fit_codes(df, ["v"]), ["v"])
           .select(F.col("w").alias("v"), "v__code").collect()}
    want = sorted({str(i) for i in range(2500)})
    assert got == {v: i for i, v in enumerate(want)}


def test_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    d = {r["g"]: r["p50"] for r in P.describe(df, ["x"], by="g").collect()}
    assert d == {None: 2.0, "a": 5.0}
    assert {r["g"]: r["median"] for r in P.target_box(df, "x", "g").collect()} == {None: 2.0, "a": 5.0}
    from packetlens.operators import metrics as M
    pred = spark.createDataFrame([(None, 1, 2.0), (None, 0, 1.0), ("a", 1, 1.0)], "g string, label int, logit double")
    assert {r["g"]: r["auroc"] for r in M.metrics_by(pred, ["g"]).collect()} == {None: 1.0, "a": 0.0}


def test_scaler_constant_and_nan(spark):
    df = spark.createDataFrame([(1.0, 5.0, "train"), (3.0, 5.0, "val"), (float("nan"), 5.0, "train"),
                                (100.0, 5.0, "test")], "x double, k double, split string")
    m = EN.fit_scaler(df, ["x", "k"])
    assert m["x"].mean == 2.0 and m["x"].scale == 1.0 and m["k"].scale == 1.0
    out = EN.apply_scaler(df, m).filter(F.col("split") == "test").first()
    assert out["x"] == 98.0 and out["k"] == 0.0


def test_ordinal(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    assert [r[0] for r in EN.ordinal_encode(df, "s").collect()] == [1, 0, -1]


def test_profile_counts_null_as_value(spark):
    df = spark.createDataFrame([(1, "x"), (1, None), (2, None), (None, None)], "a int, b string")
    prof = {r["feature"]: r for r in P.profile_columns(df).collect()}
    assert prof["a"]["unique_values"] == 3 and prof["a"]["missing"] == 1
    assert prof["b"]["unique_values"] == 2 and prof["b"]["feature_type"] == "Flag"
    assert prof["b"]["first_density_pct"] == 75.0 and prof["b"]["density_gap_pct"] == 50.0
    assert prof["a"]["density_gap_pct"] == 25.0


def test_sequence_matrix_order(spark):
    df = spark.createDataFrame([("s", 1, 2.0, 1), ("s", 0, 1.0, 1)], "sequence_id string, step int, x double, "
                               "sequence_label int")
    r = EN.sequence_matrix(df, ["x"]).first()
    assert r["matrix"] == [[1.0], [2.0]] and r["sequence_label"] == 1
