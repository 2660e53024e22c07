"""Scalar functions, casts, null fill and schema rules on literal edge tables."""

import math

import pytest
from pyspark.sql import types as T

from packetlens.functions import scalar as X
from packetlens.operators import nulls, schema


def test_hex(spark):
    df = spark.createDataFrame([("0x10",), ("10",), ("ff",), (" 0XfF ",), (None,)], "h string")
    assert [r[0] for r in df.select(X.hex_to_long("h")).collect()] == [16, 16, 255, 255, None]
    bad = spark.createDataFrame([("0xZZ",), ("",)], "h string")
    assert [r[0] for r in bad.select(X.hex_to_long("h", strict=False)).collect()] == [None, None]
    with pytest.raises(Exception):
        spark.createDataFrame([("0xZZ",)], "h string").select(X.hex_to_long("h")).collect()


def test_number_or_hex_and_default(spark):
    df = spark.createDataFrame([("12",), ("1.5e3",), ("ff",), ("12F",), ("xyz",), ("nan",), (None,)], "m string")
    got = df.select(X.number_or_hex("m").alias("a"), X.number_or_default("m").alias("b")).collect()
    assert [r["a"] for r in got][:5] == [12.0, 1500.0, 255.0, float(0x12F), None]
    assert [r["b"] for r in got] == [12.0, 1500.0, -1.0, -1.0, -1.0, -1.0, -1.0]


def test_text_length_and_map(spark):
    df = spark.createDataFrame([("  ab\tc \n",), (None,), (" x　",)], "s string")
    got = df.select(X.text_length("s", True).alias("a"), X.text_length("s").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(4, 4), (0, None), (1, 1)]
    m = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert [r[0] for r in m.select(X.map_values("k", {"a": 1}, default=9)).collect()] == [1, 9, None]
    with pytest.raises(Exception):
        m.select(X.map_values("k", {"a": 1}, strict=True)).collect()


def test_parse_epoch(spark):
    df = spark.createDataFrame([(" 2021 11:44:10.081753000 ",), ("2021 11:44:10",), ("junk",)], "s string")
    got = [r[0] for r in df.select(X.parse_epoch("s")).collect()]
    assert got[0] == pytest.approx(1609501450.081753)
    assert got[1] is None and got[2] is None


def test_casts(spark):
    df = spark.createDataFrame([("12",), ("1.5",), (" 7 ",), ("abc",), (None,)], "s string")
    got = df.select(X.cast_lenient("s", "long", fill=0, via="double").alias("a"),
                    X.cast_lenient("s", "long").alias("b")).collect()
    assert [r["a"] for r in got] == [12, 1, 7, 0, 0]
    assert [r["b"] for r in got] == [12, None, 7, None, None]
    with pytest.raises(Exception):
        df.select(X.cast_strict("s", "long")).collect()


def test_supertype():
    B, I, L, Fl, D, S = (T.BooleanType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(),
                         T.StringType())
    assert schema.common_supertype([B, I]) == S
    assert schema.common_supertype([I, L]) == L
    assert schema.common_supertype([L, Fl]) == Fl
    assert schema.common_supertype([T.DateType(), S]) == S
    assert schema.common_supertype([D]) == D


def test_rename_swap_and_strict_drop(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    out = schema.rename(df, {"a": "b", "b": "a"})
    assert out.columns == ["b", "a"] and out.first()["b"] == 1
    with pytest.raises(KeyError):
        schema.drop_columns(df, ["zz"], strict=True)
    assert schema.drop_columns(df, ["zz", "a"], strict=False).columns == ["b"]


def test_fill_nulls(spark):
    df = spark.createDataFrame(
        [(1, None, None, None, "x"), (2, 2.0, None, True, None), (3, float("nan"), None, None, "y")],
        "id long, v double, allnull long, flag boolean, s string")
    out = nulls.fill_nulls(df)
    assert out.columns == ["id", "v", "allnull", "flag", "s", "v.is_valid", "allnull.is_valid", "flag.is_valid"]
    rows = out.orderBy("id").collect()
    assert rows[0]["v"] == -1 and rows[1]["s"] == "NONE" and rows[0]["flag"] is False
    assert rows[0]["v.is_valid"] is False and rows[1]["v.is_valid"] is True
    assert math.isnan(rows[2]["v"])  # NaN is not null: kept
    bad = spark.createDataFrame([(None,)], "d date")
    with pytest.raises(ValueError):
        nulls.fill_nulls(bad)


def test_superfluous(spark):
    df = spark.createDataFrame([(1, "a", None, 5), (2, "a", None, None)], "a int, b string, c int, d int")
    assert schema.superfluous_columns(df) == ["b", "c"]
