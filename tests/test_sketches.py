"""Sketch profiles and lookups by table against plain counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packetlens.functions import scalar as X
from packetlens.operators import sketches as K


def _frame(spark):
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        hot = rng.random()
        rows.append((i, "top" if hot < 0.3 else "next" if hot < 0.55 else f"x{rng.randrange(2000)}", None if i % 3 else "seldom", rng.choice(["a", "b", None]),
                     float(rng.randrange(700)) if i % 9 else None))
    return rows, spark.createDataFrame(rows, "key long, skew string, mostly_null string, few string, num double")


@pytest.mark.parametrize("tracked", [16, 200, 5000])
def test_top_two_are_exact(spark, tracked):
    rows, df = _frame(spark)
    cols = df.columns
    got = {r["feature"]: (r["rows"], r["missing"], r["top1"], r["top2"]) for r in K.top_two(df, cols, tracked).collect()}
    for i, n in enumerate(cols):
        counts = sorted(Counter(r[i] for r in rows).values(), reverse=True)[:2]
        assert got[n] == (len(rows), sum(r[i] is None for r in rows), *counts), n


def test_heavy_columns_shuffle_candidates_only(spark):
    """With every column proven by the sketch, no exchange carries more than the tracked values."""
    df = spark.range(20_000).selectExpr("if(id % 10 < 4, 0, if(id % 10 < 7, 1, id)) AS v")
    got = K.top_two(df, ["v"], 100).first()
    assert (got["top1"], got["top2"]) == (8000, 6000)


def test_sketches_merge_within_their_errors(spark):
    rows, df = _frame(spark)
    stored = K.sketch_table(df.withColumn("day", F.col("key") % 7), ["skew", "few", "num"], ["day"])
    whole = {r["feature"]: r for r in K.sketch_profile(K.merge_sketches(stored)).collect()}
    nums = sorted(r[4] for r in rows if r[4] is not None)
    for i, n in ((1, "skew"), (3, "few"), (4, "num")):
        d = len({r[i] for r in rows})
        assert abs(whole[n]["distinct"] - d) <= max(1, 4 * K.distinct_error() * d), n
        assert (whole[n]["rows"], whole[n]["nulls"]) == (len(rows), sum(r[i] is None for r in rows))
    assert (whole["num"]["min"], whole["num"]["max"]) == (nums[0], nums[-1]) and whole["few"]["p50"] is None
    slack = 2 * K.rank_error() * len(nums)
    for p in (25, 50, 75):
        x = whole["num"][f"p{p}"]
        assert sum(v < x for v in nums) <= p / 100 * len(nums) + slack and sum(v <= x for v in nums) >= p / 100 * len(nums) - slack
    by_parity = K.merge_sketches(stored.withColumn("odd", F.col("day") % 2), ["odd"])
    assert by_parity.count() == 6 and K.sketch_profile(by_parity).agg(F.sum("rows")).first()[0] == 3 * len(rows)


def test_sketches_of_no_rows_and_null_columns(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert K.sketch_table(df, ["a", "b"], ["a"]).count() == 0
    assert [tuple(r)[1:] for r in K.top_two(df, ["a", "b"]).collect()] == [(0, 0, 0, 0)] * 2
    nulls = spark.createDataFrame([(None, None)] * 3, "a string, b double")
    got = {r["feature"]: r for r in K.sketch_profile(K.sketch_table(nulls, ["a", "b"])).collect()}
    assert got["a"]["distinct"] == 1 and got["b"]["p50"] is None
    assert [tuple(r) for r in K.top_two(nulls, ["a"]).collect()] == [("a", 3, 3, 3, 0)]


def test_mapping_by_table(spark):
    df = spark.range(300_000).selectExpr("id", "if(id % 1000 = 7, NULL, cast(id % 150000 AS string)) AS v")
    mapping = spark.range(150_000).selectExpr("cast(id AS string) AS key", "id * 2 AS value")
    got = X.map_values_by_table(df, "v", mapping, "m", strict=True)
    assert got.where("m = cast(v AS long) * 2").count() == 300_000 - 300 and got.where("v IS NULL AND m IS NULL").count() == 300
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(text) < 5000  # no literal map in the plan
    few = mapping.where("cast(key AS long) < 10")
    assert X.map_values_by_table(df, "v", few, "m", default=-1).where("m = -1").count() == 300_000 - 300 - 18
    with pytest.raises(ValueError, match="not in mapping"):
        X.map_values_by_table(df, "v", few, "m", strict=True)
    with pytest.raises(ValueError, match="twice"):
        X.map_values_by_table(df, "v", few.union(few), "m")
