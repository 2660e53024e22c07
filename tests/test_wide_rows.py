"""Rows of many columns: encoded without lambdas, and carried as one struct while sequences are cut."""

import math

from pyspark.sql import functions as F

from packetlens.operators import encode as EN
from packetlens.operators import sessions


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_packed_rows_need_no_lambda(spark):
    values = [1.0, 0.0, -0.0, None, float("nan"), float("inf"), -2.5]
    df = spark.createDataFrame([(f"s{i}", v, i % 2 == 0, i % 3 - 1) for i, v in enumerate(values)], "sequence_id string, x double, f boolean, cat__code int")
    layout = EN.Layout.of_widths({"cat": 2, "f": 1, "x": 1})
    moments = {"x": EN.Moments(0.0, 2.0)}
    plain = EN.assemble(df, layout, moments, ["f"], ["sequence_id"])
    packed = EN.assemble(EN.pack_scalars(df, moments, ["f"], ["sequence_id", "cat__code"]), layout, moments, ["f"], ["sequence_id"])
    for i, v in enumerate(values):
        want = {i % 3 - 1: 1.0} if i % 3 else {}
        want |= {2: 1.0} if i % 2 == 0 else {}
        want |= {3: v / 2} if v is not None and v != 0 else {}
        for got in (plain, packed):
            r = got.where(F.col("sequence_id") == f"s{i}").first()["features"]
            assert r["size"] == 4 and r["indices"] == list(want)
            assert all(a == b or math.isnan(a) and math.isnan(b) for a, b in zip(r["values"], want.values(), strict=True))
    assert "lambda" not in _optimized(packed)


def test_wide_sequences_equal_narrow_ones(spark):
    rows = spark.range(500).selectExpr("if(id % 29 = 0, null, cast(id % 3 as string)) session_id", "double(id div 2 % 40) timestamp", "id tb",
                                       "if(id % 17 = 0, null, id % 23 = 0) attack_label", "id % 7 c0")
    wide = rows.select("*", *[(F.col("c0") * i).alias(f"c.{i}") for i in range(1, 30)])
    cut = lambda df: sessions.make_sequences(df, 5, tiebreak=["tb"])
    a, b = cut(rows), cut(wide)
    assert b.columns == [*wide.columns[2:], "sequence_label", "sequence_id", "step"]
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)
    assert b.where(F.col("`c.4`") != F.col("c0") * 4).count() == 0
    assert "__row" in _optimized(b) and "__row" not in _optimized(a)


def test_selected_features_are_found_in_a_tree(spark):
    layout = EN.Layout.of_widths({"a": 1, "b": 3, "c": 0, "d": 1, "e": 2, "f": 1})
    row = F.struct(F.lit(8).alias("size"), F.array(*[F.lit(i) for i in (0, 2, 4, 6, 7)]).alias("indices"),
                   F.array(*[F.lit(x) for x in (1.5, 1.0, float("nan"), 1.0, -2.0)]).alias("values"))
    df = spark.range(1).select(row.alias("features", metadata=layout.metadata()))
    for names, want in ((["a"], {0: 1.5}), (["b", "c", "f"], {1: 1.0, 3: -2.0}), (["a", "d", "e"], {0: 1.5, 1: math.nan, 3: 1.0}), (["c"], {}),
                        (["f", "e", "d", "b", "a"], {0: 1.5, 2: 1.0, 4: math.nan, 6: 1.0, 7: -2.0})):
        out = EN.select_features(df, names)
        r = out.first()["features"]
        assert r["size"] == sum(w for n, _, w in layout.features if n in names) and r["indices"] == list(want)
        assert all(a == b or math.isnan(a) and math.isnan(b) for a, b in zip(r["values"], want.values(), strict=True))
        assert "named_struct(slot" not in _optimized(out)


def test_few_codes_shuffle_no_rows(spark):
    df = spark.range(3000).selectExpr("cast(id % 900 as string) cat", "cast(id % 3 as string) few", "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        coded = EN.apply_codes(df, EN.fit_codes(df, ["cat", "few"], None, None), ["cat", "few"])
        plan = coded._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    few = coded.select("few__code").distinct().collect()
    assert sorted(r[0] for r in few) == [0, 1, 2] and coded.agg(F.max("cat__code")).first()[0] == 899 and coded.count() == 3000
