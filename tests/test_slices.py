"""Plans over ordered slices stay small: finding a row's slice must not multiply the key's expression."""

from functools import partial

from pyspark.sql import functions as F

from packetlens.operators import encode, ordered
from packetlens.operators import sessions as S

MARK = "key-mark"


def _rows(spark, n=400):
    return spark.range(n).select(F.col("id").alias("event_id"), F.concat(F.lit(MARK), (F.col("id") % 3).cast("string")).alias("k"),
                                 (F.col("id") * 7 % 50).cast("double").alias("t"), (F.col("id") % 2).alias("attack_label"))


def test_slice_search_keeps_the_key_expression_once_a_use(spark, monkeypatch):
    monkeypatch.setattr(S, "range_buckets", partial(ordered.range_buckets, rows_per_bucket=40))
    out = S.sessionize(_rows(spark), "k", "t", 5.0, tiebreak=["event_id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(MARK) < 60  # before: the search's steps nested it thousands of times
    assert out.count() == 400


def test_slices_have_no_null_and_count_the_borders(spark):
    df = spark.createDataFrame([(None,), (1,), (5,), (9,), (12,)], "v int").withColumn("a", F.array(F.lit(1), F.lit(5), F.lit(9)))
    got = ordered.count_le(df, "a", F.col("v"), 64, "n")
    assert not got.schema["n"].nullable
    assert {r["v"]: r["n"] for r in got.collect()} == {None: 0, 1: 1, 5: 2, 9: 3, 12: 3}
    empty = ordered.count_le(df.withColumn("a", F.lit(None).cast("array<int>")), "a", F.col("v"), 64, "n")
    assert {r["n"] for r in empty.collect()} == {0}


def test_the_one_slice_of_a_small_table_is_never_null(spark):
    wide = _rows(spark).withColumn("tb", F.xxhash64("event_id", "k", "t"))
    out = ordered.range_buckets(wide, ["k", "tb"])
    assert not out.schema["__bkt"].nullable  # a null would make a filter of the whole hash, again in every branch
    assert [r["__bkt"] for r in out.select("__bkt").distinct().collect()] == [0]


def test_one_large_group_is_dealt_to_several_tasks(spark):
    """A session of 300,000 rows lies in slices that several tasks number; it used to be one slice up to a million rows."""
    rows = spark.range(300_000).select(F.lit("0").alias("k"), (F.col("id") * 7919 % 300_007).alias("t"), "id")
    got = ordered.range_buckets(rows, ["k", "t", "id"]).groupBy("__bkt").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("__bkt").collect()
    assert len(got) >= 3 and sum(r["n"] for r in got) == 300_000 and max(r["n"] for r in got) < 200_000
    assert all(a["hi"] < b["lo"] for a, b in zip(got, got[1:]))


def test_vectors_compute_their_slots_once(spark):
    df = _rows(spark).select("k", F.col("event_id").alias("sequence_id"), F.lit(0).alias("step"), F.lit(1).alias("sequence_label"), F.lit("train").alias("split"), "t")
    rows = encode.assemble(df, encode.Layout.of_widths({"t": 1}), {"t": encode.Moments(1.0, 2.0)}, [], ["sequence_id", "sequence_label", "split", "step"])
    plan = encode.sequence_vectors(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(") == 1 and plan.count("filter(array(") == 1  # before: once for the indices and once for the values
