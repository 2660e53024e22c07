"""Invariants of the prepared (encoded, split) sequence table."""

import pytest
from pyspark.sql import functions as F

from packetlens.plans.queries_encode import prepared as prepared_rows
from packetlens.operators import encode as EN

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def prepared(spark):
    return prepared_rows(spark, SF).cache()


def test_full_sequences_and_disjoint_splits(prepared):
    per = prepared.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"),
                                              F.countDistinct("split").alias("k"),
                                              F.countDistinct("step").alias("steps"))
    bad = per.filter((F.col("n") != 10) | (F.col("k") != 1) | (F.col("steps") != 10)).count()
    assert bad == 0
    n = per.count()
    sizes = {r["split"]: r["c"] for r in prepared.groupBy("split").agg(
        F.countDistinct("sequence_id").alias("c")).collect()}
    assert sizes["train"] == int(0.7 * n) and sizes["val"] == int(0.15 * n)
    assert sum(sizes.values()) == n


def _slots(df):
    """(sequence_id, step, split, slot, value) of every stored slot."""
    zipped = F.arrays_zip(F.col("features.indices").alias("slot"), F.col("features.values").alias("value"))
    return df.select("sequence_id", "step", "split", F.inline(zipped))


def test_scaled_train_val_moments(prepared):
    groups = EN.feature_groups(EN.Layout.of(prepared))
    n = prepared.filter(F.col("split").isin("train", "val")).count()
    tv = _slots(prepared).filter(F.col("split").isin("train", "val"))
    for name in ("num_a", "port_src", "port_dst"):
        r = tv.where(F.col("slot") == groups[name][0]).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).first()
        assert r["s"] / n == pytest.approx(0.0, abs=1e-9) and r["q"] / n == pytest.approx(1.0, abs=1e-9), name


def test_onehot_rows_have_one_slot_at_most(prepared):
    layout = EN.Layout.of(prepared)
    wide = [n for n, _, w in layout.features if n in ("ip.subnet", "port_dst.category")]
    assert len(wide) == 2
    for name in wide:
        code = EN.hot_code(prepared, name)
        mine = F.size(F.filter("features.indices", lambda i: i.between(*[EN.feature_groups(layout)[name][k] for k in (0, -1)])))
        assert prepared.filter(mine > 1).count() == 0, name
        # fitted on train+val: every train/val row hits exactly one category
        assert prepared.filter(F.col("split").isin("train", "val")).filter(code < 0).count() == 0, name


def test_columns_sorted_and_slots_ascending(prepared):
    assert prepared.columns == sorted(prepared.columns)
    layout = EN.Layout.of(prepared)
    assert layout.names == sorted(layout.names)
    bad = (F.array_sort("features.indices") != F.col("features.indices")) | (F.array_max("features.indices") >= layout.size)
    assert prepared.filter(bad | (F.col("features.size") != layout.size)).count() == 0
