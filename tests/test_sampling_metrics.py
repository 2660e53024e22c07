"""Split/sampling invariants and metrics against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from packetlens.operators import metrics as M
from packetlens.operators import sampling as SM


def _seq_rows(spark, labels, length=2):
    rows = [(f"s{i}", step, lab) for i, lab in enumerate(labels) for step in range(length)]
    return spark.createDataFrame(rows, "sequence_id string, step int, sequence_label int")


def test_split_sizes_and_disjoint(spark):
    for labels in ([1, 1] + [0] * 5, [0] * 40 + [1] * 13, [1] * 9):
        df = SM.stratified_split(_seq_rows(spark, labels))
        per = {r["sequence_id"]: r["split"] for r in df.select("sequence_id", "split").distinct().collect()}
        n = len(labels)
        assert len(per) == n
        counts = {s: sum(1 for v in per.values() if v == s) for s in SM.SPLITS}
        assert counts["train"] == int(0.7 * n) and counts["val"] == int(0.15 * n)
        assert counts["test"] == n - int(0.7 * n) - int(0.15 * n)
        for lab in set(labels):  # a label's share of the test sequences, rounded down or up
            got = sum(1 for i, x in enumerate(labels) if x == lab and per[f"s{i}"] == "test")
            share = counts["test"] * labels.count(lab) / n
            assert share - 1 < got < share + 1


def test_split_deterministic(spark):
    a = SM.stratified_split(_seq_rows(spark, [0] * 30 + [1] * 10), seed=7).collect()
    b = SM.stratified_split(_seq_rows(spark, [0] * 30 + [1] * 10), seed=7).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_balanced_errors_when_short(spark):
    with pytest.raises(Exception):
        SM.balanced_sample(_seq_rows(spark, [0] * 10 + [1] * 2), 10).collect()
    got = SM.balanced_sample(_seq_rows(spark, [0] * 10 + [1] * 6), 10)
    assert got.select("sequence_id").distinct().count() == 10


def _auc_pairs(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    if not pos or not neg:
        return 0.0
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auroc_brute_force(spark):
    rnd = random.Random(3)
    for ties in (3, 50):
        rows = [(rnd.randint(-ties, ties) / 4.0, int(rnd.random() < 0.3)) for _ in range(300)]
        df = spark.createDataFrame(rows, "logit double, label int")
        got = M.auroc(df).first()["auroc"]
        exp = _auc_pairs([(1 / (1 + math.exp(-x)), y) for x, y in rows])
        assert got == pytest.approx(exp, abs=1e-12)


def test_metric_edges(spark):
    one = spark.createDataFrame([(0.3, 1), (0.2, 1)], "logit double, label int")
    assert M.auroc(one).first()["auroc"] == 0.0
    eq = spark.createDataFrame([(0.0, 1), (0.0, 0)], "logit double, label int")
    r = M.classification_metrics(eq).first()  # score 0.5 is not > 0.5
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["accuracy"] == 0.5
    big = spark.createDataFrame([(800.0, 1), (-800.0, 0), (800.0, 0)], "logit double, label int")
    loss = M.weighted_log_loss(big, 2.0).first()["loss"]
    assert loss == pytest.approx(800.0 / 3)
    cm = M.confusion(big).first()
    assert (cm["tn"], cm["fp"], cm["fn"], cm["tp"]) == (1, 1, 0, 1)


def test_best_by_first_on_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "epoch int, val_f1 double")
    assert M.best_by(df, "val_f1").first()["epoch"] == 2
    assert M.best_by(df, "val_f1", "min").first()["epoch"] == 1
