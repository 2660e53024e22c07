"""Sparse design rows, training, selection, sampling cuts, dataset views and the experiment grid against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlens.operators import encode as EN
from packetlens.operators import sampling as SM
from packetlens.operators import selection as SEL
from packetlens.plans import datasets, experiments
from packetlens.sources import files


# ---- codes, layout, features

def _encoded(spark, rows, split="split"):
    df = spark.createDataFrame(rows, "sequence_id string, step int, sequence_label int, split string, x double, f boolean, cat string, other string")
    codes = EN.fit_codes(df, ["cat", "other"], split)
    layout = EN.fit_layout(codes, ["x", "f"], ["cat", "other"])
    coded = EN.apply_codes(df, codes, ["cat", "other"])
    return EN.assemble(coded, layout, {"x": EN.Moments(1.0, 2.0)}, ["f"], ["sequence_id", "step", "sequence_label", "split"]), layout


def test_sparse_rows(spark):
    rows = [("a", 0, 1, "train", 1.0, True, "u", None), ("a", 1, 1, "train", 3.0, False, "z", "q"), ("b", 0, 0, "test", None, None, "new", "q"),
            ("b", 1, 0, "val", 5.0, True, "é", "p")]
    df, layout = _encoded(spark, rows)
    assert layout.features == (("cat", 0, 3), ("f", 3, 1), ("other", 4, 2), ("x", 6, 1)) and layout.size == 7
    assert EN.Layout.of(df) == layout
    got = {(r["sequence_id"], r["step"]): dict(zip(r["features"]["indices"], r["features"]["values"])) for r in df.collect()}
    assert got == {("a", 0): {0: 1.0, 3: 1.0}, ("a", 1): {1: 1.0, 5: 1.0, 6: 1.0}, ("b", 0): {5: 1.0}, ("b", 1): {2: 1.0, 3: 1.0, 4: 1.0, 6: 2.0}}
    few = EN.select_features(df, ["x", "cat"])
    assert EN.Layout.of(few).features == (("cat", 0, 3), ("x", 3, 1))
    got = {(r["sequence_id"], r["step"]): dict(zip(r["features"]["indices"], r["features"]["values"])) for r in few.collect()}
    assert got == {("a", 0): {0: 1.0}, ("a", 1): {1: 1.0, 3: 1.0}, ("b", 0): {}, ("b", 1): {2: 1.0, 3: 2.0}}
    assert EN.Layout.of(EN.select_features(df, [1])).names == ["f"] and EN.Layout.of(EN.select_features(df, [])) == layout
    with pytest.raises(ValueError):
        EN.select_features(df, ["nothing"])
    vectors = EN.as_ml_vectors(EN.sequence_vectors(df))
    got = {r["sequence_id"]: (r["features"].size, dict(zip(r["features"].indices.tolist(), r["features"].values.tolist()))) for r in vectors.collect()}
    assert got == {"a": (14, {0: 1.0, 3: 1.0, 8: 1.0, 12: 1.0, 13: 1.0}), "b": (14, {5: 1.0, 9: 1.0, 10: 1.0, 11: 1.0, 13: 2.0})}


def test_codes_of_many_values(spark):
    values = sorted({f"v{random.Random(i).randrange(10**9)}" for i in range(5000)})
    df = spark.createDataFrame([(v, w) for v, w in zip(values, values[::-1])] * 2 + [(None, "x")], "a string, b string")
    got = {(r["feature"], r["value"]): r["code"] for r in EN.fit_codes(df, ["a", "b"], None, None).collect()}
    want = {("a", v): i for i, v in enumerate(values)} | {("b", v): i for i, v in enumerate(sorted([*values, "x"]))}
    assert got == want
    assert EN.fit_codes(df.limit(0), ["a", "b"], None, None).count() == 0


# ---- training and selection

def _made(spark, n=120, length=2):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        split = "train" if i % 3 else "val"
        for step in range(length):
            rows.append((f"s{i}", step, y, split, rng.gauss(y * 1.5 + 1, 2), rng.random() < 0.3 + 0.4 * y, rng.choice("uvw" if y else "uvx"), rng.choice("pq")))
    return _encoded(spark, rows)[0]


def test_training_matches_a_plain_fit(spark):
    df = _made(spark)
    weight = 1.7
    vec = {r["sequence_id"]: r for r in EN.as_ml_vectors(EN.sequence_vectors(df)).collect()}
    x = np.array([np.append(v["features"].toArray(), 1.0) for v in vec.values()])
    y = np.array([v["label"] for v in vec.values()], dtype=float)
    train = np.array([v["split"] == "train" for v in vec.values()])
    w = np.where(y == 1, weight, 1.0)
    lam, sd = 0.05, x[train, :-1].std(0, ddof=1)
    wm = (w[train, None] * x[train, :-1]).sum(0) / w[train].sum()
    sd = np.sqrt((w[train, None] * (x[train, :-1] - wm) ** 2).sum(0) / (w[train].sum() - (w[train] ** 2).sum() / w[train].sum()))
    sd[sd == 0] = 1
    beta, z = np.zeros(x.shape[1]), x.copy()
    z[:, :-1] = x[:, :-1] / sd
    for _ in range(60):  # Newton steps of the ridge loss on scaled columns
        p = 1 / (1 + np.exp(-z[train] @ beta))
        pen = np.append(np.full(x.shape[1] - 1, lam), 0.0)
        grad = (w[train] * (p - y[train])) @ z[train] / w[train].sum() + pen * beta
        hess = (z[train] * (w[train] * p * (1 - p))[:, None]).T @ z[train] / w[train].sum() + np.diag(pen + 1e-12)
        beta -= np.linalg.solve(hess, grad)
    want = dict(zip(vec, z @ beta))
    got = {r["sequence_id"]: r["logit"] for r in SEL.train_logistic(df, weight, max_iter=200, reg=lam).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in got) < 1e-2
    assert SEL.train_logistic(df, float("inf"), ["x"]).count() == len(vec)


def test_contributions_match_dense_gaussians(spark):
    df = _made(spark)
    layout = EN.Layout.of(df)
    mean, info = {}, {}
    for r in df.collect():
        v = mean.setdefault(r["sequence_id"], np.zeros(layout.size))
        v[r["features"]["indices"]] += np.array(r["features"]["values"]) / 2
        info[r["sequence_id"]] = (r["split"], r["sequence_label"])
    fit = {y: np.array([m for k, m in mean.items() if info[k] == ("train", y)]) for y in (0, 1)}

    def log_normal(x, y):
        v = np.maximum(fit[y].var(0), SEL.VAR_FLOOR)
        return -0.5 * np.log(v) - (x - fit[y].mean(0)) ** 2 / (2 * v)

    seq, prior = SEL.prepared_contributions(df, 2)
    assert prior == pytest.approx(math.log(len(fit[1]) / len(fit[0])))
    got = {r["sequence_id"]: r["contrib"] for r in seq.collect()}
    assert set(got) == {k for k, x in info.items() if x[0] == "val"}
    for k, contrib in got.items():
        ratio = log_normal(mean[k], 1) - log_normal(mean[k], 0)
        want = [ratio[a:a + w].sum() for _, a, w in layout.features]
        assert contrib == pytest.approx(want, rel=1e-6, abs=1e-6)


# ---- draws by hash cuts

@pytest.mark.parametrize("fetch", [0, 10_000])
def test_draws_match_ranks(spark, monkeypatch, fetch):
    monkeypatch.setattr(SM, "FETCH", fetch)
    monkeypatch.setattr(SM, "DIGITS", 1)
    labels = {f"s{i}": (1 if i % 7 == 0 else 0 if i % 5 else None) for i in range(400)}
    rows = spark.createDataFrame([(s, k, y) for s, y in labels.items() for k in range(2)], "sequence_id string, step int, sequence_label int")
    h = lambda s: hashlib.md5(f"9|{s}".encode()).hexdigest()
    rank = {}
    for y in (None, 0, 1):
        for i, s in enumerate(sorted((s for s, x in labels.items() if x == y), key=h)):
            rank[s] = i
    ids = lambda df: {r["sequence_id"] for r in df.collect()}
    assert ids(SM.balanced_sample(rows, 30, 9)) == {s for s, y in labels.items() if y is not None and rank[s] < 15}
    assert ids(SM.random_sample(rows, 37, 9)) == set(sorted(labels, key=h)[:37])
    assert ids(SM.random_sample(rows, 10_000, 9)) == set(labels) and not ids(SM.random_sample(rows, 0, 9))
    sizes = {y: sum(x == y for x in labels.values()) for y in (None, 0, 1)}
    quota = SM.quotas(50, sizes)
    assert sum(quota.values()) == 50 and all(abs(quota[y] - 50 * n / 400) < 1 for y, n in sizes.items())
    assert ids(SM.stratified_sample(rows, 50, 9)) == {s for s, y in labels.items() if rank[s] < quota[y]}
    assert SM.balanced_sample(rows, 30, 9).columns == rows.columns


def test_a_draw_is_a_filter(spark):
    rows = spark.range(1000).selectExpr("cast(id div 2 as string) sequence_id", "int(id % 2) step", "int(id % 20 < 4) sequence_label")
    for df in (SM.balanced_sample(rows, 10), SM.stratified_split(rows), SM.random_sample(rows, 10)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan and "Sort" not in plan


# ---- cache, dataset views, grid

def _source(spark, path, n):
    spark.range(n).selectExpr(
        "cast(id % 6 as string) session_id", "double(id) timestamp", "id % 11 = 0 attack_label", "if(id % 11 = 0, 'dos', 'none') attack_type",
        "double(id % 13) num", "if(id % 2 = 0, 'a', 'b') cat").write.mode("overwrite").parquet(path)




def test_changed_input_or_parameters_rebuild_the_cache(spark, tmp_path):
    src, base = str(tmp_path / "src"), str(tmp_path / "cache")
    load = lambda s, p: s.read.parquet(p)
    _source(spark, src, 120)
    n = datasets.load_data(spark, "mqttset", src, base, 5, loader=load)[0].count()
    stamp = lambda: [f for f in sorted(files.list_files(spark, f"{base}/mqttset_5.parquet", ".parquet"))]
    before = stamp()
    assert datasets.load_data(spark, "mqttset", src, base, 5, loader=load)[0].count() == n == 120 and stamp() == before
    datasets.load_data(spark, "mqttset", src, base, 5, seed=3, loader=load)
    assert stamp() != before
    _source(spark, src, 180)
    assert datasets.load_data(spark, "mqttset", src, base, 5, seed=3, loader=load)[0].count() == 180


def test_dataset_factory_reads_one_split(spark, tmp_path):
    src, base = str(tmp_path / "src"), str(tmp_path / "cache")
    _source(spark, src, 360)
    parts, extra = datasets.dataset_factory(spark, "mqttset", src, base, 5, features=["num"], loader=lambda s, p: s.read.parquet(p))
    counts = {s: df.count() for s, df in parts.items()}
    assert counts == {"train": 50, "val": 10, "test": 12} and extra["pos_weight"] > 0
    plan = parts["val"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "= val)" in plan
    assert {r["features"]["size"] for r in parts["val"].collect()} == {5}


def test_grid_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    src, base, out = (str(tmp_path / x) for x in ("src", "cache", "results"))
    _source(spark, src, 600)
    sources = {"mqttset": (src, lambda s, p: s.read.parquet(p))}
    run, calls = experiments.run_one, []

    def stopping(spark, dataset, data, pw, model, *a, **k):
        calls.append(model)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return run(spark, dataset, data, pw, model, *a, **k)

    monkeypatch.setattr(experiments, "run_one", stopping)
    with pytest.raises(RuntimeError):
        experiments.run_grid(spark, sources, base, out, length=5, n_train=40, n_val=10, population=4)
    rows = experiments.run_grid(spark, sources, base, out, length=5, n_train=40, n_val=10, population=4)
    assert calls == ["logistic", "lasso", "lasso"]
    got = [(r["model"], r["random_state"]) for r in rows.collect()]
    assert sorted(got) == [("lasso", 44), ("logistic", 43)] and rows.schema == files.RESULTS_SCHEMA
    files.put_results(spark.createDataFrame(rows.where("model = 'lasso'").collect(), files.RESULTS_SCHEMA), out)
    assert files.read_results(spark, out).count() == 2


def test_grid_fits_and_scores_on_whole_splits(spark, tmp_path, monkeypatch):
    src, base, out = (str(tmp_path / x) for x in ("src", "cache", "results"))
    _source(spark, src, 600)
    score, seen = SEL.score_candidates, []

    def counting(seq, masks, prior, **k):
        seen.append(({r["y"]: r["count"] for r in seq.where("split = 'val'").groupBy("y").count().collect()}, prior))
        return score(seq, masks, prior, **k)

    monkeypatch.setattr(SEL, "score_candidates", counting)
    loader = lambda s, p: s.read.parquet(p)
    assert experiments.run_grid(spark, {"mqttset": (src, loader)}, base, out, length=5, population=4).count() == 2
    sizes = {(r["split"], r["sequence_label"]): r["count"] for r in spark.read.parquet(f"{base}/mqttset_5.parquet").where("step = 0")
             .groupBy("split", "sequence_label").count().collect()}
    assert sizes["train", 0] != sizes["train", 1] and sizes["val", 0] != sizes["val", 1]
    want = ({y: sizes["val", y] for y in (0, 1)}, pytest.approx(math.log(sizes["train", 1] / sizes["train", 0])))
    assert seen == [want, want]
