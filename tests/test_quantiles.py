"""Distributed exact quantiles equal numpy's linear interpolation, including hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlens.operators.quantiles import exact_quantiles

PROBS = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)


def test_exact_quantiles_grouped(spark):
    rnd = random.Random(5)
    rows = [("hot", float(rnd.randint(0, 3000))) for _ in range(3000)]          # one group, many rows
    rows += [("tie", 7.0)] * 50 + [("tie", 8.0)]                                  # heavy ties
    rows += [("one", 1.5)] + [("nul", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"], r["p"]): r["value"] for r in exact_quantiles(df, F.col("x"), PROBS, ["g"]).collect()}
    for g in ("hot", "tie", "one"):
        vals = np.array([x for k, x in rows if k == g and x is not None])
        for p in PROBS:
            assert got[(g, p)] == pytest.approx(np.quantile(vals, p, method="linear"), abs=1e-9), (g, p)
    assert not any(k[0] == "nul" for k in got)


def test_exact_quantiles_global(spark):
    vals = [float(v) for v in np.random.default_rng(1).normal(size=2000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r["p"]: r["value"] for r in exact_quantiles(df, F.col("x"), PROBS).collect()}
    for p in PROBS:
        assert got[p] == pytest.approx(np.quantile(vals, p, method="linear"), abs=1e-12)
