"""Binary classification metrics over prediction tables (inventory K1-K6, C24).

A prediction table has a 0/1 ``label`` and a ``logit``; scores are
``sigmoid(logit)`` and a row is predicted positive when the score is strictly
above the threshold.  Every metric is one partial aggregate, optionally per
group keys; AUROC is exact with ties via a bucketed prefix sum over distinct
scores (never a single-partition window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import ColumnLike, c, join_null_safe, safe_div
from ..functions.scalar import sigmoid
from ..session import materialize
from .ordered import bucketed_prefix_sum, range_buckets

DEFAULT_THRESHOLD = 0.5


def _counts(label: Column, score: Column, threshold: float) -> list[Column]:
    pred = score > F.lit(float(threshold))
    pos = label == 1
    return [F.count_if(~pos & ~pred).alias("tn"), F.count_if(~pos & pred).alias("fp"),
            F.count_if(pos & ~pred).alias("fn"), F.count_if(pos & pred).alias("tp")]


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def _loss_term(label: Column, logit: Column, pos_weight: float) -> Column:
    y = label.cast("double")
    return F.lit(float(pos_weight)) * y * softplus(-logit) + (F.lit(1.0) - y) * softplus(logit)


def confusion(pred: DataFrame, threshold: float = DEFAULT_THRESHOLD, keys: Sequence[ColumnLike] = (),
              label: str = "label", logit: str = "logit") -> DataFrame:
    """K1: TN, FP, FN, TP (and the flattened ``confusion`` array in that order)."""
    g = pred.groupBy(*[c(k) for k in keys])
    out = g.agg(*_counts(c(label), sigmoid(logit), threshold))
    return out.withColumn("confusion", F.array(*[F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp")]))


def _rates(tn: Column, fp: Column, fn: Column, tp: Column) -> list[Column]:
    n = tn + fp + fn + tp
    return [safe_div(tp + tn, n).alias("accuracy"), safe_div(tp, tp + fp).alias("precision"),
            safe_div(tp, tp + fn).alias("recall"), safe_div(2 * tp, 2 * tp + fp + fn).alias("f1")]


def classification_metrics(pred: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                           keys: Sequence[ColumnLike] = (), label: str = "label",
                           logit: str = "logit") -> DataFrame:
    """K2: accuracy, precision, recall, F1 (an empty denominator gives 0)."""
    cm = confusion(pred, threshold, keys, label, logit)
    return cm.select(*[c(k) for k in keys], *_rates(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")))


def auroc(pred: DataFrame, keys: Sequence[ColumnLike] = (), label: str = "label",
          logit: str = "logit") -> DataFrame:
    """K3: exact area under the ROC curve with ties counted half; one class only -> 0.

    AUROC = sum over distinct scores s of pos(s) * (neg(< s) + neg(s) / 2) / (P * N).
    Scores are first collapsed to distinct values per group (map-side combine),
    then negatives below each score come from a prefix sum over ordered slices
    of the distinct scores (balanced even when scores crowd).
    """
    keys = list(keys)
    key_cols = [c(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    kn = [f"__k{i}" for i in range(len(keys))]
    per_score = pred.select(*key_cols, sigmoid(logit).alias("__s"), c(label).alias("__y")) \
        .groupBy(*kn, "__s").agg(F.count_if(F.col("__y") == 1).alias("__pos"),
                                 F.count_if(F.col("__y") != 1).alias("__neg"))
    # slices of about equal numbers of distinct scores
    per_score = materialize(per_score, "distinct-scores")
    per_score = range_buckets(per_score, [*kn, F.col("__s")], out="__qb")
    scanned = bucketed_prefix_sum(per_score, kn, [F.col("__s")], F.col("__qb"), F.col("__neg"), "__below")
    agg = scanned.groupBy(*kn).agg(
        F.sum(F.col("__pos") * (F.col("__below") + F.col("__neg") / 2.0)).alias("__area"),
        F.sum("__pos").alias("__P"), F.sum("__neg").alias("__N"))
    auc = F.when((F.col("__P") == 0) | (F.col("__N") == 0), F.lit(0.0)).otherwise(
        F.col("__area") / (F.col("__P").cast("double") * F.col("__N")))
    return agg.select(*[F.col(f"__k{i}").alias(k if isinstance(k, str) else f"key{i}")
                        for i, k in enumerate(keys)], auc.alias("auroc"))


def weighted_log_loss(pred: DataFrame, pos_weight: float = 1.0, keys: Sequence[ColumnLike] = (),
                      label: str = "label", logit: str = "logit") -> DataFrame:
    """K4: mean over rows of ``w*y*softplus(-x) + (1-y)*softplus(x)``."""
    return pred.groupBy(*[c(k) for k in keys]).agg(
        F.avg(_loss_term(c(label), c(logit).cast("double"), pos_weight)).alias("loss"))


def metrics_by(pred: DataFrame, keys: Sequence[str] = (), threshold: float = DEFAULT_THRESHOLD,
               pos_weight: float = 1.0, label: str = "label", logit: str = "logit") -> DataFrame:
    """K5: confusion, rates, loss and AUROC per group, one row per group."""
    keys = list(keys)
    base = pred.groupBy(*[c(k) for k in keys]).agg(
        *_counts(c(label), sigmoid(logit), threshold),
        F.avg(_loss_term(c(label), c(logit).cast("double"), pos_weight)).alias("loss"))
    base = base.select(*[c(k) for k in keys], "tn", "fp", "fn", "tp", "loss",
                       *_rates(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")),
                       F.array(*[F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp")]).alias("confusion"))
    auc = auroc(pred, keys, label, logit)
    if not keys:
        return _join_single_row(base, auc)
    return join_null_safe(base, auc, keys)


def _join_single_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row aggregates side by side (equi-join on a shared constant key)."""
    return a.withColumn("__j", F.lit(0)).join(b.withColumn("__j", F.lit(0)), "__j").drop("__j")


def best_by(df: DataFrame, metric: str, mode: str = "max", order: str = "epoch",
            keys: Sequence[str] = ()) -> DataFrame:
    """K6: per group, the row with the best metric; ties go to the smallest ``order``."""
    if mode not in ("max", "min"):
        raise ValueError("mode must be 'max' or 'min'")
    m = c(metric) if mode == "max" else -c(metric)
    row = F.struct(*[c(x) for x in df.columns])
    pick = F.max_by(row, F.struct(m.alias("m"), (-c(order)).alias("o")))
    return df.groupBy(*[c(k) for k in keys]).agg(pick.alias("__best")).select("__best.*")
