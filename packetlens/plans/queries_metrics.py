"""Registered queries for metrics (K1-K6) over the lineitem prediction stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from .registry import query
from .standins import duckdb_predictions, predictions

POS_WEIGHT = 2.0
PRED_CTE = f"WITH pred AS ({duckdb_predictions()}), scored AS (SELECT *, 1.0 / (1.0 + exp(-logit)) AS score FROM pred)"

_COUNTS_SQL = """COUNT(CASE WHEN label <> 1 AND NOT score > 0.5 THEN 1 END) AS tn,
  COUNT(CASE WHEN label <> 1 AND score > 0.5 THEN 1 END) AS fp,
  COUNT(CASE WHEN label = 1 AND NOT score > 0.5 THEN 1 END) AS fn,
  COUNT(CASE WHEN label = 1 AND score > 0.5 THEN 1 END) AS tp"""


def _rates_sql(src: str) -> str:
    return f"""round(CASE WHEN tn + fp + fn + tp = 0 THEN 0 ELSE CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp) END, 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1"""


_SOFTPLUS = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
_LOSS_SQL = (f"{POS_WEIGHT} * label * " + _SOFTPLUS.format(x="(-logit)")
             + " + (1 - label) * " + _SOFTPLUS.format(x="logit"))

_AUC_SQL = """auc_s AS (SELECT {K} score, COUNT(CASE WHEN label = 1 THEN 1 END) AS pos,
                    COUNT(CASE WHEN label <> 1 THEN 1 END) AS neg FROM scored GROUP BY {K} score),
auc_r AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY {P} ORDER BY score
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM auc_s),
auc AS (SELECT {K} CASE WHEN SUM(pos) = 0 OR SUM(neg) = 0 THEN 0.0
                 ELSE SUM(pos * (below + neg / 2.0)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)) END AS auroc
        FROM auc_r GROUP BY {K} 1)"""


def _rounded(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("confusion_matrix", PRED_CTE + f" SELECT {_COUNTS_SQL} FROM scored")
def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 (+C24): TN, FP, FN, TP at threshold 0.5 on sigmoid(logit)."""
    return M.confusion(predictions(spark, sf_dir)).drop("confusion")


@query("classification_metrics", PRED_CTE + f", cm AS (SELECT {_COUNTS_SQL} FROM scored) "
       f"SELECT {_rates_sql('cm')} FROM cm")
def q_classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: accuracy, precision, recall, F1."""
    m = M.classification_metrics(predictions(spark, sf_dir))
    return _rounded(m, m.columns)


@query("auroc", PRED_CTE + ", " + _AUC_SQL.replace("{K} ", "").replace("{P}", "1")
       .replace("GROUP BY 1)", ")") + " SELECT round(auroc, 6) AS auroc FROM auc")
def q_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: exact AUROC with ties (many tied scores)."""
    return _rounded(M.auroc(predictions(spark, sf_dir)), ["auroc"])


@query("log_loss", PRED_CTE + f" SELECT round(AVG({_LOSS_SQL}), 6) AS loss FROM pred")
def q_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: weighted logistic loss (pos_weight 2)."""
    return _rounded(M.weighted_log_loss(predictions(spark, sf_dir), POS_WEIGHT), ["loss"])


_BY_SQL = PRED_CTE + ", " + _AUC_SQL.replace("{K}", "{G},").replace("{P}", "{G}").replace(
    ", 1)", ")") + f""",
cm AS (SELECT {{G}}, {_COUNTS_SQL}, AVG({_LOSS_SQL}) AS loss FROM scored GROUP BY {{G}})
SELECT cm.{{G}} AS {{GA}}, tn, fp, fn, tp, round(loss, 6) AS loss, {_rates_sql('cm')}, round(auroc, 6) AS auroc
FROM cm LEFT JOIN auc ON cm.{{G}} = auc.{{G}}"""


def _metrics_by(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    m = M.metrics_by(predictions(spark, sf_dir), [key], pos_weight=POS_WEIGHT).drop("confusion")
    return _rounded(m, ["loss", "accuracy", "precision", "recall", "f1", "auroc"])


@query("metrics_by_split", _BY_SQL.replace("{GA}", "split").replace("{G}", "split"))
def q_metrics_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: all metrics per split (prediction split = line status)."""
    return _metrics_by(spark, sf_dir, "split")


@query("best_epoch", PRED_CTE.replace(duckdb_predictions(), duckdb_predictions(True)) + ", " + _AUC_SQL.replace("{K}", "epoch,").replace("{P}", "epoch")
       .replace(", 1)", ")") + f""",
cm AS (SELECT epoch, {_COUNTS_SQL}, AVG({_LOSS_SQL}) AS loss FROM scored GROUP BY epoch),
m AS (SELECT cm.epoch, tn, fp, fn, tp, round(loss, 6) AS loss, {_rates_sql('cm')}, round(auroc, 6) AS auroc
      FROM cm LEFT JOIN auc ON cm.epoch = auc.epoch)
SELECT * FROM m ORDER BY f1 DESC, epoch LIMIT 1""")
def q_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 + K6: per-'epoch' metrics (line number as epoch), pick the best F1, first on ties."""
    pred = predictions(spark, sf_dir, with_epoch=True)
    m = M.metrics_by(pred, ["epoch"], pos_weight=POS_WEIGHT).drop("confusion")
    m = _rounded(m, ["loss", "accuracy", "precision", "recall", "f1", "auroc"])
    return M.best_by(m, "f1", "max", "epoch")
