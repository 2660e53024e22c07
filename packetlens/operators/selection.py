"""Feature-subset scoring on Spark (inventory L1-L6).

The reference trains one network per candidate subset, one after another.
Here a whole population is scored in one job with a Gaussian class-conditional
model: per-sequence feature values (column means over the sequence's steps)
give additive log-likelihood-ratio contributions, one array per sequence, and
every candidate mask is applied to that array with JVM higher-order functions.
The only shuffle carries one confusion row per (task, candidate).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import c, safe_div
from ..session import materialize
from .encode import FEATURES, Layout, as_ml_vectors, select_features, sequence_vectors

VAR_FLOOR = 1e-9


def random_masks(spark: SparkSession, features: Sequence[str], population: int, seed: int = 42,
                 generation: int = 0) -> DataFrame:
    """L2: (generation, candidate_id, pos, feature, bit); bit = parity of md5(seed|gen|cand|feature)."""
    arr = F.array(*[F.lit(f) for f in features])
    base = spark.range(population).select(F.lit(generation).alias("generation"),
                                          F.col("id").alias("candidate_id"),
                                          F.posexplode(arr).alias("pos", "feature"))
    key = F.concat_ws("|", F.lit(str(seed)), F.col("generation").cast("string"),
                      F.col("candidate_id").cast("string"), F.col("feature"))
    bit = (F.conv(F.substring(F.md5(key), 1, 1), 16, 10).cast("int") % 2).alias("bit")
    return base.select("generation", "candidate_id", "pos", "feature", bit)


def collect_masks(masks: DataFrame) -> dict[int, list[int]]:
    """Bits per candidate in feature order (population x features values; parameter-bounded)."""
    out: dict[int, dict[int, int]] = {}
    for r in masks.select("candidate_id", "pos", "bit").collect():
        out.setdefault(r["candidate_id"], {})[r["pos"]] = r["bit"]
    return {k: [v[i] for i in sorted(v)] for k, v in sorted(out.items())}


def sequence_features(rows: DataFrame, groups: Mapping[str, Sequence[str]], id_col: str = "sequence_id",
                      label_col: str = "sequence_label", checkpoint: bool = True) -> DataFrame:
    """One row per sequence: split, label and the mean of every encoded column over its steps.

    The table is read by the fit and by the scoring pass, so by default it is
    written once as a table in the shared checkpoint folder (one row per sequence).
    """
    cols = [x for g in groups.values() for x in g]
    seq = rows.groupBy(c(id_col)).agg(
        F.max("split").alias("split"), F.max(c(label_col)).cast("int").alias("y"),
        *[F.avg(c(x).cast("double")).alias(f"__m{i}") for i, x in enumerate(cols)])
    if checkpoint:
        seq = materialize(seq, "sequence-features")
    return seq


def fit_gaussian(seq: DataFrame, n_cols: int, split: str = "train") -> dict:
    """Class-conditional mean / population variance per column and class counts (two rows)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(n_cols):
        aggs += [F.avg(f"__m{i}").alias(f"mu{i}"), F.var_pop(f"__m{i}").alias(f"v{i}")]
    rows = seq.filter(F.col("split") == split).groupBy("y").agg(*aggs).collect()
    return {r["y"]: r.asDict() for r in rows}


def _log_normal(x: Column, mu, var) -> Column:
    if mu is None:
        return F.lit(None).cast("double")
    v = max(var if var is not None else 0.0, VAR_FLOOR)
    return F.lit(-0.5 * math.log(2 * math.pi * v)) - (x - F.lit(mu)) * (x - F.lit(mu)) / F.lit(2 * v)


def contributions(seq: DataFrame, groups: Mapping[str, Sequence[str]], fit: dict) -> DataFrame:
    """Adds ``contrib``: per logical feature, the summed log-likelihood ratio (class 1 vs 0)."""
    if 0 not in fit or 1 not in fit:
        raise ValueError("both classes are needed in the fit split")
    per_feature, i = [], 0
    for _, cols in groups.items():
        terms = []
        for _ in cols:
            x = F.col(f"__m{i}")
            ll = (_log_normal(x, fit[1][f"mu{i}"], fit[1][f"v{i}"])
                  - _log_normal(x, fit[0][f"mu{i}"], fit[0][f"v{i}"]))
            terms.append(F.coalesce(ll, F.lit(0.0)))
            i += 1
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        per_feature.append(total)
    return seq.withColumn("contrib", F.array(*per_feature))


def score_candidates(seq: DataFrame, masks: Mapping[int, Sequence[int]], prior: float,
                     split: str = "val") -> DataFrame:
    """L3: (candidate_id, f1, n_features) for every candidate in one pass over ``split``.

    score = prior + sum(bit * contrib); predicted positive when score > 0.  An
    empty subset scores (0, inf) as in the reference.
    """
    ids = sorted(masks)
    mask_arr = F.array(*[F.array(*[F.lit(float(b)) for b in masks[k]]) for k in ids])
    scores = F.transform(mask_arr, lambda m: F.aggregate(
        F.zip_with(m, F.col("contrib"), lambda b, x: b * x), F.lit(0.0), lambda a, v: a + v) + F.lit(prior))
    ex = seq.filter(F.col("split") == split).select("y", F.posexplode(scores).alias("__k", "score"))
    pred, pos = F.col("score") > 0, F.col("y") == 1
    conf = ex.groupBy("__k").agg(F.count_if(pos & pred).alias("tp"), F.count_if(~pos & pred).alias("fp"),
                                 F.count_if(pos & ~pred).alias("fn"))
    id_map = F.array(*[F.lit(k) for k in ids])
    n_map = F.array(*[F.lit(float(sum(masks[k]))) for k in ids])
    k = F.col("__k")
    f1 = safe_div(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))
    n = F.element_at(n_map, k + 1)
    return conf.select(F.element_at(id_map, k + 1).cast("long").alias("candidate_id"),
                       F.when(n == 0, F.lit(0.0)).otherwise(f1).alias("f1"),
                       F.when(n == 0, F.lit(float("inf"))).otherwise(n).alias("n_features"))


def log_prior(fit: dict) -> float:
    n1, n0 = fit[1]["n"], fit[0]["n"]
    return math.log(n1 / n0)


def pareto_front(fitness: DataFrame) -> DataFrame:
    """L4: best F1 per subset size, kept only where it beats every smaller size.

    The window runs over one row per subset size (at most features + 1 rows).
    """
    best = fitness.filter(~F.isnan("n_features") & (F.col("n_features") != float("inf"))) \
        .groupBy("n_features").agg(F.max("f1").alias("f1"))
    w = Window.orderBy("n_features").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("__prev", F.max("f1").over(w)) \
        .filter(F.col("__prev").isNull() | (F.col("f1") > F.col("__prev"))).drop("__prev")


def best_subset(fitness: DataFrame, masks: DataFrame) -> DataFrame:
    """Highest F1, fewest features on a tie (then smallest id), with its feature names."""
    best = fitness.agg(F.max_by(F.struct("candidate_id", "f1", "n_features"),
                                F.struct(F.col("f1"), -F.col("n_features"), -F.col("candidate_id"))).alias("b")
                       ).select("b.*")
    names = masks.filter(F.col("bit") == 1).groupBy("candidate_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "feature"))).alias("__f"))
    return best.join(names, "candidate_id", "left").select(
        "candidate_id", "f1", "n_features",
        F.coalesce(F.transform("__f", lambda s: s["feature"]), F.array().cast("array<string>")).alias("features"))


def population_stats(fitness: DataFrame, by: str = "generation") -> DataFrame:
    """Avg / population std / min / max of each fitness objective per generation."""
    aggs = []
    for m in ("f1", "n_features"):
        aggs += [F.avg(m).alias(f"{m}_avg"), F.stddev_pop(m).alias(f"{m}_std"),
                 F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return fitness.groupBy(by).agg(*aggs)


def train_logistic(rows: DataFrame, pos_weight: float, features: Sequence[str] = (), max_iter: int = 50,
                   reg: float = 0.0, l1: float = 0.0, id_col: str = "sequence_id") -> DataFrame:
    """L1: weighted logistic regression on the prepared table's sequences (train split), scored on all splits.

    Every sequence is one sparse vector of its steps in order (``sequence_vectors``)
    of the named features, all if none is named.  Returns (sequence_id, label,
    logit, split).  Positive sequences carry weight ``pos_weight`` as in a
    weighted logistic loss.  The model has one number per step and slot.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    chosen = select_features(rows, features) if features else rows
    weight = float(pos_weight) if math.isfinite(pos_weight) else 1.0
    seq = sequence_vectors(chosen, id_col).select(
        c(id_col), F.col("label").cast("double").alias("label"), "split", FEATURES,
        F.when(F.col("label") == 1, F.lit(weight)).otherwise(F.lit(1.0)).alias("__w"))
    seq = as_ml_vectors(seq)
    model = LogisticRegression(featuresCol=FEATURES, labelCol="label", weightCol="__w", maxIter=max_iter,
                               regParam=reg, elasticNetParam=l1).fit(seq.filter(F.col("split") == "train"))
    return model.transform(seq).select(c(id_col), F.col("label").cast("int").alias("label"),
                                       vector_to_array("rawPrediction")[1].alias("logit"), "split")


def slot_means(rows: DataFrame, length: int, id_col: str = "sequence_id", label_col: str = "sequence_label") -> DataFrame:
    """(sequence_id, split, y, slot, x): the mean of every stored slot over a prepared sequence's ``length`` steps."""
    slots = F.inline(F.arrays_zip(F.col(FEATURES)["indices"].alias("slot"), F.col(FEATURES)["values"].alias("value")))
    long = rows.select(c(id_col), "split", c(label_col).cast("int").alias("y"), slots)
    return long.groupBy(c(id_col), "split", "y", "slot").agg((F.sum("value") / length).alias("x"))


def prepared_contributions(rows: DataFrame, length: int, fit_split: str = "train", id_col: str = "sequence_id",
                           label_col: str = "sequence_label") -> tuple[DataFrame, float]:
    """(sequence_id, split, y, contrib) of prepared sequences, and the log prior: the input of ``score_candidates``.

    The Gaussian class-conditional model of ``fit_gaussian`` per slot, for any
    number of slots: class moments are a table by slot, joined to the stored
    slots; an empty slot contributes its ratio at 0, added per feature as a
    constant.  One row per feature and class comes to the driver.
    """
    layout = Layout.of(rows)
    seqs = rows.where(F.col("step") == 0).select(c(id_col), "split", c(label_col).cast("int").alias("y"))
    means = materialize(slot_means(rows, length, id_col, label_col), "slot-means")
    n = {r["y"]: r["n"] for r in seqs.where(F.col("split") == fit_split).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        raise ValueError("both classes are needed in the fit split")
    sums = [F.sum(F.when(F.col("y") == y, v).otherwise(0.0)).alias(f"{name}{y}")
            for y in (0, 1) for name, v in (("s", F.col("x")), ("q", F.col("x") * F.col("x")))]
    fit = means.where(F.col("split") == fit_split).groupBy("slot").agg(*sums)

    def log_normal(x: Column, y: int) -> Column:
        mu = F.col(f"s{y}") / n[y]
        v = F.greatest(F.col(f"q{y}") / n[y] - mu * mu, F.lit(VAR_FLOOR))
        return F.log(v) * -0.5 - (x - mu) * (x - mu) / (2 * v)

    feature = F.lit(None).cast("int")
    for k, (_, first, width) in enumerate(layout.features):
        feature = F.when((F.col("slot") >= first) & (F.col("slot") < first + width), F.lit(k)).otherwise(feature)
    ratio = lambda x: log_normal(x, 1) - log_normal(x, 0)
    fit = materialize(fit.withColumn("feature", feature).withColumn("at0", ratio(F.lit(0.0))), "slot-fit")
    base = {r["feature"]: r["b"] for r in fit.groupBy("feature").agg(F.sum("at0").alias("b")).collect()}
    terms = (means.where(F.col("split") != fit_split).join(fit, "slot")
             .groupBy(c(id_col), "feature").agg(F.sum(ratio(F.col("x")) - F.col("at0")).alias("v"))
             .groupBy(c(id_col)).agg(F.map_from_entries(F.collect_list(F.struct("feature", "v"))).alias("terms")))
    contrib = F.array(*[F.lit(float(base.get(k, 0.0))) + F.coalesce(F.try_element_at("terms", F.lit(k)), F.lit(0.0))
                        for k in range(len(layout.features))])
    out = seqs.where(F.col("split") != fit_split).join(terms, id_col, "left").select(c(id_col), "split", "y", contrib.alias("contrib"))
    return out, math.log(n[1] / n[0])
