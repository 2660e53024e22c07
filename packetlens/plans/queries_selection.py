"""Registered queries for feature-subset scoring (L1-L6) on packet sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import sampling as SM
from ..operators import selection as SEL
from ..session import materialize
from .experiments import select
from .queries_encode import PREPARED_CTES, prepared
from .queries_sampling import SEED, SPLIT_SQL, _split_rows
from .registry import query

FEATURES = ["ack", "num_a", "port_dst", "port_src", "syn"]
POPULATION = 16
GENERATION = 0


def _scored(spark: SparkSession, sf_dir: str):
    rows = _split_rows(spark, sf_dir, *FEATURES)
    groups = {f: [f] for f in FEATURES}
    seq = SEL.sequence_features(rows, groups)
    fit = SEL.fit_gaussian(seq, len(FEATURES))
    seq = SEL.contributions(seq, groups, fit)
    masks_df = SEL.random_masks(spark, FEATURES, POPULATION, SEED, GENERATION)
    fitness = SEL.score_candidates(seq, SEL.collect_masks(masks_df), SEL.log_prior(fit))
    return fitness.withColumn("generation", F.lit(GENERATION)), masks_df


def _ln(x: str, mu: str, v: str) -> str:
    return f"(-0.5 * ln(2 * pi() * {v}) - ({x} - {mu}) * ({x} - {mu}) / (2 * {v}))"


FIT_SQL = SPLIT_SQL + """,
sm AS (SELECT r.sequence_id, MAX(a.split) AS split, CAST(MAX(r.sequence_label) AS INTEGER) AS y, """ + ", ".join(
    f"AVG(CAST(p.{f} AS DOUBLE)) AS f_{f}" for f in FEATURES) + """
       FROM seqrows r JOIN assigned a USING (sequence_id) JOIN packets p USING (event_id) GROUP BY r.sequence_id),
lng AS (""" + " UNION ALL ".join(
    f"SELECT sequence_id, split, y, '{f}' AS feature, f_{f} AS x FROM sm" for f in FEATURES) + """),
fit AS (SELECT feature, y, AVG(x) AS mu, GREATEST(COALESCE(VAR_POP(x), 0), 1e-9) AS v
        FROM lng WHERE split = 'train' GROUP BY feature, y),
prior AS (SELECT ln(CAST(COUNT(CASE WHEN y = 1 THEN 1 END) AS DOUBLE) / COUNT(CASE WHEN y = 0 THEN 1 END)) AS p
          FROM sm WHERE split = 'train'),
contrib AS (SELECT l.sequence_id, l.y, l.feature,
   COALESCE(""" + _ln("l.x", "f1.mu", "f1.v") + " - " + _ln("l.x", "f0.mu", "f0.v") + """, 0.0) AS c
   FROM lng l JOIN fit f1 ON f1.feature = l.feature AND f1.y = 1 JOIN fit f0 ON f0.feature = l.feature AND f0.y = 0
   WHERE l.split = 'val'),
masks AS (SELECT cand.range AS candidate_id, f.pos, f.feature,
   CAST(CAST(('0x' || substr(md5('""" + str(SEED) + "|" + str(GENERATION) + """|' || CAST(cand.range AS VARCHAR) || '|' || f.feature), 1, 1)) AS INTEGER) % 2 AS INTEGER) AS bit
   FROM range(""" + str(POPULATION) + """) cand,
        (VALUES """ + ", ".join(f"({i}, '{f}')" for i, f in enumerate(FEATURES)) + """) f(pos, feature)),
nf AS (SELECT candidate_id, CAST(SUM(bit) AS DOUBLE) AS n FROM masks GROUP BY candidate_id),
scores AS (SELECT m.candidate_id, ct.sequence_id, ct.y, SUM(m.bit * ct.c) + (SELECT p FROM prior) AS s
           FROM masks m JOIN contrib ct ON m.feature = ct.feature GROUP BY m.candidate_id, ct.sequence_id, ct.y),
conf AS (SELECT candidate_id, COUNT(CASE WHEN y = 1 AND s > 0 THEN 1 END) AS tp,
                COUNT(CASE WHEN y <> 1 AND s > 0 THEN 1 END) AS fp,
                COUNT(CASE WHEN y = 1 AND NOT s > 0 THEN 1 END) AS fn FROM scores GROUP BY candidate_id),
fitness AS (SELECT conf.candidate_id,
   CASE WHEN nf.n = 0 THEN 0.0 WHEN 2 * tp + fp + fn = 0 THEN 0.0
        ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1,
   CASE WHEN nf.n = 0 THEN CAST('inf' AS DOUBLE) ELSE nf.n END AS n_features, """ + str(GENERATION) + """ AS generation
   FROM conf JOIN nf USING (candidate_id))
"""


@query("score_candidates", FIT_SQL + "SELECT candidate_id, round(f1, 6) AS f1, n_features FROM fitness")
def q_score_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 + L3: random masks over five packet features; Gaussian log-likelihood-ratio
    scoring of every candidate on the val split in one pass; F1 and subset size."""
    fitness, _ = _scored(spark, sf_dir)
    return fitness.select("candidate_id", F.round("f1", 6).alias("f1"), "n_features")


@query("pareto_front", FIT_SQL + """,
best AS (SELECT n_features, MAX(f1) AS f1 FROM fitness WHERE n_features <> CAST('inf' AS DOUBLE) GROUP BY n_features),
run AS (SELECT *, MAX(f1) OVER (ORDER BY n_features ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
        FROM best)
SELECT n_features, round(f1, 6) AS f1 FROM run WHERE prev IS NULL OR f1 > prev""")
def q_pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: Pareto front (max F1, min features)."""
    fitness, _ = _scored(spark, sf_dir)
    front = SEL.pareto_front(fitness)
    return front.select("n_features", F.round("f1", 6).alias("f1"))


@query("best_subset", FIT_SQL + """,
b AS (SELECT * FROM fitness ORDER BY f1 DESC, n_features, candidate_id LIMIT 1)
SELECT b.candidate_id, round(b.f1, 6) AS f1, b.n_features,
       array_to_string(list(m.feature ORDER BY m.pos), ',') AS features
FROM b LEFT JOIN masks m ON m.candidate_id = b.candidate_id AND m.bit = 1
GROUP BY b.candidate_id, b.f1, b.n_features""")
def q_best_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best subset of the population (highest F1, then fewest features) and its names."""
    fitness, masks = _scored(spark, sf_dir)
    best = SEL.best_subset(fitness, masks)
    return best.select("candidate_id", F.round("f1", 6).alias("f1"), "n_features",
                       F.array_join("features", ",").alias("features"))


@query("population_stats", FIT_SQL + """
SELECT generation, round(AVG(f1), 6) AS f1_avg, round(STDDEV_POP(f1), 6) AS f1_std, round(MIN(f1), 6) AS f1_min,
       round(MAX(f1), 6) AS f1_max, AVG(n_features) AS n_features_avg, STDDEV_POP(n_features) AS n_features_std,
       MIN(n_features) AS n_features_min, MAX(n_features) AS n_features_max
FROM fitness GROUP BY generation""")
def q_population_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population statistics of both objectives for the generation."""
    fitness, _ = _scored(spark, sf_dir)
    st = SEL.population_stats(fitness)
    return st.select("generation", *[F.round(x, 6).alias(x) for x in ("f1_avg", "f1_std", "f1_min", "f1_max")],
                     "n_features_avg", "n_features_std", "n_features_min", "n_features_max")


def _ratio(x: str) -> str:
    """Log-likelihood ratio of a slot's value under its two normal distributions."""
    side = lambda y: f"(-0.5 * ln(v{y}) - ({x} - m{y}) * ({x} - m{y}) / (2 * v{y}))"
    return f"({side(1)} - {side(0)})"


PREPARED_SELECTION_SQL = PREPARED_CTES + f""",
labelled AS (SELECT DISTINCT sequence_id, split, CAST(sequence_label AS INTEGER) AS y FROM raw),
means AS (SELECT sequence_id, split, CAST(sequence_label AS INTEGER) AS y, slot, SUM(x) / 10 AS x FROM entries WHERE x <> 0
          GROUP BY sequence_id, split, sequence_label, slot),
ns AS (SELECT COUNT(CASE WHEN y = 1 THEN 1 END) AS n1, COUNT(CASE WHEN y = 0 THEN 1 END) AS n0 FROM labelled WHERE split = 'train'),
sums AS (SELECT slot, SUM(CASE WHEN y = 0 THEN x ELSE 0 END) AS s0, SUM(CASE WHEN y = 0 THEN x * x ELSE 0 END) AS q0,
                SUM(CASE WHEN y = 1 THEN x ELSE 0 END) AS s1, SUM(CASE WHEN y = 1 THEN x * x ELSE 0 END) AS q1
         FROM means WHERE split = 'train' GROUP BY slot),
sfit AS (SELECT slot, feature, s0 / n0 AS m0, GREATEST(q0 / n0 - (s0 / n0) * (s0 / n0), 1e-9) AS v0,
                s1 / n1 AS m1, GREATEST(q1 / n1 - (s1 / n1) * (s1 / n1), 1e-9) AS v1
         FROM sums, ns JOIN layout ON sums.slot >= layout.first AND sums.slot < layout.first + layout.width),
base AS (SELECT feature, SUM({_ratio('0.0')}) AS b FROM sfit GROUP BY feature),
terms AS (SELECT m.sequence_id, f.feature, SUM({_ratio('m.x')} - {_ratio('0.0')}) AS t
          FROM means m JOIN sfit f ON m.slot = f.slot WHERE m.split = 'val' GROUP BY m.sequence_id, f.feature),
masks AS (SELECT cand.range AS candidate_id, l.feature,
   CAST(CAST(('0x' || substr(md5('{SEED}|0|' || CAST(cand.range AS VARCHAR) || '|' || l.feature), 1, 1)) AS INTEGER) % 2 AS INTEGER) AS bit
   FROM range({POPULATION}) cand, layout l),
chosen AS (SELECT candidate_id, CAST(SUM(bit) AS DOUBLE) AS n FROM masks GROUP BY candidate_id),
scores AS (SELECT m.candidate_id, v.sequence_id, v.y,
             SUM(m.bit * (COALESCE(base.b, 0) + COALESCE(t.t, 0))) + (SELECT ln(CAST(n1 AS DOUBLE) / n0) FROM ns) AS s
           FROM masks m CROSS JOIN (SELECT * FROM labelled WHERE split = 'val') v LEFT JOIN base ON base.feature = m.feature
           LEFT JOIN terms t ON t.sequence_id = v.sequence_id AND t.feature = m.feature GROUP BY m.candidate_id, v.sequence_id, v.y),
conf AS (SELECT candidate_id, COUNT(CASE WHEN y = 1 AND s > 0 THEN 1 END) AS tp, COUNT(CASE WHEN y <> 1 AND s > 0 THEN 1 END) AS fp,
                COUNT(CASE WHEN y = 1 AND NOT s > 0 THEN 1 END) AS fn FROM scores GROUP BY candidate_id)
SELECT conf.candidate_id, round(CASE WHEN n = 0 OR 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1,
       CASE WHEN n = 0 THEN CAST('inf' AS DOUBLE) ELSE n END AS n_features FROM conf JOIN chosen USING (candidate_id)"""


@query("prepared_selection", PREPARED_SELECTION_SQL)
def q_prepared_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 + L3 on the prepared table: random subsets of its features, scored on the whole val split."""
    data = materialize(prepared(spark, sf_dir), "prepared")
    fitness, _ = select(spark, data, 10, SEED, POPULATION, None, None)
    return fitness.withColumn("f1", F.round("f1", 6))


@query("train_evaluate")
def q_train_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 + K5: weighted logistic regression on the prepared sequences' vectors, metrics per split."""
    data = materialize(prepared(spark, sf_dir), "prepared")
    pw = SM.pos_weight(data).first()["pos_weight"]
    return M.metrics_by(SEL.train_logistic(data, pw), ["split"], pos_weight=pw).drop("confusion")
