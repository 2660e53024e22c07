"""Experiment grid (inventory K7): feature selection, training and test metrics for every dataset, model and seed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encode, metrics, sampling, selection
from ..session import materialize
from ..sources import files
from .datasets import load_data

#: Models by name: parameters of the logistic regression.
MODELS: dict[str, dict[str, float]] = {"logistic": {}, "lasso": {"reg": 0.002, "l1": 1.0}}


def contributions(data: DataFrame, length: int, seed: int, n_train: int | None = None, n_val: int | None = None) -> tuple[DataFrame, float]:
    """L3's model of the prepared table: the contributions of val sequences, fitted on train sequences, and the log prior.

    Both splits are taken whole; a number takes a balanced sample of that many sequences, or of as many as the smaller class allows.
    """
    if n_train is None and n_val is None:
        return selection.prepared_contributions(data.where(F.col("split").isin("train", "val")), length)
    parts = []
    for split, n in (("train", n_train), ("val", n_val)):
        part = data.where(F.col("split") == split)
        if n is not None:
            sizes = {r["sequence_label"]: r["count"] for r in part.where("step = 0").groupBy("sequence_label").count().collect()}
            n = min(n, 2 * min(sizes.get(0, 0), sizes.get(1, 0)))  # as many as the smaller class allows
        parts.append(part if n is None else sampling.balanced_sample(part, n, seed))
    return selection.prepared_contributions(parts[0].unionByName(parts[1]), length)


def select(spark: SparkSession, data: DataFrame, length: int, seed: int, population: int = 16, n_train: int | None = None,
           n_val: int | None = None, fitted: tuple[DataFrame, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """L2-L5 on the prepared table: (fitness, masks) of a random population of feature subsets.

    Subsets are fitted on the train sequences and scored on the val sequences (``contributions``, or what it gave before: ``fitted``).
    """
    seq, prior = fitted or contributions(data, length, seed, n_train, n_val)
    masks = selection.random_masks(spark, encode.Layout.of(data).names, population, seed)
    return selection.score_candidates(seq, selection.collect_masks(masks), prior), masks


def run_one(spark: SparkSession, dataset: str, data: DataFrame, pos_weight: float, model: str, length: int, seed: int,
            **sizes) -> DataFrame:
    """One row of results: the best subset of features, and the test metrics of the model trained on it."""
    fitness, masks = select(spark, data, length, seed, **sizes)
    best = selection.best_subset(fitness, masks).first()
    chosen = list(best["features"] or [])
    scored = selection.train_logistic(data, pos_weight, chosen, **MODELS[model])
    m = metrics.metrics_by(scored.where(F.col("split") == "test"), [], pos_weight=pos_weight)
    return m.select(
        F.lit(model).alias("model"), F.lit(dataset).alias("dataset"), F.lit(length).alias("sequence_length"),
        F.lit(seed).alias("random_state"), F.array(F.lit(float(best["f1"])), F.lit(float(best["n_features"]))).alias("best_fitness_gp"),
        F.lit(len(chosen)).alias("features_count_gp"), F.array(*[F.lit(x) for x in chosen]).cast("array<string>").alias("features_gp"),
        F.col("accuracy").alias("test_accuracy"), F.col("precision").alias("test_precision"), F.col("recall").alias("test_recall"),
        F.col("f1").alias("test_f1"), F.col("auroc").alias("test_auroc"), F.col("confusion").alias("test_confusion_matrix"))


def run_grid(spark: SparkSession, sources: Mapping[str, tuple[str, Callable[[SparkSession, str], DataFrame] | None]], data_dir: str,
             results: str, models: Sequence[str] = tuple(MODELS), length: int = 10, seed: int = 42, **sizes) -> DataFrame:
    """K7: every dataset with every model; the seed grows by one with every experiment.

    ``sources`` maps a dataset name to its source and loader (None: the
    preset's).  The datasets' split is drawn with the first seed, so all
    experiments of a dataset share its cached table, and the contributions of
    its sequences, which no seed enters unless ``sizes`` asks for samples.  Each
    row is written as it is done, keyed by experiment; experiments found in
    ``results`` are skipped, so a grid that was stopped goes on where it stopped.
    """
    done = {tuple(r) for r in files.read_results(spark, results).select(files.RESULTS_KEY).collect()}  # as many as experiments
    number = 0
    for dataset, (source, loader) in sources.items():
        loaded, shared = None, {}
        for model in models:
            number += 1
            if (dataset, model, length, seed + number) in done:
                continue
            loaded = loaded or load_data(spark, dataset, source, data_dir, length, seed=seed, loader=loader)
            if not shared and sizes.get("n_train") is None and sizes.get("n_val") is None:
                seq, prior = contributions(loaded[0], length, seed)
                shared = {"fitted": (materialize(seq, "contributions"), prior)}
            files.put_results(run_one(spark, dataset, *loaded, model, length, seed + number, **sizes, **shared), results)
    return files.read_results(spark, results)
