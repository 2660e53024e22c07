"""Dataset dispatch with the two-level parquet cache (inventory A9, A3, E9)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encode, sampling
from ..sources.files import cached, fingerprint
from . import presets
from .prepare import prepare

LOADERS = {"mqttset": presets.load_mqtt, "iiotset": presets.load_edge, "x-iiotd": presets.load_flows}


def load_data(spark: SparkSession, dataset: str, source: str, data_dir: str, sequence_length: int = 10,
              ratios: Sequence[float] = sampling.DEFAULT_RATIOS, seed: int = 42,
              loader: Callable[[SparkSession, str], DataFrame] | None = None) -> tuple[DataFrame, float]:
    """Cleaned table cached as ``{dataset}.parquet``, prepared table cached as
    ``{dataset}_{L}.parquet`` (partitioned by split), plus the positive weight.

    Both are built anew if a source file or a parameter has changed.
    ``loader(spark, source)`` replaces the named preset's loader (e.g. to pass
    reader options); an unknown dataset name is an error.
    """
    if dataset not in LOADERS:
        raise ValueError(f"Unknown dataset: {dataset}")
    load = loader or LOADERS[dataset]
    base = data_dir.rstrip("/")
    cleaned = fingerprint(spark, source, dataset=dataset)
    processed = lambda: cached(spark, f"{base}/{dataset}.parquet",
                               lambda: load(spark, source), key=cleaned)
    key = fingerprint(spark, source, dataset=dataset, sequence_length=sequence_length, ratios=list(ratios), seed=seed)
    data = cached(spark, f"{base}/{dataset}_{sequence_length}.parquet",
                  lambda: prepare(processed(), sequence_length, ratios, seed), partition_by=["split"], key=key)
    pw = sampling.pos_weight(data).first()["pos_weight"]
    return data, pw


def dataset_factory(spark: SparkSession, dataset: str, source: str, data_dir: str, sequence_length: int = 10,
                    ratios: Sequence[float] = sampling.DEFAULT_RATIOS, seed: int = 42, features: Sequence[str] = (),
                    loader: Callable[[SparkSession, str], DataFrame] | None = None) -> tuple[dict[str, DataFrame], dict[str, float]]:
    """Per split the sequences of the named features (all, if none is named), one sparse vector each, and the positive weight.

    A split's frame reads that split's folder of the cached table only.
    """
    data, pw = load_data(spark, dataset, source, data_dir, sequence_length, ratios, seed, loader)
    chosen = encode.select_features(data, features) if features else data
    return {s: encode.sequence_vectors(chosen.where(F.col("split") == s)) for s in sampling.SPLITS}, {"pos_weight": pw}
