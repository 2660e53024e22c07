"""Sequence-level split and sampling (inventory I1-I4, E9, D3).

Every draw takes the sequences with the smallest ``md5(seed || '|' || id)``
of their label: the same seed gives the same draw on any cluster size.  No
sequence is ranked for it.  Histograms of hash prefixes per label tell the bin
in which the wanted rank falls; only that bin is looked at again, with a longer
prefix, until a prefix cuts exactly there.  A draw is then a filter on the
hash, without a window, a sort or a join of the rows by id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import c
from ..session import materialize

SPLITS = ("train", "val", "test")
DEFAULT_RATIOS = (0.7, 0.15, 0.15)
# Hex digits a histogram refines by, and how many hashes of open bins are fetched instead of refined again.
DIGITS = 3
FETCH = 10_000
# Labels whose cuts are put into the expression.
FEW_LABELS = 16


def rank_key(seed: int, id_col: str = "sequence_id") -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), c(id_col).cast("string")))


def sequence_table(rows: DataFrame, id_col: str = "sequence_id",
                   label_col: str = "sequence_label") -> DataFrame:
    """One row per sequence with its label (E6: the label is constant per sequence)."""
    return rows.groupBy(c(id_col)).agg(F.max(c(label_col)).alias(label_col))


def _hashes(rows: DataFrame, seed: int, id_col: str, label_col: str | None) -> DataFrame:
    """(lab, h) of every sequence, written once: histograms and refinements read it."""
    seqs = rows.select(c(id_col)).distinct().withColumn("__lab", F.lit(0)) if label_col is None else \
        sequence_table(rows, id_col, label_col).withColumnRenamed(label_col, "__lab")
    return materialize(seqs.select(F.col("__lab").alias("lab"), rank_key(seed, id_col).alias("h")), "sequence-hashes")


def _histogram(hashes: DataFrame, digits: int) -> dict:
    """label -> {prefix: number of hashes}; at most 16 ** digits rows for each label (or open bin) come to the driver."""
    out: dict = defaultdict(dict)
    for r in hashes.groupBy("lab", F.substring("h", 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["lab"]][r["p"]] = r["n"]
    return out


def _enter(bins: Mapping[str, int], rank: int) -> tuple[str, int, int]:
    """(prefix, rank inside it, its size) of the bin that holds ``rank`` (1-based)."""
    for prefix in sorted(bins):
        if rank <= bins[prefix]:
            return prefix, rank, bins[prefix]
        rank -= bins[prefix]
    raise ValueError("rank beyond the hashes")


def rank_cuts(hashes: DataFrame, first: Mapping, ranks: Mapping[object, Sequence[int]]) -> dict[object, list[str | None]]:
    """For every label and wanted rank n the hash prefix up to which it has n hashes exactly (None for n = 0).

    ``first`` is the histogram of the first digits.  A hash h is among the n
    smallest if its first characters, as many as the cut has, are <= the cut.
    """
    cuts = {lab: [None] * len(ns) for lab, ns in ranks.items()}
    todo = {(lab, i): _enter(first[lab], n) for lab, ns in ranks.items() for i, n in enumerate(ns) if n > 0}
    digits = DIGITS
    while True:
        for (lab, i), (prefix, rank, size) in list(todo.items()):
            if rank == size:
                cuts[lab][i] = prefix
                del todo[lab, i]
        if not todo:
            return cuts
        schema = "lab {}, p string".format(hashes.schema["lab"].dataType.simpleString())
        open_bins = hashes.sparkSession.createDataFrame(sorted({(lab, x[0]) for (lab, _), x in todo.items()}, key=repr), schema)
        there = F.broadcast(open_bins.withColumnRenamed("lab", "__l"))
        inside = hashes.join(there, F.col("lab").eqNullSafe(F.col("__l")) & (F.substring("h", 1, digits) == F.col("p"))).select("lab", "h")
        few = sum({(lab, x[0]): x[2] for (lab, _), x in todo.items()}.values()) <= FETCH
        digits = 32 if few else min(32, digits + DIGITS)
        finer = _histogram(inside, digits)
        todo = {(lab, i): _enter({p: n for p, n in finer[lab].items() if p.startswith(prefix)}, rank)
                for (lab, i), (prefix, rank, _) in todo.items()}


def _with_cuts(rows: DataFrame, cuts: Mapping[object, Sequence[str | None]], names: Sequence[str], seed: int,
               id_col: str, label_col: str | None) -> DataFrame:
    """Add a boolean column per name: is the row's sequence among the wanted smallest of its label?

    The cuts of a few labels are part of the expression, those of many a broadcast of one row per label.
    """
    h = rank_key(seed, id_col)
    below = lambda cut: F.coalesce(F.substring(h, F.lit(1), F.length(cut)) <= cut, F.lit(False))
    if label_col is None:
        return rows.select("*", *[below(F.lit(cut).cast("string")).alias(n) for n, cut in zip(names, cuts[0])])
    kind = rows.select(c(label_col)).schema[0].dataType.simpleString()
    if 0 < len(cuts) <= FEW_LABELS:
        known = reduce(or_, [c(label_col).eqNullSafe(F.lit(lab).cast(kind)) for lab in cuts])

        def cut_of(i: int) -> Column:
            out = F.lit(None).cast("string")
            for lab, cs in cuts.items():
                out = F.when(c(label_col).eqNullSafe(F.lit(lab).cast(kind)), F.lit(cs[i]).cast("string")).otherwise(out)
            return out
        return rows.where(known).select("*", *[below(cut_of(i)).alias(n) for i, n in enumerate(names)])
    table = rows.sparkSession.createDataFrame([(lab, *cs) for lab, cs in cuts.items()],
                                              ", ".join([f"__lab {kind}", *[f"__cut{i} string" for i in range(len(names))]]))
    joined = rows.join(F.broadcast(table), c(label_col).eqNullSafe(F.col("__lab")))
    return joined.select(*[c(x) for x in rows.columns], *[below(F.col(f"__cut{i}")).alias(n) for i, n in enumerate(names)])


def quotas(total: int, sizes: Mapping[object, int]) -> dict:
    """Largest-remainder shares of ``total``: floor(total * size / sum) per label, and one more for the largest
    remainders (ties to the smaller label, null first) until the total is met."""
    base = sum(sizes.values())
    floors = {lab: total * n // base for lab, n in sizes.items()} if base else dict.fromkeys(sizes, 0)
    order = sorted(sizes, key=lambda lab: (-(total * sizes[lab] % base if base else 0), lab is not None, lab if lab is not None else 0))
    for lab in order[:total - sum(floors.values())]:
        floors[lab] += 1
    return floors


def stratified_split(rows: DataFrame, ratios: Sequence[float] = DEFAULT_RATIOS, seed: int = 42,
                     id_col: str = "sequence_id", label_col: str = "sequence_label") -> DataFrame:
    """Add ``split`` (train/val/test) to every row, stratified by sequence label.

    Sizes follow ``train=int(.7n)``, ``val=int(.15n)``, test the rest; the test
    quota is shared among labels first, then train among what is left, by
    largest remainders.  A label's smallest hashes are test, the next ones
    train, the rest val.  Rows keep their order and partitions.
    """
    hashes = _hashes(rows, seed, id_col, label_col)
    first = _histogram(hashes, DIGITS)
    sizes = {lab: sum(bins.values()) for lab, bins in first.items()}
    n = sum(sizes.values())
    n_train, n_val = int(float(ratios[0]) * n), int(float(ratios[1]) * n)
    test = quotas(n - n_train - n_val, sizes)
    train = quotas(n_train, {lab: size - test[lab] for lab, size in sizes.items()})
    cuts = rank_cuts(hashes, first, {lab: (test[lab], test[lab] + train[lab]) for lab in sizes})
    marked = _with_cuts(rows, cuts, ("__test", "__seen"), seed, id_col, label_col)
    split = F.when(F.col("__test"), "test").when(F.col("__seen"), "train").otherwise("val")
    return marked.withColumn("split", split).drop("__test", "__seen")


def pos_weight(rows: DataFrame, splits: Sequence[str] = ("train", "val"),
               id_col: str = "sequence_id", label_col: str = "sequence_label") -> DataFrame:
    """Negatives / positives over the sequences of ``splits`` (inf with no positive)."""
    seqs = sequence_table(rows.filter(F.col("split").isin(list(splits))), id_col, label_col)
    agg = seqs.agg(F.count_if(c(label_col) == 0).alias("negatives"),
                   F.count_if(c(label_col) == 1).alias("positives"))
    return agg.withColumn("pos_weight", F.when(F.col("positives") == 0, F.lit(float("inf")))
                          .otherwise(F.col("negatives") / F.col("positives")))


def semi_filter(rows: DataFrame, ids: DataFrame, id_col: str = "sequence_id") -> DataFrame:
    """D3: rows whose id is in ``ids``; no hint, so ids are broadcast only under Spark's own size threshold."""
    return rows.join(ids.select(id_col), id_col, "left_semi")


def _drawn(rows: DataFrame, cuts: Mapping, seed: int, id_col: str, label_col: str | None) -> DataFrame:
    return _with_cuts(rows, cuts, ("__in",), seed, id_col, label_col).where("__in").drop("__in")


def balanced_sample(rows: DataFrame, n: int, seed: int = 42, id_col: str = "sequence_id",
                    label_col: str = "sequence_label") -> DataFrame:
    """``n // 2`` sequences of each label (binary labels 0/1); error if a class is short."""
    half = n // 2
    hashes = _hashes(rows.where(c(label_col).isin(0, 1)), seed, id_col, label_col)
    first = _histogram(hashes, DIGITS)
    if any(sum(first.get(lab, {}).values()) < half for lab in (0, 1)):
        raise ValueError("a class has fewer sequences than the balanced sample needs")
    return _drawn(rows, rank_cuts(hashes, first, {0: (half,), 1: (half,)}), seed, id_col, label_col)


def stratified_sample(rows: DataFrame, n: int, seed: int = 42, id_col: str = "sequence_id",
                      label_col: str = "sequence_label") -> DataFrame:
    """``n`` sequences with label shares kept (largest-remainder quotas); error if there are fewer."""
    hashes = _hashes(rows, seed, id_col, label_col)
    first = _histogram(hashes, DIGITS)
    sizes = {lab: sum(bins.values()) for lab, bins in first.items()}
    if sum(sizes.values()) < n:
        raise ValueError("sample larger than the population")
    return _drawn(rows, rank_cuts(hashes, first, {lab: (q,) for lab, q in quotas(n, sizes).items()}), seed, id_col, label_col)


def random_sample(rows: DataFrame, n: int, seed: int = 42, id_col: str = "sequence_id") -> DataFrame:
    """I4: the ``n`` sequences with the smallest hashes (all, if there are no more)."""
    hashes = _hashes(rows, seed, id_col, None)
    first = _histogram(hashes, DIGITS)
    size = sum(first.get(0, {}).values())
    return _drawn(rows, rank_cuts(hashes, first, {0: (min(n, size),)}) if size else {0: (None,)}, seed, id_col, None)
