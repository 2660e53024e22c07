"""Quality rules: word, symbol and repetition statistics of a text, judged by an isolation forest.

Fixed rules reject a document outright.  The rest is judged by how fast random
splits of the rule statistics isolate it: a forest is grown on a bounded,
hash-chosen sample of labelled rows, every document gets the mean path length,
and the rejecting score is calibrated on all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "n_chars", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
MIN_WORDS = 10
MAX_REPEAT_PCT = 20


@dataclass(frozen=True)
class ForestParams:
    """``fit_rows`` bounds the labelled rows that come to the driver to grow the forest; nothing else is bounded.

    The cut is the one of best balanced accuracy over all labelled rows: each
    label's shares decide, so it converges as labels grow, and a few wrong
    labels hardly move it.
    ``min_auc``: a statistic whose ranking of bad above good rows of the sample is not surely better than this
    (by ``sure`` standard errors) stays out of the splits: among few bad rows, some of them mislabelled, chance
    lifts useless statistics.
    """
    fit_rows: int = 8192
    trees: int = 128
    rows_per_tree: int = 256
    depth: int = 10
    seed: int = 7
    score_bins: int = 4096
    min_auc: float = 0.55
    sure: float = 2.0


def repeat_words(ids: np.ndarray, width: int = 5) -> int:
    """Words that stand in some ``width``-word window found twice or more (first one included)."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    x = ids.astype(np.uint64)
    mix = np.zeros(n, dtype=np.uint64)
    for k in range(width):  # equal windows have equal mixes; the converse is checked below
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + (x[k:k + n] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mix ^= mix >> np.uint64(29)
    s = np.sort(mix)
    if not (s[1:] == s[:-1]).any():
        return 0
    code = ids.astype(np.int64)
    full = code
    for k in range(1, width):  # exact codes of ever longer windows
        _, code = np.unique(code[:len(code) - 1] * (int(full.max()) + 1) + full[k:], return_inverse=True)
    seen = np.bincount(code)[code] > 1
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.flatnonzero(seen)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_MARKS = b"!?;:=+~^_/\\@\"'`()[]{}"


def text_stats(text: str | None) -> tuple[int, ...]:
    """The ``STATS`` of one whole text (null: empty)."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    ws = raw.split()  # bytes split at exactly the ASCII white space
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in ws], dtype=np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(ws), len(text) - count(SPACES), count(SYMBOLS), len(lines) - len(set(lines)), repeat_words(ids),
            len(text), len(lines), len(seen), count(_UPPER), count(_DIGITS), count(_MARKS))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in STATS]))
def rule_stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_stats(t) for t in texts], columns=STATS, dtype=np.int64)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * MAX_REPEAT_PCT)


def features(s: pd.DataFrame) -> np.ndarray:
    """Rates a rule would test, free of the text's length."""
    w, c = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1)
    return np.column_stack([
        s["n_symbols"] / c, s["n_upper"] / c, s["n_digits"] / c, s["n_marks"] / c,
        np.minimum(s["word_chars"] / w, 40.0), s["n_repeat_words"] / w, s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
    ]).astype(np.float64)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows (what a leaf of n rows still hides)."""
    n = np.asarray(n, dtype=np.float64)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def telling(x: np.ndarray, good: np.ndarray, p: ForestParams) -> np.ndarray:
    """Which statistics surely rank rows labelled bad above good ones (area under the curve, ties by half).

    If none surely does, those that do in the sample; if none does, or a label is missing, all.
    """
    bad = ~good
    if not good.any() or not bad.any():
        return np.ones(x.shape[1], dtype=bool)
    rank = pd.DataFrame(x).rank().to_numpy()
    n_bad, n_good = int(bad.sum()), int(good.sum())
    auc = (rank[bad].sum(0) - n_bad * (n_bad + 1) / 2) / (n_bad * n_good)
    above, twice = auc / (2 - auc), 2 * auc ** 2 / (1 + auc)  # one bad row over two good ones, two over one
    error = np.sqrt((auc * (1 - auc) + (n_bad - 1) * (above - auc ** 2) + (n_good - 1) * (twice - auc ** 2)) / (n_bad * n_good))
    for found in (auc - p.sure * error >= p.min_auc, auc >= p.min_auc):
        if found.any():
            return found
    return np.ones(x.shape[1], dtype=bool)


class IsolationForest:
    """Random splits as flat arrays: node i has children 2i + 1 and 2i + 2; a leaf has feature -1 and its path length."""

    def __init__(self, x: np.ndarray, p: ForestParams, telling: np.ndarray):
        rng = np.random.default_rng(p.seed)
        size = 2 ** (p.depth + 1) - 1
        self.depth = p.depth
        self.feature = np.full((p.trees, size), -1, dtype=np.int32)
        self.cut = np.zeros((p.trees, size))
        self.path = np.zeros((p.trees, size))
        rows = min(p.rows_per_tree, len(x))
        self.unit = float(_mean_path(np.array([max(rows, 2)]))[0])
        for t in range(p.trees):
            todo = [(0, 0, x[rng.choice(len(x), rows, replace=False)])]
            while todo:
                node, depth, part = todo.pop()
                spread = np.flatnonzero(telling & (part.max(0) > part.min(0))) if len(part) > 1 else ()
                if depth == p.depth or not len(spread):
                    self.path[t, node] = depth + _mean_path(np.array([len(part)]))[0]
                    continue
                f = int(rng.choice(spread))
                cut = rng.uniform(part[:, f].min(), part[:, f].max())
                self.feature[t, node], self.cut[t, node] = f, cut
                left = part[:, f] <= cut
                todo += [(2 * node + 1, depth + 1, part[left]), (2 * node + 2, depth + 1, part[~left])]

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): near 1 is anomalous, below 0.5 is ordinary."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, cut, path in zip(self.feature, self.cut, self.path):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                g = f[node]
                inner = g >= 0
                down = 2 * node + 1 + (x[rows, np.maximum(g, 0)] > cut[node])
                node = np.where(inner, down, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.unit)


@dataclass
class QualityModel:
    forest: IsolationForest | None
    threshold: float  # a score above it is rejected


def score_column(model: QualityModel, q: Column) -> Column:
    forest = model.forest
    if forest is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def score(s: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.score(features(s)))

    return score(q)


def fit(stats: DataFrame, labels: DataFrame, p: ForestParams = ForestParams()) -> QualityModel:
    """Grow the forest and calibrate its rejecting score.

    ``stats`` has doc_id and the struct ``q``; ``labels`` has doc_id and quality
    (1 good, 0 bad; null rows are left out; a document labelled both ways has
    both labels).  Over all labelled rows, counted in ``score_bins`` bins: the
    cut with the largest gap between the share of bad rows and the share of good
    rows that it rejects, in the middle of the cuts that do so equally well.
    Without labels, or with one label only, nothing is rejected beyond the fixed
    rules.
    """
    known = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
             .select("doc_id", "quality").distinct())
    rows = stats.select("doc_id", "q").join(known, "doc_id").where(~base_failed(F.col("q")))
    # the rows of the smallest hashes; a threshold from their number keeps all but a few more than these in the tasks
    key = F.xxhash64("doc_id", F.lit(p.seed))
    share = min(1.0, 1.5 * p.fit_rows / max(rows.count(), 1))
    few = rows.where(key <= F.lit(min(int(share * 2 ** 64), 2 ** 64 - 1) - 2 ** 63))
    sample = few.orderBy(key, "doc_id", "quality").limit(p.fit_rows).select("q.*", "quality").toPandas()
    if len(sample) < 2:
        return QualityModel(None, 1.0)
    x = features(sample)
    forest = IsolationForest(x, p, telling(x, sample["quality"].to_numpy() == 1, p))
    model = QualityModel(forest, 1.0)
    bins = (rows.select(F.floor(score_column(model, F.col("q")) * p.score_bins).cast("int").alias("b"), "quality")
            .groupBy("b").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                              F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad")).toPandas().sort_values("b"))
    good, bad = bins["good"].to_numpy(), bins["bad"].to_numpy()
    if good.sum() == 0 or bad.sum() == 0:
        return model
    above = (good.sum() - np.cumsum(good)) / good.sum()  # shares that a cut after this bin rejects
    caught = (bad.sum() - np.cumsum(bad)) / bad.sum()
    gap = caught - above
    first = int(np.argmax(gap))
    if gap[first] <= 0:
        return model
    # the rows of the next bin are the first rejected: the cut goes half way through the empty bins before it
    b = bins["b"].to_numpy()
    model.threshold = (int(b[first]) + 1 + int(b[first + 1])) / 2 / p.score_bins
    return model


def judge(docs: DataFrame, labels: DataFrame, p: ForestParams = ForestParams(), text: str = "text") -> DataFrame:
    """The struct columns ``row`` (a row of ``docs``) and ``quality_rules`` (statistics, base_failed, score, kept).

    Every row of ``docs`` is returned once, in any number of repeats; a null or
    empty text has no words, so it fails the fixed rules.  The statistics are
    computed for each whole text, first without the other columns to fit the
    forest, then in the pass that carries them.  An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(scratch.keep(docs.select("doc_id", rule_stats(F.col(f"`{text}`")).alias("q")), "stats"), labels, p)
    scratch.drop("stats")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scored = docs.select(row.alias("row"), _stats_and_score(model)(F.col(f"`{text}`")).alias("quality_rules"))
    return _with_verdict(scored, model)


def _stats_and_score(model: QualityModel):
    """Statistics and score of a text in one go, so that a task needs one Python worker."""
    forest = model.forest

    @F.pandas_udf(T.StructType([*[T.StructField(c, T.LongType()) for c in STATS], T.StructField("score", T.DoubleType())]))
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            s = pd.DataFrame([text_stats(t) for t in texts], columns=STATS, dtype=np.int64)
            yield s.assign(score=forest.score(features(s)) if forest is not None and len(s) else 0.0)

    return both


def _with_verdict(scored: DataFrame, model: QualityModel) -> DataFrame:
    q = F.col("quality_rules")
    scored = scored.withColumn("quality_rules", q.withField("base_failed", base_failed(q)))
    return scored.withColumn("quality_rules", q.withField(
        "kept", ~q["base_failed"] & (q["score"] <= F.lit(model.threshold))))


def judge_ids(docs: DataFrame, labels: DataFrame, p: ForestParams = ForestParams(), text: str = "text") -> DataFrame:
    """As ``judge`` for doc_id alone: one pass over the texts, the statistics table serves both fit and verdict."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.keep(docs.select("doc_id", rule_stats(F.col(f"`{text}`")).alias("quality_rules")), "stats")
    model, q = fit(stats.withColumnRenamed("quality_rules", "q"), labels, p), F.col("quality_rules")
    return _with_verdict(stats.withColumn("quality_rules", q.withField("score", score_column(model, q))), model)


def keep_good(docs: DataFrame, labels: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    return judge(docs, labels, p).where("quality_rules.kept").select("row.*")
