"""Secret scan: strict patterns, and random-looking strings by two character Markov models.

The strict patterns (assignments of a secret, access keys, hexadecimal runs)
always count.  Any other run of key characters is judged by how its characters
follow each other: one second-order model is trained on random strings, one on
ordinary identifiers, and the mean log-likelihood ratio over the run's
characters decides.

Labelled strings come from the whole corpus and from a seeded generator: the
values of strict spans, and drawn strings over the usual key alphabets, are
random; words, numbers and identifiers composed of neighbouring words are
ordinary.  Longer runs outside the strict spans carry no label and train
nothing.  Callers with labels of their own pass them instead.  The cut is the
one of best balanced accuracy on documents that trained neither model.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strict patterns and the least length of what must match (of the value, for an assignment); fixed by the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")   # 18 characters or more; a shorter run holds no longer one
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

#: What an assignment must hold in some case, for a quick look before the pattern.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Characters of the models; the last code stands for the start of a string.
CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
CODE = np.full(128, -1, dtype=np.int64)
CODE[[ord(c) for c in CHARS]] = np.arange(len(CHARS))
START = len(CHARS)
SIZE = START + 1

#: A maximal run of key characters (with base64 padding), and what counts as an ordinary piece of text.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
PIECE = re.compile(r"[A-Za-z0-9]+")

#: Alphabets of drawn random strings.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "abcdefghijklmnopqrstuvwxyz0123456789", CHARS[:62], CHARS[:64], CHARS[:62] + "_-")


@dataclass(frozen=True)
class SecretParams:
    """Every document trains or, a quarter of them by content hash, calibrates.

    Counts are added up in Spark and have at most ``SIZE`` cubed cells a model;
    the scores that set the cut come back as a histogram of ``bins`` bins.
    """
    drawn: int = 4000
    weight: float = 20.0     # of the shorter context when a context is rare
    bins: int = 400          # over mean log-likelihood ratios of -10 to 10
    prior: int = 50          # strings of either label assumed one off 0 on their side, so that a few odd ones don't set the cut
    seed: int = 11


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict spans, in order; code points, end exclusive.  An assignment's span is its whole match."""
    if not text:
        return []
    low = text.lower()
    out = []
    if any(w in low for w in WORDS):
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    for run in RUN.finditer(text):  # both kinds lie inside runs of key characters
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, run.start(), run.end())]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end())]
    return sorted(out)


def extra_runs(text: str | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters that no strict span covers."""
    if not text:
        return []
    return [r for r in (m.span() for m in RUN.finditer(text)) if not any(s <= r[0] and r[1] <= e for s, _, e in base)]


def transitions(strings: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """For all characters of the strings: (context and character as one number, index of the string)."""
    joined, sizes = [], []
    for s in strings:
        joined.append(s)
        sizes.append(len(s))
    size = np.array(sizes, dtype=np.int64)
    if not size.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = CODE[np.frombuffer("".join(joined).encode("ascii"), dtype=np.uint8)]
    of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    one = np.where(place >= 1, np.roll(code, 1), START)
    two = np.where(place >= 2, np.roll(code, 2), START)
    return (two * SIZE + one) * SIZE + code, of


class MarkovPair:
    """Log-likelihood ratios of random against ordinary, for every context of two characters and next character."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, weight: float):
        self.ratio = np.log(self._chances(random, weight)) - np.log(self._chances(ordinary, weight))

    @staticmethod
    def _chances(count: np.ndarray, weight: float) -> np.ndarray:
        """Second-order chances; a rare context leans on the first order, that one on the characters alone."""
        c3 = count.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + SIZE)
        p2 = (c2 + weight * p1) / (c2.sum(1, keepdims=True) + weight)
        return ((c3 + weight * p2) / (c3.sum(2, keepdims=True) + weight)).reshape(-1)

    def scores(self, strings: list[str]) -> np.ndarray:
        """Mean log-likelihood ratio of each (non-empty) string's characters."""
        at, of = transitions(strings)
        n = np.bincount(of, minlength=len(strings))
        return np.bincount(of, weights=self.ratio[at], minlength=len(strings)) / np.maximum(n, 1)


def drawn_strings(p: SecretParams, seed: int) -> list[str]:
    """Uniform strings of 16 to 64 characters over the key alphabets, the same for the same seed."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(p.drawn):
        letters = ALPHABETS[k % len(ALPHABETS)]
        out.append("".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(16, 65)))))
    return out


def labelled_strings(text: str | None) -> tuple[list[str], list[str]]:
    """(random, ordinary) strings of a text: values of strict spans, and words, numbers and identifiers made of neighbours.

    Pieces of 16 or more characters that hold a digit are left out: they have no label.
    """
    if not text:
        return [], []
    base = base_spans(text)
    random = []
    for start, kind, end in base:
        value = ASSIGN.match(text, start, end).group(2) if kind == 0 else text[start:end]
        value = "".join(c for c in value if c in CHARS)
        if not value.isdigit() and any(c.isdigit() for c in value):
            random.append(value)
    rest, at = [], 0
    for start, _, end in base:
        rest.append(text[at:start])
        at = max(at, end)
    rest.append(text[at:])
    pieces = [w for w in PIECE.findall(" ".join(rest)) if len(w) < 16 or w.isalpha()]
    ordinary = list(pieces)
    for k in range(0, len(pieces) - 2, 3):  # identifiers: three neighbours in one of the usual spellings
        a, b, c = pieces[k:k + 3]
        ordinary.append((f"{a}_{b}_{c}", f"{a}-{b}-{c}", f"{a}/{b}/{c}", a.lower() + b.capitalize() + c.capitalize())[k // 3 % 4])
    return random, ordinary


def _count(strings: Iterable[str]) -> np.ndarray:
    """How often each context and character occurs in the strings."""
    return np.bincount(transitions(strings)[0], minlength=SIZE ** 3)


def _cells(total: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """The counts above 0 of the random (first) and the ordinary strings."""
    for label, n in zip((1, 0), total):
        cell = np.flatnonzero(n)
        yield pd.DataFrame({"label": label, "cell": cell, "n": n[cell]})


#: Characters of texts whose labelled strings are counted in one go, a long text's alone.
PART_CHARS = 500_000


def _labelled_parts(texts: pd.Series) -> Iterator[tuple[list[str], list[str]]]:
    """(random, ordinary) strings of the texts, some texts at a time."""
    part, held = ([], []), 0
    for text in texts:
        for strings, more in zip(part, labelled_strings(text)):
            strings += more
        held += len(text or "")
        if held >= PART_CHARS:
            yield part
            part, held = ([], []), 0
    yield part


def _count_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = [np.zeros(SIZE ** 3, dtype=np.int64) for _ in range(2)]
    for frame in batches:
        for part in _labelled_parts(frame["text"]):
            for n, strings in zip(total, part):
                n += _count(strings)
    yield from _cells(total)


def _cut(histogram: pd.DataFrame, p: SecretParams) -> float:
    """The score of best balanced accuracy; the middle of the best ones where they tie."""
    n = np.zeros((2, p.bins))
    np.add.at(n, (histogram["label"].to_numpy(dtype=int), histogram["bin"].to_numpy(dtype=int)), histogram["n"].to_numpy(dtype=float))
    np.add.at(n, ([0, 1], _bins(np.array([-1.0, 1.0]), p)), p.prior)
    below = np.cumsum(n[0]) / n[0].sum()                # ordinary strings under the upper edge of each bin
    above = 1 - np.cumsum(n[1]) / n[1].sum()            # random strings over it
    best = np.flatnonzero(np.isclose(below + above, (below + above).max(), atol=1e-9))
    return float(((best[0] + best[-1]) / 2 + 1) * 20 / p.bins - 10)


def _bins(scores: np.ndarray, p: SecretParams) -> np.ndarray:
    return np.clip(((scores + 10) * p.bins / 20).astype(np.int64), 0, p.bins - 1)


def fit(docs: DataFrame, p: SecretParams = SecretParams(), text: str = "text", labelled: DataFrame | None = None) -> tuple[MarkovPair, float]:
    """The pair of models and the score from which a run counts as a secret.

    Trained on all documents, or on ``labelled`` (value string, random boolean)
    if that is given: a quarter of the rows, by hash, sets the cut and trains
    nothing.
    """
    derived = labelled is None
    if derived:
        t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        key = F.pmod(F.xxhash64(F.col("doc_id"), t), F.lit(1 << 40))
        rows = docs.select(t.alias("text"), (F.pmod(F.xxhash64(key), F.lit(4)) == 0).alias("held"))
        counts = rows.where("NOT held").select("text").mapInPandas(_count_cells, "label int, cell int, n long")
    else:
        chars = set(CHARS)

        def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                yield from _cells([_count(["".join(x for x in v if x in chars) for v in frame.loc[frame["random"] == label, "value"]])
                                   for label in (True, False)])

        rows = labelled.where("value IS NOT NULL AND random IS NOT NULL").select("value", "random").withColumn(
            "held", F.pmod(F.xxhash64("value"), F.lit(4)) == 0)
        counts = rows.where("NOT held").mapInPandas(own, "label int, cell int, n long")
    cells = counts.groupBy("label", "cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((2, SIZE ** 3))
    total[cells["label"].to_numpy(dtype=int), cells["cell"].to_numpy(dtype=int)] = cells["n"].to_numpy(dtype=float)
    if derived:
        total[1] += _count(drawn_strings(p, p.seed))
    models = MarkovPair(total[1], total[0], p.weight)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, p.bins), dtype=np.int64)
        for frame in batches:
            if derived:
                parts = ([[s for s in strings if len(s) >= 16] for strings in part] for part in _labelled_parts(frame["text"]))
            else:
                parts = [[["".join(x for x in v if x in CHARS) for v in frame.loc[frame["random"] == k, "value"]] for k in (True, False)]]
            for groups in parts:
                for label, strings in zip((1, 0), groups):
                    n[label] += np.bincount(_bins(models.scores(strings), p), minlength=p.bins)
        label, at = np.nonzero(n)
        yield pd.DataFrame({"label": label, "bin": at, "n": n[label, at]})

    histogram = rows.where("held").mapInPandas(score, "label int, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).toPandas()
    if derived:
        scores = _bins(models.scores(drawn_strings(p, p.seed + 1)), p)
        histogram = pd.concat([histogram, pd.DataFrame({"label": 1, "bin": scores, "n": 1})])
    return models, _cut(histogram, p)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                     T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())])


def secrets(texts: list[str | None], models: MarkovPair, cut: float) -> list[list[dict]]:
    """The spans of each text by start, then kind; strict ones have no score."""
    out, runs, places = [], [], []
    for k, text in enumerate(texts):
        base = base_spans(text)
        out.append([(s, kind, e, None) for s, kind, e in base])
        for s, e in extra_runs(text, base):
            runs.append(text[s:e])
            places.append((k, s, e))
    if runs:
        for (k, s, e), score in zip(places, models.scores(runs).tolist()):
            if score >= cut:
                out[k].append((s, 3, e, score))
    return [[{"kind": KINDS[kind], "start": s, "end": e, "base": score is None, "score": score} for s, kind, e, score in sorted(x, key=lambda y: y[:2])]
            for x in out]


def find(docs: DataFrame, p: SecretParams = SecretParams(), text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """doc_id and the secrets of each row of ``docs``: array of (kind, start, end, base, score).

    Strict spans (``base``) always stay; a run of 16 or more key characters that
    no strict span covers is added as ``random`` from the calibrated score on.
    Null and empty texts hold none; repeated rows are judged alike and each
    returned; an empty table gives an empty table; other columns are not read.
    """
    models, cut = fit(docs, p, text, labelled)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # SIZE cubed numbers at any input size

    @F.pandas_udf(T.ArrayType(SPAN))
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(secrets(texts.tolist(), shared.value, cut))

    return docs.select("doc_id", spans(F.col(f"`{text}`")).alias("spans"))


def redact(docs: DataFrame, p: SecretParams = SecretParams(), text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans become one mark, null stays null."""
    models, cut = fit(docs, p, text)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t, spans in zip(texts, secrets(texts.tolist(), shared.value, cut)):
                end, parts = 0, []
                for s in spans:
                    if s["start"] >= end:
                        parts += [t[end:s["start"]], mark]
                    end = max(end, s["end"])
                out.append("".join([*parts, t[end:]]) if t is not None else None)
            yield pd.Series(out)

    return docs.select(*[clean(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def span_text(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined; strict spans have their kind's order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
