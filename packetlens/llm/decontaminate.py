"""Benchmark decontamination: a BM25 index of the test items, queried by every training passage.

The items are indexed once: a term's postings hold its BM25 impact on each
item, kept in blocks of items with the block's largest impact.  Every document
is cut into overlapping passages, long enough that an item copied into the text
lies whole in one of them.  A passage is scored as block-max WAND does, for a
batch of passages at once: the sum of its terms' largest impacts must reach the
lowest threshold, the sum of block maxima the block's lowest threshold, and
only then are the items of the block scored.  All items above their thresholds
are retrieved (there is no top-k), and for each the whole item, its question
and its answer are looked up in the passage: a part is held if enough of its
shingles are, or if one word edit turns it into a run of the passage (one edit
takes five shingles, too many of a short part).

An item's threshold is the least score of a passage that the test can accept:
the score of the whole item or of its question (with its answer, if the question
says too little alone) less the impacts of as many of the heaviest terms as a
held part can lack.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

WORD = re.compile(r"\w+")
LAST_SENTENCE = re.compile(r"[.!?]\s+(?=\S)|\n+(?=\S)")


@dataclass(frozen=True)
class LeakParams:
    """``shard_items`` bounds the items of one index; a larger benchmark is indexed and queried shard by shard.

    ``piece_chars`` bounds the texts whose words a task holds at once (one whole text at least).
    """
    shingle: int = 5           # words; shorter parts survive no edit, a shorter question is no leak without its answer
    overlap: float = 0.8
    k1: float = 1.2
    b: float = 0.75
    block: int = 8
    stretch: float = 1.25      # a passage holds a copy grown by this factor
    shard_items: int = 20_000
    piece_chars: int = 1_000_000


def terms(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item before its last sentence or line, and of that last one; an item of one sentence is both."""
    cuts = [m.end() for m in LAST_SENTENCE.finditer(text)]
    for cut in reversed(cuts):
        q, a = terms(text[:cut]), terms(text[cut:])
        if q and a:
            return q, a
    return terms(text), terms(text)


def grams(ws: list[str], n: int) -> list[tuple]:
    return [tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)] if len(ws) >= n else [tuple(ws)] if ws else []


def _runs_on(part: list[str], text: list[str], half: int) -> bool:
    """Whether ``text`` holds ``part`` with at most one word changed, dropped or put in after its first ``half`` words."""
    n, at = len(part), -1
    for _ in range(text.count(part[0])):
        at = text.index(part[0], at + 1)
        if text[at:at + half] != part[:half]:
            continue
        i = half
        while i < n and at + i < len(text) and text[at + i] == part[i]:
            i += 1
        rest, end = part[i + 1:], at + i
        if i == n or text[end + 1:end + n - i] == rest or text[end:end + n - i - 1] == rest or text[end + 1:end + 1 + n - i] == part[i:]:
            return True
    return False


def within_one_edit(part: list[str], text: list[str]) -> bool:
    """Whether a run of ``text`` is ``part`` with at most one word changed, dropped or put in: one half of it is untouched."""
    half = len(part) // 2
    return _runs_on(part, text, half) or _runs_on(part[::-1], text[::-1], len(part) - half)


@dataclass
class Part:
    """An item, its question or its answer: words, distinct words, shingles, and how many distinct words a held copy can lack."""
    words: list[str]
    vocab: set[str]
    shingles: set[tuple]
    lacking: int

    @staticmethod
    def of(ws: list[str], p: LeakParams) -> "Part":
        shingles = set(grams(ws, p.shingle))
        # a missing word takes at least one shingle with it
        return Part(ws, set(ws), shingles, max(int((1 - p.overlap) * len(shingles) + 1e-9), int(len(ws) >= p.shingle)))

    def overlap(self, have: set[tuple]) -> float:
        return len(self.shingles & have) / len(self.shingles)


class ItemIndex:
    """Inverted index of the items of one shard, as flat numpy postings."""

    def __init__(self, items: list[tuple[int, str]], p: LeakParams):
        items = [(i, t) for i, t in items if terms(t)]
        self.p, self.ids = p, np.array([i for i, _ in items], dtype=np.int64)
        docs = [terms(t) for _, t in items]
        parts = [question_answer(t) for _, t in items]
        self.parts = [[Part.of(x, p) for x in (ws, q, a)] for ws, (q, a) in zip(docs, parts)]
        self.longest = max((len(d) for d in docs), default=1)
        self.vocab: dict[str, int] = {}
        tf = [Counter(self.vocab.setdefault(w, len(self.vocab)) for w in d) for d in docs]
        n, mean = len(docs), np.mean([len(d) for d in docs]) if docs else 1.0
        df = np.zeros(len(self.vocab))
        for c in tf:
            df[list(c)] += 1
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        post, lowest = [], np.zeros(n)
        for i, (c, d) in enumerate(zip(tf, docs)):
            weight = {t: idf[t] * f * (p.k1 + 1) / (f + p.k1 * (1 - p.b + p.b * len(d) / mean)) for t, f in c.items()}
            post += [(t, i, w) for t, w in weight.items()]
            whole, question, answer = self.parts[i]
            alone = len(question.words) >= p.shingle
            ways = [(whole.vocab, whole.lacking),
                    (question.vocab, question.lacking) if alone else (whole.vocab, question.lacking + answer.lacking)]
            lowest[i] = min(sum(sorted(weight[self.vocab[w]] for w in ws)[:max(len(ws) - lacking, 1)]) for ws, lacking in ways) * (1 - 1e-6)
        order = np.argsort(lowest, kind="stable")  # blocks of items with near thresholds
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        self.order, self.lowest = order, lowest[order]
        self.n_blocks = -(-n // p.block) if n else 0
        self.block_lowest = np.array([self.lowest[k * p.block:(k + 1) * p.block].min() for k in range(self.n_blocks)])
        post.sort()
        t = np.array([x[0] for x in post], dtype=np.int64)
        self.post_item = rank[np.array([x[1] for x in post], dtype=np.int64)] if post else np.empty(0, dtype=np.int64)
        self.post_impact = np.array([x[2] for x in post])
        self.post_start = np.searchsorted(t, np.arange(len(self.vocab) + 1))
        self.term_max = np.array([self.post_impact[a:b].max() for a, b in zip(self.post_start[:-1], self.post_start[1:])])
        best: dict[tuple[int, int], float] = {}
        for tt, it, w in zip(t.tolist(), self.post_item.tolist(), self.post_impact.tolist()):
            key = (tt, it // p.block)
            best[key] = max(best.get(key, 0.0), w)
        keys = sorted(best)
        self.block_no = np.array([k[1] for k in keys], dtype=np.int64)
        self.block_max = np.array([best[k] for k in keys])
        self.block_start = np.searchsorted(np.array([k[0] for k in keys], dtype=np.int64), np.arange(len(self.vocab) + 1))

    @staticmethod
    def _spread(start: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry of ``term`` all its postings: (entry, posting) index pairs."""
        count = start[term + 1] - start[term]
        entry = np.repeat(np.arange(len(term)), count)
        first = np.cumsum(count) - count
        return entry, np.arange(len(entry)) - first[entry] + start[term][entry]

    def search(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item rank, score) of all items above threshold, for distinct (passage, term) pairs of n passages."""
        if not len(term) or not len(self.lowest):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        bound = np.bincount(passage, weights=self.term_max[term], minlength=n)
        live = bound[passage] >= self.lowest[0]
        passage, term = passage[live], term[live]
        if not len(term):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        names, passage = np.unique(passage, return_inverse=True)
        hits = []
        # passages at a time (they come in order): their postings and block sums stay bounded
        load = np.bincount(passage, weights=self.post_start[term + 1] - self.post_start[term]) + self.n_blocks
        cuts = np.flatnonzero(np.diff(np.cumsum(load) // 2_000_000)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
            first, end = np.searchsorted(passage, (lo, hi))
            pa, te = passage[first:end] - lo, term[first:end]
            rows = hi - lo
            e, k = self._spread(self.block_start, te)
            sums = np.bincount(pa[e] * self.n_blocks + self.block_no[k], weights=self.block_max[k], minlength=rows * self.n_blocks)
            opened = sums.reshape(rows, self.n_blocks) >= self.block_lowest
            some = opened.any(1)[pa]
            pa, te = pa[some], te[some]
            e, k = self._spread(self.post_start, te)
            item = self.post_item[k]
            inside = opened[pa[e], item // self.p.block]
            key = pa[e][inside] * len(self.lowest) + item[inside]
            found, at = np.unique(key, return_inverse=True)
            score = np.bincount(at, weights=self.post_impact[k][inside], minlength=len(found)) if len(found) else np.empty(0)
            pas, it = found // len(self.lowest), found % len(self.lowest)
            good = score >= self.lowest[it]
            hits.append((names[pas[good] + lo], it[good], score[good]))
        return tuple(np.concatenate(x) for x in zip(*hits))

    def verify(self, parts: list[Part], passage: list[str], held: set[str], have: dict[int, set]) -> tuple[float, ...] | None:
        """Overlaps of item, question and answer if the passage holds the item (see ``leaks``); ``have`` caches its shingles."""
        whole, question, answer = parts
        if len(question.vocab - held) > question.lacking and len(whole.vocab - held) > whole.lacking:
            return None

        def overlap(x: Part) -> float:
            size = min(self.p.shingle, len(x.words))
            if size not in have:
                have[size] = set(grams(passage, size)) if len(passage) >= size else set()
            return x.overlap(have[size])

        def edited(x: Part) -> bool:
            return len(x.words) >= self.p.shingle and len(x.vocab - held) <= 1 and within_one_edit(x.words, passage)

        out = tuple(overlap(x) for x in parts)
        need, size = self.p.overlap, self.p.shingle
        if out[0] >= need and out[1] > 0 or edited(whole):
            return out
        if out[1] >= need and len(question.words) >= size:
            return out
        if out[1] >= need or edited(question):
            if len(question.words) >= 2 * size or out[2] >= need or edited(answer):
                return out
        return None

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """Verified items of each text, best passage of each."""
        out: list[list[dict]] = [[] for _ in texts]
        if not len(self.lowest):
            return out
        step = max(int(self.longest * self.p.stretch) + 1, self.p.shingle)
        words, of, pas, ter, at = [], [], [], [], []
        vocab = self.vocab
        n = 0
        for d, text in enumerate(texts):
            ws = terms(text)
            if not ws:
                words.append(ws)
                continue
            words.append(ws)
            ids = np.fromiter((vocab.get(w, -1) for w in ws), dtype=np.int64, count=len(ws))
            pos = np.flatnonzero(ids >= 0)
            last = max(0, -(-len(ws) // step) - 2)  # passage k covers the steps k and k + 1
            k = pos // step
            for q in (np.minimum(k, last), np.maximum(k - 1, 0)):
                pas.append(q + n)
                ter.append(ids[pos])
            of.append(np.full(last + 1, d))
            at.append(np.arange(last + 1) * step)
            n += last + 1
        if not n:
            return out
        of, at = np.concatenate(of), np.concatenate(at)
        key = np.unique(np.concatenate(pas) * len(vocab) + np.concatenate(ter))
        seen = -1
        for q, it, score in zip(*self.search(key // len(vocab), key % len(vocab), n)):
            d, start = int(of[q]), int(at[q])
            if q != seen:
                seen, passage, have = q, words[d][start:start + 2 * step], {}
                held = set(passage)
            overlap = self.verify(self.parts[self.order[it]], passage, held, have)
            if overlap:
                out[d].append({"item_id": int(self.ids[self.order[it]]), "start_word": start, "score": float(score),
                               "overlap": overlap[0], "question_overlap": overlap[1], "answer_overlap": overlap[2]})
        return [list({x["item_id"]: x for x in sorted(hits, key=lambda x: (x["overlap"], x["score"], -x["start_word"]))}.values())
                for hits in out]


def list_ahead(rows: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Each row, and whether another one follows."""
    held = next(rows, None)
    while held is not None:
        following = next(rows, None)
        yield held, following is not None
        held = following


HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start_word", T.LongType()),
                    T.StructField("score", T.DoubleType()), T.StructField("overlap", T.DoubleType()),
                    T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())])


def _indexes(benchmark: DataFrame, p: LeakParams) -> Iterator[bytes]:
    """The pickled index of each shard of the benchmark (shards by item hash), built in one task a shard; one at a time comes to the driver."""
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct()
    shards = max(1, -(-items.count() // p.shard_items))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item_id", "text"])
        index = ItemIndex(list(zip(rows["item_id"].tolist(), rows["text"].tolist())), p)
        return pd.DataFrame({"index": [cloudpickle.dumps(index)]})

    scratch = Scratch(benchmark.sparkSession, "benchmark")
    built = scratch.keep(items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards))).groupBy("shard")
                         .applyInPandas(build, "index binary"), "indexes")
    for row in built.toLocalIterator():
        yield bytes(row["index"])


def _found(text: Column, shared, p: LeakParams) -> Column:
    """Column of the verified leaks (array of ``HIT``) of a text among the items of one broadcast index."""
    @F.pandas_udf(T.ArrayType(HIT))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        idx = cloudpickle.loads(shared.value)
        for texts in batches:
            out, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t) if t else 0
                if size >= p.piece_chars:
                    out += idx.leaks(part)
                    part, size = [], 0
            out += idx.leaks(part)
            yield pd.Series(out)

    return find(text)


def leaks(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams(), text: str = "text") -> DataFrame:
    """doc_id with each benchmark item its text holds: best passage, BM25 score and overlaps.

    A part is held if ``overlap`` of its five-word shingles (a part of fewer
    words is one shingle) lie in one passage, or all of its five or more words
    but for one edit.  An item counts as held if question and answer together
    are (by shingles: the question among them), if question and answer are each,
    or if the question is alone: by its shingles from five words on, by one edit
    from ten on (one word makes a short question another).  Case and punctuation don't matter.  Null
    and empty texts hold nothing, items without words are held by nothing, a
    repeated row is reported as often as it stands in ``docs``.
    """
    spark, scratch, found = docs.sparkSession, Scratch(docs.sparkSession, "leaks"), []
    indexes = list_ahead(_indexes(benchmark, p))
    for index, more in indexes:
        shared = spark.sparkContext.broadcast(index)
        hits = docs.select("doc_id", F.explode(_found(F.col(f"`{text}`"), shared, p)).alias("hit")).select("doc_id", "hit.*")
        if not found and not more:
            return hits
        found.append(scratch.keep(hits, f"hits{len(found)}"))  # a large benchmark: one index at a time is held anywhere
        shared.unpersist()
    return reduce(DataFrame.unionByName, found) if found else docs.select("doc_id", F.lit(None).cast(HIT).alias("hit")).where("false").select("doc_id", "hit.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns; further indexes see what the earlier ones left."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "clean")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    for k, (index, more) in enumerate(list_ahead(_indexes(benchmark, p))):
        shared = spark.sparkContext.broadcast(index)
        docs = docs.select(row.alias("row"), _found(F.col(f"`{text}`"), shared, p).alias("hits")).where(F.size("hits") == 0).select("row.*")
        if k or more:
            docs = scratch.keep(docs, f"clean{k}")
            shared.unpersist()
    return docs
