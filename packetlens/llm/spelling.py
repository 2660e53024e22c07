"""Spelling variants: words one edit from a far more frequent word, by a bit-sliced position index.

The vocabulary is cut into blocks.  For each position and letter a block has a
bitset over its words, and all queries of the block walk their letters at once:
per query one bitset holds the words equal so far, one the words with one
replaced letter so far, one the words with one more letter so far.  A letter
moves each by one word-parallel step; the longer words read the slice of the
next position.  A missing letter is the same pair seen from the longer word.

One edit lies in the front or in the back half of a word and leaves the other
half as it is, so only words that share a half (with the half's place and the
shorter word's length) go into one block; no pair is lost.  A half that too
many words share is refined: the part that may hold the edit is halved again,
down to single letters, where the alphabet bounds the block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")


@dataclass(frozen=True)
class SpellingParams:
    """``drop_every``: a run whose hash this divides loses one letter (0: none does); it makes the rare spellings of the contract."""
    min_letters: int = 6
    min_count: int = 5
    ratio: int = 5
    drop_every: int = 199
    hot: int = 2048          # words of one shared half before it is refined
    block_words: int = 8192
    flush: int = 200_000     # distinct words a task holds before it hands their counts on


def lower_ascii(text: str) -> str:
    """Only A-Z lower-cased."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def text_words(doc_id: str, text: str | None, p: SpellingParams) -> Counter:
    """Words of a whole text (null: none) that have enough letters, with their counts."""
    out: Counter = Counter()
    if not text:
        return out
    seed = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(r for r in RUN.findall(lower_ascii(text)) if len(r) >= p.min_letters).items():
        if p.drop_every:
            h = zlib.crc32(run.encode(), seed)
            if h % p.drop_every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
        if len(run) >= p.min_letters:
            out[run] += n
    return out


def word_counts(docs: DataFrame, p: SpellingParams = SpellingParams(), text: str = "text") -> DataFrame:
    """(word, n) of all words of all texts; counted in the tasks first.  A null doc_id counts as the empty string."""
    def batch(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for rows in batches:
            for doc_id, t in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                for word, n in text_words(doc_id, t, p).items():
                    held[word] += n
                if len(held) >= p.flush:
                    yield batch(held)
                    held.clear()
        yield batch(held)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _entry(m: Column, lo: Column, hi: Column) -> Column:
    """A window of class m (pairs of m letters, or of m and m + 1) that may hold the edit, and the hash of all around it."""
    longer = F.length("word") - m
    key = F.xxhash64(m, lo, hi, F.expr("'|'"), F.substring("word", F.lit(1), lo), F.lit("|"), F.substring("word", hi + longer + 1, F.length("word")))
    return F.struct(m.cast("int").alias("m"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), key.alias("key"))


def _halves(words: DataFrame, least: int) -> DataFrame:
    """Four entries a word: front and back half, as the shorter and as the longer word of a pair."""
    n = F.length("word")
    entries = []
    for m in (n, n - 1):
        h = F.floor(m / 2).cast("int")
        entries += [_entry(m, F.lit(0), h), _entry(m, h, m)]
    return words.select("word", "n", F.explode(F.array(*entries)).alias("e")).select("word", "n", "e.*").where(F.col("m") >= least)


def _refined(entries: DataFrame) -> DataFrame:
    """Two entries for each: the edit in the front or in the back half of the window."""
    m, lo, hi = F.col("m"), F.col("lo"), F.col("hi")
    mid = F.floor((lo + hi) / 2).cast("int")
    return (entries.select("word", "n", F.explode(F.array(_entry(m, lo, mid), _entry(m, mid, hi))).alias("e"))
            .select("word", "n", "e.*"))


def _bits(rows: np.ndarray) -> np.ndarray:
    """Boolean rows over the words of a block as rows of 64-bit words."""
    pad = -rows.shape[1] % 64
    return np.packbits(np.pad(rows, ((0, 0), (0, pad))), axis=1, bitorder="little").view(np.uint64)


def _members(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of every set bit."""
    row, at = np.nonzero(bits)
    if not len(row):
        return row, at
    which, bit = np.nonzero(np.unpackbits(bits[row, at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return row[which], at[which] * 64 + bit


def near_pairs(words: list[str], m: int, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a, b) of the words with m letters, or with m and m + 1, that are exactly one edit apart.

    ``words`` are distinct and have m or m + 1 letters.  A pair of m letters comes both ways, one of m and m + 1 once.
    """
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")          # the queries (m letters) first
    n_short = int((size == m).sum())
    letters = np.full((len(words), m + 2), -1, dtype=np.int32)
    for row, k in enumerate(order.tolist()):
        letters[row, :size[k]] = np.frombuffer(words[k].encode("utf-32-le"), dtype=np.int32)
    short = np.zeros((1, len(words)), dtype=bool)
    short[0, :n_short] = True
    short, longer = _bits(short), _bits(~short)
    found = []
    for lo in range(0, n_short, chunk):
        q = letters[lo:min(lo + chunk, n_short)]
        same = np.broadcast_to(short | longer, (len(q), short.shape[1])).copy()
        swapped, added = np.zeros_like(same), np.zeros_like(same)
        for j in range(m):
            names, which = np.unique(q[:, j], return_inverse=True)
            here = _bits(letters[:, j] == names[:, None])[which]       # words with the query's letter at this position
            ahead = _bits(letters[:, j + 1] == names[:, None])[which]  # ... and one further on
            added = (added | same) & ahead
            swapped = (swapped & here) | (same & ~here)
            same &= here
        a, b = _members((swapped & short) | ((added | same) & longer))
        found.append((order[a + lo], order[b]))
    return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (np.empty(0, int), np.empty(0, int))


def _near_in_block(frame: pd.DataFrame) -> pd.DataFrame:
    out = []
    for m, part in frame.groupby("m"):
        part = part.drop_duplicates("word")
        words, n = part["word"].to_numpy(dtype=object), part["n"].to_numpy()
        a, b = near_pairs(words.tolist(), int(m))
        other = np.array([len(w) for w in words])[b] != m if len(b) else np.zeros(0, bool)
        for x, y in ((a, b), (b[other], a[other])):   # a longer word meets the shorter one, too
            out.append((words[x], words[y], n[y]))
    word, near, near_n = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"word": pd.Series(word, dtype=object), "near": pd.Series(near, dtype=object), "near_n": near_n})


def near_words(vocabulary: DataFrame, p: SpellingParams = SpellingParams(), scratch: Scratch | None = None) -> DataFrame:
    """(word, near, near_n): all pairs of words of ``vocabulary`` (word, n) that differ by one edit, both ways, each once."""
    scratch = scratch or Scratch(vocabulary.sparkSession, "spelling")
    ready, level, entries = [], 0, scratch.keep(_halves(vocabulary, p.min_letters), "entries0")
    while True:
        groups = entries.groupBy("key", "m", "lo", "hi").agg(
            F.count(F.lit(1)).alias("c"), F.sum((F.length("word") == F.col("m")).cast("long")).alias("c_m"))
        groups = groups.where("c > 1 AND c_m > 0").withColumn("hot", (F.col("c") > p.hot) & (F.col("hi") - F.col("lo") > 1))
        sorted_out = scratch.keep(entries.join(groups.select("key", "m", "lo", "hi", "hot"), ["key", "m", "lo", "hi"]), f"grouped{level}")
        ready.append(sorted_out.where("NOT hot").select("word", "n", "m", "key"))
        hot = sorted_out.where("hot")
        if hot.isEmpty():
            break
        level, entries = level + 1, scratch.keep(_refined(hot), f"entries{level + 1}")
    blocks = ready[0]
    for more in ready[1:]:
        blocks = blocks.unionByName(more)
    n_blocks = max(1, -(-blocks.count() // p.block_words))
    return (blocks.withColumn("block", F.pmod("key", F.lit(n_blocks))).groupBy("block")
            .applyInPandas(lambda frame: _near_in_block(frame), "word string, near string, near_n long").distinct())


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for every word that has a form: each round doubles the steps followed, so a few rounds do."""
    cur, i = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        ahead = cur.select(F.col("word").alias("root"), F.col("root").alias("further"))
        i += 1
        new = scratch.keep(cur.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                  F.col("further").isNotNull().alias("moved")), f"roots{i}")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        cur = new.select("word", "root")


def group_variants(docs: DataFrame, p: SpellingParams = SpellingParams(), text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word with enough letters and occurrences in the texts of ``docs``.

    Near: exactly one letter (code point) replaced, added or left out.  ``form``
    is the near word of largest n (ties: the smallest by code points) if that is
    at least ``ratio`` times the word's own n, else null; ``root`` is the last
    word reached by forms, the word itself without one.  Null and empty texts
    have no words, a null doc_id counts as the empty string in the hash, each
    repeated row counts, a run of any length is one word, an empty table gives
    an empty table, and other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    vocabulary = scratch.keep(word_counts(docs, p, text).where(F.col("n") >= p.min_count), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = near_words(vocabulary, p, scratch).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.minus") >= F.lit(p.ratio) * F.col("n")
    words = scratch.keep(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")), "words")
    roots = _roots(words.where("form IS NOT NULL"), scratch)
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB text of ``group_variants`` with the default parameters; the checksum is computed byte by byte over its table.
SQL = r"""
WITH RECURSIVE tbl AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (
  SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
           CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + (ord(c)::BIGINT >> 6), 128 + (ord(c)::BIGINT & 63)] END)) AS b FROM counted),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM bytes, tbl),
spelt AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, length(word) AS len, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM v, unnest(range(1, length(word) + 1)) AS p(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.x = b.x AND a.i = b.i AND a.len = b.len AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.x = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.x = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS top, max(n) AS top_n FROM near GROUP BY word),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * v.n THEN top END AS form, CASE WHEN top_n >= 5 * v.n THEN top_n END AS form_n
  FROM v LEFT JOIN best ON v.word = best.word),
reach AS (
  SELECT word, word AS here, 0 AS steps FROM formed
  UNION ALL SELECT r.word, f.form, steps + 1 FROM reach r JOIN formed f ON f.word = r.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(here, steps) AS root FROM reach GROUP BY word) r ON f.word = r.word
"""
