"""Source divergence audit: exact distances between the word distributions of sources, by products of one-hot levels.

Per language, a source's count of a term is its level there.  Every block of
terms has one indicator column for each (source, level) that occurs in it; the
columns multiplied by their transpose count, for every two sources and every two
levels, the terms that have them: all joint tables of the block at once.  A
distance that depends on a term by its two levels only is then priced once per
cell of the joint tables and added up over blocks.

Blocks hold ``block_terms`` terms by ``block_groups`` sources on either side.
Terms that neither side of a block has are not sent: they all have the joint
level (0, 0) and are counted by subtraction.  All numbers are integers, or
floats that hold integers below 2 ** 53.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_bitmaps
from .spelling import lower_ascii

#: A term: ASCII letters and all characters beyond ASCII.
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class AuditParams:
    min_docs: int = 10
    scale: int = 1_000_000_000
    top_terms: int = 10
    block_terms: int = 2048
    block_groups: int = 32
    columns: int = 1024      # indicator columns of one product
    flush: int = 600_000     # counts a task holds before it hands them on


PARTS = "lang string, term string, df long, total long, sources array<string>, ns array<long>"


def _part(lang: str, counts: dict[str, Counter], dfs: dict[str, Counter]) -> pa.RecordBatch:
    """A language's counts in one task: a row per term with the sources that have it, and one of term '' with all sources."""
    sources = list(counts)
    terms = pa.array([t for s in sources for t in counts[s]], pa.string()).dictionary_encode()
    code = terms.indices.to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(sources)), [len(counts[s]) for s in sources])
    n = np.array([x for s in sources for x in counts[s].values()], dtype=np.int64)
    df = np.array([dfs[s][t] for s in sources for t in counts[s]], dtype=np.int64)
    order = np.argsort(code, kind="stable")
    size = np.bincount(code, minlength=len(terms.dictionary))
    first = np.cumsum(size) - size                                                      # a term's first entry
    starts = np.concatenate([[0], len(sources) + np.append(first, len(code))]).astype(np.int32)  # term '' comes before all
    total = lambda x: np.add.reduceat(x[order], first) if len(x) else x
    names = pa.array(sources, pa.string()).take(pa.array(np.concatenate([np.arange(len(sources)), of[order]])))
    numbers = pa.array(np.concatenate([np.zeros(len(sources), dtype=np.int64), n[order]]))
    rows = len(starts) - 1
    return pa.RecordBatch.from_arrays([
        pa.repeat(pa.scalar(lang, pa.string()), rows), pa.concat_arrays([pa.array([""], pa.string()), terms.dictionary]),
        pa.array(np.append(0, total(df)), pa.int64()), pa.array(np.append(0, total(n)), pa.int64()),
        pa.ListArray.from_arrays(pa.array(starts), names), pa.ListArray.from_arrays(pa.array(starts), numbers)],
        ["lang", "term", "df", "total", "sources", "ns"])


def term_parts(docs: DataFrame, p: AuditParams = AuditParams(), text: str = "text") -> DataFrame:
    """Counts as they leave the tasks: per language and term the rows with it (df), its occurrences (total) and those in each source.

    Term '' lists the sources that occur.  A term may have several rows.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        df: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        for batch in batches:
            for lang, source, t in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                found = TERM.findall(lower_ascii(t))
                n[lang][source].update(found)
                df[lang][source].update(set(found))
            if sum(len(x) for held in n.values() for x in held.values()) >= p.flush:
                yield from (_part(lang, held, df[lang]) for lang, held in n.items())
                n.clear()
                df.clear()
        yield from (_part(lang, held, df[lang]) for lang, held in n.items())

    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`"), empty).alias(name) for c, name in (("lang", "lang"), ("source", "source"), (text, "text"))])
    return rows.mapInArrow(count, PARTS)


def _price(n: Column, total: Column, v: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 2) / (total + 2 v)), exact at any size (decimal numbers)."""
    wide = (n + 2).cast("decimal(20,0)") * F.lit(scale).cast("decimal(12,0)")
    return F.call_function("div", wide, (total + 2 * v).cast("decimal(20,0)")) + 1


def _distance(a: Column, b: Column) -> Column:
    """floor((a - b) ** 2 / (a + b)) of prices (up to 1,000,000,001 each, so the square is a long)."""
    return F.call_function("div", (a - b) * (a - b), a + b)


def one_hot(level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicator columns of a (term, group) table of levels: the 0/1 matrix, and group and level of each column."""
    width = int(level.max()) + 1
    code = level + np.arange(level.shape[1]) * width
    names, at = np.unique(code, return_inverse=True)
    hot = np.zeros((level.shape[0], len(names)), dtype=np.float32)
    hot[np.repeat(np.arange(level.shape[0]), level.shape[1]), at.reshape(-1)] = 1
    return hot, names // width, names % width


def _n_columns(level: np.ndarray) -> int:
    return sum(len(np.unique(c)) for c in level.T)


def _cuts(a: np.ndarray, b: np.ndarray, columns: int) -> Iterator[slice]:
    """The terms of a block (by falling count) in runs whose levels need few columns on either side."""
    todo = [(0, len(a))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 1 and max(_n_columns(a[lo:hi]), _n_columns(b[lo:hi])) > columns:
            mid = (lo + hi) // 2
            todo += [(mid, hi), (lo, mid)]
        elif hi > lo:
            yield slice(lo, hi)


def joint_distance(level_a: np.ndarray, price_a: list[np.ndarray], level_b: np.ndarray, price_b: list[np.ndarray], columns: int) -> np.ndarray:
    """Summed distance of every group of a to every group of b over the terms of a block.

    ``level_x`` is (term, group), ``price_x[g]`` the price of each level of group g.
    """
    total = np.zeros((level_a.shape[1], level_b.shape[1]))
    for part in _cuts(level_a, level_b, columns):
        hot_a, group_a, own_a = one_hot(level_a[part])
        hot_b, group_b, own_b = one_hot(level_b[part])
        terms = hot_a.T @ hot_b                      # joint tables of all groups: terms by (level here, level there)
        i, j = np.nonzero(terms)
        x = np.array([price_a[g][k] for g, k in zip(group_a, own_a)], dtype=np.int64)[i]
        y = np.array([price_b[g][k] for g, k in zip(group_b, own_b)], dtype=np.int64)[j]
        cost = (x - y) ** 2 // (x + y) * terms[i, j].astype(np.int64)
        cell = group_a[i] * total.shape[1] + group_b[j]
        total += np.bincount(cell, weights=cost, minlength=total.size).reshape(total.shape)
    return total.astype(np.int64)


def _levels(rows: pd.DataFrame, terms: np.ndarray, groups: np.ndarray, empty: dict[int, int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(term, group) table of level numbers, and the price of each level (level 0 is the count 0)."""
    level = np.zeros((len(terms), len(groups)), dtype=np.int64)
    prices = [np.array([empty[g]], dtype=np.int64) for g in groups.tolist()]
    for g, part in rows.groupby("g"):
        k = int(np.searchsorted(groups, g))
        names, first, own = np.unique(part["n"].to_numpy(), return_index=True, return_inverse=True)
        level[part["t"].to_numpy(), k] = own + 1
        prices[k] = np.concatenate([prices[k], part["price"].to_numpy()[first]])
    return level, prices


def _block_distances(frame: pd.DataFrame, p: AuditParams) -> pd.DataFrame:
    """One block of terms for two blocks of groups: (lang, a, b, seen, value, rest) for all pairs of their groups."""
    i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    none = frame["term"] == ""
    empty = dict(zip(frame.loc[none, "g"].astype(int), frame.loc[none, "price"].astype(int)))
    rows = frame[~none]
    names, t = np.unique(rows["term"].to_numpy().astype(str), return_inverse=True)
    weight = np.bincount(t, weights=rows["n"].to_numpy(dtype=float), minlength=len(names))
    rank = np.empty(len(names), dtype=np.int64)
    rank[np.argsort(-weight, kind="stable")] = np.arange(len(names))
    rows = rows.assign(t=rank[t] if len(names) else t)
    groups = np.array(sorted(empty), dtype=np.int64)
    sides = [groups[groups // p.block_groups == k] for k in (i, j)]
    (la, pa), (lb, pb) = [_levels(rows[rows["g"].isin(set(s.tolist()))], names, s, empty) for s in sides]
    value = joint_distance(la, pa, lb, pb, p.columns) if len(names) else np.zeros((len(sides[0]), len(sides[1])), dtype=np.int64)
    za, zb = (np.array([empty[g] for g in s.tolist()], dtype=np.int64) for s in sides)
    rest = (za[:, None] - zb) ** 2 // (za[:, None] + zb)
    a, b = (x.reshape(-1) for x in np.meshgrid(sides[0], sides[1], indexing="ij"))
    out = pd.DataFrame({"lang": frame["lang"].iloc[0], "a": a, "b": b, "seen": len(names), "value": value.reshape(-1), "rest": rest.reshape(-1)})
    if i != j:
        out = pd.concat([out, out.rename(columns={"a": "b", "b": "a"})])
    return out[out["a"] != out["b"]]


def audit(docs: DataFrame, p: AuditParams = AuditParams(), text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of ``docs``.

    Part ``pair``: each other source of the language with the summed distance of
    the two word distributions over the language's kept terms (those in
    ``min_docs`` rows at least).  Part ``term``: the group's ``top_terms``
    kept terms that it has more of than its language, by their distance.  Ranks
    go by falling value, then item.  Null text, lang and source are empty
    strings; a group without terms has pairs; a language without kept terms has
    pairs of value 0; repeated rows are rows; an empty table gives an empty
    table; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    parts = scratch.keep(term_parts(docs, p, text), "parts")
    kept = scratch.keep(parts.where("term != ''").groupBy("lang", "term").agg(F.sum("total").alias("lang_n"), F.sum("df").alias("df"))
                        .where(F.col("df") >= p.min_docs).drop("df"), "kept")
    # sources of kept terms only: the many rare terms go before their counts are dealt out
    # (a filter of fixed size first: most rows hold a rare term)
    some = in_bitmaps(parts.withColumn("h", F.xxhash64("lang", "term")), "h", kept.select(F.xxhash64("lang", "term").alias("key"))).where("held")
    counts = (some.join(kept.select("lang", "term"), ["lang", "term"])
              .select("lang", "term", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("ns").alias("n"))))
              .groupBy("lang", "source", "term").agg(F.sum("n").alias("n")))
    cells = scratch.keep(counts.join(kept, ["lang", "term"]), "cells")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = F.lit(0).cast("long")
    groups = scratch.keep(
        parts.where("term = ''").select("lang", F.explode("sources").alias("source")).distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("lang_total", zero).alias("lang_total"),
                F.coalesce("total", zero).alias("total"), numbered.cast("long").alias("g"), F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("n_groups"))
        .withColumn("blocks", F.greatest(F.ceil(F.col("v") / p.block_terms), F.lit(1)))
        .withColumn("sides", F.ceil(F.col("n_groups") / p.block_groups)), "groups")
    priced = scratch.keep(cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "g", "sides", "term", "n", _price(F.col("n"), F.col("total"), F.col("v"), p.scale).alias("price"),
        _price(F.col("lang_n"), F.col("lang_total"), F.col("v"), p.scale).alias("lang_price"),
        F.pmod(F.xxhash64("term"), F.col("blocks")).alias("tb")), "priced")

    # pairs: the rows of a block of terms go to every pair of group blocks that their own block is in
    nothing = groups.select("lang", "g", "sides", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"),
                            F.when(F.col("v") > 0, _price(zero, F.col("total"), F.greatest("v", F.lit(1)), p.scale)).otherwise(F.lit(1)).alias("price"),
                            F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("tb"))
    side = F.floor(F.col("g") / p.block_groups)
    sent = (priced.select("lang", "g", "sides", "term", "n", "price", "tb").unionByName(nothing)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
            .select("lang", "tb", F.least(side, "other").alias("i"), F.greatest(side, "other").alias("j"), "g", "term", "n", "price"))
    blocks = sent.groupBy("lang", "tb", "i", "j").applyInPandas(
        lambda frame: _block_distances(frame, p), "lang string, a long, b long, seen long, value long, rest long")
    summed = blocks.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.first("rest").alias("rest"))
    name = groups.select("lang", "g", "source", "v")
    pairs = (summed.join(name.withColumnRenamed("g", "a"), ["lang", "a"])
             .join(name.select("lang", F.col("g").alias("b"), F.col("source").alias("item")), ["lang", "b"])
             .select("lang", "source", "item", (F.col("value") + (F.col("v") - F.col("seen")) * F.col("rest")).alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    # terms: ranks up to top_terms, cut in every task before the shuffle
    terms = (priced.where("price > lang_price")
             .select("lang", "source", F.col("term").alias("item"), _distance(F.col("price"), F.col("lang_price")).alias("value"))
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.top_terms))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))


SQL = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT lang, source, rid, unnest(ws) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
l AS (SELECT lang, count(*) AS v, sum(c) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.c FROM g JOIN k ON g.lang = k.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT m.lang, m.source, m.term, m.n,
        (1 + (1000000000::HUGEINT * (m.n + 2)) // (sum(m.n) OVER (PARTITION BY m.lang, m.source) + 2 * l.v))::BIGINT AS p,
        (1 + (1000000000::HUGEINT * (m.c + 2)) // (l.total + 2 * l.v))::BIGINT AS q
      FROM m JOIN l ON m.lang = l.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 10
"""
