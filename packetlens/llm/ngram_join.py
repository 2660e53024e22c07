"""Exact n-gram Jaccard join by a token-group matrix.

Documents are sets of word n-grams; two link when 100 * |A & B| >= percent *
|A | B|.  The result is one component per document, and every link between
different sets counts, however the candidates are found:

1. Equal sets collapse into one vertex.
2. A partner shares at least ``ceil(percent * n / 100)`` of a set's n tokens, so
   the first tokens of both in one global order must meet several times
   (``needed``).  Vertices whose first tokens are hardly found elsewhere have
   no partner and go.  The same is asked of whole sets, with exact counts.
3. What is left is partitioned into groups of similar vertices: a vertex joins
   the least mutated vertex of each of its min-hash buckets at half the
   similarity.  Leaders, and the least mutated vertex of the whole group, are
   compared exactly; these comparisons are linear in the documents however
   large a group of near copies is, and link most of it.  Members outside the
   group's largest component are queries on the group, block against block
   inside tasks; a block pair gives a spanning forest of its links.
4. The token-group matrix holds every group's token union.  A document with a
   rare first token in a foreign group is a query on that group; its overlap
   with the group's union bounds its overlap with any member, so only groups
   with at least the needed overlap are opened, and their members compared.

Tokens are 64-bit hashes of the n-gram (two different n-grams of the corpus
share one with a chance of 2 ** -64).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components, in_bitmaps, text_hash


@dataclass(frozen=True)
class JoinParams:
    n: int = 4
    percent: int = 85
    seeds: int = 8              # min-hash buckets in which a vertex looks for a leader
    group_percent: int = 50     # similarity to a leader at which a vertex joins its group
    block_tokens: int = 500_000  # bounds of a block of members that one task holds
    block_sets: int = 2_048
    small_group: int = 4        # groups up to this size are opened without the bound
    pairs_each: int = 8         # pairs a member that share a first token, up to which a group is compared by them


class _Hashes(dict):
    """Word to 64-bit hash, filled on demand and emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def tokens(text: str | None, n: int, hashes: dict) -> np.ndarray:
    """Distinct n-gram hashes of a whole text, ascending; A-Z count as a-z; a shorter text is one n-gram."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return np.empty(0, dtype=np.int64)
    w = np.array([hashes[x] for x in ws], dtype=np.uint64)
    if len(w) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=len(ws))], dtype=np.uint64).view(np.int64)
    m = len(w) - n + 1
    h = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(31))) * _MULT[k % 8] + w[k:k + m]
    h = (h ^ (h >> np.uint64(32))) * _MULT[7]
    return np.unique((h ^ (h >> np.uint64(29))).view(np.int64))


def shared_least(n, percent: int):
    """Tokens that a partner of a set of n shares with it at least."""
    return (n * percent + 99) // 100


def first_meets(n, percent: int):
    """How many of the common tokens come among the first ``first_length`` of the set."""
    return (n - shared_least(n, percent)) // 2 + 1


def first_length(n, percent: int):
    return n - shared_least(n, percent) + first_meets(n, percent)


def needed(n, percent: int):
    """First tokens of a set of n that at least one other set has among its own first ones, if it has a partner.

    The first m common tokens are among the first ``n - shared_least + m`` of
    both sets; m is the smaller set's, and a partner has ``percent`` % of n at least.
    """
    return first_meets(shared_least(n, percent), percent)


#: Documents of one output batch: a task holds the tokens of so many at a time.
PIECE = 256


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def _mapped(rows: DataFrame, columns: T.StructType, p: JoinParams, make) -> DataFrame:
    """``rows`` without ``text`` and with the columns that ``make`` gives for the token sets of a few texts at a time."""
    kept = [c for c in rows.columns if c != "text"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, PIECE):
                part = batch.slice(lo, PIECE)
                sets = [tokens(t, p.n, hashes) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *make(sets)], names=[*kept, *columns.names])

    schema = T.StructType([*[rows.schema[c] for c in kept], *columns.fields])
    return rows.mapInArrow(over, schema)


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())


def _signatures(rows: DataFrame, p: JoinParams) -> DataFrame:
    """n, sig and pre (the first tokens) of every row."""
    columns = T.StructType([T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("pre", T.ArrayType(T.LongType()))])
    return _mapped(rows, columns, p, lambda sets: [
        pa.array([len(x) for x in sets], pa.int64()), _digests(sets), _lists([x[:first_length(len(x), p.percent)] for x in sets])])


def _full_sets(rows: DataFrame, p: JoinParams) -> DataFrame:
    """sig and toks (all tokens) of every row."""
    columns = T.StructType([T.StructField("sig", T.BinaryType()), T.StructField("toks", T.ArrayType(T.LongType()))])
    return _mapped(rows, columns, p, lambda sets: [_digests(sets), _lists(sets)])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of vertices with their token counts (na, nb) and the exact overlap (both)."""
    left = sets.select(F.col("vid").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = sets.select(F.col("vid").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("both")))


def _similar(percent: int) -> Column:
    return F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent


def _blocks_linked(q: dict, m: dict, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of sets (flat numpy arrays), none inside a known component."""
    toks_q, toks_m = q["toks"], m["toks"]
    of_q, of_m = np.repeat(np.arange(len(q["n"])), q["len"]), np.repeat(np.arange(len(m["n"])), m["len"])
    shared = np.intersect1d(toks_q, toks_m)
    both = np.zeros((len(q["n"]), len(m["n"])), dtype=np.float32)
    for lo in range(0, len(shared), 4096):  # exact: counts stay below 2 ** 24
        part = shared[lo:lo + 4096]
        sides = []
        for toks, of, rows in ((toks_q, of_q, len(q["n"])), (toks_m, of_m, len(m["n"]))):
            at = np.searchsorted(part, toks)
            hit = part[np.minimum(at, len(part) - 1)] == toks
            side = np.zeros((rows, len(part)), dtype=np.float32)
            side[of[hit], at[hit]] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    total = q["n"][:, None] + m["n"][None, :]
    i, j = np.nonzero((both.astype(np.int64) * 100 >= (total - both.astype(np.int64)) * percent) & (q["comp"][:, None] != m["comp"][None, :]))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x
    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(int(q["comp"][a])), find(int(m["comp"][b]))
        if x != y:
            root[x] = y
            out.append((int(q["vid"][a]), int(m["vid"][b])))
    return out


def _inside_groups(grouped: DataFrame, comps: DataFrame, sets: DataFrame, scratch: Scratch, p: JoinParams) -> DataFrame:
    """Links (a, b) that join the components left in each group, asked by the members outside its largest component.

    Similar sets share a first token.  Where few members do (a family of one
    template with many fillings), those are compared pair by pair, a few a
    member at most; other groups are compared block against block.
    """
    placed = grouped.select("vid", "n", "grp").join(comps, "vid", "left").withColumn("comp", F.coalesce("comp", "vid"))
    sizes = placed.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    per = (sizes.groupBy("grp").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("c"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("comps"))
           .where("comps > 1")
           .select("grp", F.col("main.comp").alias("main"), "c",
                   F.greatest(F.ceil(F.col("t") / p.block_tokens), F.ceil(F.col("c") / p.block_sets)).cast("int").alias("blocks")))
    first = (grouped.select("vid", "n", "grp", F.explode("pre").alias("token")).join(per.select("grp", "main", "c"), "grp")
             .join(comps, "vid", "left").withColumn("comp", F.coalesce("comp", "vid")))
    first = scratch.keep(first, "first")  # dealt by group and token from here on, not by group alone
    meets = first.groupBy("grp", "token").agg(F.count_if(F.col("comp") != F.col("main")).alias("q"), F.count(F.lit(1)).alias("m"), F.first("c").alias("c"))
    few = (meets.groupBy("grp").agg(F.sum(F.col("q") * (F.col("m") - 1)).alias("pairs"), F.first("c").alias("c"))
           .where(F.col("pairs") <= p.pairs_each * F.col("c")).select("grp"))
    few = scratch.keep(few, "few")
    met = first.join(few, "grp", "left_semi")
    side = lambda s: met.select("grp", "token", F.col("vid").alias(s), F.col("comp").alias(f"c{s}"), F.col("n").alias(f"n{s}"), "main")
    pairs = (side("a").where("ca != main").drop("main").join(side("b").drop("main"), ["grp", "token"]).where("ca != cb")
             .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.percent).select("a", "b").distinct())
    sparse = _compared(pairs, sets).where(_similar(p.percent)).select("a", "b")
    open_ = (placed.join(per.drop("c"), "grp").join(few, "grp", "left_anti")
             .withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
             .join(sets.select("vid", "toks"), "vid"))
    one = F.struct("vid", "comp", "n", F.size("toks").cast("long").alias("len"), "toks")
    flat = lambda side: [F.col(f"x.{c}").alias(f"{side}_{c}") for c in ("vid", "comp", "n", "len")] + [
        F.flatten("x.toks").alias(f"{side}_toks")]
    blocks = open_.groupBy("grp", "block", "blocks").agg(F.collect_list(one).alias("x"))
    queries = open_.where("comp != main").groupBy("grp", "block", "blocks").agg(F.collect_list(one).alias("x"))
    asks = (queries.select("grp", "blocks", F.col("block").alias("qb"), *flat("q"))
            .withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    rows = asks.join(blocks.select("grp", F.col("block").alias("mb"), *flat("m")), ["grp", "mb"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                side = lambda s: {c: np.asarray(getattr(r, f"{s}_{c}"), dtype=np.int64) for c in ("vid", "comp", "n", "len", "toks")}
                out += _blocks_linked(side("q"), side("m"), p.percent)
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return rows.drop("grp", "mb", "qb", "blocks").mapInPandas(compare, "a long, b long").unionByName(sparse)


def components(docs: DataFrame, p: JoinParams = JoinParams(), text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, linked, component (vertex number), component_id.

    component_id is the smallest doc_id reachable by links, the row's own
    included; rows without words link with nothing, not even each other, and
    keep their own doc_id.  Null doc_ids are never the smallest; a component of
    null doc_ids only has a null component_id.  Repeated rows link like any
    other copies.  Columns of ``docs`` beyond doc_id and ``text`` are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    source = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    wide = scratch.keep(_signatures(source.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text"), p), "wide")
    firsts = scratch.keep(
        wide.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("pre").alias("pre"))
        .withColumn("vid", F.monotonically_increasing_id()), "firsts")
    rows, vertices = scratch.keep(wide.drop("pre"), "rows"), scratch.keep(firsts.drop("pre"), "vertices")
    scratch.drop("wide")
    members = rows.join(vertices.select("sig", "vid"), "sig", "left")

    # vertices whose first tokens meet often enough elsewhere (a vertex holds a token once)
    first = firsts.select("vid", F.explode("pre").alias("token"))
    common = first.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    alive = scratch.keep(
        first.join(common, "token", "left_semi").groupBy("vid").agg(F.count(F.lit(1)).alias("c"))
        .join(vertices, "vid").where(F.col("c") >= _sql(needed, F.col("n"), p.percent)).select("vid", "sig", "doc_id", "n"), "alive")
    scratch.drop("firsts")
    edges = _edges(source, alive, scratch, p)
    roots = connected_components(edges, scratch, "cc_all")
    grouped = members.join(roots.select(F.col("v").alias("vid"), F.col("root")), "vid", "left")
    grouped = scratch.keep(grouped.withColumn("component", F.coalesce("root", "vid")).drop("root"), "placed")
    # written, so that the join below has an exchange of its own and a component of many rows is split there
    least = grouped.where("component IS NOT NULL").groupBy("component").agg(
        F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    least = scratch.keep(least, "least")
    return grouped.join(least, "component", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce(F.col("members") > 1, F.lit(False)).alias("linked"),
        "component", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _sql(rule, n: Column, percent: int) -> Column:
    """``rule`` over a column: the same integer arithmetic, as a column of floored quotients."""
    class Whole:
        def __init__(self, c): self.c = c
        def __add__(self, o): return Whole(self.c + getattr(o, "c", o))
        def __sub__(self, o): return Whole(self.c - getattr(o, "c", o))
        def __mul__(self, o): return Whole(self.c * getattr(o, "c", o))
        def __floordiv__(self, o): return Whole(F.floor(self.c / o))
    return rule(Whole(n), percent).c


def _least_hash(toks: Column, seed: int) -> Column:
    return F.struct(F.array_min(F.transform(toks, lambda t: F.xxhash64(t, F.lit(seed)))).alias("h"), F.lit(seed).alias("s"))


def _edges(source: DataFrame, alive: DataFrame, scratch: Scratch, p: JoinParams) -> DataFrame:
    """Links (a, b) between vertices that give the same components as all links."""
    # whole sets of the vertices left, from the one row of each; the filter only thins out the texts
    # (a null doc_id has a hash of its own)
    held = in_bitmaps(source.withColumn("h", F.xxhash64("doc_id")), "h", alive.select(F.xxhash64("doc_id").alias("key"))).where("held")
    texts = _full_sets(held.select("text"), p)
    sets = scratch.keep(texts.groupBy("sig").agg(F.first("toks").alias("toks"))
                        .join(alive.select("sig", "vid"), "sig").select("vid", "toks"), "sets")
    posting = sets.select("vid", F.explode("toks").alias("token"))
    # tokens with their number of sets, for those found in two sets or more
    counts = posting.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per_set = posting.join(counts, "token").groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    n = F.col("n")
    own, spare = n - F.size("common"), n - _sql(shared_least, n, p.percent)  # tokens of this set alone; tokens a partner may lack
    # from here on a set is its n and the tokens it has in common with others: the rest overlap with nothing
    kept = scratch.keep(
        per_set.join(alive.select("vid", "n"), "vid").where(own <= spare)
        .select("vid", "n", own.alias("own"), F.transform("common", lambda x: x["token"]).alias("toks"),
                # rarest first: tokens of this set alone come first of all
                F.transform(F.slice("common", F.lit(1), (spare + 1 - own).cast("int")), lambda x: x["token"]).alias("pre")), "kept")
    scratch.drop("sets")

    # groups: the least mutated vertex of each min-hash bucket leads it
    # (half the buckets leave out the rarest and the most common tokens: mutations, and passages that all kinds of texts share)
    quarter = F.floor(F.size("toks") / 4).cast("int")
    middle = F.slice("toks", quarter + 1, F.greatest(F.size("toks") - 2 * quarter, F.lit(1)))
    buckets = kept.select("vid", "n", "own", F.explode(F.array(*[_least_hash(middle if s % 2 else F.col("toks"), s) for s in range(p.seeds)])).alias("bucket"))
    best = F.min_by(F.struct("vid", "n"), F.struct("own", F.xxhash64("vid"), "vid")).alias("l")
    leaders = buckets.groupBy("bucket").agg(best)
    to_leader = (buckets.join(leaders, "bucket").where("vid != l.vid")
                 .where((F.least("n", "l.n") * 100 >= F.greatest("n", "l.n") * p.group_percent))
                 .select(F.col("vid").alias("a"), F.col("l.vid").alias("b")).distinct())
    near = scratch.keep(_compared(to_leader, kept), "near")
    families = connected_components(near.where(_similar(p.group_percent)), scratch, "cc_groups")
    grouped = kept.select("vid", "n", "own", "pre").join(
        families.select(F.col("v").alias("vid"), "root"), "vid", "left").withColumn("grp", F.coalesce("root", "vid")).drop("root")
    grouped = scratch.keep(grouped, "grouped")
    heads = grouped.groupBy("grp").agg(best)
    to_head = grouped.join(heads, "grp").where("vid != l.vid").select(F.col("vid").alias("a"), F.col("l.vid").alias("b"))
    to_head = to_head.join(near.select("a", "b"), ["a", "b"], "left_anti")
    stars = scratch.keep(near.union(_compared(to_head, kept)).where(_similar(p.percent)).select("a", "b"), "stars")
    comps = connected_components(stars, scratch, "cc_stars").select(F.col("v").alias("vid"), F.col("root").alias("comp"))
    inside = scratch.keep(_inside_groups(grouped, comps, kept, scratch, p), "inside")

    # the rest: first tokens that lie in two groups or more
    first = grouped.select("vid", "n", "grp", F.explode("pre").alias("token"))
    across = first.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token")
    first = scratch.keep(first.join(across, "token", "left_semi"), "across")
    groups = first.groupBy("token", F.col("grp").alias("g")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    fits = (F.col("hi") * 100 >= F.col("n") * p.percent) & (F.col("lo") * p.percent <= F.col("n") * 100)
    # one direction is enough: the vertex of the smaller group number asks
    queries = first.join(groups, "token").where("grp < g").where(fits).select("vid", "n", "g").distinct()
    sizes = grouped.groupBy(F.col("grp").alias("g")).agg(F.count(F.lit(1)).alias("size"))
    queries = scratch.keep(queries.join(sizes, "g"), "queries")
    asked = queries.where(F.col("size") > p.small_group)
    matrix = (grouped.join(asked.select(F.col("g").alias("grp")).distinct(), "grp", "left_semi")
              .join(kept.select("vid", "toks"), "vid").select(F.col("grp").alias("g"), F.explode("toks").alias("token")).distinct())
    bounded = (asked.join(kept.select("vid", "toks"), "vid").select("vid", "n", "g", F.explode("toks").alias("token"))
               .join(matrix, ["g", "token"]).groupBy("vid", "g").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("c"))
               .where(F.col("c") >= _sql(shared_least, F.col("n"), p.percent)).select("vid", "g"))
    opened = bounded.union(queries.where(F.col("size") <= p.small_group).select("vid", "g"))
    member = first.select("token", F.col("vid").alias("b"), F.col("n").alias("nb"), F.col("grp").alias("g"))
    pairs = (first.select("token", "vid", "n").join(opened, "vid").join(member, ["g", "token"])
             .where((F.least("n", "nb") * 100 >= F.greatest("n", "nb") * p.percent))
             .select(F.col("vid").alias("a"), "b").distinct())
    found = _compared(pairs, kept).where(_similar(p.percent)).select("a", "b")
    return stars.union(inside).union(found)


def keep_first(docs: DataFrame, p: JoinParams = JoinParams(5, 80), text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component: the smallest (doc_id, text hash), null doc_ids last.

    Rows without words are in no component and all stay.  Only rows that a
    bounded filter takes for linked are joined; the others pass straight through.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    scratch = Scratch(docs.sparkSession, "ngram-keep")
    linked = scratch.keep(components(docs, p, text).where("linked"), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    first = linked.groupBy("component").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_hash")
    t = text_hash(F.col(f"`{text}`"))
    keyed = docs.select(F.struct(*cols).alias("row"), F.col("doc_id").alias("d"), t.alias("t")).withColumn("h", F.xxhash64("d", "t"))
    flagged = in_bitmaps(keyed, "h", linked.select(F.xxhash64("doc_id", "text_hash").alias("key")))
    names = linked.select("doc_id", "text_hash").distinct()
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("text_hash"))
    gone = flagged.where("held").join(names, same, "left_anti")
    kept = flagged.where("held").join(first, same, "left_semi").dropDuplicates(["d", "t"])
    return flagged.where("NOT held").select("row.*").unionByName(gone.select("row.*")).unionByName(kept.select("row.*"))


#: DuckDB text of the contract query (4 words, 85 %): all pairs that share a shingle, and what they reach.
SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                      WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM worded),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id
FROM sets s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON s.doc_id = r.x
"""
