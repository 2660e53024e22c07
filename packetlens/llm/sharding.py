"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt into blocks by a seeded hash.  How many rows of each block go to
each shard is drawn first, as a matrix with the exact block and shard totals
(row by row hypergeometric draws: the law a uniform permutation of all rows
would give).  Each block is then permuted on its own, its first rows go to
shard 0, the next to shard 1 and so on, and every shard is permuted again, in
hash ranges, for the final slots.  Only block totals reach the driver: at most
``max_blocks`` numbers.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_hash


@dataclass(frozen=True)
class ShardParams:
    shards: int = 8
    seed: int = 7
    rows_per_block: int = 250_000
    min_blocks: int = 16
    max_blocks: int = 16_384


def _uniform(*key: int) -> float:
    return int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:7], "big") / 2.0 ** 56


def hypergeometric(u: float, good: int, bad: int, draws: int) -> int:
    """The number of good rows among ``draws`` of good + bad, at quantile ``u`` of an order that starts at the mode.

    Exact inversion: probabilities are summed outwards from the mode, so the
    steps grow with the standard deviation only.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    at_mode = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    up = down = at_mode
    i = j = mode
    u -= at_mode
    while u > 0 and (i < high or j > low):
        if i < high:
            up *= (good - i) * (draws - i) / ((i + 1) * (bad - draws + i + 1))
            i += 1
            u -= up
            if u <= 0:
                return i
        if j > low:
            down *= j * (bad - draws + j) / ((good - j + 1) * (draws - j + 1))
            j -= 1
            u -= down
            if u <= 0:
                return j
        if up < 1e-300 and down < 1e-300:
            break
    return mode


def communication_matrix(blocks: dict[int, int], p: ShardParams) -> dict[int, list[int]]:
    """Rows that each block sends to each shard; rows sum to the blocks, columns to sizes at most one apart."""
    total = sum(blocks.values())
    room = [total // p.shards + (s < total % p.shards) for s in range(p.shards)]
    matrix = {}
    for b in sorted(blocks):
        rest, left, out = sum(room), blocks[b], []
        for s in range(p.shards):
            k = hypergeometric(_uniform(p.seed, b, s), room[s], rest - room[s], left)
            out.append(k)
            rest, left = rest - room[s], left - k
        room = [r - k for r, k in zip(room, out)]
        matrix[b] = out
    return matrix


def _small_table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A few driver values as rows (parsed by SQL, no RDD)."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def assign(rows: DataFrame, identity: list[Column], p: ShardParams = ShardParams()) -> DataFrame:
    """``rows`` with the long columns ``shard`` and ``slot``: counts at most one apart, slots gapless from 0.

    ``identity`` seeds the draws, so the result depends on the rows' content and
    the seed alone, not on partitions or retries; rows of equal identity may
    swap places with each other only.  Empty input gives empty output.  Columns
    called shard or slot are replaced.
    """
    cols = [c for c in rows.columns if c not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    key = F.xxhash64(F.lit(p.seed), *identity)
    keyed = rows.select(row.alias("__row"), F.xxhash64(key, F.lit(1)).alias("__h1"), F.xxhash64(key, F.lit(2)).alias("__h2"))
    spark = rows.sparkSession
    n = rows.count()
    n_blocks = max(p.min_blocks, min(p.max_blocks, n // p.rows_per_block))
    block = F.pmod(F.xxhash64("__h1", F.lit(3)), F.lit(n_blocks)).cast("int")
    keyed = keyed.withColumn("__block", block)
    blocks = {r["__block"]: r["n"] for r in keyed.groupBy("__block").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix(blocks, p)
    ends = [{"b": b, "ends": [sum(out[:s + 1]) for s in range(p.shards)]} for b, out in matrix.items()]
    bounds = _small_table(spark, ends, "b int, ends array<bigint>")
    # first permutation, inside a block, and the shard by rank
    rank = F.row_number().over(Window.partitionBy("__block").orderBy("__h1", "__h2"))
    dealt = keyed.withColumn("__rank", rank.cast("long")).join(F.broadcast(bounds), F.col("__block") == F.col("b"))
    dealt = dealt.withColumn("__shard", F.size(F.filter("ends", lambda e: e < F.col("__rank"))))
    # exchange and second permutation: hash ranges of a shard, numbered on from the ranges before
    ranges = max(1, n_blocks // p.shards)
    dealt = dealt.withColumn("__range", F.pmod(F.xxhash64("__h2", F.lit(4)), F.lit(ranges)).cast("int"))
    counts = {(r["__shard"], r["__range"]): r["n"] for r in
              dealt.groupBy("__shard", "__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = [], {}
    for s, k in sorted(counts):
        starts.append({"s": s, "k": k, "start": at.get(s, 0)})
        at[s] = at.get(s, 0) + counts[s, k]
    offset = F.broadcast(_small_table(spark, starts, "s int, k int, start bigint"))
    place = F.row_number().over(Window.partitionBy("__shard", "__range").orderBy("__h2", "__h1")).cast("long") - 1
    return (dealt.select("__row", "__shard", "__range", place.alias("__place"))
            .join(offset, (F.col("__shard") == F.col("s")) & (F.col("__range") == F.col("k")))
            .select("__row.*", F.col("__shard").alias("shard"), (F.col("start") + F.col("__place")).alias("slot")))


def shard(docs: DataFrame, p: ShardParams = ShardParams(), text: str = "text") -> DataFrame:
    """``docs`` with shard and slot, drawn from doc_id and text (nulls count as values)."""
    return assign(docs, [F.col("doc_id"), F.col("doc_id").isNull(), text_hash(F.col(f"`{text}`"))], p)


def shard_sizes(docs: DataFrame, p: ShardParams = ShardParams(), text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, shard and slot; the texts themselves are not exchanged."""
    t = F.col(f"`{text}`")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"),
                       F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"), text_hash(t).alias("__text"))
    out = assign(rows, [F.col("doc_id"), F.col("doc_id").isNull(), F.col("__text")], p)
    return out.drop("__text")
