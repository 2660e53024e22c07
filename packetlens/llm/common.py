"""Helpers shared by the training-data operators: tables, words, bounded membership filters, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_on_exit, scratch_path

#: ASCII white space of the word contracts: blank and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"

#: Bits of a membership filter (8 MB, at any input size), and of one of the bitmaps it consists of.
FILTER_BITS = 1 << 26
BITMAP = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written intermediate tables of one operator call, in the shared checkpoint folder.

    ``keep`` writes a frame and reads it back (lineage is cut, the files survive
    lost executors); ``drop`` deletes tables that no later plan reads, the others
    go when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, scratch_path(spark, f"tables/{name}-{uuid.uuid4().hex[:12]}")
        drop_on_exit(spark, self.base)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Array of the words (runs of anything but ASCII white space) of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def text_hash(text: Column) -> Column:
    """64-bit hash of a text, null and empty told apart."""
    return F.xxhash64(text, text.isNull())


def prefix_reduce(arr: Column, zero: Column, plus: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """Exclusive prefixes of an array: element i is the sum of the elements before it, n + 1 elements in all.

    ``aggregate`` copies its buffer at every step, so one pass over n elements
    costs n * n; blocks of ``block`` elements and prefixes over block totals
    bring that to n * block + (n / block) ** 2.
    """
    def scan(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(plus(F.element_at(acc, -1), x))))

    n_blocks = F.ceil(F.size(arr) / F.lit(float(block))).cast("int")
    blocks = F.when(n_blocks > 0, F.transform(F.sequence(F.lit(0), F.greatest(n_blocks, F.lit(1)) - 1),
                                              lambda k: F.slice(arr, k * block + 1, block))
                    ).otherwise(F.array(arr))
    inner = F.transform(blocks, lambda b: scan(b, zero))
    starts = scan(F.transform(inner, lambda p: F.element_at(p, -1)), zero)
    body = F.flatten(F.transform(F.arrays_zip(inner.alias("p"), F.slice(starts, 1, F.size(inner)).alias("s")),
                                 lambda z: F.transform(F.slice(z["p"], 1, F.size(z["p"]) - 1),
                                                       lambda x: plus(z["s"], x))))
    return F.concat(body, F.array(F.element_at(starts, -1)))


def in_bitmaps(rows: DataFrame, h: str, keys: DataFrame, out: str = "held") -> DataFrame:
    """``rows`` with ``out``: true for every row whose hash column ``h`` is in ``keys`` (column ``key``), and for few others.

    The filter has a fixed size whatever ``keys`` holds: 8 MB, broadcast as bitmaps of 4 KB.  Filled up, it lets
    everything through, so it may only thin out the input of an exact join.  The lowest two bits of a hash don't count.
    """
    def at(c: str) -> Column:
        return F.pmod(F.shiftright(F.col(c), 2), F.lit(FILTER_BITS))
    maps = keys.select(F.shiftright(at("key"), 15).cast("int").alias("__m"), (at("key") % BITMAP).alias("__p")).groupBy("__m").agg(
        F.bitmap_construct_agg("__p").alias("__bits"))
    rows = rows.withColumn("__at", at(h)).withColumn("__n", F.shiftright("__at", 15).cast("int"))
    rows = rows.join(F.broadcast(maps), F.col("__n") == F.col("__m"), "left")
    p = F.col("__at") % BITMAP
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return rows.withColumn(out, F.coalesce(F.getbit(byte, p % 8) == 1, F.lit(False))).drop("__at", "__n", "__m", "__bits")


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) for every vertex of ``edges``: root is the smallest vertex reachable, root itself included.

    Alternating large-star and small-star rounds; each is a min-aggregate
    (combined map-side) and a join back, so the centre of a large star is never
    gathered in one row.  Rounds are written; a checksum of the edges tells the
    last one.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("v", "u")) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                .union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())

    cur = scratch.keep(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), f"{name}0")
    i, last = 0, None
    while True:
        mark = cur.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if mark == last:
            break
        i, last = i + 1, mark
        cur = scratch.keep(star(star(cur, True), False), f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
    return cur.select(F.col("u").alias("v"), F.col("v").alias("root")).union(
        cur.select(F.col("v"), F.col("v").alias("root")).distinct())
