"""Ordered scans that stay distributed when one group holds most of the rows.

A plain ``row_number().over(Window.partitionBy(g).orderBy(t))`` sends every row
of group ``g`` to one task.  The helpers here split each group into ordered
buckets, number rows inside ``(g, bucket)`` and add the row count of all
earlier buckets, taken from a per-bucket summary table whose size is
``groups x buckets`` (not rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import ColumnLike, c
from ..session import materialize

# Sentinel bucket for null order keys: sorts before every real bucket.
NULL_BUCKET = -(2**63)

# Rows a bucket should hold on average when the borders are derived from the data.
DEFAULT_ROWS_PER_BUCKET = 100_000
# Sampled keys per bucket, and borders of one node of the search tree.
SAMPLES_PER_BUCKET = 20
FAN = 64
# Borders up to which the search tree is broadcast (a few dozen bytes each).
BROADCAST_BORDERS = 1_000_000


def time_bucket(t: Column, width: float) -> Column:
    """Bucket index ``floor(t / width)``; nulls go to ``NULL_BUCKET`` (sorted first)."""
    return F.coalesce(F.floor(t.cast("double") / F.lit(float(width))).cast("long"),
                      F.lit(NULL_BUCKET))


def one_bucket(x: Column) -> Column:
    """0 for every row, but not a constant: joins on a constant bucket would lose their key."""
    return F.coalesce(F.pmod(F.xxhash64(x), F.lit(1)).cast("long"), F.lit(0).cast("long"))


def count_le(df: DataFrame, arr_col: str, value: Column, limit: int, out: str) -> DataFrame:
    """Add ``out`` = number of elements <= value of the ascending array (of at most ``limit``) in ``arr_col``.

    Binary lifting in one fold over the halving steps, the value bound once
    (the outer ``transform``): the tree holds the value a single time, however
    often a filter or join condition made of ``out`` is moved below it, and
    ``out`` is never null, so no filter for nulls arises.
    """
    top = 1 << max(limit, 1).bit_length() - 1
    steps = F.array(*[F.lit(top >> i) for i in range(top.bit_length())])
    size = F.coalesce(F.size(arr_col), F.lit(0))

    def found(v: Column) -> Column:
        def step(at: Column, width: Column) -> Column:
            ok = (at + width <= size) & (F.get(F.col(arr_col), at + width - 1) <= v)
            return F.when(ok, at + width).otherwise(at)
        return F.aggregate(steps, F.lit(0), step)

    return df.withColumn(out, F.coalesce(F.get(F.transform(F.array(value), found), F.lit(0)), F.lit(0)).cast("long"))


def _borders(df: DataFrame, n: int, n_buckets: int) -> DataFrame:
    """(q, k): the ascending keys (column ``__k`` of ``df``) that part its ``n`` rows into about ``n_buckets`` buckets, numbered.

    They come from a sample of the keys, drawn by hash (every evaluation sees
    the same one), range-partitioned, sorted and numbered as it is written.
    Only the sample's row counts per range come to the driver.
    """
    share = min(1.0, SAMPLES_PER_BUCKET * n_buckets / n)
    drawn = df.where(F.pmod(F.xxhash64("__k", F.lit(17)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select(F.col("__k").alias("k"))
    at = F.monotonically_increasing_id()  # partition number and place in it
    sample = materialize(drawn.repartitionByRange("k").sortWithinPartitions("k").select("k", at.alias("at")), "border-sample")
    part = F.shiftright("at", 33)
    starts, total = [], 0
    for r in sample.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        starts.append((r["p"], total))
        total += r["n"]
    step = max(1, total // n_buckets)
    starts = df.sparkSession.createDataFrame(starts, "p long, start long")
    place = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = sample.join(F.broadcast(starts), part == F.col("p")).select("k", place.alias("place")).where(F.col("place") % step == step - 1)
    return materialize(placed.select(F.floor(F.col("place") / step).alias("q"), "k"), "borders")


def range_buckets(df: DataFrame, keys: Sequence[ColumnLike], rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
                  out: str = "__bkt") -> DataFrame:
    """Add ``out``: ordered slices of about ``rows_per_bucket`` rows, monotone in the tuple of ``keys`` (nulls first).

    Keys are of any types that have an order.  Borders are sampled from the
    whole key, so rows of one time (or of none) are parted by what follows it;
    only rows equal in all keys stay together.  A row finds its slice in a
    search tree of the borders: one small join per level, with ``FAN`` borders
    in a node, so rows never carry long arrays and there may be any number of slices.
    """
    n = df.count()
    n_buckets = -(-n // rows_per_bucket)
    if n_buckets <= 1:
        return df.withColumn(out, one_bucket(c(keys[-1])))
    df = df.withColumn("__k", F.struct(*[c(x).alias(f"k{i}") for i, x in enumerate(keys)]))
    borders = _borders(df, n, n_buckets)
    size = borders.count()
    levels = 1
    while FAN ** levels < size:
        levels += 1
    df = df.withColumn("__node", one_bucket(F.col("__k")))
    for level in range(levels - 1, -1, -1):
        unit = FAN ** level
        at, node = F.col("q") % (unit * FAN), F.floor(F.col("q") / (unit * FAN))
        # the first border of each child but the first; at the lowest level all borders
        picked = borders.where((at % unit == 0) & (at > 0)) if level else borders
        table = picked.groupBy(node.alias("__n")).agg(F.sort_array(F.collect_list("k")).alias("__ks"))
        table = F.broadcast(table) if size <= BROADCAST_BORDERS else table
        df = df.join(table, F.col("__node") == F.col("__n"), "left")
        df = count_le(df, "__ks", F.col("__k"), FAN, "__child")
        df = df.withColumn("__node", F.col("__node") * FAN + F.col("__child")).drop("__n", "__ks", "__child")
    return df.withColumnRenamed("__node", out).drop("__k")


def order_buckets(df: DataFrame, t: ColumnLike, tiebreak: Sequence[ColumnLike] = (),
                  rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, out: str = "__bkt") -> DataFrame:
    """Ordered slices monotone in (t null first, tiebreak)."""
    return range_buckets(df, [c(t).cast("double"), *tiebreak], rows_per_bucket, out)


def group_key(partition: Sequence[ColumnLike]) -> Column:
    """One non-null struct key for a list of grouping columns.

    Struct equality treats null fields as equal, so null group values stay one
    group in plain equi-joins (no null-safe join, which would re-shuffle).
    """
    if not partition:
        return F.struct(F.lit(0).alias("_"))
    return F.struct(*[c(p).alias(f"k{i}") for i, p in enumerate(partition)])


def bucketed_row_number(df: DataFrame, partition: Sequence[ColumnLike], order: Sequence[Column],
                        bucket: Column, out: str = "rn") -> DataFrame:
    """1-based row number within ``partition`` in ``order``.

    ``bucket`` must be monotone in the order (e.g. a time bucket of the first
    order key).  Work per task is bounded by one (partition, bucket) slice;
    the big side is shuffled once, by (group, bucket), and the offset join
    reuses that partitioning.
    """
    # a non-null bucket keeps Catalyst from inferring an isnotnull filter on the
    # join key and pushing the bucket expression below earlier aggregates
    staged = df.withColumn("__g", group_key(partition)).withColumn(
        "__bkt", F.coalesce(bucket.cast("long"), F.lit(NULL_BUCKET)))
    w = Window.partitionBy("__g", "__bkt").orderBy(*order)
    staged = staged.withColumn("__lrn", F.row_number().over(w).cast("long"))
    counts = staged.groupBy("__g", "__bkt").agg(F.count(F.lit(1)).alias("__n"))
    wb = Window.partitionBy("__g").orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__g", "__bkt",
                            F.coalesce(F.sum("__n").over(wb), F.lit(0)).cast("long").alias("__off"))
    return (staged.join(offsets, on=["__g", "__bkt"], how="inner")
            .withColumn(out, F.col("__off") + F.col("__lrn"))
            .drop("__off", "__lrn", "__g", "__bkt"))


def bucketed_prefix_sum(df: DataFrame, partition: Sequence[ColumnLike], order: Sequence[Column],
                        bucket: Column, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the partition in ``order`` (exclusive).

    Same plan shape as ``bucketed_row_number``: a window inside (group, bucket)
    plus bucket totals prefix-summed over a table of one row per bucket.
    """
    staged = (df.withColumn("__g", group_key(partition))
              .withColumn("__bkt", F.coalesce(bucket.cast("long"), F.lit(NULL_BUCKET)))
              .withColumn("__v", value))
    w = (Window.partitionBy("__g", "__bkt").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, -1))
    staged = staged.withColumn("__lsum", F.coalesce(F.sum("__v").over(w), F.lit(0)))
    totals = staged.groupBy("__g", "__bkt").agg(F.sum("__v").alias("__bt"))
    wb = Window.partitionBy("__g").orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__g", "__bkt", F.coalesce(F.sum("__bt").over(wb), F.lit(0)).alias("__off"))
    return (staged.join(offsets, on=["__g", "__bkt"], how="inner")
            .withColumn(out, F.col("__off") + F.col("__lsum"))
            .drop("__off", "__lsum", "__g", "__bkt", "__v"))
