"""Profiling aggregates (inventory E1-E13, G4, G5).

Every profile is a partial (map-side combined) aggregate.  Per-column
statistics come from one wide aggregate, not one job per column; the column
profile unpivots once and groups by (feature, value).  A table total is a
scalar subquery (one partial aggregate), never a window over the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import exact_quantiles

from ..functions.common import ColumnLike, c, join_null_safe

# Column classes by number of distinct values, and the limit under
# which a numeric column is treated as categorical against a target.
CLASS_SUPERFLUOUS_MAX = 1
CLASS_FLAG = 2
CLASS_CATEGORICAL_MAX = 10
NUMERIC_AS_CATEGORICAL_BELOW = 20
WHISKER_IQR = 1.5


def _total(df: DataFrame) -> Column:
    """Row count of ``df`` as a scalar subquery (lazy; one partial aggregate when run)."""
    return df.agg(F.count(F.lit(1))).scalar()


def group_count(df: DataFrame, keys: Sequence[ColumnLike], name: str = "count") -> DataFrame:
    """Rows per key combination (null is a group)."""
    return df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, col: str, density_digits: int = 3, sort: str | None = "count") -> DataFrame:
    """Count and density (%) per value, null included.

    ``sort="count"`` orders by count (descending, ties by value), ``"value"`` by
    value, ``None`` leaves the aggregate unordered.
    """
    counts = df.groupBy(c(col)).agg(F.count(F.lit(1)).alias("count"))
    total = _total(df)
    out = counts.withColumn("density_pct", F.round(F.col("count") / total * 100, density_digits))
    if sort == "count":
        return out.orderBy(F.col("count").desc(), c(col).asc_nulls_first())
    if sort == "value":
        return out.orderBy(c(col).asc_nulls_first())
    return out


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share (%) per label value."""
    counts = df.groupBy(c(label)).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("pct", F.round(F.col("count") / _total(df) * 100, 6))


def distinct_values(df: DataFrame, col: ColumnLike) -> DataFrame:
    """Distinct values of a column."""
    return df.select(c(col)).distinct()


def describe(df: DataFrame, cols: Sequence[str], percentiles: Sequence[float] = (0.25, 0.5, 0.75),
             by: str | None = None, method: str = "exact", accuracy: int = 100_000) -> DataFrame:
    """E5: count, null count, mean, sample std, min, percentiles, max per column.

    Moments come from one wide aggregate (optionally per ``by`` value), stacked
    to one row per (group, feature).  ``method="exact"`` computes percentiles
    by linear interpolation between order statistics with the distributed
    method of ``quantiles`` (no group's values are held in one buffer);
    ``"approx"`` uses the bounded-memory sketch directly.
    """
    aggs = []
    for i, n in enumerate(cols):
        x = c(n).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(x.isNull()).alias(f"z{i}"),
                 F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if method == "approx":
            aggs.append(F.percentile_approx(x, [float(p) for p in percentiles], accuracy).alias(f"q{i}"))
    keys = [by] if by else []
    grouped = df.groupBy(*[c(k) for k in keys])
    wide = grouped.agg(*aggs)
    pcols = [f"p{int(round(p * 100))}" for p in percentiles]
    names = ["feature", "count", "null_count", "mean", "std", "min", "max"]
    rows = []
    for i, n in enumerate(cols):
        fields = [F.lit(n), F.col(f"n{i}"), F.col(f"z{i}"), F.col(f"m{i}"), F.col(f"s{i}"),
                  F.col(f"lo{i}"), F.col(f"hi{i}")]
        if method == "approx":
            fields += [F.col(f"q{i}")[j] for j in range(len(percentiles))]
        rows.append(F.struct(*[f.alias(nm) for f, nm in zip(fields, names + (pcols if method == "approx" else []))]))
    stats = wide.select(*[c(k) for k in keys], F.inline(F.array(*rows)))
    if method == "approx":
        return stats.select(*[c(k) for k in keys], *names[:6], *pcols, "max")
    long = df.select(*[c(k) for k in keys], F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), c(n).cast("double").alias("x")) for n in cols])))
    q = exact_quantiles(long, F.col("x"), percentiles, [*keys, "feature"])
    q = q.withColumn("__pc", F.concat(F.lit("p"), F.round(F.col("p") * 100).cast("int").cast("string")))
    wideq = q.groupBy(*[c(k) for k in keys], "feature").pivot("__pc", pcols).agg(F.first("value"))
    out = join_null_safe(stats, wideq, [*keys, "feature"])
    return out.select(*[c(k) for k in keys], *names[:6], *pcols, "max")


def distinct_count(df: DataFrame, cols: Sequence[str], approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct values per column with null counted as one value; one row.

    ``approx`` uses the HyperLogLog++ sketch (bounded memory, relative error
    ``rsd``) instead of exact distinct aggregation.
    """
    aggs = []
    for n in cols:
        d = F.approx_count_distinct(c(n), rsd) if approx else F.count_distinct(c(n))
        aggs.append((d + F.max(c(n).isNull().cast("int"))).alias(n))
    return df.agg(*aggs)


def feature_class(unique: Column) -> Column:
    return (F.when(unique <= CLASS_SUPERFLUOUS_MAX, "Superfluous")
            .when(unique == CLASS_FLAG, "Flag")
            .when(unique <= CLASS_CATEGORICAL_MAX, "Categorical")
            .otherwise("Categorical - High Cardinality"))


def profile_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: observations, missing, missing %, top value density %,
    top-minus-second density, type, distinct values (null counts), class.

    One unpivot to (feature, value-as-text), one (feature, value) count with
    map-side combine, then per-feature aggregates; the runner-up count needs the
    top count first, which arrives through a broadcast of one row per column.
    """
    cols = list(cols or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), c(n).cast("string").alias("value"))
                      for n in cols])
    long = df.select(F.inline(pairs))
    vc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    per = vc.groupBy("feature").agg(
        F.sum("cnt").alias("rows"), F.max("cnt").alias("top1"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).alias("missing"),
        F.count(F.lit(1)).alias("unique_values"))
    second = vc.join(F.broadcast(per.select("feature", "top1")), "feature").groupBy("feature").agg(
        F.max(F.when(F.col("cnt") < F.col("top1"), F.col("cnt"))).alias("below"),
        F.count_if(F.col("cnt") == F.col("top1")).alias("n_top"))
    prof = per.join(second, "feature")
    top2 = F.when(F.col("n_top") >= 2, F.col("top1")).otherwise(F.coalesce(F.col("below"), F.lit(0)))
    d1 = F.round(F.col("top1") / F.col("rows") * 100, 3)
    d2 = F.round(top2 / F.col("rows") * 100, 3)
    type_map = F.create_map(*[x for n in cols for x in (F.lit(n), F.lit(types[n]))])
    return prof.select(
        "feature",
        (F.col("rows") - F.col("missing")).alias("observations"),
        F.col("missing").cast("long").alias("missing"),
        F.round(F.col("missing") / F.col("rows") * 100, 2).alias("missing_rate_pct"),
        d1.alias("first_density_pct"),
        F.round(d1 - d2, 3).alias("density_gap_pct"),
        type_map[F.col("feature")].alias("variable_type"),
        F.col("unique_values"),
        feature_class(F.col("unique_values")).alias("feature_type")).orderBy("feature_type", "unique_values",
                                                                             "feature")


def target_box(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Box statistics of ``feature`` per ``target`` value.

    Quartiles are exact (linear); whiskers are the most extreme values within
    1.5 IQR of the box; outliers are counted beyond them.  The second pass
    joins the per-target box (one row per target value) by broadcast.
    """
    x = c(feature).cast("double")
    counts = df.groupBy(c(target)).agg(F.count(x).alias("n"))
    q = exact_quantiles(df.select(c(target), x.alias("__v")), F.col("__v"), (0.25, 0.5, 0.75), [target])
    quart = q.groupBy(c(target)).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
                                       for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    box = join_null_safe(counts, quart, [target])
    box = box.withColumn("lo_fence", F.col("q1") - WHISKER_IQR * (F.col("q3") - F.col("q1"))) \
             .withColumn("hi_fence", F.col("q3") + WHISKER_IQR * (F.col("q3") - F.col("q1")))
    # one row per target value; Catalyst/AQE broadcast it only under their size threshold
    fences = box.select(c(target).alias("__tf"), "lo_fence", "hi_fence")
    rows = df.select(c(target).alias("__t"), x.alias("__x"))
    joined = rows.join(fences, rows["__t"].eqNullSafe(fences["__tf"])).drop("__tf")
    inside = F.col("__x").between(F.col("lo_fence"), F.col("hi_fence"))
    tails = joined.groupBy("__t").agg(
        F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
        F.count_if(F.col("__x").isNotNull() & ~inside).alias("outliers"))
    out = box.join(tails, box[f"`{target}`"].eqNullSafe(tails["__t"]), "left").drop("__t")
    return out.drop("lo_fence", "hi_fence")


def is_categorical(df: DataFrame, feature: str) -> bool:
    """String columns, or fewer than 20 distinct values (null counts)."""
    dt = df.schema[feature].dataType
    if isinstance(dt, T.StringType):
        return True
    row = df.agg(F.count_distinct(c(feature)).alias("d"),
                 F.max(c(feature).isNull().cast("int")).alias("z")).first()
    return (row["d"] + (row["z"] or 0)) < NUMERIC_AS_CATEGORICAL_BELOW


def target_relationship(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Counts by (feature, target) for categorical features, else box statistics."""
    if is_categorical(df, feature):
        return group_count(df, [feature, target])
    return target_box(df, feature, target)


def anti_features(profile: DataFrame, drop: DataFrame, key: str = "feature") -> DataFrame:
    """Profile rows whose feature is not in ``drop`` (left anti join)."""
    return profile.join(drop.select(key), key, "left_anti")


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows in ``order`` (a top-k: per-task top-n, then merge)."""
    return df.orderBy(*order).limit(n)
