"""Exact quantiles that stay distributed for hot groups.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer.  Here the distinct (group, value) pairs are cut into
ordered slices of about equal size; a bucketed prefix sum then gives, for every
distinct value, the number of rows below it in its group, and the values at the wanted ranks are picked by a
join against a tiny table of target ranks.  The result is exact linear
interpolation between order statistics (as ``percentile`` / SQL
``quantile_cont``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import bucketed_prefix_sum, range_buckets


def exact_quantiles(df: DataFrame, value: Column, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., ``p``, ``value``) with the exact linear-interpolated quantile per group."""
    keys = list(keys)
    x = value.cast("double")
    distinct = df.where(x.isNotNull()).groupBy(*keys, x.alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    # read by the slicing, the group sizes and the prefix scan: materialize once
    distinct = materialize(distinct, "distinct-values")
    sized = distinct.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    pos = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"),
                                       (F.lit(float(p)) * (F.col("__n") - 1)).alias("pos")) for p in probs]))
    targets = sized.select(*keys, pos.alias("__t")).select(
        *keys, F.col("__t.p").alias("p"), F.col("__t.pos").alias("__pos"))
    ranks = targets.select(*keys, "p", "__pos", F.explode(F.array(
        F.floor("__pos").cast("long"), F.ceil("__pos").cast("long"))).alias("__r")).distinct()
    bucketed = range_buckets(distinct, [*keys, F.col("__x")], out="__qb")
    scanned = bucketed_prefix_sum(bucketed, keys, [F.col("__x")], F.col("__qb"), F.col("__c"), "__below")
    # both sides descend from ``distinct``: rename the rank side's keys so the
    # join condition refers to plain, unambiguous column names
    rk = [f"__rk{i}" for i in range(len(keys))]
    ranks = ranks.select(*[F.col(f"`{k}`").alias(r) for k, r in zip(keys, rk)], "p", "__pos", "__r")
    cond = [F.col(f"`{k}`").eqNullSafe(F.col(r)) for k, r in zip(keys, rk)]
    cond.append((F.col("__r") >= F.col("__below")) & (F.col("__r") < F.col("__below") + F.col("__c")))
    hit = scanned.join(F.broadcast(ranks) if not keys else ranks, _and(cond), "inner")
    hit = hit.select(*[F.col(f"`{k}`") for k in keys], "p", "__pos", "__r", "__x")
    per = hit.groupBy(*keys, "p", "__pos").agg(
        F.min_by("__x", "__r").alias("__lo"), F.max_by("__x", "__r").alias("__hi"))
    frac = F.col("__pos") - F.floor("__pos")
    val = F.when(frac == 0, F.col("__lo")).otherwise(
        (F.lit(1.0) - frac) * F.col("__lo") + frac * F.col("__hi"))
    return per.select(*keys, "p", val.alias("value"))


def _and(conds: list[Column]) -> Column:
    out = conds[0]
    for cnd in conds[1:]:
        out = out & cnd
    return out
