"""Profiles from mergeable sketches (inventory E3, E5, E7 at scale).

A sketch table holds one row per (group, feature) with counts, a distinct-count
sketch and, for numbers, a quantile sketch, both as binary columns.  It is
stored once per portion of the data (a day, a file, a split) and merged for any
larger group later, without reading the data again.  Errors are those of the
sketches' sizes: ``distinct_error`` and ``rank_error`` state them.

The two commonest values of a column (E7) come from a heavy-hitter sketch that
names candidates and a second scan that counts these exactly; only columns for
which the counts prove nothing are counted value by value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import c
from .profile import feature_class

#: log2 of the distinct sketch's registers; size of the quantile sketch.
LG_REGISTERS = 14
QUANTILE_K = 2048
#: Values a heavy-hitter sketch tracks per column.
TRACKED = 1000


def distinct_error(lg_registers: int = LG_REGISTERS) -> float:
    """Relative standard error of the distinct count."""
    return 1.04 / math.sqrt(1 << lg_registers)


def rank_error(k: int = QUANTILE_K) -> float:
    """Error in rank, as a share of the rows, that a quantile keeps with 99 % confidence."""
    return 2.446 / k ** 0.9433


def numeric_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [n for n in cols if isinstance(types[n], T.NumericType)]


def sketch_table(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), lg_registers: int = LG_REGISTERS,
                 k: int = QUANTILE_K) -> DataFrame:
    """(by..., feature, rows, nulls, min, max, distinct_sketch, quantile_sketch) in one aggregate; store it as a table.

    min, max and quantiles are of numbers (null for other columns); distinct
    values are compared as text, nulls apart.
    """
    numbers = set(numeric_columns(df, cols))
    aggs = []
    for i, n in enumerate(cols):
        x = c(n).cast("double")
        aggs += [F.count_if(c(n).isNull()).alias(f"z{i}"), F.hll_sketch_agg(c(n).cast("string"), lg_registers).alias(f"d{i}")]
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.kll_sketch_agg_double(x, k).alias(f"q{i}")] if n in numbers else []
    wide = df.groupBy(*[c(b) for b in by]).agg(F.count(F.lit(1)).alias("rows"), *aggs)
    none, blank = F.lit(None).cast("double"), F.lit(None).cast("binary")
    per = [F.struct(F.lit(n).alias("feature"), F.col("rows").alias("rows"), F.col(f"z{i}").alias("nulls"),
                    (F.col(f"lo{i}") if n in numbers else none).alias("min"), (F.col(f"hi{i}") if n in numbers else none).alias("max"),
                    F.col(f"d{i}").alias("distinct_sketch"), (F.col(f"q{i}") if n in numbers else blank).alias("quantile_sketch"))
           for i, n in enumerate(cols)]
    return wide.select(*[c(b) for b in by], F.inline(F.array(*per)))


def merge_sketches(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketch table of coarser groups: rows of equal (by..., feature) merged."""
    merged = F.when(F.count("quantile_sketch") > 0, F.kll_merge_agg_double("quantile_sketch"))
    return table.groupBy(*[c(b) for b in by], "feature").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("distinct_sketch", True).alias("distinct_sketch"), merged.alias("quantile_sketch"))


def sketch_profile(table: DataFrame, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The sketch table read out: its group columns, rows, nulls, distinct values (null counts as one), min, quantiles, max."""
    own = [n for n in table.columns if n not in ("rows", "nulls", "min", "max", "distinct_sketch", "quantile_sketch")]
    some = F.col("quantile_sketch").isNotNull() & (F.col("nulls") < F.col("rows"))
    quantiles = [F.when(some, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(p)))).alias(f"p{round(p * 100)}") for p in percentiles]
    distinct = F.hll_sketch_estimate("distinct_sketch") + (F.col("nulls") > 0).cast("long")
    return table.select(*[c(n) for n in own], "rows", "nulls", distinct.alias("distinct"), "min", *quantiles, "max")


def top_two(df: DataFrame, cols: Sequence[str], tracked: int = TRACKED) -> DataFrame:
    """(feature, rows, missing, top1, top2): exact counts of the two commonest values of every column (null is a value).

    One scan sketches the heavy hitters of all columns; a second counts the
    candidates.  A value that the sketch lost has at most ``rows * 2.7 /
    tracked`` occurrences, so counts above that are the largest; columns with
    smaller ones (keys, measurements) are counted value by value, as 64-bit
    hashes.  ``tracked`` numbers per column come to the driver.
    """
    spark = df.sparkSession
    hashed = df.select(*[F.when(c(n).isNotNull(), F.xxhash64(c(n).cast("string"))).alias(f"v{i}") for i, n in enumerate(cols)])
    first = hashed.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"v{i}").isNull()).alias(f"z{i}") for i in range(len(cols))],
                       *[F.expr(f"approx_top_k(v{i}, {tracked}, {tracked})").alias(f"t{i}") for i in range(len(cols))]).first()
    rows = first["rows"]

    def pairs(which: Sequence[int]) -> DataFrame:
        return hashed.select(F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"v{i}").alias("v")) for i in which])))

    def largest(counts: DataFrame) -> dict[int, list[int]]:
        """The two largest counts of each column, and the sum of all."""
        best = counts.groupBy("f").agg(F.max("n").alias("a"), F.max_by("v", F.struct("n", "v")).alias("v1"), F.sum("n").alias("s"))
        rest = counts.join(F.broadcast(best), "f").where(~F.col("v").eqNullSafe(F.col("v1"))).groupBy("f").agg(F.max("n").alias("b"))
        return {r["f"]: [r["a"], r["b"] or 0, r["s"]] for r in best.join(rest, "f", "left").collect()}

    out: dict[int, list[int]] = {}
    if rows:
        named = [(i, x["item"]) for i in range(len(cols)) for x in (first[f"t{i}"] or []) if x["item"] is not None]
        all_cols = range(len(cols))
        candidates = F.broadcast(spark.createDataFrame(named, "f int, v long"))
        counted = pairs(all_cols).join(candidates, ["f", "v"], "left_semi").groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
        found, lost = largest(counted), rows * 2.7 / tracked
        with_null = lambda counts, i: sorted([*counts, first[f"z{i}"]])[-1:-3:-1]  # noqa: E731  (null is a value, too)
        unsure = []
        for i in all_cols:
            a, b, total = found.get(i, [0, 0, 0])
            out[i] = with_null([a, b], i)
            if out[i][1] <= lost and total + first[f"z{i}"] < rows:
                unsure.append(i)
        if unsure:
            exact = largest(pairs(unsure).where(F.col("v").isNotNull()).groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")))
            for i in unsure:
                out[i] = with_null(exact.get(i, [0, 0, 0])[:2], i)
    return spark.createDataFrame([(n, rows, first[f"z{i}"], *(out.get(i) or [0, 0])) for i, n in enumerate(cols)],
                                 "feature string, rows long, missing long, top1 long, top2 long")


def profile_columns_sketched(df: DataFrame, cols: Sequence[str] | None = None, tracked: int = TRACKED,
                             lg_registers: int = LG_REGISTERS) -> DataFrame:
    """E7 with exact densities and missing counts, and distinct counts by sketch (``distinct_error``; small counts are exact)."""
    cols = list(cols or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    distinct = sketch_profile(sketch_table(df.select(*[c(n).cast("string").alias(n) for n in cols]), cols, lg_registers=lg_registers), ())
    prof = top_two(df, cols, tracked).join(F.broadcast(distinct.select("feature", "distinct")), "feature")
    share = lambda x: F.round(F.when(F.col("rows") > 0, x / F.col("rows") * 100), 3)
    d1: Column = share(F.col("top1"))
    kind = F.create_map(*[x for n in cols for x in (F.lit(n), F.lit(types[n]))])
    return prof.select(
        "feature", (F.col("rows") - F.col("missing")).alias("observations"), "missing",
        F.round(F.when(F.col("rows") > 0, F.col("missing") / F.col("rows") * 100), 2).alias("missing_rate_pct"),
        d1.alias("first_density_pct"), F.round(d1 - share(F.col("top2")), 3).alias("density_gap_pct"),
        kind[F.col("feature")].alias("variable_type"), F.col("distinct").alias("unique_values"), feature_class(F.col("distinct")).alias("feature_type"))
