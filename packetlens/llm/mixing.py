"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded draw.

Everything is DataFrame code.  Per-source token sums come from a map-side
combined aggregate; targets are a water filling over one row per source.  A
document is taken floor(rate) times, and once more if its seeded hash, uniform
on [0, 1), falls below a cut.  With a plain cut at the fraction, one long
document shifts a source's total by its whole size; the cut is therefore the
hash value up to which the source's documents, in hash order, hold the fraction
of its words: each document still has that chance over the seeds, but the draws
of a source's documents are not independent of each other.  Rows of equal
doc_id and text have one hash; where the cut falls on such a group, as many of
its rows are taken as come nearest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, n_words


@dataclass(frozen=True)
class MixParams:
    """``weights`` repeat over the sources in code point order (null last).

    The mix holds ``share`` of all words; a source gives ``max_rate`` times its
    words at most.  Up to ``broadcast_sources`` sources (counted first) the
    per-source table is broadcast, beyond it is joined by its key.
    """
    weights: Sequence[int] = (5, 2, 1)
    share: float = 1.5
    max_rate: int = 2
    seed: int = 7
    broadcast_sources: int = 100_000


HASH_BITS = 60
LEVEL_BITS = 12


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """60 uniform bits of (seed, doc_id, text)."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def _ranked_sources(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size, rank): sources numbered in code point order, null last, without gathering them in one task."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    per = scratch.keep(per.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    starts, n = [], 0
    for r in per.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # one row a range
        starts.append((r["part"], n))
        n += r["n"]
    starts = sizes.sparkSession.createDataFrame(starts, "part long, start long")
    return per.join(F.broadcast(starts), part == F.col("part")).select("source", "source_size", (F.col("start") + place).alias("rank"))


def targets(sizes: DataFrame, p: MixParams, scratch: Scratch) -> DataFrame:
    """(source, source_size, weight, target, times, extra): words wanted of each source, whole repeats, words beyond.

    Targets are weight * level, cut at ``max_rate`` times the source.  The level
    is found by filling: sources that the level so far overfills are full, and
    what they leave is spread over the others, until none is added.
    """
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in p.weights]), (F.pmod(F.col("rank"), F.lit(len(p.weights))) + 1).cast("int"))
    per = _ranked_sources(sizes, scratch).select("source", "source_size", weight.alias("weight"))
    per = scratch.keep(per.withColumn("cap", F.col("source_size") * p.max_rate), "weighed")
    total = per.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, n_full = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > F.col("cap")
        r = per.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("cap"),
                    F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if r["n"] == n_full:
            break
        n_full = r["n"]
        level = (p.share * total - r["cap"]) / r["weight"] if r["weight"] else float("inf")
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    per = per.select("source", "source_size", "weight", target.alias("target"))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return per.withColumn("times", times).withColumn("extra", F.col("target") - F.col("times") * F.col("source_size"))


def _border(parts: DataFrame, before: str, into: str) -> DataFrame:
    """The part (one row of a source's ordered parts) in which the words wanted run out, with the words before it."""
    w = Window.partitionBy("source").orderBy(into).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col(before) + F.sum("words").over(w)
    return (parts.withColumn("upto", upto).where("upto > extra AND upto - words <= extra")
            .withColumn(before, F.col("upto") - F.col("words")).drop("upto"))


def cuts(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """(source, cut, cut_rows): hashes below ``cut`` get the extra copy, and ``cut_rows`` of the rows equal to it.

    Found by refinement: word sums of 4,096 hash ranges per source, the range
    in which the wanted words run out, its 4,096 parts, and at last the hash
    values of one such part (a 16-millionth of the source).  No source is
    sorted or gathered as a whole.  Of the two cuts around the wanted words the
    nearer is taken, the lower in a tie.
    """
    same = F.col("source").eqNullSafe(F.col("s"))
    want = per.where("source_size > 0").select(F.col("source"), "extra")
    shift1, shift2 = HASH_BITS - LEVEL_BITS, HASH_BITS - 2 * LEVEL_BITS
    one = (sizes.groupBy("source", F.shiftright("h", shift1).alias("p1")).agg(F.sum("size").alias("words"))
           .join(want.withColumnRenamed("source", "s"), same)
           .drop("s").withColumn("before", F.lit(0).cast("long")))
    one = _border(one, "before", "p1").select(F.col("source").alias("s"), "p1", "before", "extra")
    two = (sizes.join(one, same & (F.shiftright("h", shift1) == F.col("p1")))
           .groupBy("source", F.shiftright("h", shift2).alias("p2")).agg(
               F.sum("size").alias("words"), F.first("before").alias("before"), F.first("extra").alias("extra")))
    two = _border(two, "before", "p2").select(F.col("source").alias("s"), "p2", "before", "extra")
    three = (sizes.join(two, same & (F.shiftright("h", shift2) == F.col("p2")))
             .groupBy("source", "h").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"),
                                         F.first("before").alias("before"), F.first("extra").alias("extra")))
    three = _border(three, "before", "h")
    nearest = F.ceil((F.col("extra") - F.col("before")) * F.col("rows") / F.col("words") - 0.5)
    return three.select("source", F.col("h").alias("cut"), F.least(F.greatest(nearest, F.lit(0)), F.col("rows")).cast("long").alias("cut_rows"))


def plan(docs: DataFrame, p: MixParams, text: str = "text") -> tuple[DataFrame, DataFrame, Scratch]:
    """(sizes, per_source, scratch): doc_id, source, size, h of every row, and the plan of every source; both written."""
    scratch = Scratch(docs.sparkSession, "mix")
    t = F.col(f"`{text}`")
    sizes = docs.select("doc_id", "source", n_words(t).alias("size"), draw(F.col("doc_id"), t, p.seed).alias("h"), F.monotonically_increasing_id().alias("row"))
    sizes = scratch.keep(sizes, "sizes")
    per = scratch.keep(targets(sizes, p, scratch), "targets")
    cut = cuts(sizes, per).withColumnRenamed("source", "s")
    per = scratch.keep(per.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "plan")
    return sizes, per, scratch


def with_plan(rows: DataFrame, per: DataFrame, p: MixParams) -> DataFrame:
    """``rows`` (with ``source`` as struct field key ``__source``) next to their source's plan."""
    small = per.count() <= p.broadcast_sources
    right = per.withColumnRenamed("source", "__plan_source")
    return rows.join(F.broadcast(right) if small else right, F.col("__source").eqNullSafe(F.col("__plan_source"))).drop("__plan_source")


def _with_copies(rows: DataFrame, at: str) -> DataFrame:
    """Add ``copies``, the times a row is taken, to written rows with their plan, hash ``h`` and written row number ``at``.

    The rows at a source's cut are numbered: inside the task that wrote them,
    and on from the counts of the tasks before.
    """
    on_cut = F.coalesce(F.col("h") == F.col("cut"), F.lit(False))
    plain = rows.where(~on_cut).withColumn("copies", F.col("times") + F.coalesce(F.col("h") < F.col("cut"), F.lit(False)).cast("long"))
    border = rows.where(on_cut).withColumn("__task", F.shiftright(at, 33))
    inside = F.row_number().over(Window.partitionBy("__source", "__task").orderBy(at))
    earlier = Window.partitionBy("__source").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = (border.groupBy("__source", "__task").agg(F.count(F.lit(1)).alias("__c"))
             .select(F.col("__source").alias("__s"), F.col("__task").alias("__t"), F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__start")))
    number = border.withColumn("__in", inside).join(tasks, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__task") == F.col("__t")))
    number = number.withColumn("copies", F.col("times") + (F.col("__start") + F.col("__in") <= F.col("cut_rows")).cast("long"))
    return plain.unionByName(number.drop("__task", "__in", "__s", "__t", "__start"))


def taken(docs: DataFrame, p: MixParams = MixParams(), text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, times taken and words taken of every row of ``docs``.

    A null source is a source of its own (the last); a null or empty text has
    size 0.  Rows of equal doc_id and text are interchangeable: how many of them
    are taken once more is the same in every run.
    """
    sizes, per, _ = plan(docs, p, text)
    rows = _with_copies(with_plan(sizes.withColumn("__source", F.col("source")), per, p), "row")
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, p: MixParams = MixParams(), text: str = "text") -> DataFrame:
    """The mixed rows: each row of ``docs`` as often as it is taken, with its own columns.

    Rows without words belong to a size of 0 and follow their source's rate
    like the others (a source without any words is not taken).
    """
    _, per, scratch = plan(docs, p, text)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("__row"), F.col("source").alias("__source"), draw(F.col("doc_id"), F.col(f"`{text}`"), p.seed).alias("h"))
    rows = with_plan(rows, per, p)
    on_cut = F.coalesce(F.col("h") == F.col("cut"), F.lit(False))
    whole = rows.where(~on_cut).select("__row", (F.col("times") + F.coalesce(F.col("h") < F.col("cut"), F.lit(False)).cast("long")).alias("copies"))
    # the rows at the cuts, written to be numbered: one a source, or a group of copies
    border = scratch.keep(rows.where(on_cut).withColumn("row", F.monotonically_increasing_id()), "border")
    copies = whole.unionByName(_with_copies(border, "row").select("__row", "copies")).where("copies > 0")
    return copies.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")


#: DuckDB text of ``taken`` with the default parameters.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7:' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
leveled AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size::DOUBLE / weight, source ASC NULLS LAST
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY 2 * source_size::DOUBLE / weight, source ASC NULLS LAST
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM per),
target AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM leveled),
wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM target),
upto AS (
  SELECT s.*, w.source_size, w.target, w.times, w.target - w.times * w.source_size AS extra,
         sum(size) OVER (PARTITION BY s.source ORDER BY h) AS through,
         sum(size) OVER (PARTITION BY s.source, h) AS unit
  FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (times + CASE WHEN through <= extra OR (through - unit <= extra AND through - extra < extra - (through - unit))
                                 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM upto
"""
