"""Sessionization and fixed-length sequences (inventory F1-F6).

All ordered numbering is bucketed (see ``ordered``): a key or session that
holds a third of all rows is still split across many tasks, and the only
per-key state that crosses bucket borders travels through a summary table
with one row per (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.common import ColumnLike, c, flag
from ..session import materialize
from .ordered import bucketed_row_number, group_key, range_buckets, time_bucket

SEQUENCE_SEPARATOR = "||"
# Columns beside the keys from which rows are carried as one struct.
WIDE = 16


def _as_col(v: ColumnLike | bool) -> Column:
    if isinstance(v, bool):
        return F.lit(v)
    return c(v)


def _key_string(df: DataFrame, key: ColumnLike) -> Column:
    col = c(key)
    if isinstance(key, str) and isinstance(df.schema[key].dataType, StringType):
        return col
    if isinstance(key, str) and not hasattr(df.schema[key].dataType, "fields"):
        return col.cast("string")
    # structs (one uniform struct per protocol family): JSON text is injective
    return F.to_json(col)


def _opens(t: Column, pure_syn: Column, prev: Column, prev_closed: Column,
           timeout: float, after_close: str) -> Column:
    """Does this row open a new session given the previous row's carry."""
    rule = prev.isNotNull() & (pure_syn | ((t - prev) > F.lit(float(timeout))))
    if after_close == "split":
        rule = prev_closed | rule
    return F.coalesce(rule, F.lit(False))


def _with_buckets(df: DataFrame, keys: Sequence[ColumnLike], time: ColumnLike, tiebreak: Sequence[ColumnLike],
                  bucket_width: float | None) -> DataFrame:
    """Ordered slices ``__bkt`` of the rows: from the data, or of a given width in time.

    Slices of the data run over (keys, time, tie-break), so a key lies in one
    slice, or in a few if it is hot, and the summaries have about as many rows
    as there are keys.  ``tiebreak`` must order rows of equal time completely:
    numbers are computed on the rows and on their summary, and both must see
    one order.
    """
    if not tiebreak:
        raise ValueError("a tie-break is needed: rows of equal time have no order otherwise")
    if bucket_width:
        return df.withColumn("__bkt", time_bucket(c(time), bucket_width))
    return range_buckets(df, [*keys, c(time).cast("double"), *tiebreak])


def sessionize(df: DataFrame, key: ColumnLike, time: ColumnLike, timeout: float, *,
               tiebreak: Sequence[ColumnLike], is_tcp: ColumnLike | bool = False,
               syn: ColumnLike | None = None, ack: ColumnLike | None = None,
               fin: ColumnLike | None = None, rst: ColumnLike | None = None,
               after_close: str = "join", bucket_width: float | None = None,
               out: str = "session_id") -> DataFrame:
    """Split each key's packets into sessions.

    Within a key, ordered by (time, tiebreak) with null times first, a row
    opens a new session when the previous row's time is known and either the
    row is a pure SYN (TCP, syn=1, ack!=1) or the gap exceeds ``timeout``.
    A TCP FIN/RST row clears the carried time, so the next row joins the old
    session (``after_close="join"``, the reference behaviour) or opens a new
    one (``"split"``).  The id is ``key_text || '_' || n`` with n from 0.

    Closed form: lag + running sum, no UDF.  Rows are shuffled once by
    (key, time bucket); the previous-row carry across bucket borders and the
    running session count come from a per-(key, bucket) summary.
    """
    if after_close not in ("join", "split"):
        raise ValueError("after_close must be 'join' or 'split'")
    t = c(time).cast("double")
    tcp = F.coalesce(_as_col(is_tcp), F.lit(False))
    staged = (_with_buckets(df, [key], time, tiebreak, bucket_width)
              .withColumn("__kstr", _key_string(df, key))
              .withColumn("__g", group_key([key]))
              .withColumn("__t", t)
              .withColumn("__syn", tcp & flag(syn) & ~flag(ack))
              .withColumn("__cls", tcp & (flag(fin) | flag(rst))))
    staged = staged.withColumn("__eff", F.when(F.col("__cls"), F.lit(None)).otherwise(F.col("__t")))
    w = Window.partitionBy("__g", "__bkt").orderBy(F.col("__t").asc_nulls_first(),
                                                    *[c(x).asc_nulls_first() for x in tiebreak])
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    staged = (staged
              .withColumn("__rn", F.row_number().over(w))
              .withColumn("__prev", F.lag("__eff").over(w))
              .withColumn("__pcls", F.coalesce(F.lag("__cls").over(w), F.lit(False))))
    staged = staged.withColumn(
        "__open",
        F.when(F.col("__rn") == 1, F.lit(0)).otherwise(
            _opens(F.col("__t"), F.col("__syn"), F.col("__prev"), F.col("__pcls"),
                   timeout, after_close).cast("int")))
    staged = staged.withColumn("__cum", F.sum("__open").over(running))

    summary = staged.groupBy("__g", "__bkt").agg(
        F.min_by(F.struct(F.col("__t").alias("t"), F.col("__syn").alias("syn")), "__rn").alias("__first"),
        F.max_by(F.struct(F.col("__eff").alias("eff"), F.col("__cls").alias("cls")), "__rn").alias("__last"),
        F.sum("__open").alias("__lo"))
    ws = Window.partitionBy("__g").orderBy("__bkt")
    summary = (summary
               .withColumn("__cin", F.lag(F.col("__last.eff")).over(ws))
               .withColumn("__ccls", F.coalesce(F.lag(F.col("__last.cls")).over(ws), F.lit(False))))
    summary = summary.withColumn(
        "__fo", _opens(F.col("__first.t"), F.col("__first.syn"), F.col("__cin"), F.col("__ccls"),
                       timeout, after_close).cast("long"))
    summary = summary.withColumn(
        "__off", F.coalesce(F.sum(F.col("__lo") + F.col("__fo")).over(
            ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    summary = summary.select("__g", "__bkt", "__off", "__fo")

    joined = staged.join(summary, on=["__g", "__bkt"], how="inner")
    number = F.col("__off") + F.col("__fo") + F.col("__cum")
    result = joined.withColumn(out, F.concat(F.col("__kstr"), F.lit("_"), number.cast("string")))
    return result.drop("__kstr", "__g", "__t", "__bkt", "__syn", "__cls", "__eff", "__rn",
                       "__prev", "__pcls", "__open", "__cum", "__off", "__fo")


def chunk_index(df: DataFrame, length: int, session: ColumnLike | None = "session_id",
                time: ColumnLike = "timestamp", *, tiebreak: Sequence[ColumnLike],
                bucket_width: float | None = None, out: str = "chunk",
                step_out: str | None = "step") -> DataFrame:
    """F1 (and F6 with ``session=None``): ``ceil(row_number / length)`` in time order.

    ``step`` is the 0-based position inside the chunk.  Numbering is bucketed by
    time, so a single session (or the whole table) never lands in one task.
    """
    df = _with_buckets(df, [] if session is None else [session], time, tiebreak, bucket_width)
    order = [c(time).asc_nulls_first(), *[c(x).asc_nulls_first() for x in tiebreak]]
    partition = [] if session is None else [session]
    numbered = bucketed_row_number(df, partition, order, F.col("__bkt"), out="__rn")
    numbered = numbered.withColumn(out, F.ceil(F.col("__rn") / F.lit(length)).cast("long"))
    if step_out:
        numbered = numbered.withColumn(step_out, ((F.col("__rn") - 1) % F.lit(length)).cast("int"))
    return numbered.drop("__rn")


def make_sequences(df: DataFrame, length: int, session: str = "session_id",
                   time: str = "timestamp", label: str = "attack_label",
                   *, tiebreak: Sequence[ColumnLike], bucket_width: float | None = None,
                   keep_step: bool = True, drop_session: bool = True) -> DataFrame:
    """cut sessions into full sequences of ``length`` rows with one label.

    ``sequence_id = session || '||' || chunk``; ``sequence_label`` is 1 when the
    sum of ``label`` over the sequence is positive; partial tail chunks are
    dropped.

    Rows are shuffled once, by (session, time bucket).  A chunk is full exactly
    when ``chunk * length`` does not exceed the session's row count (known from
    the bucket summary), so no per-sequence count is needed.  A chunk can only
    cross a bucket border as the first or last chunk of a bucket: label sums of
    those boundary chunks are combined through a small per-(session, bucket)
    table; every other chunk lies inside one bucket and is summed by a window
    there.  Both summary joins keep the rows' partitioning.  The columns of a wide
    table that play no part travel as one struct: sorts, windows and joins then
    move one value a row instead of some dozens.
    """
    order = [c(time).asc_nulls_first(), *[c(x).asc_nulls_first() for x in tiebreak]]
    used = {session, time, label, *tiebreak}
    others = [n for n in df.columns if n not in used] if all(isinstance(x, str) for x in used) else []
    wide, columns = len(others) > WIDE, df.columns
    if wide:
        df = df.select(*[c(n) for n in columns if n in used], F.struct(*[c(n) for n in others]).alias("__row"))
    staged = (_with_buckets(df, [session], time, tiebreak, bucket_width).withColumn("__g", group_key([session]))
              .withColumn("__y", F.coalesce(c(label).cast("long"), F.lit(0))))
    w = Window.partitionBy("__g", "__bkt").orderBy(*order)
    staged = (staged.withColumn("__lrn", F.row_number().over(w).cast("long"))
              .withColumn("__bn", F.count(F.lit(1)).over(
                  w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))

    # One aggregate per (session, bucket): row count, and label sums of the first
    # k rows and of the last k rows for k = 1..length (a boundary chunk covers
    # at most ``length`` rows of a bucket, at its start or at its end).
    ks = range(1, length + 1)
    summary = staged.groupBy("__g", "__bkt").agg(
        F.count(F.lit(1)).alias("__n"),
        F.array(*[F.sum(F.when(F.col("__lrn") <= k, F.col("__y")).otherwise(0)) for k in ks]).alias("__pre"),
        F.array(*[F.sum(F.when(F.col("__bn") - F.col("__lrn") < k, F.col("__y")).otherwise(0)) for k in ks])
        .alias("__suf"))
    wb = Window.partitionBy("__g").orderBy("__bkt")
    summary = summary.select(
        "*", F.coalesce(F.sum("__n").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__n").over(Window.partitionBy("__g")).alias("__tot"))
    if wide:  # read three times below
        summary = materialize(summary, "slice-summary")
    fc = F.ceil((F.col("__off") + 1) / F.lit(length)).cast("long")
    lc = F.ceil((F.col("__off") + F.col("__n")) / F.lit(length)).cast("long")
    summary = summary.withColumn("__fc", fc).withColumn("__lc", lc)
    k1 = F.col("__fc") * length - F.col("__off")                        # rows of the first chunk here
    k2 = F.col("__off") + F.col("__n") - (F.col("__lc") - 1) * length    # rows of the last chunk here
    summary = summary.withColumn("__pf", F.element_at("__pre", k1.cast("int"))) \
                     .withColumn("__pl", F.when(F.col("__lc") != F.col("__fc"),
                                                F.element_at("__suf", k2.cast("int"))))
    edges = summary.select("__g", F.inline(F.array(
        F.struct(F.col("__fc").alias("__chunk"), F.col("__pf").alias("__p")),
        F.struct(F.col("__lc").alias("__chunk"), F.col("__pl").alias("__p")))))
    edge_tot = edges.where(F.col("__p").isNotNull()).groupBy("__g", "__chunk").agg(F.sum("__p").alias("__et"))
    per_bucket = (summary.select("__g", "__bkt", "__off", "__tot", "__fc", "__lc")
                  .join(edge_tot.select("__g", F.col("__chunk").alias("__fc"), F.col("__et").alias("__ft")),
                        ["__g", "__fc"], "left")
                  .join(edge_tot.select("__g", F.col("__chunk").alias("__lc"), F.col("__et").alias("__lt")),
                        ["__g", "__lc"], "left"))

    rows = staged.join(per_bucket, on=["__g", "__bkt"], how="inner")
    rows = rows.withColumn("__rn", F.col("__off") + F.col("__lrn")) \
               .withColumn("__chunk", F.ceil(F.col("__rn") / F.lit(length)).cast("long"))
    inside = F.sum("__y").over(Window.partitionBy("__g", "__bkt", "__chunk"))
    total = (F.when(F.col("__chunk") == F.col("__fc"), F.col("__ft"))
             .when(F.col("__chunk") == F.col("__lc"), F.col("__lt")).otherwise(inside))
    rows = rows.withColumn("sequence_label", (total > 0).cast("long"))
    rows = rows.filter(F.col("__chunk") * F.lit(length) <= F.col("__tot"))
    rows = rows.withColumn(
        "sequence_id",
        F.concat(c(session).cast("string"), F.lit(SEQUENCE_SEPARATOR), F.col("__chunk").cast("string")))
    if keep_step:
        rows = rows.withColumn("step", ((F.col("__rn") - 1) % F.lit(length)).cast("int"))
    rows = rows.drop("__g", "__bkt", "__y", "__lrn", "__bn", "__tot", "__fc", "__lc", "__off", "__rn", "__chunk",
                     "__ft", "__lt")
    if wide:
        rows = rows.select(*[F.col("__row")[n].alias(n) if n in others else c(n) for n in columns],
                           *[c(n) for n in rows.columns if n not in columns and n != "__row"])
    if drop_session:
        rows = rows.drop(session, time)
    return rows


def sequence_label_counts(sequences: DataFrame) -> DataFrame:
    """Number of sequences per sequence label.

    Every full sequence has exactly one ``step == 0`` row, so counting those
    rows per label counts sequences without a per-sequence aggregate (no
    shuffle of the rows by sequence id).  Without a ``step`` column it falls
    back to one row per sequence id.
    """
    if "step" in sequences.columns:
        firsts = sequences.filter(F.col("step") == 0)
        return firsts.groupBy("sequence_label").agg(F.count(F.lit(1)).alias("n_sequences"))
    per_seq = sequences.groupBy("sequence_id").agg(F.max("sequence_label").alias("sequence_label"))
    return per_seq.groupBy("sequence_label").agg(F.count(F.lit(1)).alias("n_sequences"))
