"""Chat formatting in budgeted windows; DataFrame code only.

A conversation becomes one or more training rows.  Prefix sums of turn tokens
cut it into turn-aligned spans of about a budget; every row after the first
repeats the system turn and a limited history before its span.  Only assistant
turns of the span itself are under the loss mask, so each is learned from once.

Turns are numbered, summed and dealt to spans without their texts, in ordered
slices, so a conversation may hold any share of all turns; texts are joined to
the finished spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import DEFAULT_ROWS_PER_BUCKET, bucketed_prefix_sum, bucketed_row_number, range_buckets
from .common import Scratch

START, END = "<|im_start|>", "<|im_end|>"


#: A token, as far as budgets go: a run of letters, a digit, or another mark.
TOKEN = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]"


@dataclass(frozen=True)
class ChatParams:
    """Sizes are tokens plus ``marks`` per turn.  A window holds the system turn, at most ``history`` of repeated
    turns, and new turns until ``budget`` is reached.  The last turn is whole, however long it is: no turn is
    split.  Nor is the system turn: if it is longer than half of what is left, a window takes as many new
    tokens as it repeats of it, and so outgrows the budget, but all windows together stay below three times the turns."""
    budget: int = 256
    history: int = 64
    marks: int = 4
    rows_per_slice: int = DEFAULT_ROWS_PER_BUCKET


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def escape(text: Column) -> Column:
    """No control string is left in the result: backslashes are doubled, ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As ``escape``, with line breaks taken out too: a role ends at the line break."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def windows(turns: DataFrame, p: ChatParams = ChatParams()) -> DataFrame:
    """conv_id, window, context_turns, text, loss (array of (start, end), end exclusive, in code points of ``text``).

    ``turns`` has conv_id, turn, role, text; rows are taken by turn (null
    first; equal turns by role and text hash), a null role or text is empty, rows of
    null conv_id are one conversation.  ``context_turns`` of a row are
    repeated from earlier rows and not under the mask.  Further columns are not
    read; no rows give no rows.
    """
    scratch = Scratch(turns.sparkSession, "turns")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    source = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.xxhash64(text).alias("th"))
    slim = source.select("conv_id", "turn", "role", "th", (n_tokens(F.col("text")) + p.marks).alias("size"))
    slim = scratch.keep(slim.withColumn("row", F.monotonically_increasing_id()), "slim")
    place = ["turn", "role", "th", "row"]
    sliced = range_buckets(slim, ["conv_id", *place], p.rows_per_slice, out="slice")
    order = [F.col(x).asc_nulls_first() for x in place]
    numbered = scratch.keep(bucketed_row_number(sliced, ["conv_id"], order, F.col("slice"), out="i"), "numbered")
    is_system = (F.col("i") == 1) & (F.col("role") == "system")
    systems = numbered.where(is_system).select(F.col("conv_id").alias("c"), F.col("size").alias("system"))
    own = F.when(is_system, 0).otherwise(F.col("size"))
    rows = bucketed_prefix_sum(numbered, ["conv_id"], [F.col("i")], F.col("slice"), own, out="at")
    rows = rows.join(systems, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    held = F.coalesce("system", F.lit(0))
    rows = rows.withColumn("step", F.greatest(F.lit(1), F.lit(p.budget - p.history) - held, held).cast("long"))
    rows = rows.withColumn("span", F.floor(F.col("at") / F.col("step"))).withColumn("first", is_system)
    rows = scratch.keep(rows.select("conv_id", "turn", "role", "th", "i", "at", "step", "span", "first"), "rows")
    # spans, numbered in their conversation
    starts = rows.where("NOT first").groupBy("conv_id", "span").agg(F.min("at").alias("begin"))
    starts = scratch.keep(starts.unionByName(rows.where("first").join(
        rows.where("NOT first").select(F.col("conv_id").alias("c")).distinct(), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
        .select("conv_id", "span", F.col("at").alias("begin"))), "starts")  # a conversation of a system turn alone is a span, too
    windows_ = bucketed_row_number(range_buckets(starts, ["conv_id", "span"], p.rows_per_slice, out="slice"), ["conv_id"], [F.col("span")], F.col("slice"), out="window")
    windows_ = scratch.keep(windows_.select(F.col("conv_id").alias("c"), F.col("span").alias("to"), "begin", F.col("window").cast("int").alias("window")), "windows")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("to"))
    new = rows.join(windows_, same).select("conv_id", "i", "window", F.lit(True).alias("new"))
    # a turn is history of the spans that begin within the history budget after its own start
    later = rows.where("NOT first").select("conv_id", "i", "at", F.col("span").alias("from"), F.explode(
        F.sequence(F.col("span"), F.floor((F.col("at") + p.history) / F.col("step")))).alias("span")).where("span > from")
    history = later.join(windows_, same).where(F.col("begin") - F.col("at") <= p.history).select("conv_id", "i", "window", F.lit(False).alias("new"))
    systems = rows.where("first").select("conv_id", "i", F.col("span").alias("from"))
    kept = (systems.join(windows_, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("to") > F.col("from")))
            .select("conv_id", "i", "window", F.lit(False).alias("new")))
    # texts, one of equal ones, to their turns and then to every span that holds them
    texts = source.dropDuplicates(["conv_id", "turn", "role", "th"]).select(
        F.col("conv_id").alias("c"), F.col("turn").alias("u"), F.col("role").alias("r"), F.col("th").alias("h"), "text")
    texts = rows.join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("u")) & (F.col("role") == F.col("r")) & (F.col("th") == F.col("h")))
    texts = texts.select(F.col("conv_id").alias("c"), F.col("i").alias("k"), "role", "text")
    pieces = new.unionByName(history).unionByName(kept).join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("i") == F.col("k"))).drop("c", "k")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    piece = F.struct("i", head.alias("head"), escape(F.col("text")).alias("body"), "new", (F.col("role") == "assistant").alias("answer"))
    rows = pieces.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(piece)).alias("t"))
    tail = END + "\n"
    spans = F.aggregate(
        "t", F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("loss")),
        lambda acc, x: F.struct(
            (acc["pos"] + F.length(x["head"]) + F.length(x["body"]) + len(tail)).cast("long").alias("pos"),
            F.when(x["new"] & x["answer"], F.concat(acc["loss"], F.array(F.struct(
                (acc["pos"] + F.length(x["head"])).cast("long").alias("start"),
                (acc["pos"] + F.length(x["head"]) + F.length(x["body"])).cast("long").alias("end")))))
            .otherwise(acc["loss"]).alias("loss")))
    return rows.select(
        "conv_id", "window",
        F.size(F.filter("t", lambda x: ~x["new"])).alias("context_turns"),
        F.concat_ws("", F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(tail)))).alias("text"),
        spans["loss"].alias("loss"))


def read_back(rows: DataFrame) -> DataFrame:
    """Turns and masked text of every conversation, parsed from formatted rows.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    parts = F.slice(F.split("text", r"<\|im_start\|>", -1), F.lit(2), F.greatest(F.size(F.split("text", r"<\|im_start\|>", -1)) - 1, F.lit(0)))
    fresh = F.filter(parts, lambda _, i: i >= F.col("context_turns"))

    def turn(x: Column) -> Column:
        line = F.instr(x, F.lit("\n"))
        role = F.substring(x, F.lit(1), line - 1)
        body = F.substring(x, line + 1, F.length(x) - line - len(END) - 1)
        return F.concat(unescape_role(role), F.lit("\n"), unescape(body), F.lit("\n"))

    loss = F.concat_ws("", F.transform("loss", lambda s: unescape(
        F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))
    per = rows.select("conv_id", "window", F.size(fresh).cast("long").alias("n"), F.concat_ws("", F.transform(fresh, turn)).alias("turns"),
                      loss.alias("loss"), F.length("text").cast("long").alias("chars"))
    piece = F.sort_array(F.collect_list(F.struct("window", "turns", "loss")))
    whole = per.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), piece.alias("w"))
    turns = F.concat_ws("", F.transform("w", lambda x: x["turns"]))
    masked = F.concat_ws("", F.transform("w", lambda x: x["loss"]))
    return whole.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(masked).cast("long").alias("loss_chars"),
                        F.sha2(masked, 256).alias("loss_sha256"), "formatted_chars")
