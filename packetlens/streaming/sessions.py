"""Incremental sessionization of packet streams (F5 on Structured Streaming).

The batch operator (``operators.sessions.sessionize``) needs the whole history
of a key.  On a stream the same rule runs with state: a key's carried previous
time (null after FIN/RST), its session counter and whether its previous packet
closed a connection.  Keys are dealt by hash to ``slots`` groups; one call of a
group numbers the packets of all its keys at once with NumPy (shift + cumulative
sum), so the number of calls does not grow with the number of keys.

Without ``delay``, packets of a key are expected in time order across
micro-batches (captures are); within a micro-batch they are sorted by (time,
tiebreak).  With ``delay``, packets may come in any order within it: a key's
packets wait in its state until the watermark has passed them, a timer brings
them out even if the key sends nothing more, and packets later than the delay
are dropped, as by any watermark.  ``expire`` lets the state of a silent key go.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import ColumnLike, c, flag
from ..operators.sessions import _as_col, _key_string

STATE_SCHEMA = "carry binary, waiting binary"
OWN = ["__kstr", "__t", "__syn", "__cls", "__slot"]
#: Carry of a key: previous time (NaN: none), session number, whether the previous packet closed, latest time seen in ms (NaN: none).
CARRY = {"last": "float64", "n": "int64", "closed": "bool", "newest": "float64"}
#: Groups that keys are dealt to.  A group's state holds its keys' carries and waiting packets.
SLOTS = 1024


def _pack(pdf: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def _carry_of(data: bytes | None) -> pd.DataFrame:
    """The carries of a group by key."""
    if data is None:
        return pd.DataFrame({k: pd.Series(dtype=t) for k, t in CARRY.items()}, index=pd.Index([], dtype=object))
    return _unpack(data).set_index("__kstr")


def _numbered(pdf: pd.DataFrame, carry: pd.DataFrame, timeout: float, after_close: str, tiebreak: Sequence[str], out: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The packets of a group's keys with their session ids, and the carries of these keys after them."""
    pdf = pdf.sort_values(["__kstr", "__t", *tiebreak], na_position="first", kind="mergesort").reset_index(drop=True)
    kstr = pdf["__kstr"].to_numpy(dtype=object)
    first = np.append(True, kstr[1:] != kstr[:-1])
    starts = np.flatnonzero(first)
    ends, of = np.append(starts[1:], len(kstr)) - 1, np.cumsum(first) - 1  # last row of a key, key of a row
    before = carry.reindex(kstr[starts])
    seen = before["n"].notna().to_numpy()
    t = pdf["__t"].to_numpy(dtype="float64", na_value=np.nan)
    closed = pdf["__cls"].to_numpy(dtype=bool)
    pure = pdf["__syn"].to_numpy(dtype=bool)
    eff = np.where(closed, np.nan, t)
    prev, prev_closed = np.roll(eff, 1), np.roll(closed, 1)
    prev[starts] = before["last"].to_numpy(dtype="float64")
    prev_closed[starts] = seen & (before["closed"].to_numpy() == True)  # noqa: E712  (null for a new key)
    with np.errstate(invalid="ignore"):
        opens = ~np.isnan(prev) & (pure | ((t - prev) > timeout))
    if after_close == "split":
        opens |= prev_closed
    opens[starts[~seen]] = False  # the very first packet of a key never opens a new session
    running = np.cumsum(opens)
    n = running - (running[starts] - opens[starts])[of] + np.where(seen, before["n"].to_numpy(dtype="float64"), 0).astype("int64")[of]
    pdf[out] = pdf["__kstr"].astype(str) + "_" + pd.Series(n).astype(str)
    after = pd.DataFrame({"last": eff[ends], "n": n[ends], "closed": closed[ends], "newest": before["newest"].to_numpy(dtype="float64")},
                         index=pd.Index(kstr[starts], dtype=object))
    return pdf, after


def _merged(carry: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([carry[~carry.index.isin(after.index)], after]).astype(CARRY) if len(carry) else after.astype(CARRY)


def _stored(carry: pd.DataFrame) -> bytes:
    return _pack(carry.rename_axis("__kstr").reset_index())


def _session_fn(timeout: float, after_close: str, tiebreak: Sequence[str], out: str):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        carry = _carry_of(state.get[0] if state.exists else None)
        pdf, after = _numbered(pd.concat(list(pdfs), ignore_index=True), carry, timeout, after_close, tiebreak, out)
        state.update((_stored(_merged(carry, after)), None))
        yield pdf.drop(columns=OWN)
    return fn


def _waiting_fn(timeout: float, after_close: str, tiebreak: Sequence[str], out: str, expire_ms: int | None):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stored, waiting = state.get if state.exists else (None, None)
        carry, passed = _carry_of(stored), state.getCurrentWatermarkMs()
        frames = [] if state.hasTimedOut else list(pdfs)
        fresh = set().union(*(x["__kstr"] for x in frames))
        if waiting:
            frames.insert(0, _unpack(waiting))
        rest = None
        if frames:
            pdf = pd.concat(frames, ignore_index=True)
            at = pdf["__ms"].to_numpy(dtype="float64", na_value=np.nan)
            newest = pd.Series(at, dtype="float64").groupby(pdf["__kstr"].to_numpy(dtype=object)).max()
            ready = ~(at > passed)  # packets without a time don't wait
            if ready.any():
                done, after = _numbered(pdf[ready], carry, timeout, after_close, tiebreak, out)
                carry = _merged(carry, after)
                yield done.drop(columns=[*OWN, "__ms", "__at"], errors="ignore")
            rest = pdf[~ready]
            if expire_ms is not None:  # a key whose packets all wait has no carry yet and can't expire
                at_last = np.fmax(carry["newest"].to_numpy(dtype="float64"), newest.reindex(carry.index).to_numpy(dtype="float64"))
                carry["newest"] = at_last
        if expire_ms is not None and len(carry):
            held = set() if rest is None else set(rest["__kstr"])
            due = carry["newest"].to_numpy(dtype="float64") + expire_ms
            own = np.array([k in fresh for k in carry.index], dtype=bool)
            silent = np.where(own, due <= passed, due < passed) & ~np.array([k in held for k in carry.index], dtype=bool)
            carry, due = carry[~silent], due[~silent]  # silent for long enough: the key may start anew
            due = due[~np.isnan(due) & ~np.array([k in held for k in carry.index], dtype=bool)]
        else:
            due = np.empty(0)
        more = rest is not None and len(rest) > 0
        if not more and not len(carry):
            if state.exists:
                state.remove()
            return
        state.update((_stored(carry), _pack(rest) if more else None))
        timers = [*([max(int(rest["__ms"].min()), passed + 1)] if more else []), *([max(int(due.min()), passed)] if len(due) else [])]
        if timers:
            state.setTimeoutTimestamp(min(timers))
    return fn


def sessionize_stream(df: DataFrame, key: ColumnLike, time: ColumnLike, timeout: float, *,
                      tiebreak: Sequence[str] = (), is_tcp: ColumnLike | bool = False,
                      syn: ColumnLike | None = None, ack: ColumnLike | None = None,
                      fin: ColumnLike | None = None, rst: ColumnLike | None = None,
                      after_close: str = "join", out: str = "session_id", delay: str | None = None,
                      seconds: float = 1.0, expire: float | None = None, slots: int = SLOTS) -> DataFrame:
    """Streaming F5: the session ids of the batch operator.

    ``delay`` (an interval, such as "10 minutes") is how late a packet may
    come; None expects packets of a key in order.  ``seconds`` is the length of
    a unit of ``time``.  A packet leaves once the watermark has passed it; one
    without a time leaves at once, as the first of its key.  A key silent for
    ``expire`` units of time (beyond the watermark) is forgotten, and its
    numbers start again at 0; None keeps the few numbers of every key.
    ``slots`` is the number of groups keys are dealt to (fixed for a checkpoint).
    """
    tcp = F.coalesce(_as_col(is_tcp), F.lit(False))
    staged = df.select("*", _key_string(df, key).alias("__kstr"), c(time).cast("double").alias("__t"),
                       (tcp & flag(syn) & ~flag(ack)).alias("__syn"),
                       (tcp & (flag(fin) | flag(rst))).alias("__cls"))
    staged = staged.withColumn("__slot", F.pmod(F.xxhash64("__kstr"), F.lit(slots)).cast("int"))
    out_schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    if delay is None:
        fn, state, timer = _session_fn(float(timeout), after_close, list(tiebreak), out), STATE_SCHEMA, "NoTimeout"
    else:
        ms = F.ceil(F.col("__t") * (1000.0 * seconds)).cast("long")
        staged = staged.withColumn("__ms", ms).withColumn("__at", F.timestamp_millis("__ms")).withWatermark("__at", delay)
        expire_ms = None if expire is None else int(expire * seconds * 1000)
        fn, state, timer = _waiting_fn(float(timeout), after_close, list(tiebreak), out, expire_ms), STATE_SCHEMA, "EventTimeTimeout"
    return staged.groupBy("__slot").applyInPandasWithState(fn, out_schema, state, "append", timer)
