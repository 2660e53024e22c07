"""Table -> split, encoded sequence table (inventory A8, composing C1, F1-F4, I1, J1, J2, J4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import c
from ..operators import encode, nulls, sampling, schema, sessions
from ..session import bound_methods, materialize

SEQUENCE_KEEP = ["sequence_id", "sequence_label", "attack_type", "attack_label", "split", "step"]


def feature_kinds(df: DataFrame, special: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """Sorted numeric, boolean and string columns outside ``special``."""
    special = set(special)
    num, boo, cat = [], [], []
    for f in df.schema.fields:
        if f.name in special:
            continue
        if isinstance(f.dataType, T.BooleanType):
            boo.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            num.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            cat.append(f.name)
    return sorted(num), sorted(boo), sorted(cat)


def prepare(df: DataFrame, length: int = 10, ratios: Sequence[float] = sampling.DEFAULT_RATIOS,
            seed: int = 42, fit_on: Sequence[str] = ("train", "val"),
            tiebreak: Sequence[str] | None = None, bucket_width: float | None = None,
            checkpoint: bool = True) -> DataFrame:
    """Fill nulls, cut labelled sequences, split, fit encoders on ``fit_on``, assemble.

    The result has the columns of ``SEQUENCE_KEEP`` and ``features``, one sparse
    vector a row with its ``encode.Layout``.  ``df`` must hold ``attack_label,
    attack_type, session_id, timestamp``.  Rows with equal (session, timestamp)
    are ordered by ``tiebreak``, columns that are no features (default: a hash of
    the whole row, so identical rows are the only unordered ones).  The sequence
    rows are written once to the shared checkpoint folder because the split, two
    fits and the final projection all read them.
    """
    bound_methods(df.sparkSession)
    schema.require_columns(df, schema.SPECIAL_COLUMNS)
    filled = nulls.fill_nulls(df, no_flag=["attack_label"])
    special = [*schema.SPECIAL_COLUMNS, "sequence_id", *(tiebreak or [])]
    numeric, booleans, categorical = feature_kinds(filled, special)
    if tiebreak is None:
        filled = filled.withColumn("__tb", F.xxhash64(*[c(n) for n in filled.columns]))
        tiebreak = ["__tb"]
    seq = sessions.make_sequences(filled, length, session="session_id", time="timestamp",
                                  label="attack_label", tiebreak=tiebreak, bucket_width=bucket_width)
    seq = seq.drop(*tiebreak)
    if checkpoint:
        seq = materialize(seq, "prepared-sequences")
    split = sampling.stratified_split(seq, ratios, seed)
    moments = encode.fit_scaler(split, numeric, "split", fit_on)
    codes = encode.fit_codes(split, categorical, "split", fit_on) if categorical else None
    split = encode.pack_scalars(split, moments, booleans, [*categorical, *SEQUENCE_KEEP])
    if categorical:
        split = encode.apply_codes(split, codes, categorical)
    layout = encode.fit_layout(codes, [*numeric, *booleans], categorical)
    return encode.assemble(split, layout, moments, booleans, SEQUENCE_KEEP)
