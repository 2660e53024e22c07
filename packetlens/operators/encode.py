"""Encoding and feature assembly (inventory J1-J7).

Categories of any number are fitted to a table ``(feature, value, code)`` and
applied by joins on the value; no category list reaches the driver.  An
encoded row is one sparse vector: every feature has a range of slots (a number
or a boolean one slot, a categorical feature one for each category), given by a
``Layout`` of one entry per feature, and only non-zero slots are stored.  An
unseen category is an empty slot.  Wide one-hot columns exist for callers that
ask for them with their own category lists.  Moments (J2) are two numbers a
column.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import c
from ..session import drop_on_exit, materialize, scratch_path

GROUP_SEPARATOR = "__"
CODE = "code"
FEATURES = "features"
PACKED = "__packed"


def _fit_rows(df: DataFrame, split_col: str | None, fit_on: Sequence[str] | None) -> DataFrame:
    if split_col and fit_on:
        return df.filter(c(split_col).isin(list(fit_on)))
    return df


def _values(df: DataFrame, cols: Sequence[str], split_col: str | None, fit_on: Sequence[str] | None) -> DataFrame:
    """Distinct non-null (feature, value) pairs of the fitted rows (one unpivot + distinct)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), c(n).cast("string").alias("value")) for n in cols])
    return _fit_rows(df, split_col, fit_on).select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()


def fit_codes(df: DataFrame, cols: Sequence[str], split_col: str | None = "split",
              fit_on: Sequence[str] | None = ("train", "val")) -> DataFrame:
    """J1/J3 fit: the table (feature, value, code), code = 0-based place among the sorted values of its feature.

    Values are range-partitioned, numbered as they are written and moved on by
    the counts of the ranges before (one row per feature and range): no task
    holds all values, and the driver none.  The table is written, so its size is
    known: a join planned by the product of two sizes would shuffle all rows by
    their categories, some of which are few.
    """
    ranged = _values(df, cols, split_col, fit_on).repartitionByRange("feature", "value").sortWithinPartitions("feature", "value")
    at = F.monotonically_increasing_id()  # partition number and place in it
    ranged = materialize(ranged.select("feature", "value", at.alias("at")), "categories")
    part = F.shiftright("at", 33)
    starts, taken = [], {}
    for r in ranged.groupBy("feature", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r["feature"], r["part"], r["first"] - taken.get(r["feature"], 0)))
        taken[r["feature"]] = taken.get(r["feature"], 0) + r["n"]
    starts = df.sparkSession.createDataFrame(starts, "__f string, __p long, __s long")  # features x ranges rows
    moved = ranged.join(F.broadcast(starts), (F.col("feature") == F.col("__f")) & (part == F.col("__p")))
    return materialize(moved.select("feature", "value", (F.col("at") - F.col("__s")).cast("int").alias("code")), "codes")


def apply_codes(df: DataFrame, codes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each of ``cols`` by ``{name}__code``; null and unseen values are -1.

    One left join per column; Spark broadcasts a column's code table if it is
    below its own threshold and splits skewed values otherwise.
    """
    for i, n in enumerate(cols):
        mine = codes.where(F.col("feature") == n).select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__c{i}"))
        df = df.join(mine, c(n).cast("string") == F.col(f"__v{i}"), "left").drop(f"__v{i}")
    keep = [c(n) for n in df.columns if n not in cols and not n.startswith("__c")]
    return df.select(*keep, *[F.coalesce(F.col(f"__c{i}"), F.lit(-1)).alias(f"{n}{GROUP_SEPARATOR}{CODE}") for i, n in enumerate(cols)])


def fit_categories(df: DataFrame, cols: Sequence[str], split_col: str | None = "split",
                   fit_on: Sequence[str] | None = ("train", "val")) -> dict[str, list]:
    """J1 fit for wide columns the caller asks for: the sorted values per column, which become column names' indexes."""
    cats: dict[str, list] = {n: [] for n in cols}
    for r in _values(df, cols, split_col, fit_on).toLocalIterator() if cols else ():
        cats[r["feature"]].append(r["value"])
    return {k: sorted(v) for k, v in cats.items()}


def _onehot_pairs(cats: Mapping[str, Sequence[str]]) -> list[tuple[str, Column]]:
    out = []
    for name, values in cats.items():
        x = c(name).cast("string")
        for i, v in enumerate(values):
            out.append((f"{name}{GROUP_SEPARATOR}{i}",
                        F.when(x == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0))))
    return out


def onehot_columns(cats: Mapping[str, Sequence[str]]) -> list[Column]:
    """J1 apply: ``{name}__{i}`` = 1.0 where the value is category i, else 0.0 (unknown: all 0)."""
    return [e.alias(n) for n, e in _onehot_pairs(cats)]


def apply_onehot(df: DataFrame, cats: Mapping[str, Sequence[str]]) -> DataFrame:
    keep = [c(n) for n in df.columns if n not in cats]
    return df.select(*keep, *onehot_columns(cats))


def ordinal_encode(df: DataFrame, col: str, codes: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Place of the value in the sorted values of the column; unknown or null -> -1."""
    if codes is None:
        codes = fit_codes(df, [col], None, None)
    mine = codes.where(F.col("feature") == col).select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    joined = df.join(mine, c(col).cast("string") == F.col("__v"), "left")
    return joined.withColumn(out or col, F.coalesce("__c", F.lit(-1))).drop("__v", "__c")


@dataclass(frozen=True)
class Moments:
    mean: float
    scale: float


def fit_scaler(df: DataFrame, cols: Sequence[str], split_col: str | None = "split",
               fit_on: Sequence[str] | None = ("train", "val")) -> dict[str, Moments]:
    """J2 fit: mean and population std per column in one aggregate; NaN/null skipped;
    zero (or undefined) std scales by 1."""
    if not cols:
        return {}
    rows = _fit_rows(df, split_col, fit_on)
    aggs = []
    for i, n in enumerate(cols):
        x = c(n).cast("double")
        ok = F.when(~F.isnan(x), x)
        aggs += [F.avg(ok).alias(f"m{i}"), F.stddev_pop(ok).alias(f"s{i}")]
    r = rows.agg(*aggs).first()
    out = {}
    for i, n in enumerate(cols):
        mean = r[f"m{i}"] if r[f"m{i}"] is not None else 0.0
        std = r[f"s{i}"]
        out[n] = Moments(mean, std if std else 1.0)
    return out


def scaled_columns(moments: Mapping[str, Moments]) -> list[Column]:
    return [((c(n).cast("double") - F.lit(m.mean)) / F.lit(m.scale)).alias(n) for n, m in moments.items()]


def apply_scaler(df: DataFrame, moments: Mapping[str, Moments]) -> DataFrame:
    keep = [c(n) for n in df.columns if n not in moments]
    return df.select(*keep, *scaled_columns(moments))


def onehot_summary(coded: DataFrame, codes: DataFrame, col: str) -> DataFrame:
    """Min, max, row count and width of a column's one-hot block, and the category count, from its codes.

    A block of k columns holds a 0 as soon as k > 1 or a row is unseen, and a 1
    as soon as a row is seen.
    """
    width = codes.where(F.col("feature") == col).agg(F.count(F.lit(1)).alias("width"))
    code = c(f"{col}{GROUP_SEPARATOR}{CODE}")
    rows = coded.agg(F.count(F.lit(1)).alias("rows"), F.count_if(code >= 0).alias("seen"))
    one = rows.withColumn("__j", F.lit(0)).join(width.withColumn("__j", F.lit(0)), "__j")
    some = (F.col("width") > 0) & (F.col("rows") > 0)
    return one.select(
        F.when(some, ((F.col("width") == 1) & (F.col("seen") == F.col("rows"))).cast("double")).alias("min"),
        F.when(some, (F.col("seen") > 0).cast("double")).alias("max"), "rows", "width", F.col("width").alias("categories"))


@dataclass(frozen=True)
class Layout:
    """Slots of an encoded row: (feature, first slot, width) by feature name."""
    features: tuple[tuple[str, int, int], ...]

    @staticmethod
    def of_widths(widths: Mapping[str, int]) -> "Layout":
        out, at = [], 0
        for name in sorted(widths):
            out.append((name, at, widths[name]))
            at += widths[name]
        return Layout(tuple(out))

    @staticmethod
    def of(df: DataFrame, col: str = FEATURES) -> "Layout":
        """The layout that a column of encoded rows carries (it survives writing and reading as Parquet)."""
        return Layout(tuple((x["name"], x["first"], x["width"]) for x in df.schema[col].metadata["layout"]))

    @property
    def names(self) -> list[str]:
        return [n for n, _, _ in self.features]

    @property
    def size(self) -> int:
        return sum(w for _, _, w in self.features)

    def metadata(self) -> dict:
        return {"layout": [{"name": n, "first": a, "width": w} for n, a, w in self.features]}

    def keep(self, names: Sequence[str]) -> "Layout":
        """The layout of the named features alone."""
        missing = set(names) - set(self.names)
        if missing:
            raise ValueError(f"unknown features: {sorted(missing)}")
        return Layout.of_widths({n: w for n, _, w in self.features if n in names})


def _vector(slots: Column, size: int | Column) -> Column:
    """The encoded row of an array of (slot, value) in slot order; its two fields are read as such, without a lambda call for each element."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.struct(size.cast("int").alias("size"), slots["slot"].alias("indices"), slots["value"].alias("values"))


def _slots(vector: Column) -> Column:
    return F.arrays_zip(vector["indices"].alias("slot"), vector["values"].alias("value"))


def fit_layout(codes: DataFrame | None, scalars: Sequence[str], categorical: Sequence[str]) -> Layout:
    """One slot for each scalar, one for each category of a categorical feature (counted; one row per feature comes back)."""
    widths = dict.fromkeys(scalars, 1) | dict.fromkeys(categorical, 0)
    if categorical:
        widths |= {r["feature"]: r["n"] for r in codes.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Layout.of_widths(widths)


def _scalars(moments: Mapping[str, Moments], booleans: Sequence[str]) -> dict[str, Column]:
    """The value of every feature of one slot, by name in order: scaled numerics, booleans as 0 or 1."""
    out = dict(zip(moments, scaled_columns(moments))) | {n: c(n).cast("double") for n in booleans}
    return {n: out[n] for n in sorted(out)}


def pack_scalars(df: DataFrame, moments: Mapping[str, Moments], booleans: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``df`` with the scalar features as one array that ``assemble`` reads, beside the columns of ``keep``.

    The joins of ``apply_codes`` then move one value a row in place of some dozens of columns.
    """
    values = [*_scalars(moments, booleans).values()]
    kept = [c(n) for n in df.columns if n in set(keep)]
    return df.select(*kept, (F.array(*values) if values else F.array().cast("array<double>")).alias(PACKED))


def assemble(df: DataFrame, layout: Layout, moments: Mapping[str, Moments], booleans: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """J4 + J1: ``features``, the sparse vector of scaled numerics, booleans and one-hot categories, beside the id and label columns.

    Categories come as code columns (``apply_codes``), scalars as columns or as
    one array (``pack_scalars``).  Nulls, zeros and unseen categories are empty
    slots.  Columns in name order.  Of packed rows, slots and values are plain
    arrays from which a mark for empty is removed: Spark interprets what a
    lambda's array is made of.
    """
    scalars = _scalars(moments, booleans)
    packed = PACKED in df.columns
    if packed:
        scalars = {n: F.get(F.col(PACKED), F.lit(i)) for i, n in enumerate(scalars)}
    pairs = []
    for name, first, _ in layout.features:
        if name in scalars:
            pairs.append((F.lit(first).cast("int"), scalars[name]))
        else:
            code = c(f"{name}{GROUP_SEPARATOR}{CODE}")
            pairs.append(((F.lit(first) + code).cast("int"), F.when(code >= 0, F.lit(1.0))))
    kept = [n for n in keep if n in df.columns]
    if packed and pairs:
        indices = F.array_remove(F.array(*[F.when(value != 0, slot).otherwise(F.lit(-1)) for slot, value in pairs]), -1)
        values = F.array_remove(F.array(*[F.coalesce(value, F.lit(0.0)) for _, value in pairs]), 0.0)
        vector = F.struct(F.lit(layout.size).cast("int").alias("size"), indices.alias("indices"), values.alias("values"))
    else:
        slots = [F.struct(slot.alias("slot"), value.alias("value")) for slot, value in pairs]
        stored = F.filter(F.array(*slots), lambda x: x["value"] != 0) if slots else F.array().cast("array<struct<slot:int,value:double>>")
        df = df.select(*[c(n) for n in kept], stored.alias("__slots"))  # a column of its own: the vector reads it twice
        vector = _vector(F.col("__slots"), layout.size)
    parts = {n: c(n).alias(n) for n in kept} | {FEATURES: vector.alias(FEATURES, metadata=layout.metadata())}
    return df.select(*[parts[k] for k in sorted(parts)])


def feature_groups(layout: Layout) -> dict[str, range]:
    """Logical feature -> its slots."""
    return {n: range(a, a + w) for n, a, w in layout.features}


def select_features(df: DataFrame, features: Sequence[str | int], keep: Sequence[str] | None = None, col: str = FEATURES) -> DataFrame:
    """The named (or positional) features' slots only, moved together; no feature named keeps all.  ``keep``: other columns (default all)."""
    layout = Layout.of(df, col)
    names = [layout.names[f] if isinstance(f, int) else f for f in features] or layout.names
    new = layout.keep(names)
    at = {n: a for n, a, _ in new.features}
    moves: list[tuple[int, int | None]] = []  # (first slot, its move; None drops), in slot order, equal neighbours as one
    for n, a, w in layout.features:
        by = at[n] - a if n in at else None
        if w and (not moves or moves[-1][1] != by):
            moves.append((a, by))

    def place(slot: Column, some: Sequence[tuple[int, int | None]]) -> Column:
        if len(some) <= 1:
            return F.lit(-1) if not some or some[0][1] is None else slot + some[0][1]
        half = len(some) // 2
        return F.when(slot < some[half][0], place(slot, some[:half])).otherwise(place(slot, some[half:]))

    moved = F.transform(c(col)["indices"], lambda x: place(x, moves))
    kept = F.array_compact(F.zip_with(moved, c(col)["values"], lambda x, v: F.when(x >= 0, v)))
    row = F.struct(F.lit(new.size).cast("int").alias("size"), F.array_remove(moved, -1).alias("indices"), kept.alias("values"))
    others = [n for n in (df.columns if keep is None else keep) if n in df.columns and n != col]
    return df.select(*[c(n) for n in others], row.alias(col, metadata=new.metadata()))


def hot_code(df: DataFrame, feature: str, col: str = FEATURES) -> Column:
    """The category code that an encoded row holds for ``feature``, -1 for none."""
    first, width = {n: (a, w) for n, a, w in Layout.of(df, col).features}[feature]
    mine = F.filter(c(col)["indices"], lambda i: (i >= first) & (i < first + width))
    return F.coalesce(F.get(mine, F.lit(0)) - first, F.lit(-1))


def sequence_vectors(df: DataFrame, id_col: str = "sequence_id", label_col: str = "sequence_label", step_col: str = "step",
                     col: str = FEATURES) -> DataFrame:
    """J6 flattened: one sparse vector per sequence, the rows' vectors one after another in step order, with label and split.

    A group holds exactly one sequence (a fixed number of rows), so collecting it is bounded.
    """
    width = Layout.of(df, col).size
    steps = F.sort_array(F.collect_list(F.struct(c(step_col).alias("step"), _slots(c(col)).alias("slots"))))
    flat = F.flatten(F.transform("__steps", lambda s, i: F.transform(
        s["slots"], lambda x: F.struct((i * width + x["slot"]).alias("slot"), x["value"].alias("value")))))
    grouped = df.groupBy(c(id_col)).agg(steps.alias("__steps"), F.max(c(label_col)).alias("label"), F.max("split").alias("split"))
    flat_rows = grouped.select(c(id_col), "label", "split", flat.alias("__slots"), (F.size("__steps") * width).alias("__size"))
    return flat_rows.select(c(id_col), "label", "split", _vector(F.col("__slots"), F.col("__size")).alias(col))


def as_ml_vectors(df: DataFrame, col: str = FEATURES) -> DataFrame:
    """``df`` with its encoded rows as vectors of the learning library.

    The table is written in the vectors' storage form and read back as vectors
    (training passes over it many times anyway), so no row goes through Python.
    """
    import uuid

    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    v = c(col)
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), v["size"].alias("size"), v["indices"].alias("indices"), v["values"].alias("values"))
    df = df.withColumn(col, stored)
    path = scratch_path(df.sparkSession, f"tables/vectors-{uuid.uuid4().hex[:12]}")
    drop_on_exit(df.sparkSession, path)
    df.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, VectorUDT() if f.name == col else f.dataType) for f in df.schema.fields])
    return df.sparkSession.read.schema(schema).parquet(path)


def sequence_matrix(df: DataFrame, features: Sequence[str], split: str | None = None,
                    id_col: str = "sequence_id", label_col: str = "sequence_label",
                    step_col: str = "step") -> DataFrame:
    """One row per sequence: ``matrix`` (steps x features, in step order) and label.

    A group holds exactly one sequence (a fixed number of rows), so collecting
    it is bounded.
    """
    if split is not None:
        df = df.filter(F.col("split") == split)
    vec = F.array(*[c(x).cast("double") for x in features])
    g = df.groupBy(c(id_col)).agg(
        F.sort_array(F.collect_list(F.struct(c(step_col).alias("s"), vec.alias("v")))).alias("__steps"),
        F.max(c(label_col)).alias(label_col))
    return g.select(c(id_col), F.transform("__steps", lambda x: x["v"]).alias("matrix"), c(label_col))
