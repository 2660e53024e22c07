"""Readers and writers (inventory A1-A4).

Paths are any Hadoop-compatible URI; listing and existence checks go through
the cluster's FileSystem API, never the driver's local disk.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import c
from ..operators.schema import common_supertype, project


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def list_files(spark: SparkSession, directory: str, suffix: str = ".csv") -> list[str]:
    """Data files below ``directory`` (recursive), sorted; hidden/_ files skipped."""
    fs, p = _fs(spark, directory)
    it = fs.listFiles(p, True)
    out = []
    while it.hasNext():
        st = it.next()
        name = st.getPath().getName()
        if name.startswith((".", "_")) or not name.endswith(suffix):
            continue
        out.append(st.getPath().toString())
    return sorted(out)


def _override(schema: T.StructType, overrides: Mapping[str, T.DataType] | None) -> T.StructType:
    overrides = overrides or {}
    return T.StructType([T.StructField(f.name, overrides.get(f.name, f.dataType), True) for f in schema.fields])


def _reader(spark: SparkSession, multi_line: bool):
    """CSV by RFC 4180: a quote inside a quoted field is doubled; no other escape."""
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line))


def infer_csv_schema(spark: SparkSession, path: str | Sequence[str], sampling_ratio: float = 1.0,
                     overrides: Mapping[str, T.DataType] | None = None, multi_line: bool = False) -> T.StructType:
    inferred = (_reader(spark, multi_line).option("inferSchema", True)
                .option("samplingRatio", sampling_ratio).csv(path).schema)
    return _override(inferred, overrides)


def read_csv(spark: SparkSession, path: str | Sequence[str], overrides: Mapping[str, T.DataType] | None = None,
             schema: T.StructType | None = None, sampling_ratio: float = 1.0, multi_line: bool = False) -> DataFrame:
    """A1: RFC 4180 CSV with header; explicit schema, or an inferred one with per-column overrides.

    ``multi_line`` allows line breaks inside quoted fields; a file is then read
    by one task each, so keep it off for large files without such fields.

    Inference is an extra pass (bounded by ``sampling_ratio``); give ``schema``
    at scale.  The data pass always runs with an explicit schema.
    """
    if schema is None:
        schema = infer_csv_schema(spark, path, sampling_ratio, overrides, multi_line)
    return _reader(spark, multi_line).option("enforceSchema", False).schema(schema).csv(path)


#: What a text that reads as a whole number, or as a double, looks like at least.  Texts that don't (addresses, names, hex)
#: aren't parsed: a failed parse raises inside, at some microseconds each.
_DIGITS_ONLY = r"^[^0-9A-Za-z.]*[0-9]+[^0-9A-Za-z.]*$"
_NUMBER_LIKE = r"^[\x00-\x20]*[+-]?(?!0[xX][^pP]*$)[0-9.NnIi][0-9A-Za-z+-]*\.?[0-9A-Za-z+-]*[\x00-\x20]*$"
#: Types a CSV column may take, narrowest first, and the test of a text for each.
_CSV_TYPES: list[tuple[T.DataType, Callable[[Column], Column]]] = [
    (T.IntegerType(), lambda x: F.coalesce(F.when(x.rlike(_DIGITS_ONLY), x.try_cast("bigint")).between(-2**31, 2**31 - 1), F.lit(False))),
    (T.LongType(), lambda x: F.when(x.rlike(_DIGITS_ONLY), x.try_cast("bigint")).isNotNull()),
    (T.DoubleType(), lambda x: F.when(x.rlike(_NUMBER_LIKE), x.try_cast("double")).isNotNull()),
    (T.TimestampType(), lambda x: F.when(x.contains(":"), x.try_cast("timestamp")).isNotNull()),
    (T.BooleanType(), lambda x: F.lower(F.trim(x)).isin("true", "false")),
]


def csv_headers(spark: SparkSession, files: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Column names of every file, from its first line (a read of one line each)."""
    out = {}
    for path in files:
        line = spark.read.text(path).first()
        out[path] = tuple(next(csv.reader([line["value"].lstrip("\ufeff")]))) if line else ()
    return out


def _as_text(spark: SparkSession, headers: Mapping[str, tuple[str, ...]], multi_line: bool) -> list[DataFrame]:
    """Files of equal columns in one frame each, all columns as text."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, names in headers.items():
        groups.setdefault(names, []).append(path)
    return [_reader(spark, multi_line).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(paths)
            for names, paths in groups.items() if names]


def type_lattice(spark: SparkSession, files: Sequence[str], sampling_ratio: float = 1.0, multi_line: bool = False,
                 headers: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(file, column, values, fits): per file and column the number of values, and how many fit each type of ``_CSV_TYPES``.

    One pass over all files, whatever columns each has and in whatever order;
    the result has a row per file and column.
    """
    headers = headers or csv_headers(spark, files)
    per_group = []
    for df in _as_text(spark, headers, multi_line):
        names = df.columns
        rows = df.withColumn("__file", F.col("_metadata.file_path"))
        if sampling_ratio < 1.0:
            rows = rows.where(F.pmod(F.xxhash64(*[c(n) for n in names], "__file"), F.lit(1 << 30)) < int(sampling_ratio * (1 << 30)))
        # one small aggregate over (column, value) instead of six for each column, which no compiler takes
        values = rows.select(F.col("__file").alias("file"), F.inline(F.array(*[
            F.struct(F.lit(n).alias("column"), c(n).alias("value")) for n in names])))
        # tests in a projection of their own, where what they share is computed once
        tests = [fits(F.col("value")).alias(f"__fits{i}") for i, (_, fits) in enumerate(_CSV_TYPES)]
        per_group.append(values.select("file", "column", "value", *tests).groupBy("file", "column").agg(
            F.count("value").alias("values"), F.array(*[F.count_if(f"__fits{i}") for i in range(len(tests))]).alias("fits")))
    return reduce(DataFrame.unionByName, per_group)


def merged_types(lattice: DataFrame) -> dict[str, T.DataType]:
    """B1 over the files: the common type of each column's narrowest types; text if it has no value anywhere."""
    found: dict[str, list[T.DataType]] = {}
    for r in lattice.collect():  # a row per file and column
        mine = found.setdefault(r["column"], [])
        if r["values"]:
            mine.append(next((t for (t, _), n in zip(_CSV_TYPES, r["fits"]) if n == r["values"]), T.StringType()))
    return {n: common_supertype(types) if types else T.StringType() for n, types in found.items()}


def read_csv_files(spark: SparkSession, files: Sequence[str], overrides: Mapping[str, T.DataType] | None = None,
                   sampling_ratio: float = 1.0, multi_line: bool = False) -> DataFrame:
    """CSV files that may differ in columns and their order, as one frame: columns by name, each of the common type of
    all files (``merged_types``), null where a file lacks it; ``__path`` is the file of a row.

    Values that a sampled inference got wrong become null.
    """
    headers = csv_headers(spark, files)
    types = merged_types(type_lattice(spark, files, sampling_ratio, multi_line, headers)) | dict(overrides or {})
    names = list(dict.fromkeys(n for h in headers.values() for n in h))
    frames = []
    for df in _as_text(spark, headers, multi_line):
        have = set(df.columns)
        cast = lambda n: c(n) if types[n] == T.StringType() else c(n).try_cast(types[n])
        frames.append(df.select(*[(cast(n) if n in have else F.lit(None).cast(types[n])).alias(n) for n in names],
                                F.col("_metadata.file_path").alias("__path")))
    return reduce(DataFrame.unionByName, frames)


def read_labelled_dir(spark: SparkSession, directory: str, benign_prefix: str = "legitimate",
                      overrides: Mapping[str, T.DataType] | None = None, label_from: str = "file",
                      sampling_ratio: float = 1.0, schema: T.StructType | None = None,
                      multi_line: bool = False) -> DataFrame:
    """A2 + B1: every CSV of a directory, labelled by where it lies.

    ``attack_type`` is the file stem (``label_from="file"``) or the parent folder
    name (``"dir"``, ``key=value`` folders give the value); ``attack_label`` is
    true unless it starts with ``benign_prefix``.  Without ``schema``, one pass
    over all files gives the type of every column in every file, and a column
    has their common type (B1); files may have different columns in any order.
    """
    files = list_files(spark, directory)
    if not files:
        raise FileNotFoundError(f"no CSV files below {directory}")
    if schema is None:
        df = read_csv_files(spark, files, overrides, sampling_ratio, multi_line)
    else:
        df = read_csv(spark, files, overrides, schema, sampling_ratio, multi_line).withColumn("__path", F.col("_metadata.file_path"))
    if label_from == "file":
        label = F.regexp_replace(F.regexp_extract("__path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    elif label_from == "dir":
        label = F.regexp_extract("__path", r"([^/=]+)/[^/]+$", 1)
    else:
        raise ValueError("label_from must be 'file' or 'dir'")
    df = df.withColumn("attack_type", label).drop("__path")
    return df.withColumn("attack_label", ~F.col("attack_type").startswith(benign_prefix))


def fingerprint(spark: SparkSession, source: str, **parameters) -> str:
    """A text that changes when a file below ``source`` is added, removed or rewritten, or a parameter changes.

    Names, sizes and times of the files are listed and combined in Spark; no content is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    r = found.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"),
                  F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("x")).first()
    return json.dumps({"files": [r["n"], r["b"], r["x"]], **parameters}, sort_keys=True, default=str)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame],
           partition_by: Sequence[str] = (), key: str | None = None) -> DataFrame:
    """A3: read-through parquet cache: read ``path`` if a finished write is there (``_SUCCESS``), else build, write, read back.

    With ``key`` (see ``fingerprint``) a manifest beside the table says what it
    was built from, and another key builds it anew.  The manifest is written
    last, so a table whose write stopped half-way is never taken.
    """
    path = path.rstrip("/")
    manifest = f"{path}.manifest"
    fresh = path_exists(spark, f"{path}/_SUCCESS")
    if key is not None:
        fresh = fresh and path_exists(spark, f"{manifest}/_SUCCESS") and spark.read.text(manifest, wholetext=True).first()["value"].strip() == key
    if not fresh:
        if key is not None:
            remove(spark, manifest)
        w = build().write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        if key is not None:
            spark.createDataFrame([(key,)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
    return spark.read.parquet(path)


# Fixed value: the experiment-results schema (13 fields).
RESULTS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("dataset", T.StringType()),
    T.StructField("sequence_length", T.LongType()), T.StructField("random_state", T.LongType()),
    T.StructField("best_fitness_gp", T.ArrayType(T.DoubleType())),
    T.StructField("features_count_gp", T.LongType()),
    T.StructField("features_gp", T.ArrayType(T.StringType())),
    T.StructField("test_accuracy", T.DoubleType()), T.StructField("test_precision", T.DoubleType()),
    T.StructField("test_recall", T.DoubleType()), T.StructField("test_f1", T.DoubleType()),
    T.StructField("test_auroc", T.DoubleType()),
    T.StructField("test_confusion_matrix", T.ArrayType(T.DoubleType())),
])


#: What names one experiment.
RESULTS_KEY = ["dataset", "model", "sequence_length", "random_state"]


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """A4: append experiment rows (cast to the results schema) to a parquet table."""
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULTS_SCHEMA.fields]) \
        .write.mode(mode).parquet(path)


def put_results(df: DataFrame, path: str) -> None:
    """A4 keyed by ``RESULTS_KEY``: rows lie in one folder per experiment, and writing an experiment again replaces its folder.

    A grid that stops and starts anew so leaves no row twice.
    """
    rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULTS_SCHEMA.fields])
    rows.write.partitionBy(*RESULTS_KEY).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows written so far, in the results schema; none if nothing is there."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], RESULTS_SCHEMA)
    return project(spark.read.schema(RESULTS_SCHEMA).parquet(path), RESULTS_SCHEMA.fieldNames())
