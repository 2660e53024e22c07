"""Session helpers: local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
METHOD_CONF, METHOD_DEFAULT, METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit", "65535", "8000"
_written: list[str] = []


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "packetlens") -> SparkSession:
    """Build (or reuse) a session with the settings this library assumes.

    On a cluster the session already exists and carries its own configuration:
    a running session is returned as it is, nothing is set on it.
    """
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that value (or
    the context's checkpoint folder) is always used as is.  Only a ``local``
    master without either gets a fresh scratch folder; on a cluster a folder of
    one machine would lose data, so an unset setting is an error there.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        current = jdir.get() if jdir.isDefined() else None
    if not current and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        try:
            spark.conf.set(CHECKPOINT_CONF, current)
        except Exception:  # noqa: BLE001  (core setting not settable at runtime here)
            pass
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(current)
    return current


def bound_methods(spark: SparkSession) -> None:
    """Have wide projections run in methods that the JVM compiles.

    HotSpot never compiles a method of over 8,000 bytes of bytecode, and Spark
    makes one method of a whole stage up to 65,535: a projection of some dozens
    of columns then stays interpreted, at several times the cost a row.  With
    the limit that Spark's own documentation names for HotSpot such a stage is
    run in smaller methods.  Rows are the same; a value set by the session's
    owner is left as it is.
    """
    if spark.conf.get(METHOD_CONF, METHOD_DEFAULT) == METHOD_DEFAULT:
        spark.conf.set(METHOD_CONF, METHOD_LIMIT)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df, name: str):
    """Write ``df`` as a parquet table below the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` (survives executor loss: the files
    live in the shared folder) and later reads get column pruning and filter
    pushdown.  Every call takes a fresh folder, which ``drop_tables`` deletes
    once the results that read it are done with; on exit all are dropped.
    """
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"tables/{name}-{uuid.uuid4().hex[:12]}")
    drop_on_exit(spark, path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def drop_on_exit(spark: SparkSession, path: str) -> None:
    """Have ``path`` deleted by ``drop_tables``, which also runs when this process ends."""
    if not _written:
        atexit.register(drop_tables, spark)
    _written.append(path)


def tables_written() -> int:
    """How many intermediate tables are registered; a mark for ``drop_tables``."""
    return len(_written)


def drop_tables(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate tables that this process has written, or those after the mark ``since``.

    Nothing that still reads them may be used afterwards: write a result first.
    """
    while len(_written) > since and spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
