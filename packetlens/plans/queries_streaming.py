"""Registered streaming query: packets read as a file stream, sessionized with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files
from ..streaming.sessions import sessionize_stream
from .captures import fresh_path
from .queries import SESSION_SQL, TIMEOUT_US, _OPEN_JOIN
from .registry import query
from .standins import PACKETS_SQL, SPARK_US, packets, table


@query("stream_sessionize", SESSION_SQL.replace("{OPEN}", _OPEN_JOIN) + "SELECT event_id, session_id FROM sessions")
def q_stream_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 on Structured Streaming: events as a parquet file stream -> packets view ->
    per-key stateful sessionization -> parquet sink (run to completion), read back."""
    schema = table(spark, sf_dir, "events").schema
    events = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("pathGlobFilter", "events.parquet").parquet(sf_dir.rstrip("/")))
    pk = spark.sql(PACKETS_SQL.replace("{US}", SPARK_US), events=events)
    s = sessionize_stream(pk, "stream_id", "ts_us", TIMEOUT_US, tiebreak=["event_id"], is_tcp=True,
                          syn="syn", ack="ack", fin="fin", rst="rst")
    out, ck = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-ck")
    q = (s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("event_id", "session_id")


#: Micro-batches that the unordered stream is read in, at most one more.
BATCHES = 8


def late_files(spark: SparkSession, pk: DataFrame, day: int) -> str:
    """Write the packets as files that mix up to three days: portions of one day of arrival, one after another, of as
    many files each as there are tasks; a last packet moves the watermark past the others.

    The portions are dealt in one pass over the packets and then copied in their order, each read once.
    """
    last = pk.agg(F.max("ts_us").alias("t")).first()["t"]
    late = F.col("ts_us") + F.pmod(F.xxhash64("event_id"), F.lit(3 * day))
    src, dealt = fresh_path(spark, "stream-in"), fresh_path(spark, "stream-dealt")
    fields = [F.col(n).cast(t) for n, t in pk.dtypes]
    portion = F.coalesce(F.floor(late / day), F.lit(-1)).cast("long")
    pk.select(*fields, portion.alias("__file")).write.partitionBy("__file").parquet(dealt)
    found = spark.read.schema(T.StructType([*pk.schema.fields, T.StructField("__file", T.LongType())])).parquet(dealt)
    portions = [r["__file"] for r in found.select("__file").distinct().orderBy("__file").collect()]  # one a day
    for k, day_of in enumerate(portions):
        found.where(F.col("__file") == day_of).drop("__file").write.parquet(f"{src}/p{k:05d}")
    end = pk.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "stream_id": F.lit("end"), "ts_us": F.lit(last + 30 * day).cast("long")})
    end.select(fields).write.parquet(f"{src}/p{len(portions):05d}")
    return src


@query("stream_sessionize_unordered", SESSION_SQL.replace("{OPEN}", _OPEN_JOIN) + "SELECT event_id, session_id FROM sessions")
def q_stream_sessionize_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 by event time: the packets in files that mix up to three days, with a watermark of four, give the batch sessions."""
    day = 86_400 * 1_000_000
    pk = packets(spark, sf_dir)
    src = late_files(spark, pk, day)
    # a portion is a day, so with three days of mixing a file's packets are at most four older than any before: files may come in any number
    per_batch = max(1, -(-len(files.list_files(spark, src, ".parquet")) // BATCHES))
    stream = spark.readStream.schema(pk.schema).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True).parquet(src)
    s = sessionize_stream(stream, "stream_id", "ts_us", TIMEOUT_US, tiebreak=["event_id"], is_tcp=True, syn="syn", ack="ack", fin="fin", rst="rst",
                          delay="4 days", seconds=1e-6)
    out, ck = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-ck")
    q = (s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).where("event_id >= 0").select("event_id", "session_id")
