"""Streaming sessionization equals the batch operator across several micro-batches."""

import random

from pyspark.sql import functions as F

from packetlens.operators import sessions as S
from packetlens.streaming.sessions import sessionize_stream

SCHEMA = "id long, key string, t double, tcp boolean, syn int, ack int, fin int, rst int"


def test_stream_matches_batch(spark, tmp_path):
    rnd = random.Random(11)
    rows = [(i, f"k{rnd.randint(0, 3)}", float(i * 7 + rnd.randint(0, 5)), True, int(rnd.random() < 0.1),
             int(rnd.random() < 0.3), int(rnd.random() < 0.05), int(rnd.random() < 0.03)) for i in range(300)]
    src = tmp_path / "src"
    for part, lo in enumerate(range(0, 300, 100)):  # three time-ordered files -> three micro-batches
        spark.createDataFrame(rows[lo:lo + 100], SCHEMA).coalesce(1).write.parquet(str(src / f"p{part}"))
    batch = S.sessionize(spark.createDataFrame(rows, SCHEMA), "key", "t", 20, tiebreak=["id"],
                         is_tcp=F.col("tcp"), syn="syn", ack="ack", fin="fin", rst="rst", bucket_width=100.0)
    expected = {r["id"]: r["session_id"] for r in batch.collect()}
    for mode in ("join", "split"):
        stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", True).parquet(str(src)))
        s = sessionize_stream(stream, "key", "t", 20, tiebreak=["id"], is_tcp=F.col("tcp"), syn="syn",
                              ack="ack", fin="fin", rst="rst", after_close=mode)
        out, ck = tmp_path / f"out-{mode}", tmp_path / f"ck-{mode}"
        q = (s.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(ck))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        got = {r["id"]: r["session_id"] for r in spark.read.parquet(str(out)).collect()}
        if mode == "join":
            assert got == expected
        else:
            ref = S.sessionize(spark.createDataFrame(rows, SCHEMA), "key", "t", 20, tiebreak=["id"],
                               is_tcp=F.col("tcp"), syn="syn", ack="ack", fin="fin", rst="rst",
                               after_close="split", bucket_width=100.0)
            assert got == {r["id"]: r["session_id"] for r in ref.collect()}


def _run(spark, src, out, ck, **options):
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False)
              .option("recursiveFileLookup", True).parquet(str(src)))
    s = sessionize_stream(stream, "key", "t", 20, tiebreak=["id"], is_tcp=F.col("tcp"), syn="syn", ack="ack", fin="fin", rst="rst", **options)
    q = (s.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(ck)).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(str(out)).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["session_id"] for r in rows}


def test_unordered_stream_matches_batch(spark, tmp_path):
    """Packets up to 100 s late, some without a time, keys that fall silent: the batch result once the watermark has passed."""
    rnd = random.Random(12)
    rows = [(i, f"k{rnd.randint(0, 4)}", float(i * 5) if i % 50 or i > 40 else None, True, int(rnd.random() < 0.1),
             int(rnd.random() < 0.3), int(rnd.random() < 0.05), int(rnd.random() < 0.03)) for i in range(400)]
    rows.append((400, "end", 10_000.0, True, 0, 0, 0, 0))
    late = lambda r: -1 if r[2] is None else r[2] + rnd.uniform(0, 90) if r[1] != "end" else 1e9
    dealt = sorted(rows, key=late)
    src = tmp_path / "src"
    for part, lo in enumerate(range(0, 401, 58)):
        spark.createDataFrame(dealt[lo:lo + 58], SCHEMA).coalesce(1).write.parquet(str(src / f"p{part}"))
    for mode in ("join", "split"):
        batch = S.sessionize(spark.createDataFrame(rows, SCHEMA), "key", "t", 20, tiebreak=["id"], is_tcp=F.col("tcp"), syn="syn", ack="ack",
                             fin="fin", rst="rst", after_close=mode)
        want = {r["id"]: r["session_id"] for r in batch.collect() if r["key"] != "end"}
        got = _run(spark, src, tmp_path / f"o-{mode}", tmp_path / f"c-{mode}", delay="100 seconds", after_close=mode)
        got.pop(400, None)
        assert got == want


def test_silent_keys_are_forgotten(spark, tmp_path):
    def one(i, key, t):
        return (i, key, float(t), True, 0, 0, 0, 0)
    files = [[one(0, "a", 10), one(1, "a", 110)], [one(2, "b", 5_000)], [one(3, "b", 5_001)], [one(4, "a", 6_000), one(5, "b", 6_001)], [one(6, "b", 9_000)]]
    src = tmp_path / "src"
    for part, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(src / f"p{part}"))
    kept = _run(spark, src, tmp_path / "o1", tmp_path / "c1", delay="1 second")
    gone = _run(spark, src, tmp_path / "o2", tmp_path / "c2", delay="1 second", expire=1_000)
    assert (kept[0], kept[1], kept[4]) == ("a_0", "a_1", "a_2") and (gone[0], gone[1], gone[4]) == ("a_0", "a_1", "a_0")


def test_unordered_query_keeps_packets_of_portions_in_several_files(spark, tmp_path):
    """A portion of the stream lies in as many files as there are tasks: no packet may come too late within its portion."""
    from packetlens.plans.queries import _sessionized
    from packetlens.plans.queries_streaming import q_stream_sessionize_unordered

    rnd = random.Random(13)
    kinds = ["click", "view", "error", "signup", "purchase"]
    events = spark.range(600).select(
        F.col("id").alias("event_id"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, pmod(xxhash64(id), 1900000))").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod(F.hash("id"), F.lit(5)) + 1).cast("int")).alias("event_type"),
        F.lit(rnd.random()).alias("value"), F.lit("{}").alias("props"))
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    want = {r["event_id"]: r["session_id"] for r in _sessionized(spark, str(tmp_path)).collect()}
    rows = q_stream_sessionize_unordered(spark, str(tmp_path)).collect()
    assert len(rows) == 600
    assert {r["event_id"]: r["session_id"] for r in rows} == want
