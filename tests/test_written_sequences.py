"""The sequence rows are cut once: what splits, fits and scores them reads a written table."""

import datetime

import pytest
from pyspark.sql import functions as F

from packetlens.operators import sampling
from packetlens.plans import queries_encode, queries_sampling, queries_selection


@pytest.fixture(scope="module")
def events_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    start = F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz")
    spark.range(400).select(
        F.col("id").alias("event_id"), (start + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("error", "signup", "click", "view", "purchase"))), (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
        F.col("id").cast("double").alias("value"), F.lit("x").alias("props")).write.parquet(f"{path}/events.parquet")
    return path


class Seen(Exception):
    pass


@pytest.mark.parametrize("build, columns", [
    (queries_encode._feats, {"event_id", "step"}), (queries_selection._scored, set(queries_selection.FEATURES)),
    (queries_sampling.q_stratified_split, {"event_id"}), (queries_sampling.q_stratified_sample, {"event_id", "step"})])
def test_draws_read_written_sequences_of_the_columns_they_use(spark, events_dir, monkeypatch, build, columns):
    def draw(rows, *_, **__):
        raise Seen(rows._jdf.queryExecution().optimizedPlan().toString(), rows.count(), rows.columns)

    monkeypatch.setattr(sampling, "stratified_split", draw)
    monkeypatch.setattr(sampling, "stratified_sample", draw)
    with pytest.raises(Seen) as seen:
        build(spark, events_dir)
    plan, n, found = seen.value.args
    assert n == 350  # 5 full sequences of each of the 7 streams
    assert set(found) == {"sequence_id", "sequence_label"} | columns  # before: all of the packets', payloads too
    assert "Window" not in plan and "Join" not in plan  # before: the split cut them for its hashes and again for its rows
