"""Corpus preparation: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps;
all but the last return the columns of ``documents``.  Stages are written as
Parquet and read again by the next one.  Nulls, empty texts, repeated rows and
further columns are treated as the operators' docstrings say; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetlens.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from packetlens.llm.common import Scratch, table
from packetlens.plans.registry import query
from packetlens.session import drop_tables, tables_written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the isolation forest, calibrated on ``labels``, accept."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingles at 80 %."""
    return ngram_join.keep_first(docs, ngram_join.JoinParams(5, 80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target shares of words."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in uniformly shuffled shards 0 to 7 with gapless slots."""
    return sharding.shard(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]

#: The isolation forest and the components can't be stated in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        mark = tables_written()
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{i}")
        drop_tables(spark, mark)  # the stage's own tables: its result is written
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs


@query("pipeline", ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over the whole ``documents`` table: shuffled shards of the mixed, clean documents."""
    return run(spark, sf_dir)
