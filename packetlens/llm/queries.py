"""Registered queries of the training-data operators: each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from .common import Scratch, table
from . import (chat_format, decontaminate, divergence, licenses, line_dedup, mixing, ngram_join, pii, quality_rules, secret_scan, sharding,
               spelling, token_output)


def _n_of(spans: Column, kind: Column) -> Column:
    """Number of the spans of a kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every document, the fixed rules and the forest's verdict calibrated on labels."""
    judged = quality_rules.judge_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    q = F.col("quality_rules")
    return judged.select("doc_id", *[q[c].alias(c) for c in quality_rules.STATS[:5]],
                         q["base_failed"].alias("base_failed"), q["score"].alias("score"), q["kept"].alias("kept"))


@query("op5_ngram_jaccard_join", ngram_join.SQL)
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 4-word shingle links of 85 % similarity, by groups and their token unions."""
    return ngram_join.components(table(spark, sf_dir, "documents"), ngram_join.JoinParams(4, 85)).select(
        "doc_id", "n_shingles", "component_id")


@query("op4_mixing", mixing.SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, at 5 : 2 : 1 source weights and 150 % of all words."""
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard 0 to 7 and gapless slot of every document: a uniform shuffle, row counts at most one apart."""
    return sharding.shard_sizes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item, the BM25 score of its passage and the overlaps."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_line_dedup", line_dedup.SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that go because an earlier line equals them or is within one word edit."""
    return line_dedup.document_digests(line_dedup.line_decisions(table(spark, sf_dir, "documents")))


@query("op3_token_ids")
def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, written in ranked variable-length blocks and read back from the files."""
    import public_tokenizers
    p = token_output.TokenParams(public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.token_table(table(spark, sf_dir, "documents"), p)


@query("op8_chat_format")
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, in budgeted windows; digests read back from the written rows."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    own = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{tricky}'), (-1L, 1L, 'assistant', '{tricky}') AS t(conv_id, turn, role, text)")
    written = Scratch(spark, "chat").keep(chat_format.windows(turns.unionByName(own)), "windows")
    return chat_format.read_back(written)


def _as_files(documents: DataFrame) -> DataFrame:
    """``documents`` as files: a path from source, lang and doc_id; every 40th is a LICENSE file of its source or language folder."""
    number = F.coalesce(F.col("doc_id"), F.lit(-1))
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    path = (F.when(number % 80 == 0, F.concat_ws("/", source, F.concat(F.lit("LICENSE-"), number.cast("string"))))
            .when(number % 40 == 0, F.concat_ws("/", source, lang, F.concat(F.lit("LICENSE-"), number.cast("string"))))
            .otherwise(F.concat_ws("/", source, lang, F.pmod(F.floor(number / 40), F.lit(50)).cast("string"),
                                   F.concat(number.cast("string"), F.lit(".txt")))))
    return documents.select("doc_id", path.alias("path"), "text")


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document as a file: its own notice by TF-IDF cosine, or the nearest directory's licence file."""
    return licenses.scan(_as_files(table(spark, sf_dir, "documents"))).select(
        "doc_id", "path", "licence", "licence_by", "licence_cosine", "licence_dir")


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document: strict patterns, and candidates that the trained span classifier accepts."""
    spans = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    counts = [_n_of(base, F.lit(k)).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return spans.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


@query("op11_secret_scan")
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: strict patterns, and runs that the character models find random."""
    spans = secret_scan.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    counts = [_n_of(base, F.lit(k)).alias(f"n_{k}") for k in secret_scan.KINDS[:3]]
    return spans.select("doc_id", *counts, F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
                        secret_scan.span_text(F.col("spans")).alias("spans"))


@query("op12_spelling_variants", spelling.SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the far more frequent word one edit away, and the last word that such steps reach."""
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query("op13_source_divergence", divergence.SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the word distributions of all sources of a language, and each source's most telling terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))
