"""The corpus pipeline, stage by stage, against brute force on a small table."""

from collections import Counter

import corpus_pipeline
from packetlens.llm import quality_rules
from packetlens.llm.common import table
from plain import plain_words
from test_filters import plain_components, plain_leaks, plain_stats

SF = "/root/testdata/sf0.001"


def key(r):
    return r["doc_id"], r["text"]


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    out, tables = docs, [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, SF)
        rows = out.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out = spark.createDataFrame(rows, docs.schema)  # the next stage reads what this one kept
        tables.append(rows)
    start, good, single, clean, mixed, sharded = tables
    # quality: nothing that the fixed rules reject stays; of the rows they leave, nearly all labelled good
    # stay and nearly all labelled bad go (some labels are wrong: the cut is the one of best balanced accuracy)
    failed = {key(r) for r in start if (s := plain_stats(r["text"]))[0] < 10 or 100 * s[4] > 20 * s[0]}
    assert not failed & {key(r) for r in good} and set(map(key, good)) <= set(map(key, start))
    kept = set(map(key, good))
    for quality, least, most in ((1, 0.95, 1.0), (0, 0.0, 0.05)):
        labelled = {r["doc_id"] for r in table(spark, SF, "labels").where(f"quality = {quality}").collect()}
        judged = [key(r) in kept for r in start if r["doc_id"] in labelled and key(r) not in failed]
        assert judged and least <= sum(judged) / len(judged) <= most
    # near duplicates: the smallest doc_id of each component
    comps = plain_components([(r["doc_id"], r["text"]) for r in good], 5, 80)
    assert {r["doc_id"] for r in single} == {c for _, _, c in comps}
    # decontamination: exactly the rows without a benchmark item
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    dirty = {d for d, _ in plain_leaks([(r["doc_id"], r["text"]) for r in single], items)}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single} - dirty
    # mixing: whole copies, at most two, words near 150 %
    size = lambda rows: sum(len(plain_words(r["text"])) for r in rows)
    copies = Counter(map(key, mixed))
    assert set(copies) <= set(map(key, clean)) and max(copies.values()) <= 2
    longest = max(len(plain_words(r["text"])) for r in clean)
    sources = len({r["source"] for r in clean})
    assert abs(size(mixed) - 1.5 * size(clean)) <= longest * sources
    # sharding: every row once, shard sizes at most one apart
    assert Counter(map(key, sharded)) == copies
    per = Counter(r["shard"] for r in sharded)
    assert max(per.values()) - min(per.values()) <= 1
    assert len({(r["shard"], r["slot"]) for r in sharded}) == len(sharded)


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_null_rows_pass_every_stage(spark, docs, edge_rows):
    out = docs(edge_rows)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.count() > 0 and {"shard", "slot"} <= set(out.columns)
    assert quality_rules.keep_good(docs([]), table(spark, SF, "labels")).count() == 0
