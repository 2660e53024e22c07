"""Quality rules, n-gram join and decontamination against plain Python, and on edge tables."""

import re
from collections import Counter

import pytest

from packetlens.llm import decontaminate, ngram_join, quality_rules
from plain import SF, plain_words



def plain_stats(text):
    ws = plain_words(text)
    t = text or ""
    seen = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    cover = {i + k for i in range(len(ws) - 4) if seen[tuple(ws[i:i + 5])] > 1 for k in range(5)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if plain_words(line):
            dup += line in lines
            lines.add(line)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(cover))


def test_statistics_match_plain_python(spark, docs, edge_rows):
    rows = edge_rows + [(20, "a b c d e f a b c d e x a b c d e", "a"), (21, "z " * 40, "a"), (22, "## a b $|<> %", "a")]
    for _, text, *_ in rows:
        assert quality_rules.text_stats(text)[:5] == plain_stats(text)


def test_quality_query(spark):
    import __spark_entry__ as E
    got = {r["doc_id"]: r for r in E.queries()["op9_quality_rules"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        g, want = got[r["doc_id"]], plain_stats(r["text"])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (g["base_failed"] and g["kept"])


def test_forest_rejects_held_out_bad_rows_and_keeps_good_ones(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit_on, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = quality_rules.judge_ids(docs, fit_on).join(held, "doc_id").where("NOT quality_rules.base_failed")
    rows = judged.selectExpr("quality", "int(quality_rules.kept) AS k").toPandas()
    rate = rows.groupby("quality")["k"].mean()
    assert rate[1] >= 0.99 and rate[0] <= 0.2


def test_verdict_survives_wrong_labels(spark):
    """A few flipped labels, and documents labelled both ways, leave the forest's verdict on held-out rows."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    fit_on, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    bad = fit_on.where("quality = 0").orderBy("doc_id").limit(2)
    flipped = fit_on.join(bad.select("doc_id"), "doc_id", "left_anti").union(bad.selectExpr("doc_id", "1L"))
    for noisy in (flipped, fit_on.union(bad.selectExpr("doc_id", "1L"))):
        judged = quality_rules.judge_ids(docs, noisy).join(held, "doc_id").where("NOT quality_rules.base_failed")
        rate = judged.selectExpr("quality", "int(quality_rules.kept) AS k").toPandas().groupby("quality")["k"].mean()
        assert rate[1] >= 0.98 and rate[0] <= 0.2


def test_verdict_survives_the_worst_rows_labelled_good(spark):
    """The two highest-scored bad rows of the fitted half carry the wrong label; held-out rows are judged as before."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    fit_on, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    scored = quality_rules.judge_ids(docs, fit_on).join(fit_on.where("quality = 0"), "doc_id").where("NOT quality_rules.base_failed")
    worst = [r["doc_id"] for r in scored.selectExpr("doc_id", "quality_rules.score AS s").orderBy("s", ascending=False).limit(2).collect()]
    flipped = fit_on.where(~fit_on["doc_id"].isin(worst)).union(spark.createDataFrame([(d, 1) for d in worst], fit_on.schema))
    judged = quality_rules.judge_ids(docs, flipped).join(held, "doc_id").where("NOT quality_rules.base_failed")
    rate = judged.selectExpr("quality", "int(quality_rules.kept) AS k").toPandas().groupby("quality")["k"].mean()
    assert rate[1] >= 0.98 and rate[0] <= 0.1


def test_quality_edges(spark, docs, edge_rows):
    df = docs(edge_rows)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (6, None, 0)], "doc_id long, quality long, toxic long")
    out = quality_rules.keep_good(df, labels)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 2, 2, 6, 7]
    assert quality_rules.keep_good(docs([]), labels).count() == 0


def plain_components(rows, n, percent):
    sets = []
    for i, (d, t) in enumerate(rows):
        ws = plain_words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(ws[k:k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_components_match_all_pairs(spark, docs, edge_rows, n, percent):
    import random
    rng = random.Random(5)
    rows = [(d, t) for d, t, *_ in edge_rows]
    base = [f"t{i}" for i in range(60)]
    for k in range(40):  # a chain and a cloud of near copies, with clean rows between
        ws = list(base)
        for _ in range(rng.randrange(4)):
            ws[rng.randrange(60)] = f"m{rng.randrange(1000)}"
        rows.append((100 + k, " ".join(ws)))
        rows.append((200 + k, " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(30))))
    rows += [(300, "A b"), (301, "a B"), (302, "a  b"), (303, "a"), (304, "one two three four"), (305, "One two three four")]
    got = ngram_join.components(docs(rows), ngram_join.JoinParams(n, percent))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == plain_components(rows, n, percent)


@pytest.mark.parametrize("pairs_each", [0, 8])
def test_families_of_one_template(spark, docs, pairs_each):
    """Texts alike by half, from one template with fillings of a small vocabulary; a few are near copies of each other."""
    import random
    rng = random.Random(8)
    template = [f"t{i}" for i in range(50)]
    rows = []
    for k in range(90):
        filling = [f"f{rng.randrange(4)}" for _ in range(40)]
        rows.append((k, " ".join(template + filling)))
        if k % 15 == 0:
            ws = template + filling
            ws[70] = "changed"
            rows.append((500 + k, " ".join(ws)))
    p = ngram_join.JoinParams(4, 85, pairs_each=pairs_each, block_sets=16)
    got = ngram_join.components(docs(rows), p)
    want = plain_components(rows, 4, 85)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == want
    assert sum(d != c for d, _, c in want) >= 6


def test_first_token_bound_is_safe():
    """Any two sets that link meet often enough among their first tokens (checked over random sets)."""
    import random
    rng = random.Random(3)
    for percent in (80, 85):
        for _ in range(3000):
            n = rng.randrange(1, 60)
            a = set(rng.sample(range(400), n))
            b = set(a)
            for _ in range(rng.randrange(0, n // 5 + 2)):
                if b and rng.random() < 0.6:
                    b.discard(rng.choice(sorted(b)))
                else:
                    b.add(rng.randrange(400))
            if not b or 100 * len(a & b) < percent * len(a | b):
                continue
            first = lambda s: set(sorted(s)[:ngram_join.first_length(len(s), percent)])
            meets = len(first(a) & first(b))
            assert meets >= ngram_join.needed(len(a), percent) and meets >= ngram_join.needed(len(b), percent)


def test_keep_first_keeps_one_of_each_group(spark, docs, edge_rows):
    df = docs(edge_rows)
    out = ngram_join.keep_first(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out.collect()) == [-1, 1, 3, 4, 5, 6, 8, 9]
    assert ngram_join.keep_first(docs([])).count() == 0


def plain_leaks(docs, items, size=5, share=0.8):
    out = set()
    for i, t in docs:
        ws = decontaminate.terms(t)
        for j, x in items:
            item = decontaminate.terms(x)
            k = min(size, len(item))
            need = set(decontaminate.grams(item, size))
            have = {tuple(ws[q:q + k]) for q in range(len(ws) - k + 1)}
            if need and len(need & have) >= share * len(need) - 1e-9:
                out.add((i, j))
    return out


def test_leaks_match_brute_force(spark):
    import __spark_entry__ as E
    got = {(r["doc_id"], r["item_id"]) for r in E.queries()["op6_decontamination"](spark, SF).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got == plain_leaks(docs, items) and got


def test_altered_leaks_shards_and_edges(spark, docs, edge_rows):
    item = " ".join(f"q{i}" for i in range(30)) + ". " + " ".join(f"a{i}" for i in range(12)) + "."
    items = [(0, item), (1, "short one"), (2, ""), (3, None), (None, "x y z"), (4, item)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = item.split()
    near = words[:20] + ["CHANGED"] + words[21:]
    far = words[:10] + ["x"] + words[11:18] + ["y"] + words[19:26] + ["z"] + words[27:34] + ["v"] + words[35:]
    rows = [(50, "lead in " * 300 + item.upper() + " and out " * 200), (51, " ".join(near)), (52, " ".join(far)), (53, "a short, one!")]
    rows += [(d, t) for d, t, *_ in edge_rows]
    df = docs(rows)
    want = {(50, 0), (50, 4), (51, 0), (51, 4), (53, 1)}
    for p in (decontaminate.LeakParams(), decontaminate.LeakParams(shard_items=2, block=1)):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench, p).collect()} == want
    clean = decontaminate.keep_clean(df, bench)
    assert clean.columns == df.columns and clean.count() == len(rows) - 3
    assert decontaminate.keep_clean(docs([]), bench).count() == 0
    assert decontaminate.keep_clean(df, bench.limit(0)).count() == len(rows)


def test_short_copies_with_an_edit_and_lone_questions(spark, docs):
    """One edit anywhere in a short item, a question without its answer, and parts that stand apart are leaks."""
    q, a = [f"q{i}" for i in range(11)], [f"a{i}" for i in range(8)]
    bench = spark.createDataFrame([(0, " ".join(q) + "? " + " ".join(a) + "."), (1, " ".join(f"s{i}" for i in range(15)) + "."),
                                   (2, "Why so? " + " ".join(f"b{i}" for i in range(9)) + "."),
                                   (3, "which town is the capital of x1? " + " ".join(f"c{i}" for i in range(6)) + ".")], "item_id long, text string")
    item, one = q + a, [f"s{i}" for i in range(15)]
    rows, want = [], set()

    def add(ws, *items):
        rows.append((len(rows), "lead in words " + " ".join(ws) + " and then out"))
        want.update((len(rows) - 1, i) for i in items)

    for x, i in ((item, 0), (one, 1)):
        for k in range(len(x)):
            add(x[:k] + ["new"] + x[k + 1:], i)
            add(x[:k] + x[k + 1:], i)
            add(x[:k] + ["new"] + x[k:], i)
    add(q, 0)
    add(q[:5] + ["new"] + q[6:], 0)
    add(q[:5] + ["new"] + q[6:] + ["the", "answer", "is"] + a, 0)
    add(["why", "so", "answer"] + [f"b{i}" for i in range(9)], 2)
    add("which town is the capital of x1".split(), 3)
    # no leaks: an answer alone, two edits in a short question, a question of two words, a short question with another word
    add(a)
    add(q[:3] + ["new"] + q[4:8] + ["new"] + q[9:])
    add(["why", "so"])
    add("which town is the capital of x2".split())
    for p in (decontaminate.LeakParams(), decontaminate.LeakParams(block=1)):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(rows), bench, p).collect()} == want
