"""Line dedup, sharding, mixing, token output, personal data, chat and licences against plain Python, and on edge tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlens.llm import chat_format, licenses, line_dedup, mixing, pii, sharding, token_output
from plain import SF, plain_words

import __spark_entry__ as E


# line dedup -----------------------------------------------------------------

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def plain_lines(rows, p):
    places = sorted({(d is None, d or 0, line_hash, k, w) for d, t, line_hash in rows for k, w in enumerate(tuple(plain_words(x)) for x in (t or "").split("\n"))})
    first, out = {}, {}
    for z, d, h, k, w in places:
        if w:
            first.setdefault(w, (z, d, h, k))
    order = sorted(first, key=first.get)
    seq = {w: w if len(w) >= p.min_words else " ".join(w) for w in order}  # words, or the characters of few words
    able = {w for w in order if len(w) >= p.min_words or len(seq[w]) >= p.min_chars}
    near = {w for i, w in enumerate(order) if w in able and any(
        v in able and type(seq[v]) is type(seq[w]) and abs(len(seq[v]) - len(seq[w])) <= p.edits and edit_distance(seq[v], seq[w]) <= p.edits for v in order[:i])}
    for z, d, h, k, w in places:
        out[(None if z else d, h, k)] = not w or (first[w] == (z, d, h, k) and w not in near)
    return out


def altered(rng, elements, new, times):
    """A list with up to ``times`` elements replaced, dropped or put in."""
    ws = list(elements)
    for _ in range(rng.randint(0, times)):
        kind, at = rng.randrange(3), rng.randrange(len(ws))
        if kind == 0:
            ws[at] = new()
        elif kind == 1:
            del ws[at]
        else:
            ws.insert(at, new())
    return ws


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_line_decisions(spark, docs, edge_rows, edits):
    rng = random.Random(edits)
    p = line_dedup.LineParams(edits=edits)
    base, short = [f"b{i}" for i in range(9)], "two to five words"
    rows = [(d, t) for d, t, *_ in edge_rows if len(t or "") < (10_000 if edits == 1 else 100)]
    for k in range(60 if edits < 3 else 40):
        ws = altered(rng, base, lambda: f"x{rng.randrange(3)}", edits + 1)
        few = "".join(altered(rng, short, lambda: rng.choice("xy "), edits + 1))
        rows.append((100 + k, f"line {k} of its own here now\n" + " ".join(ws) + f"\n\nshort one\n {few}\t\n" + few[:12]))
    df = docs(rows)
    hashed = [(r["doc_id"], r["text"], r["h"]) for r in df.withColumn("h", F.xxhash64("text", F.col("text").isNull())).collect()]
    got = {(r["doc_id"], r["th"], r["line_no"]): r["kept"] for r in line_dedup.line_decisions(df, p).collect()}
    assert got == plain_lines(hashed, p)
    if edits == 1:
        clean = line_dedup.dedup_lines(df)
        assert clean.columns == df.columns and clean.count() == len(rows)
        assert line_dedup.document_digests(line_dedup.line_decisions(docs([]))).count() == 0


def test_lines_of_the_given_table(spark):
    """Every line of the smallest given documents table against all pairs of lines."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    hashed = [(r["doc_id"], r["text"], r["h"]) for r in df.withColumn("h", F.xxhash64("text", F.col("text").isNull())).collect()]
    got = {(r["doc_id"], r["th"], r["line_no"]): r["kept"] for r in line_dedup.line_decisions(df).collect()}
    assert got == plain_lines(hashed, line_dedup.LineParams())


def test_edit_distance_band(spark):
    rng = random.Random(8)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(0, 7))], [rng.choice("abc") for _ in range(rng.randint(0, 7))]) for _ in range(400)]
    frame = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for k in (1, 2, 3):
        got = [r["w"] for r in frame.select(line_dedup.within_edits(F.col("a"), F.col("b"), k).alias("w")).collect()]
        assert got == [edit_distance(a, b) <= k for a, b in pairs]


def test_very_long_line(spark, docs):
    ws = [f"w{i}" for i in range(20_000)]
    rows = [(1, " ".join(ws)), (2, " ".join(ws[:10_000] + ["x"] + ws[10_001:])), (3, " ".join(ws[:5] + ws[6:])), (4, " ".join(ws[::-1]))]
    got = {r["doc_id"]: r["kept"] for r in line_dedup.line_decisions(docs(rows)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


# sharding -------------------------------------------------------------------

def test_shards(spark, docs, edge_rows):
    df = docs(edge_rows + [(1000 + i, f"t{i % 7}") for i in range(500)])
    rows = sharding.shard(df).collect()
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
    assert len(rows) == len(edge_rows) + 500 and sorted(per) == list(range(8))
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    again = sharding.shard(df.repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["text"], r["shard"], r["slot"])
    assert Counter(map(key, rows)) == Counter(map(key, again))
    assert sharding.shard(docs([])).count() == 0


def test_shard_digest(spark):
    got = {r["doc_id"]: r for r in E.queries()["op2_sharding"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        raw = (r["text"] or "").encode()
        assert (got[r["doc_id"]]["size"], got[r["doc_id"]]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))


def test_hypergeometric_law():
    rng = random.Random(2)
    for good, bad, draws in ((30, 70, 20), (5, 5, 9), (1, 0, 1), (0, 8, 3)):
        got = Counter(sharding.hypergeometric(rng.random(), good, bad, draws) for _ in range(4000))
        from math import comb
        for k in range(draws + 1):
            want = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) if k <= good and draws - k <= bad else 0
            assert abs(got[k] / 4000 - want) < 0.04
    matrix = sharding.communication_matrix({0: 10, 1: 0, 2: 333, 5: 10 ** 10}, sharding.ShardParams())
    assert [sum(v) for v in matrix.values()] == [10, 0, 333, 10 ** 10]
    totals = [sum(v[s] for v in matrix.values()) for s in range(8)]
    assert max(totals) - min(totals) <= 1


# mixing ---------------------------------------------------------------------

def test_mix(spark, docs, edge_rows):
    rng = random.Random(4)
    rows = edge_rows + [(5000 + i, "w " * rng.randrange(1, 60), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    df = docs(rows)
    got = mixing.taken(df).collect()
    size = Counter()
    taken, target = Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(size.values())
    names = sorted([s for s in size if s is not None], key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:  # plain water filling
        level = (1.5 * total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and weight[s] * level > 2 * size[s]}
        if not more:
            break
        full |= more
    for s in names:
        want = 2 * size[s] if s in full else weight[s] * level
        assert target[s] == pytest.approx(want)
        biggest = max(r["size"] for r in got if r["source"] == s)
        assert abs(taken[s] - want) <= biggest
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    copies = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert copies == +want
    assert mixing.mix(docs([])).count() == 0
    assert sorted(map(str, mixing.taken(df.repartition(3)).collect())) == sorted(map(str, got))


def test_groups_of_equal_rows_split_at_the_cut(spark):
    """Null doc_ids, one doc_id for all, and copies without end still come near the target."""
    for rows in ([(None, f"w{i} " * 10, "a") for i in range(60)] + [(i, "w " * 10, "a") for i in range(20)] + [(1, "x " * 10, "b")] * 40,
                 [(None, "w " * 10, "a")] * 80 + [(7, "v " * 10, "b")] * 50):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        got = mixing.taken(df).collect()
        for s in "ab":
            mine = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 10
        mixed = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mix(df).collect())
        assert sum(mixed.values()) * 10 == sum(r["taken"] for r in got) and max(mixed[r] / rows.count(r) for r in mixed) <= 2


def test_mix_oracle(spark):
    from oracle import compare, duck
    sf = "/root/testdata/sf0.01"
    ok, msg = compare(spark, duck(sf), sf, "op4_mixing", E.queries()["op4_mixing"], E.oracle_sql()["op4_mixing"])
    assert ok, msg


# token output ---------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_token_files(spark, docs, edge_rows, tokenizer):
    path, tok = tokenizer
    rows = [(d, t) for d, t, *_ in edge_rows] + [(40, " lead"), (41, "a  b   c"), (42, "tail \n x \t y "), (43, "<|endoftext|> z"), (44, "it's 12 3!! 's")]
    got = token_output.token_table(docs(rows), token_output.TokenParams(path, block_ids=500)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for d, t in order:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want
    assert token_output.token_table(docs([]), token_output.TokenParams(path)).count() == 0


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    """Odd white space, control strings, marks and joined pieces; a tokenizer that cuts otherwise encodes whole texts."""
    path, tok = tokenizer
    rng = random.Random(17)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u2003", "a", "it's", "'ll", "é", "漢字", "😀", "123", "4.5", "...", "<|endoftext|>", "Word", "_x", "\x1c", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    pieces = token_output.Pieces(token_output.TokenParams(path))
    assert pieces.cuts
    for _ in range(2):  # cold, then from the cache
        for t, ids in zip(texts, pieces.encode(texts)):
            assert ids.tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2], repr(t)
    import public_tokenizers
    from tokenizers import Tokenizer
    other = public_tokenizers.path("word_bpe_49k.json")
    whole = token_output.Pieces(token_output.TokenParams(other))
    assert not whole.cuts
    got = whole.encode(["Some Words, here.", ""])
    assert [x.tolist() for x in got] == [[*Tokenizer.from_file(other).encode("Some Words, here.", add_special_tokens=False).ids, 2], [2]]


def test_pack_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 4099):
        ids = rng.integers(0, 90_000, n).astype(np.uint32)
        assert (token_output.unpack(*token_output.pack(ids), n) == ids).all()


# personal data --------------------------------------------------------------

def plain_spans(t):
    t, out = t or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        ds = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(ds) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(ds[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_base_spans(spark, docs, edge_rows):
    odd = ["a@b.c+d@e.f x@y@z.com a@b..c é a.b@c.d.e. @x.y", "1.2.3.4.5 256.1.1.1 0255.1.2.3 1.2.3", "4539 1488 0343 6467 1-2-3 4539--1488",
           "+1 (988) 555-2485 +12345 +1+2 5555555 (call 555-123-4567)", "1" * 5000, "1 " * 4000, "a@b" + ".c" * 5000 + " x@y.com 😀 q@r.st", "1.2.3.4" * 3,
           "+0 0 0 0 0 0 0 0 0  a@b.cc ", "a.b-c@d-e.f-g +1-23 45(67)8.9"]
    rows = [(d, t) for d, t, *_ in edge_rows] + [(100 + i, t) for i, t in enumerate(odd)]
    rng = random.Random(9)
    rows += [(200 + i, "".join(rng.choice("a1.@+- 4()é") for _ in range(80))) for i in range(300)]
    got = pii.find(docs(rows)).select("doc_id", pii.span_text(F.filter("spans", lambda x: x["base"])).alias("s")).collect()
    assert Counter((r["doc_id"], r["s"]) for r in got) == Counter((d, plain_spans(t)) for d, t in rows)
    assert pii.find(docs([])).count() == 0


def test_classifier_adds_supported_candidates(spark, docs):
    rows = [(i, f"please call +1 (212) 555-{1000 + i} today, mail me{i}@site.com now") for i in range(200)]
    rows += [(500 + i, f"or phone 212-555-{2000 + i} at night") for i in range(60)] + [(900, "order no 999 1234567 and 12.5")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs(rows)).collect()}
    assert sum(any(not x["base"] for x in got[500 + i]) for i in range(60)) >= 54
    assert not got[900]


def planted_text(rng, base):
    """A line of prose with one planted span, and the span; or with something alike that is none."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    given, last, city = rng.choice(pii.GIVEN), rng.choice(pii.SURNAMES + ["Okafor", "Lindqvist", "Brzezinski", "Moretti"]), rng.choice(pii.CITIES)
    token = "".join(rng.choice("abcdefghkmnpqrstuvwxyzABCDEFGH23456789!#") for _ in range(rng.randint(9, 14))) + rng.choice("23456789")
    word = lambda: rng.choice(["Maple", "Station", "Garden", "Church", "Mill", "Victoria", "Gold"])
    true = {
        "name": [(f"please ask {given} {last} about it", f"{given} {last}"), (f"signed by Dr. {last} today", f"Dr. {last}"), (f"Herr {last} kommt morgen", f"Herr {last}"),
                 (f"met {given} {last}, an old friend", f"{given} {last}"), (f"me llamo {given} {last} y vivo", f"{given} {last}"), (f"Mme {last} est là", f"Mme {last}")],
        "address": [((s := f"{rng.randint(1, 999)} {word()} {rng.choice(['Street', 'Avenue', 'Road', 'Lane'])}") and f"send it to {s}, {city} {digits(5)} please", s),
                    ((g := f"{rng.choice(['Garten', 'Berg', 'Linden'])}straße {rng.randint(1, 99)}") and f"wohnt in der {g}, {digits(5)} {city}", g),
                    ((f := f"{rng.randint(1, 99)} rue de la {rng.choice(['Paix', 'Gare', 'Liberté'])}") and f"j'habite au {f}, {digits(5)} {city}", f),
                    ((c := f"Calle {rng.choice(['Mayor', 'Real', 'Nueva'])}, {rng.randint(1, 99)}") and f"vive en {c}, {city}", c)],
        "phone": [((u := f"{rng.choice(['212', '415', '617'])}-555-{digits(4)}") and f"call {u} tonight", u), ((d := f"030 {rng.randint(2, 9)}{digits(6)}") and f"Telefon {d} abends", d),
                  ((r := " ".join(["01", *(digits(2) for _ in range(4))])) and f"appelez le {r} demain", r), ((e := f"91{rng.randint(1, 9)} {digits(3)} {digits(3)}") and f"llame al {e} ya", e)],
        "email": [((m := f"{given.lower()} (at) site{rng.randint(1, 9)}.com") and f"mail {m} now", m)],
        "secret": [(f"my password is {token} ok", token), (f"login password: {token} ok", token), (f"mein Passwort ist {token} ja", token)],
    }
    false = [f"the {given} {word()} Street is long", f"the password policy is {rng.choice(['strict', 'simple', 'public'])} here", f"order no {digits(3)} {digits(7)} came",
             f"chapter {rng.randint(1, 20)} of the {word()} {word()} Review", f"version 212-555-{digits(4)} of it", f"they walked {rng.randint(2, 90)} steps", f"page {digits(3)} and {digits(4)}",
             f"{given}'s law holds", f"the {city} {word()} Society", f"a password must be long"]
    if base:
        kind = rng.choice(list(true))
        text, span = rng.choice(true[kind])
        return text, (kind, span)
    return rng.choice(false), None


def test_recall_and_precision_on_planted_spans(spark, docs):
    """Spans that no strict pattern takes, among the prose of the given table; the classifier sees no label of them."""
    rng = random.Random(21)
    prose = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(900).collect()]
    rows, want = [], Counter()
    for k, text in enumerate(prose):
        lines = text.split("\n")
        planted, span = planted_text(rng, k % 3 != 2) if k % 5 else ("", None)
        lines.insert(rng.randrange(len(lines) + 1), planted)
        rows.append((k, "\n".join(lines)))
        if span:
            at = rows[-1][1].index(span[1])
            want[k, span[0], at, at + len(span[1])] += 1
    got = {(r["doc_id"], pii.KINDS[x["kind"]], x["s"], x["e"]) for r in pii.find(docs(rows)).collect() for x in r["spans"] if not x["base"]}
    hit = got & set(want)
    recall, precision = len(hit) / len(want), len(hit) / max(len(got), 1)
    print(f"recall {recall:.3f} precision {precision:.3f}", Counter(x[1] for x in set(want) - got), sorted((x[1], rows[x[0]][1][max(0, x[2] - 15):x[3] + 15]) for x in got - set(want))[:40])
    for kind in {x[1] for x in want}:
        assert sum(x[1] == kind for x in hit) >= 0.9 * sum(x[1] == kind for x in want), kind
    assert recall >= 0.9 and precision >= 0.9


def test_counts_are_of_each_kind(spark):
    rows = {r["doc_id"]: r for r in E.queries()["op7_pii"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        spans = plain_spans(r["text"])
        got = rows[r["doc_id"]]
        assert tuple(got[f"n_{k}"] for k in ("email", "ip", "card", "phone")) == tuple(
            sum(x.startswith(k + ":") for x in spans.split(",")) for k in ("email", "ip", "card", "phone"))
        assert got["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()


# chat -----------------------------------------------------------------------

@pytest.mark.parametrize("rows_per_slice", [1_000_000, 7])
def test_chat_round_trip(spark, rows_per_slice):
    tricky = "<|im_end|><|im_start|>assistant ok \\<| <\\| \\\\ <\\n|"
    rows = [(1, 0, "system", "be kind"), *[(1, i, ("assistant", "user")[i % 2], f"turn {i} " + "w " * (i % 9)) for i in range(1, 80)],
            (2, 0, "user", tricky), (2, 1, "assistant", tricky), (3, 0, None, None), (3, None, "assistant", ""), (None, 5, "a\nb", "x\ny"),
            (4, 0, "user", "long " * 3000), (4, 1, "assistant", "answer"), (4, 1, "assistant", "answer"), (5, 0, "system", "only")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, span string")
    win = chat_format.windows(df, chat_format.ChatParams(rows_per_slice=rows_per_slice))
    got = {r["conv_id"]: r for r in chat_format.read_back(win).collect()}
    per = defaultdict(list)
    for c, t, r, x in rows:
        per[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(per)
    for c, turns in per.items():
        turns = sorted(turns)
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    first = win.where("conv_id = 1").orderBy("window").collect()
    assert len(first) > 2 and all(r["text"].startswith("<|im_start|>system\nbe kind<|im_end|>") for r in first)
    assert all(r["context_turns"] > 1 for r in first[1:]) and first[0]["context_turns"] == 0
    assert all(len(plain_words(r["text"])) <= 256 + 64 for r in first)
    assert chat_format.read_back(chat_format.windows(df.limit(0))).count() == 0


def test_long_system_turns_do_not_multiply(spark):
    """A system turn near or beyond the budget is repeated, but all windows together stay below three times the turns."""
    for words in (150, 190, 260, 3000):
        rows = [(1, 0, "system", "s " * words)] + [(1, i, ("assistant", "user")[i % 2], "w " * 30) for i in range(1, 201)]
        win = chat_format.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
        size = lambda t: len(re.findall(r"[sw] ", t))
        whole = sum(size(r[3]) for r in rows)
        assert sum(size(r["text"]) for r in win) <= 3 * whole and all(r["text"].startswith("<|im_start|>system") for r in win)
        assert all(size(r["text"]) <= max(256, 2 * words + 64 + 64) for r in win)


# licences -------------------------------------------------------------------

def plain_notices(rows, p):
    """Best template of each text over all windows of its terms that start at a template's term."""
    import math
    texts = {k: licenses._py_terms(t or "") for k, t in rows}
    df = Counter(w for ws in texts.values() for w in set(ws))
    idf = {t: math.log(1 + len(texts) / (1 + c)) for t, c in df.items()}
    zero = math.log(1 + len(texts))
    out = {}
    for key, ws in texts.items():
        for tpl in licenses.templates(p):
            w = {t: c * idf.get(t, zero) for t, c in Counter(tpl.terms).items()}
            norm = sum(x * x for x in w.values()) ** 0.5
            n = len(tpl.terms)
            for at in [0] if len(ws) <= n else [i for i, t in enumerate(ws) if t in w]:
                c = Counter(ws[at:at + n])
                if not c or not tpl.needs <= set(c):
                    continue
                size = sum((m * idf[t]) ** 2 for t, m in c.items()) ** 0.5
                cos = round(sum(m * idf[t] * w.get(t, 0.0) for t, m in c.items()) / size / norm, 9)
                if cos >= p.cosine and (key not in out or (-cos, tpl.licence) < out[key]):
                    out[key] = (-cos, tpl.licence)
    return {k: (licence, -minus) for k, (minus, licence) in out.items()}


def found_notices(spark, rows, p=licenses.LicenceParams()):
    files = spark.createDataFrame(rows, "path string, text string")
    return {r["path"]: (r["licence"], r["cosine"]) for r in licenses.notices(files, p).collect()}


def test_notices_match_plain_cosine(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("concat('f/', doc_id) AS path", "text").collect()
    rows = [tuple(r) for r in docs if len(r["text"]) < 3000 or "icen" in r["text"]]
    rows += [("f/a", "x\nlicensed under the apache license, version 2.0 (the License)"), ("f/b", "This work is licensed under the GNU General Public License"),
             ("f/c", "Released under the MIT Licence"), ("f/d", "the of and"), ("f/e", None), ("f/f", ""), ("f/g", licenses._PERMISSION[40:700]),
             ("f/h", "pad " * 9 + licenses.TEMPLATES["BSD-3-Clause"][1] + " end" * 9), ("f/i", "SPDX-License-Identifier: GPL-2.0"), ("f/j", "SPDX-License-Identifier: WTFPL")]
    p = licenses.LicenceParams()
    want, got = plain_notices(rows, p), found_notices(spark, rows, p)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(got) > 30
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)
    assert {k: got.get(k, (None,))[0] for k in ("f/a", "f/g", "f/h", "f/i", "f/j", "f/b")} == {
        "f/a": "Apache-2.0", "f/g": "MIT", "f/h": "BSD-3-Clause", "f/i": "GPL-2.0", "f/j": None, "f/b": None}


def test_every_term_weighs_by_its_own_idf(spark):
    """A frequent word inside a notice weighs next to nothing, in small and large tables; a rare one does."""
    lines = ["All that rights that reserved", "Licensed as that under the Apache License, Version 2.0", "Released zzyzx under qqfx the MIT jjwq License."]
    for n in (200, 5000):
        rows = [(f"f/{i}", f"as that plain body {i}") for i in range(n)] + [(f"n/{k}", x) for k, x in enumerate(lines)]
        want, got = plain_notices(rows[-300:] if n < 300 else rows, licenses.LicenceParams()), found_notices(spark, rows)
        assert got.keys() == {"n/1"} and got["n/1"][0] == "Apache-2.0" and 0.8 < got["n/1"][1] < 1
        assert got["n/1"][1] == pytest.approx(want["n/1"][1], abs=1e-6) or n < 300


def test_recall_of_licence_texts_as_they_stand_in_files(spark):
    """Templates as comment headers and licence files: wrapped at many widths, marked, cut at the end, words altered, numbered."""
    rng = random.Random(12)
    prose = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text NOT ILIKE '%licen%' AND text NOT ILIKE '%rights%'").limit(150).collect()]
    rows, want = [], {}
    for k in range(400):
        licence = rng.choice(sorted(licenses.TEMPLATES))
        ws = rng.choice(licenses.TEMPLATES[licence]).split()
        if rng.random() < 0.15:
            ws = (licenses.SPDX + licence).split()
        if len(ws) > 25:
            ws = [w if rng.random() > 0.03 else "changed" for w in ws][:len(ws) - rng.randrange(3)]
        mark, width = rng.choice(["// ", "# ", " * ", "", "-- ", "\t"]), rng.choice([3, 6, 9, 14, 500])
        lines = [mark + " ".join(ws[i:i + width]) for i in range(0, len(ws), width)]
        head = [mark + "Copyright (c) 2021 The Authors"] if rng.random() < 0.5 else []
        rows.append((f"p/{k}", "\n".join(head + lines) + "\n\n" + (rng.choice(prose) if rng.random() < 0.7 else "")))
        want[f"p/{k}"] = licence
    clean = [(f"c/{k}", t) for k, t in enumerate(prose)]
    got = found_notices(spark, rows + clean)
    right = sum(got.get(k, (None,))[0] == licence for k, licence in want.items())
    print("recall", right / len(want), [(k, want[k], got.get(k)) for k in want if got.get(k, (None,))[0] != want[k]][:12])
    assert right >= 0.9 * len(want)
    assert sum(k in got for k, _ in clean) <= 0.01 * len(clean)


def test_inheritance(spark):
    apache, mit = licenses.TEMPLATES["Apache-2.0"][0], licenses.TEMPLATES["MIT"][0]
    body = "\n".join(f"plain body {i}" for i in range(3))
    rows = [("LICENSE", apache), ("a/x.txt", body), ("a/b/COPYING.md", mit), ("a/b/c/y.txt", body), ("a/b/c/z.txt", body + "\n" + apache),
            ("a/bb/y.txt", None), (None, body), ("a/b/c/y.txt", body), ("q.txt", "")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "path string, text string, dir string, th int")
    got = Counter((r["path"], r["licence"], r["licence_by"], r["licence_dir"], r["dir"]) for r in licenses.scan(df).collect())
    assert got == Counter([
        ("LICENSE", "Apache-2.0", "notice", None, "k"), ("a/x.txt", "Apache-2.0", "inherited", "", "k"), ("a/b/COPYING.md", "MIT", "notice", None, "k"),
        ("a/b/c/y.txt", "MIT", "inherited", "a/b", "k"), ("a/b/c/z.txt", "Apache-2.0", "notice", None, "k"), ("a/bb/y.txt", "Apache-2.0", "inherited", "", "k"),
        (None, None, None, None, "k"), ("a/b/c/y.txt", "MIT", "inherited", "a/b", "k"), ("q.txt", "Apache-2.0", "inherited", "", "k")])
    assert licenses.scan(df.limit(0)).count() == 0
    clash = df.selectExpr("*", *[f"'own' AS {c}" for c in (*licenses.ADDED, "f", "k", "at", "terms", "len")])
    again = licenses.scan(clash)
    assert again.columns == [c for c in clash.columns if c not in ("text", *licenses.ADDED)] + list(licenses.ADDED)
    assert Counter((r["path"], r["licence"], r["licence_by"], r["licence_dir"], r["dir"]) for r in again.collect()) == got
    long = " ".join(f"w{i % 7919}" for i in range(120_000)) + " " + apache
    assert [r["licence"] for r in licenses.scan(spark.createDataFrame([("x", long)], "path string, text string")).collect()] == ["Apache-2.0"]
