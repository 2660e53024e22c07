"""Line dedup over the corpus by a deletion-neighbourhood join; DataFrame code only.

A line is a sequence of words, a short line one of characters (one word is too
much of it).  Two lines of one kind within ``edits`` edits (a word or character
replaced, added or left out) share a variant: what is left once the places of
the edits are deleted in both.  A variant also says at which gaps something was
deleted; lines with equal variant and gaps are all within the bound of each
other, and so are lines whose gaps together number ``edits`` at most.  So the
earliest line of each (variant, gaps) stands for all of them, no pairs of lines
are made, and a variant's few gap sets meet each other in one row.  Every line
meets one earliest line per variant at most; meetings are verified by edit
distance.

Variants are too many to emit for all of a corpus.  ``edits`` edits leave one of
``edits + 1`` segments of a line as it is, so only lines that share a segment
key with another distinct line emit variants; with one edit, only for the
places outside the halves they share.  No pair is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_bitmaps, prefix_reduce, text_hash


@dataclass(frozen=True)
class LineParams:
    """``edits``: the bound, in words; a line emits about n ** edits variants, so 2 and 3 are for short or few lines.

    Lines of fewer than ``min_words`` words are compared by characters (their
    words joined by blanks) under the same bound, from ``min_chars`` characters
    on; shorter ones are duplicates only if equal.
    """
    edits: int = 1
    min_words: int = 6
    min_chars: int = 12


def normal(line: Column) -> Column:
    """The words of a line joined by one blank; only lines that are not so already are rewritten."""
    odd = line.startswith(" ") | line.endswith(" ")
    for x in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | line.contains(x)
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def _n_words(norm: Column) -> Column:
    """Blanks of a normal line and one; both lengths are of bytes."""
    return F.when(norm == "", 0).otherwise(F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)


def _hash(*cols: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), *cols).alias("x"), F.xxhash64(F.lit(2), *cols).alias("y"))


def _kind(norm: Column, n: Column, p: LineParams) -> Column:
    """w: compared by words, c: by characters, null: too short for any edit."""
    return F.when(n >= p.min_words, "w").when(F.length(norm) >= p.min_chars, "c")


def _elements(norm: Column, kind: Column) -> Column:
    return F.when(kind == "w", F.split(norm, " ")).otherwise(F.regexp_extract_all(norm, F.lit("(?s)."), F.lit(0)))


def _segment_keys(norm: Column, kind: Column, n: Column, k: int) -> Column:
    """Keys of the segments that may be left as they are: in class c, pairs of c and c to c + k elements.

    The shorter line is cut into k + 1 segments; in the longer one a segment
    stands further on by the edits before it.  The last bits of a key say
    whether it is of the first segment (1) or the last (2).
    """
    def segment(j: int, lo: Column, size: Column) -> Column:
        upto = norm if j == k else F.call_function("substring_index", norm, F.lit(" "), (lo + size).cast("int"))
        by_word = upto if j == 0 else F.call_function("substring_index", upto, F.lit(" "), -size)
        return F.when(kind == "w", by_word).otherwise(F.substring(norm, lo + 1, size))

    keys = []
    for d in range(k + 1):
        c = n - d
        for j in range(k + 1):
            lo, hi = F.floor(c * j / (k + 1)).cast("int"), F.floor(c * (j + 1) / (k + 1)).cast("int")
            spare = (k - d) // 2
            shifts = [0] if j == 0 else [d] if j == k else range(-spare, d + spare + 1)
            for shift in shifts:
                part = segment(j, F.greatest(lo + shift, F.lit(0)), F.greatest(hi - lo, F.lit(0)))
                keys.append(F.xxhash64(kind, F.lit(j), c, part).bitwiseAND(F.lit(-4)).bitwiseOR(F.lit((j == 0) + 2 * (j == k))))
    return F.array(*keys)


def _lines(docs: DataFrame, text: str) -> DataFrame:
    t = F.col(f"`{text}`")
    return docs.select("doc_id", text_hash(t).alias("th"), F.posexplode(F.split(F.coalesce(t, F.lit("")), "\n", -1)).alias("line_no", "line"))


def _order() -> Column:
    """Place of a line in the corpus: doc_id (null last), text hash, line number."""
    return F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "line_no")


def _single_deletions(lines: DataFrame) -> DataFrame:
    """``_variants`` for one edit, by rows: a running combination of a line's elements gives what is left without each."""
    w = Window.partitionBy("id").orderBy("j")
    rows = lines.select("id", "kind", "n", "lo", "hi", F.posexplode("s").alias("j", "w"))
    stay, moved = F.xxhash64("j", "w"), F.xxhash64(F.col("j") - 1, "w")
    whole = Window.partitionBy("id")
    rows = rows.select("id", "kind", "n", "lo", "hi", "j", stay.alias("e"), F.bit_xor(stay).over(w).alias("p"), F.bit_xor(moved).over(w).alias("g"),
                       F.bit_xor(stay).over(whole).alias("all"), F.bit_xor(moved).over(whole).alias("all_moved"))
    xor = lambda a, b: F.col(a).bitwiseXOR(F.col(b))
    less = xor("p", "e").bitwiseXOR(xor("g", "all_moved"))    # the elements before at their places, the later ones moved up
    none = F.array().cast("array<int>")
    own = F.struct(F.xxhash64("kind", "n", "all").alias("key"), none.alias("gaps"))
    gone = F.struct(F.xxhash64("kind", F.col("n") - 1, less).alias("key"), F.array((F.col("j") * 8).cast("int")).alias("gaps"))
    found = F.array_compact(F.array(F.when(F.col("j") == 0, own), F.when(F.col("j").between(F.col("lo"), F.col("hi")), gone)))
    return rows.select("id", F.inline(found))


def _variants(lines: DataFrame, k: int) -> DataFrame:
    """(id, key, gaps) of every line: the hash of what is left after up to k deletions, and the gaps of these as numbers.

    A gap is the place in what is left, times 8, plus its number among the
    deletions at that place.  Elements are hashed with their place in what is
    left and combined by exclusive or, so a variant costs one combination of prefixes.
    """
    if k == 1:
        return _single_deletions(lines)
    xor = lambda a, b: a.bitwiseXOR(b)
    n, here = F.col("n"), lines
    for t in range(k + 1):  # prefixes of the elements moved up by t
        here = here.withColumn(f"p{t}", prefix_reduce(_moved(t), F.lit(0).cast("long"), xor))

    def left(t: int, start: Column, so_far: Column, gaps: Column, last: Column) -> Column:
        """All variants that delete nothing from ``start`` on, or up to k - t places more."""
        p = F.col(f"p{t}")
        rest = xor(xor(so_far, F.element_at(p, -1)), F.get(p, start))
        own = F.array(F.struct(F.xxhash64("kind", n - t, rest).alias("key"), gaps.alias("gaps")))
        if t == k:
            return own

        def without(at: Column) -> Column:
            gap = (at - t) * 8
            gap = gap + F.when(F.shiftright(last, 3) == at - t, last.bitwiseAND(F.lit(7)) + 1).otherwise(0)
            return left(t + 1, at + 1, xor(xor(so_far, F.get(p, at)), F.get(p, start)), F.concat(gaps, F.array(gap.cast("int"))), gap)

        places = F.when(start < n, F.sequence(start, F.greatest(n - 1, start))).otherwise(F.array().cast("array<int>"))
        return F.concat(own, F.flatten(F.transform(places, without)))

    none = F.array().cast("array<int>")
    return here.select("id", F.explode(left(0, F.lit(0), F.lit(0).cast("long"), none, F.lit(-1))).alias("v")).select("id", "v.*")


def _moved(t: int) -> Column:
    """Hashes of the elements at their places less t."""
    return F.transform("s", lambda w, j: F.xxhash64(j - t, w))


def _earliest(variants: DataFrame, k: int) -> DataFrame:
    """(key, gaps, first): for every variant and gap set the earliest line whose gaps number at most k together with these."""
    sets = variants.groupBy("key", "gaps").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c"))
    met = sets.groupBy("key").agg(F.collect_list(F.struct("gaps", "first")).alias("all"), F.sum("c").alias("c")).where("c > 1")
    one = F.explode("all").alias("one")
    met = met.select("key", "all", one).select("key", "all", F.col("one.gaps").alias("gaps"))
    together = lambda x: F.size(x["gaps"]) + F.size("gaps") - F.size(F.array_intersect(x["gaps"], F.col("gaps")))
    return met.select("key", "gaps", F.array_min(F.transform(F.filter("all", lambda x: together(x) <= k), lambda x: x["first"])).alias("first"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by one replaced, added or left-out word at most."""
    def same_first(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.when(at == 0, F.least(F.size(x), F.size(y)).cast("long")).otherwise(at - 1)
    differ = F.size(F.filter(F.zip_with(a, b, lambda p, q: p.eqNullSafe(q)), lambda s: ~s))
    less = F.least(F.size(a), F.size(b))
    return F.when(F.size(a) == F.size(b), differ <= 1).otherwise(
        (F.abs(F.size(a) - F.size(b)) == 1) & (same_first(a, b) + same_first(F.reverse(a), F.reverse(b)) >= less))


def within_edits(a: Column, b: Column, k: int) -> Column:
    """Whether the edit distance of two arrays is k at most: rows of the distance table, a band of 2 k + 1 cells each."""
    far = F.lit(k + 1)
    band = F.sequence(F.lit(-k), F.lit(k))
    start = F.transform(band, lambda d: F.when((d >= 0) & (d <= F.size(b)), d).otherwise(far))

    def row(state: Column, x: Column) -> Column:
        i, prev = state["i"], state["cells"]

        def cell(done: Column, d: Column) -> Column:
            j = i + d + 1                                        # elements of b so far
            same = F.get(b, j - 1).eqNullSafe(x)
            best = F.least(F.get(prev, d + k) + F.when(same, 0).otherwise(1),
                           F.coalesce(F.get(prev, d + k + 1), far) + 1, F.coalesce(F.get(done, d + k - 1), far) + 1, far)
            at_start = F.when(j == 0, F.least(i + 1, far)).otherwise(best)
            return F.concat(done, F.array(F.when((j < 0) | (j > F.size(b)), far).otherwise(at_start)))

        cells = F.aggregate(band, F.array().cast("array<int>"), cell)
        return F.struct((i + 1).alias("i"), cells.alias("cells"))

    last = F.aggregate(a, F.struct(F.lit(0).alias("i"), start.alias("cells")), row)
    return (F.abs(F.size(a) - F.size(b)) <= k) & (F.get(last["cells"], F.size(b) - F.size(a) + k) <= k)


def line_decisions(docs: DataFrame, p: LineParams = LineParams(), text: str = "text") -> DataFrame:
    """(doc_id, th, line_no, line_hash, kept, near) of every line of every document.

    A line goes if an equal line (the same words) stands earlier in the corpus,
    or (``near``) an earlier line of its kind is within ``edits`` edits of it,
    whether that one is kept or not; kinds are lines of ``min_words`` words or
    more, compared by words, and shorter ones, compared by characters.  Earlier:
    by doc_id, null last, then text hash, then line number.  Lines without words
    always stay; a null or empty text is one such line.  Rows of equal doc_id
    and text are one document and appear once.  A line of few, very long words
    is compared by all its characters.
    """
    k = p.edits
    scratch = Scratch(docs.sparkSession, "lines")
    raw = _lines(docs, text)
    norm = normal(F.col("line"))
    # one row for each line, with hashes only
    seq = raw.select("doc_id", "th", "line_no", norm.alias("norm")).withColumn("n", _n_words(F.col("norm")))
    seq = seq.withColumn("kind", _kind(F.col("norm"), F.col("n"), p))
    size = F.when(F.col("kind") == "w", F.col("n")).otherwise(F.length("norm"))
    rows = scratch.keep(
        seq.select("doc_id", "th", "line_no", "n", _hash(F.col("norm")).alias("lh"),
                   F.when(F.col("kind").isNotNull(), _segment_keys(F.col("norm"), F.col("kind"), size, k)).alias("segments")), "rows")
    firsts = scratch.keep(rows.where("n > 0").groupBy("lh").agg(F.min(_order()).alias("ord")), "firsts")
    # lines that share a segment with another one: by a filter of fixed size, so a few more may pass
    segments = rows.where("segments IS NOT NULL").select(F.col("lh.x").alias("lx"), F.explode("segments").alias("key"))
    shared = segments.groupBy("key").agg(F.min("lx").alias("lo"), F.max("lx").alias("hi")).where("lo < hi").select("key")
    some = in_bitmaps(segments, "key", shared).where("held").groupBy("lx").agg(F.bit_or(F.col("key").bitwiseAND(F.lit(3))).alias("side"))
    some = scratch.keep(some, "some")
    # these lines again, numbered in their order; one edit stands outside a shared half
    again = raw.select(norm.alias("norm")).withColumn("lx", _hash(F.col("norm"))["x"])
    picked = in_bitmaps(again, "lx", some.select(F.col("lx").alias("key"))).where("held")
    picked = picked.withColumn("lh", _hash(F.col("norm"))).groupBy("lh").agg(F.first("norm").alias("norm"))
    picked = scratch.keep(picked.join(firsts.select("lh", "ord"), "lh").withColumn("lx", F.col("lh.x")).join(some, "lx").select("ord", "norm", "side"), "picked")
    picked = picked.withColumn("kind", _kind(F.col("norm"), _n_words(F.col("norm")), p)).where("kind IS NOT NULL")
    picked = picked.select("ord", "kind", "side", _elements(F.col("norm"), F.col("kind")).alias("s")).withColumn("n", F.size("s"))
    half, less = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")
    lo = F.when(F.col("side") == 1, less).otherwise(0)
    hi = F.when(F.col("side") == 2, F.greatest(half - 1, less)).otherwise(F.col("n") - 1)
    numbered = picked.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("id", F.monotonically_increasing_id())
    lines = scratch.keep(numbered.select("id", "ord", "kind", "n", "s", lo.alias("lo"), hi.alias("hi")), "lines")
    variants = scratch.keep(_variants(lines, k), "variants")
    meets = variants.join(_earliest(variants, k), ["key", "gaps"]).where("first < id").select("id", "first").distinct()
    pairs = (meets.join(lines.select("id", "ord", F.col("s").alias("a")), "id")
             .join(lines.select(F.col("id").alias("first"), F.col("s").alias("b")), "first"))
    close = within_one_edit(F.col("a"), F.col("b")) if k == 1 else within_edits(F.col("a"), F.col("b"), k)
    gone = scratch.keep(pairs.where(close).select("ord").distinct(), "gone")
    scratch.drop("variants", "lines", "picked", "some")
    judged = firsts.select("lh", "ord").join(gone.withColumn("near", F.lit(True)), "ord", "left").select(
        "lh", F.col("ord").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    own = _order()
    places = rows.select("doc_id", "th", "line_no", "n", "lh")
    twice = rows.where("line_no = 0").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    places = places if twice.isEmpty() else places.distinct()  # a document that stands several times has its lines once
    return (places.join(judged, "lh", "left")
            .select("doc_id", "th", "line_no", F.col("lh.x").alias("line_hash"),
                    (F.col("first").isNull() | ((own == F.col("first")) & ~F.col("near"))).alias("kept"),
                    F.coalesce("near", F.lit(False)).alias("near")))


def document_digests(decisions: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_equal and n_near (lines gone as equal to an earlier line, or as near one only), kept_md5 (of the numbers of the lines that stay)."""
    line = F.struct("line_no", "kept")
    per = decisions.groupBy("doc_id", "th").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum((~F.col("kept") & ~F.col("near")).cast("long")).alias("n_equal"), F.sum((~F.col("kept") & F.col("near")).cast("long")).alias("n_near"),
        F.sort_array(F.collect_list(line)).alias("lines"))
    kept = F.transform(F.filter("lines", lambda x: x["kept"]), lambda x: x["line_no"].cast("string"))
    return per.select("doc_id", "n_lines", "n_equal", "n_near", F.md5(F.array_join(kept, ",")).alias("kept_md5"))


def dedup_lines(docs: DataFrame, p: LineParams = LineParams(), text: str = "text") -> DataFrame:
    """``docs`` with the lines that go taken out of ``text``; a text that loses all lines becomes empty, null stays null."""
    gone = (line_decisions(docs, p, text).where("NOT kept").groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t"))
            .agg(F.collect_set("line_no").alias("__gone")))
    t = F.col(f"`{text}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("__row"), F.col("doc_id").alias("__doc"),
                       t.alias("__text"), text_hash(t).alias("__th"))
    kept = F.concat_ws("\n", F.filter(F.split("__text", "\n", -1), lambda _, i: ~F.array_contains("__gone", i)))
    new = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(kept)
    joined = rows.join(gone, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")), "left")
    return joined.select("__row.*", new.alias(text)).select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB text of ``document_digests`` with the default parameters, for distinct doc_ids.
SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no,
                  unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
x AS (SELECT doc_id, line_no, ws, array_to_string(ws, ' ') AS norm, len(ws) AS n FROM w),
firsts AS (SELECT norm, any_value(ws) AS ws, any_value(n) AS n, min({'d': doc_id, 'k': line_no}) AS ord FROM x WHERE n > 0 GROUP BY norm),
able AS (SELECT norm, ord, CASE WHEN n >= 6 THEN 'w' ELSE 'c' END AS kind, CASE WHEN n >= 6 THEN ws ELSE string_split(norm, '') END AS s
         FROM firsts WHERE n >= 6 OR length(norm) >= 12),
own AS (SELECT norm, ord, kind, md5(array_to_string(s, chr(31))) AS key FROM able),
less AS (SELECT norm, ord, kind, len(s) AS m, i, md5(array_to_string(list_concat(s[1:i - 1], s[i + 1:]), chr(31))) AS key
         FROM able, unnest(range(1, len(s) + 1)) AS p(i)),
swapped AS (SELECT norm, ord, min(ord) OVER (PARTITION BY kind, m, i, key) AS first FROM less),
shorter AS (SELECT kind, key, min(ord) AS first FROM less GROUP BY kind, key),
gone AS (
  SELECT norm FROM swapped WHERE first < ord
  UNION SELECT own.norm FROM own JOIN shorter USING (kind, key) WHERE shorter.first < own.ord
  UNION SELECT less.norm FROM less JOIN own USING (kind, key) WHERE own.ord < less.ord),
judged AS (
  SELECT x.doc_id, x.line_no, gone.norm IS NOT NULL AS near, x.n = 0 OR (firsts.ord = {'d': x.doc_id, 'k': x.line_no} AND gone.norm IS NULL) AS kept
  FROM x LEFT JOIN firsts ON x.norm = firsts.norm AND x.n > 0 LEFT JOIN gone ON x.norm = gone.norm AND x.n > 0)
SELECT doc_id, count(*) AS n_lines, CAST(count(CASE WHEN NOT kept AND NOT near THEN 1 END) AS BIGINT) AS n_equal,
       CAST(count(CASE WHEN NOT kept AND near THEN 1 END) AS BIGINT) AS n_near,
       md5(coalesce(string_agg(CASE WHEN kept THEN CAST(line_no AS VARCHAR) END, ',' ORDER BY line_no), '')) AS kept_md5
FROM judged GROUP BY doc_id
"""
