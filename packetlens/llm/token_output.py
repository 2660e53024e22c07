"""Token-id output: byte-level BPE ids in a byte-aligned variable-length binary format.

The file format is a Parquet table of blocks, in ascending doc_id order.  A
block holds whole documents: their doc_ids and id counts, the block's ids
ranked by frequency, one control byte for four ids (two bits each: length less
one) and, apart from them, the data bytes (the rank of each id, little-endian
in 1 to 3 bytes).  Frequent ids take one byte.  Decoding looks the control
bytes up in a table of lengths and gathers the data bytes with numpy.

Texts are tokenized once, by the tokenizers library, in pieces: between two
non-white characters a blank always starts a new pre-token, so a text's ids are
those of its blank-led pieces in a row, and pieces repeat.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

INNER_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the blank and the line break, and a character that marks the cuts.
ODD = re.compile("[\x00\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@dataclass(frozen=True)
class TokenParams:
    """``tokenizer`` is a path that every executor can read; ``block_ids`` bounds a block (it holds one document at least)."""
    tokenizer: str
    end_id: int = 2
    block_ids: int = 2_000_000
    cached_pieces: int = 700_000   # of a worker's younger half; when it is full it becomes the older one


class Pieces:
    """Text to ids through a cache of blank-led pieces, for tokenizers that cut before a blank; whole texts for others."""

    def __init__(self, p: TokenParams):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tok, self.p = Tokenizer.from_file(p.tokenizer), p
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.cuts = cuts_before_blanks(self.tok)
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None

    @staticmethod
    def split(text: str) -> list[str]:
        if not text:
            return []
        if ODD.search(text) or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            parts = INNER_BLANK.split(text)
            return [parts[0], *[" " + x for x in parts[1:]]]
        return text.replace(" ", "\x00 ").split("\x00")  # every blank stands between two others

    def _learn(self, new: list[str]) -> None:
        """Ids of new pieces: those of one run of non-white characters in one go, parted by line breaks; the others one by one."""
        known, simple, others = self.ids, [], []
        for x in new:
            w = x.strip()
            (simple if w and "\n" not in w and len(w) == len(x) - (x[0] == " ") else others).append(x)
        for lo in range(0, len(simple), 20_000):
            part = simple[lo:lo + 20_000]
            ids = np.array(self.batch(["\n".join(part)], add_special_tokens=False)[0].ids, dtype="<u4") if self.line is not None else np.empty(0, "<u4")
            ends = np.append(np.flatnonzero(ids == self.line), len(ids)) if self.line is not None else np.empty(0, int)
            if len(ends) != len(part):
                others += part
                continue
            raw, at = ids.tobytes(), 0
            for x, end in zip(part, (ends * 4).tolist()):
                known[x] = raw[at:end]
                at = end + 4
        for lo in range(0, len(others), 20_000):
            part = others[lo:lo + 20_000]
            for x, e in zip(part, self.batch(part, add_special_tokens=False)):
                known[x] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        end = np.array([self.p.end_id], dtype="<u4").tobytes()
        if not self.cuts:
            return [np.array([*e.ids, self.p.end_id], dtype="<u4") for e in self.batch(texts, add_special_tokens=False)]
        if len(self.ids) > self.p.cached_pieces:
            self.ids, self.old = {}, self.ids
        known, old = self.ids, self.old
        split = {t: self.split(t) for t in texts}  # a copy is cut and put together once
        new = set().union(*split.values()).difference(known)
        seen = new & old.keys()
        known.update((x, old[x]) for x in seen)
        self._learn(list(new - seen))
        get = known.__getitem__
        done = {t: np.frombuffer(b"".join(map(get, parts)) + end, dtype="<u4") for t, parts in split.items()}
        return [done[t] for t in texts]


def cuts_before_blanks(tok) -> bool:
    """Whether a tokenizer surely cuts before every blank between two non-white characters: byte-level words by its
    own pattern, no blank put in front, nothing rewritten before."""
    import json
    conf = json.loads(tok.to_str())
    pre = conf.get("pre_tokenizer") or {}
    return (conf.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and not any(" " in t["content"] for t in conf.get("added_tokens", [])))


_held: dict[TokenParams, Pieces] = {}


def _pieces(p: TokenParams) -> Pieces:
    """The tokenizer and cache of this worker process, which lives for many tasks."""
    if p not in _held:
        _held.clear()
        _held[p] = Pieces(p)
    return _held[p]


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ids by falling frequency, control bytes, data bytes) of a sequence of ids."""
    count = np.bincount(ids)
    vocab = np.flatnonzero(count)
    order = np.lexsort((vocab, -count[vocab]))
    rank = np.zeros(len(count), dtype=np.uint32)
    rank[vocab[order]] = np.arange(len(vocab), dtype=np.uint32)
    value = rank[ids]
    size = 1 + (value >= 1 << 8).astype(np.uint8) + (value >= 1 << 16).astype(np.uint8)
    padded = np.zeros(-(-len(value) // 4) * 4, dtype=np.uint8)
    padded[:len(value)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    octets = value.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    data = octets[np.arange(3) < size[:, None]]
    return vocab[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


#: Lengths of the four values that a control byte stands for.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.int64)


def unpack(vocab: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ids of a block."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size) - size
    octets = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
    value = octets[start]
    two, three = size > 1, size > 2
    value[two] |= octets[start[two] + 1] << np.uint32(8)
    value[three] |= octets[start[three] + 2] << np.uint32(16)
    return np.frombuffer(vocab, dtype="<u4")[value]


BLOCKS = "part int, block long, doc_ids array<long>, counts array<long>, vocab binary, control binary, data binary"
READ = "part int, block long, place long, doc_id long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, path: str, p: TokenParams, text: str = "text") -> None:
    """Write the ids of every document to ``path`` in the format above.

    Documents are range-partitioned by doc_id (null first; rows of equal doc_id
    by their first characters, then by text hash; equal rows at random), so no
    task holds more than its range; a null text is empty, and an empty one is
    the end id alone.  Repeated rows are written as often as they stand.  Other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), "head", "th"]
    rows = rows.withColumns({"head": F.left("text", F.lit(64)), "th": F.xxhash64("text"), "any": F.xxhash64(F.monotonically_increasing_id())})
    ranged = rows.repartitionByRange(*order, "any").withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, number = _pieces(p), 0
        held: list[np.ndarray] = []
        keys: list = []
        part = 0

        def block() -> pa.RecordBatch:
            nonlocal number, held, keys
            vocab, control, data = pack(np.concatenate(held))
            out = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int64()),
                "doc_ids": pa.array([keys], pa.list_(pa.int64())), "counts": pa.array([[len(x) for x in held]], pa.list_(pa.int64())),
                "vocab": pa.array([vocab], pa.binary()), "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary())})
            number, held, keys = number + 1, [], []
            return out

        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                part = some.column("part")[0].as_py()
                for key, ids in zip(some.column("doc_id").to_pylist(), pieces.encode(some.column("text").to_pylist())):
                    if held and size + len(ids) > p.block_ids:
                        yield block()
                        size = 0
                    held.append(ids)
                    keys.append(key)
                    size += len(ids)
        if held:
            yield block()

    ranged.select("part", "doc_id", "text").mapInArrow(blocks, BLOCKS).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for b in frame.itertuples(index=False):
                counts = np.asarray(b.counts, dtype=np.int64)
                ids = unpack(b.vocab, b.control, b.data, int(counts.sum()))
                ends = np.cumsum(counts)
                yield pd.DataFrame({
                    "part": b.part, "block": b.block, "place": np.arange(len(counts)), "doc_id": pd.array(b.doc_ids, dtype="Int64"),
                    "n_tokens": counts, "ids_crc32": [zlib.crc32(ids[e - c:e].astype("<u4").tobytes()) for e, c in zip(ends, counts)]})

    blocks = spark.read.schema(BLOCKS).parquet(path)
    rows = blocks.mapInPandas(decode, READ)
    # ids before a block: its part's blocks before, and all parts before
    totals = blocks.select("part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))
    parts = totals.groupBy("part").agg(F.sum("ids").alias("ids"))
    earlier = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", earlier.alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", "block", F.coalesce(F.sum("ids").over(in_part), F.lit(0)).alias("block_start")).join(parts, "part")
    in_block = Window.partitionBy("part", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(in_block), F.lit(0))
    return (rows.withColumn("before", before).join(starts, ["part", "block"])
            .select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def token_table(docs: DataFrame, p: TokenParams, text: str = "text") -> DataFrame:
    """Write the ids of ``docs`` below the shared scratch folder and read them back (see the two functions)."""
    path = f"{Scratch(docs.sparkSession, 'tokens').base}/blocks"
    write_tokens(docs, path, p, text)
    return read_tokens(docs.sparkSession, path)
