"""Line dedup by a sharded minimal perfect hash over distinct lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyratory.llm.blocks import as_bytes, mixed
from gyratory.session import materialise

_SPACE = b" \t\n\v\f\r"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(_SPACE).lower()


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _code_points(key: bytes) -> int:
    return len(key.decode("utf-8", "replace"))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: levels of bits, each set where exactly one of the level's keys falls.

    A key's index is the number of bits set before its own, over all levels. `count` and `mark` (32 bits of the key) are arrays
    by that index.
    """

    GAMMA = 1.6

    def __init__(self, levels: list[np.ndarray], sizes: list[int], mark: np.ndarray, count: np.ndarray):
        self.levels, self.sizes, self.mark, self.count = levels, sizes, mark, count
        self.before, total = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.before.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())

    @staticmethod
    def place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        step = np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mixed(a + mixed(b ^ step)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, count: np.ndarray) -> PerfectHash:
        levels, sizes, rest = [], [], np.arange(len(a))
        while len(rest):
            size = max(64, int(len(rest) * cls.GAMMA) // 64 * 64 + 64)
            at = cls.place(a[rest], b[rest], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = rest[~alone[at]]
        out = cls(levels, sizes, np.zeros(len(a), np.uint32), np.zeros(len(a), np.int64))
        index = out.index(a, b)
        out.mark[index], out.count[index] = b.astype(np.uint32), count
        return out

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each key; -1 where no level has it."""
        out, rest = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (bits, size) in enumerate(zip(self.levels, self.sizes, strict=True)):
            if not len(rest):
                break
            at = self.place(a[rest], b[rest], level, size)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[rest[hit]] = (self.before[level][at >> 6] + below)[hit]
            rest = rest[~hit]
        return out

    def counts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Stored count of each key; 0 where the mark differs."""
        at = self.index(a, b)
        if not len(self.mark):
            return np.zeros(len(a), np.int64)
        return np.where((at >= 0) & (self.mark[at] == b.astype(np.uint32)), self.count[at], 0)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], np.int64).tobytes()
        return head + b"".join(x.tobytes() for x in self.levels) + self.mark.tobytes() + self.count.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = [int(x) for x in np.frombuffer(data, np.int64, n, 8)]
        at, levels = 8 * (n + 1), []
        for size in sizes:
            levels.append(np.frombuffer(data, np.uint64, size // 64, at))
            at += size // 8
        keys = (len(data) - at) // 12
        return cls(levels, sizes, np.frombuffer(data, np.uint32, keys, at), np.frombuffer(data[at + 4 * keys :], np.int64, keys))


def _blocked(docs: DataFrame, doc_id: str, text: str, blocks: int) -> DataFrame:
    """doc_id, text and the document's block: fixed by its content, so a rerun task deals it the same way."""
    return docs.select(F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(blocks)).cast("int").alias("block"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def line_counts(docs: DataFrame, min_length: int = 1) -> DataFrame:
    """(block, a, b, n): 128-bit hashes of line keys with the number of documents of an Arrow batch that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, bytes], int] = {}
            for block, text in zip(batch.column("block").to_pylist(), as_bytes(batch.column("text")), strict=True):
                keys = {line_key(x) for x in text.split(b"\n")}
                for key in keys:
                    if key and (min_length <= 1 or _code_points(key) >= min_length):
                        at = block, _hash(key)
                        found[at] = found.get(at, 0) + 1
            if found:
                hashes = np.frombuffer(b"".join(h for _, h in found), np.int64).reshape(-1, 2)
                arrays = [np.array([b for b, _ in found], np.int32), hashes[:, 0].copy(), hashes[:, 1].copy(), np.array(list(found.values()), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["block", "a", "b", "n"])

    return docs.select("block", "text").mapInArrow(run, "block int, a long, b long, n long")


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, index): one serialised `PerfectHash` for each shard of the distinct keys of `counts` (a, b, n)."""
    total = counts.groupBy("a", "b").agg(F.sum("n").alias("n")).withColumn("shard", F.pmod(F.col("a"), F.lit(shards)).cast("int"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [rows[c].to_numpy().view(np.uint64) for c in "ab"]
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "index": [PerfectHash.build(*keys, rows["n"].to_numpy()).to_bytes()]})

    return total.groupBy("shard").applyInPandas(build, "shard int, index binary")


def frequent(counts: DataFrame, index: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """(block, a, b) of the keys of each block that the index counts in at least `min_docs` documents.

    A shard's arrays precede its probes in the sorted partition, so a task holds the arrays of one shard at a time.
    """
    probes = counts.select(F.pmod(F.col("a"), F.lit(shards)).cast("int").alias("shard"), "block", "a", "b", F.lit(None).cast("binary").alias("index"))
    arrays = index.select("shard", F.lit(None).cast("int").alias("block"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "index")
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = arrays.union(probes).repartition(parts, "shard").sortWithinPartitions("shard", F.col("index").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            at, blobs = 0, batch.column("index")
            loads = np.flatnonzero(np.asarray(blobs.is_valid()))
            for stop in [*loads.tolist(), batch.num_rows]:
                if stop > at:
                    part = batch.slice(at, stop - at)
                    a, b = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in "ab")
                    many = pa.array(held.counts(a, b) >= min_docs)
                    yield part.select(["block", "a", "b"]).filter(many)
                if stop < batch.num_rows:
                    held = PerfectHash.from_bytes(blobs[stop].as_py())
                at = stop + 1

    return lined.mapInArrow(run, "block int, a long, b long").distinct()


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1, doc_id: str = "doc_id", text: str = "text", blocks: int | None = None, shard_keys: int = 100_000) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of each document, without the lines whose key is in at least `min_docs` documents.

    Lines end at \\n; a null or empty text is one empty line and stays the empty text. A line's key has ASCII white space stripped at both
    ends and A-Z lower-cased; keys of under `min_length` code points are always kept. Other lines stay, joined by \\n, as they were. A line
    repeated inside a document counts once. Rows that repeat a document count as documents of their own. An empty table gives no rows.

    Documents are dealt into blocks by a hash. Only 128-bit line hashes are counted and indexed, about `shard_keys` in a
    shard. The blocks' distinct hashes probe the shards; what comes back is the block's frequent hashes, which meet the block's documents in
    sorted order. A line in a third of all documents is one probe a block.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks or 4 * parts
    dealt = _blocked(docs, doc_id, text, blocks)
    counts = materialise(line_counts(dealt, min_length))
    shards = max(1, -(-counts.count() // shard_keys))
    index = materialise(build_index(counts, shards))
    hits = frequent(counts, index, shards, min_docs)
    none = F.lit(None)
    rows = hits.select("block", none.cast("long").alias("doc_id"), none.cast("string").alias("text"), "a", "b", F.lit(False).alias("doc"))
    kind = dict(dealt.dtypes)["doc_id"]
    rows = rows.withColumn("doc_id", none.cast(kind)).union(dealt.select("block", "doc_id", "text", none.cast("long"), none.cast("long"), F.lit(True)))
    lined = rows.repartition(parts, "block").sortWithinPartitions("block", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, drop = None, set()
        for batch in batches:
            hashes = np.stack([batch.column(c).fill_null(0).to_numpy() for c in "ab"], axis=1)
            picked, out = [], []
            texts = as_bytes(batch.column("text"))
            for i, (at, doc) in enumerate(zip(batch.column("block").to_pylist(), batch.column("doc").to_pylist(), strict=True)):
                if at != block:
                    block, drop = at, set()
                if not doc:
                    drop.add(hashes[i].tobytes())
                    continue
                lines = texts[i].split(b"\n")
                kept = [x for x in lines if not (drop and (key := line_key(x)) and _hash(key) in drop)]
                picked.append(i)
                out.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
            if out:
                n, gone, body = zip(*out, strict=True)
                arrays = [batch.column("doc_id").take(pa.array(picked)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(body, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_lines", "n_dropped", "text"])

    return lined.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, text string")
