"""SimHash near-dedup with Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyratory.llm.blocks import as_bytes
from gyratory.llm.components import components
from gyratory.session import materialise

#: Generator polynomial of the binary Golay code of length 23: 12 data bits, any word within 3 bits of one codeword.
GENERATOR = 0b101011100011
#: (first bit, bits) of the segments of a 64-bit fingerprint; the last is padded with zeros to 23 bits.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainder modulo the generator: 11 bits that name the error pattern."""
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


class Golay:
    """Codeword indices of 23-bit words."""

    def __init__(self):
        patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)], np.int64)
        self.error = np.zeros(1 << 11, np.int64)
        self.error[_remainders(patterns)] = patterns
        self.low, self.high = _remainders(np.arange(1 << 12)), _remainders(np.arange(1 << 11) << 12)

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12 data bits of the only codeword within 3 bits."""
        remainder = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.error[remainder]) >> 11

    def indices(self, words: np.ndarray) -> np.ndarray:
        """Rows of the indices of each word and its 23 neighbours, sorted, -1 for repeats: 1 or 6 of them.

        Words that differ by up to two bits have a common neighbour, so they share an index.
        """
        flips = np.concatenate(([0], 1 << np.arange(23)))
        found = np.sort(self.index(words[:, None] ^ flips[None, :]), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return np.sort(found, axis=1)[:, -6:]


def simhash(words: list[bytes], shingle: int, seed: int = 42, distinct: bool = False) -> int:
    """64 bits, each set where over half of the shingles' XXH64 values have it; 0 without words. Counted in blocks of shingles."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    ones, total, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    if distinct:
        hashes = {digest(text[s : e - 1], seed) for s, e in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)}
        parts = [np.fromiter(hashes, np.uint64, len(hashes))]
    else:
        firsts, lasts = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
        parts = (np.fromiter((digest(text[s : e - 1], seed) for s, e in zip(firsts[i : i + 65536], lasts[i : i + 65536], strict=True)), np.uint64) for i in range(0, n, 65536))
    for part in parts:
        total += len(part)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", distinct: bool = False) -> DataFrame:
    """(doc_id, fingerprint long) of each row: words end at ASCII white space, A-Z are lower-cased, fewer words make one shingle."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhash(t.lower().split(), shingle, distinct=distinct) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint long")


def _segments(values: np.ndarray) -> list[np.ndarray]:
    return [(values >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def close_keys(prints: DataFrame) -> DataFrame:
    """(fingerprint, key): of fingerprints within two bits of each other, some key is shared.

    Two errors leave one of three segments whole, and put at most two into the next. A key is a whole segment
    with a Golay index of the next one: 1 or 6 keys a segment.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Golay()
        for frame in frames:
            parts = _segments(frame["fingerprint"].to_numpy().view(np.uint64))
            rows, keys = [], []
            for i, whole in enumerate(parts):
                index = code.indices(parts[(i + 1) % 3])
                row, column = np.nonzero(index >= 0)
                rows.append(row)
                keys.append((i << 36) | (whole[row] << 12) | index[row, column])
            yield pd.DataFrame({"fingerprint": frame["fingerprint"].to_numpy()[np.concatenate(rows)], "key": np.concatenate(keys)})

    return prints.select("fingerprint").mapInPandas(run, "fingerprint long, key long")


def wide_keys(prints: DataFrame, carry: str) -> DataFrame:
    """(fingerprint, key, int column `carry` of `prints`): of fingerprints with at most two errors in at least two segments, some key is shared.

    That holds within five bits, and for most pairs of up to eight. A key is the Golay indices of two segments: up to 36 a pair.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Golay()
        for frame in frames:
            values = frame["fingerprint"].to_numpy()
            index = [code.indices(x) for x in _segments(values.view(np.uint64))]
            for n, (i, j) in enumerate(combinations(range(3), 2)):
                key = (n << 24) | (index[i][:, :, None] << 12) | index[j][:, None, :]
                fits = (index[i][:, :, None] >= 0) & (index[j][:, None, :] >= 0)
                row = np.nonzero(fits)[0]
                yield pd.DataFrame({"fingerprint": values[row], "key": key[fits], carry: frame[carry].to_numpy()[row]})

    return prints.select("fingerprint", carry).mapInPandas(run, f"fingerprint long, key long, {carry} int")


def _neighbours(prints: DataFrame) -> DataFrame:
    """Links by common neighbours: fingerprints one bit or less from the same value hang on the smallest of them."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    near = prints.select("fingerprint", F.explode(F.transform(flips, lambda x: F.col("fingerprint").bitwiseXOR(x))).alias("value"))
    least = near.groupBy("value").agg(F.min("fingerprint").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return near.join(least, "value").filter("fingerprint <> b").select(F.col("fingerprint").alias("a"), "b")


def close_links(prints: DataFrame, crowd: int = 64) -> DataFrame:
    """(a, b) links that connect all `prints` (fingerprint, distinct) that differ by at most two bits.

    Members of a key's bucket are compared with each other where it has at most `crowd` of them. Members of larger
    buckets meet by their 65 neighbours instead: what shares a neighbour is within two bits, so a star links the group. Both
    ways are exact, and neither is quadratic in a bucket.
    """
    keys = materialise(close_keys(prints))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    few = sizes.filter((F.col("n") > 1) & (F.col("n") <= crowd)).select("key")
    many = sizes.filter(F.col("n") > crowd).select("key")
    small = keys.join(few, "key", "left_semi")
    pairs = small.alias("x").join(small.alias("y"), "key").filter("x.fingerprint < y.fingerprint AND bit_count(x.fingerprint ^ y.fingerprint) <= 2")
    pairs = pairs.select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b"))
    crowded = keys.join(many, "key", "left_semi").select("fingerprint").distinct()
    return pairs.union(_neighbours(crowded)).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", crowd: int = 64) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of each row. Fingerprints link at two or fewer differing bits, chains included.

    component_id is the smallest doc_id reachable, itself included; null doc_ids count for nothing, and a component of such
    rows alone has null. Texts without words, null ones too, have fingerprint zero, linked like any other. Rows that
    repeat share their fingerprint. An empty table gives no rows.

    Equal fingerprints are one class from the start; keys, links and components are of classes, never of documents.
    """
    prints = materialise(fingerprints(docs, shingle, doc_id, text))
    classes = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(close_links(classes, crowd))
    named = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = materialise(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "root").select(F.col("fingerprint").alias("print"), "component_id")
    return prints.join(labels, prints["fingerprint"] == labels["print"]).select("doc_id", "fingerprint", "component_id")
