"""Source divergence audit: terms counted once to filter them, then again through sharded minimal perfect hashes into dense slots."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyratory.llm.blocks import as_bytes
from gyratory.llm.line_index import PerfectHash
from gyratory.session import materialise

#: Terms are ASCII letters, lower-cased, and every byte of a character beyond ASCII; anything else parts them.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_PIECE = 1 << 22
#: Terms that a task of the first pass holds before it hands them on, and bytes of dense slots that one of the second does.
_HELD, _DENSE = 400_000, 1 << 27
#: Sides of a tile of the pairwise sums: sources and terms.
TILE, BLOCK = 64, 4096


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of a few MB."""
    at = 0
    while at < len(text):
        stop = at + _PIECE
        if stop < len(text):
            # a term is never cut: the piece ends at the next byte that parts terms
            while stop < len(text) and _LETTERS[text[stop]] != 0x20:
                stop += 1
        yield text[at:stop].translate(_LETTERS).split()
        at = stop


class TermShard:
    """Minimal perfect hash of some keys with the keys themselves in the order of their slots."""

    def __init__(self, index: PerfectHash, keys: list[bytes]):
        self.index, self.keys = index, keys

    @staticmethod
    def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pair = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)
        return pair[:, 0].copy(), pair[:, 1].copy()

    @classmethod
    def build(cls, keys: list[bytes]) -> TermShard:
        a, b = cls.hashes(keys)
        index = PerfectHash.build(a, b, np.arange(1, len(keys) + 1))
        ordered: list[bytes] = [b""] * len(keys)
        for at, key in zip(index.index(a, b).tolist(), keys, strict=True):
            ordered[at] = key
        index.count[index.index(a, b)] = index.index(a, b) + 1
        return cls(index, ordered)

    def slots(self, keys: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where the stored key is another."""
        found = self.index.counts(a, b) - 1
        for i in np.flatnonzero(found >= 0).tolist():
            if self.keys[found[i]] != keys[i]:
                found[i] = -1
        return found

    def to_bytes(self) -> bytes:
        index, ends = self.index.to_bytes(), np.cumsum([len(k) for k in self.keys], dtype=np.int64)
        return np.array([len(index), len(self.keys)], np.int64).tobytes() + index + ends.tobytes() + b"".join(self.keys)

    @classmethod
    def from_bytes(cls, data: bytes) -> TermShard:
        size, n = (int(x) for x in np.frombuffer(data, np.int64, 2))
        ends = np.frombuffer(data[16 + size : 16 + size + 8 * n], np.int64).tolist()
        body = data[16 + size + 8 * n :]
        return cls(PerfectHash.from_bytes(data[16 : 16 + size]), [body[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)] if n else [])


def _key(lang: str, term: bytes) -> bytes:
    return lang.encode("utf-8", "surrogatepass") + b"\0" + term


def kept_terms(rows: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term) found in at least `min_docs` rows of the language, counted exactly; `rows` has lang, source and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                names = pa.array(list(found), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), names, pa.array(list(found.values()), pa.int64())], names=["lang", "term", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
                own: set[bytes] = set()
                for some in terms(text):
                    own.update(some)
                held.setdefault(lang, Counter()).update(own)
                if sum(map(len, held.values())) > _HELD:
                    yield from flushed()
        yield from flushed()

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")


def build_shards(kept: DataFrame, shards: int) -> DataFrame:
    """(shard, size, index): the serialised `TermShard` of each shard of the keys of `kept`."""

    def build(rows: pa.Table) -> pa.Table:
        made = TermShard.build(_keys_of(rows)).to_bytes()
        return pa.table({"shard": rows.column("shard").slice(0, 1), "size": [len(made)], "index": pa.array([made], pa.binary())})

    return _dealt(kept, shards).groupBy("shard").applyInArrow(build, "shard int, size long, index binary")


def _keys_of(rows: pa.Table | pa.RecordBatch) -> list[bytes]:
    return [_key(lang, term) for lang, term in zip(rows.column("lang").to_pylist(), as_bytes(rows.column("term")), strict=True)]


def _dealt(kept: DataFrame, shards: int) -> DataFrame:
    """`kept` with the shard of each key, by the hash that probes use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = _shard_of(TermShard.hashes(_keys_of(batch))[0], shards).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.select(["lang", "term"]).columns, pa.array(shard)], names=["lang", "term", "shard"])

    return kept.mapInArrow(run, "lang string, term string, shard int")


def slot_terms(index: DataFrame) -> DataFrame:
    """(slot, lang, term) of every key that the shards store; a slot names shard and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("index").to_pylist(), strict=True):
                parts = [k.rpartition(b"\0") for k in TermShard.from_bytes(blob).keys]
                slot = pa.array((shard << 32) + np.arange(len(parts)))
                yield pa.RecordBatch.from_arrays([slot, *(pa.array([p[i] for p in parts], pa.binary()).cast(pa.string()) for i in (0, 2))], names=["slot", "lang", "term"])

    return index.select("shard", "index").mapInArrow(run, "slot long, lang string, term string")


def _slot_counts(rows: DataFrame, sent: Broadcast) -> DataFrame:
    """(lang, source, slot, n): occurrences of the terms of the shards that `sent` holds, a row of each slot, group and task or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, blobs = sent.value
        held = {shard: TermShard.from_bytes(blob) for shard, blob in blobs}
        numbers = sorted(held)
        base = dict(zip(numbers, np.concatenate(([0], np.cumsum([len(held[s].keys) for s in numbers])))[:-1].astype(np.int64).tolist(), strict=True))
        name = np.concatenate([(np.int64(s) << 32) + np.arange(len(held[s].keys)) for s in numbers])
        dense: dict[tuple[str, str], np.ndarray] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                used = np.flatnonzero(counts)
                arrays = [pa.array([lang] * len(used), pa.string()), pa.array([source] * len(used), pa.string()), pa.array(name[used]), pa.array(counts[used])]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "slot", "n"])
            dense.clear()

        def places(keys: list[bytes]) -> np.ndarray:
            a, b = TermShard.hashes(keys)
            out, shard = np.full(len(keys), -1, np.int64), _shard_of(a, total)
            order = np.argsort(shard, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(part) and (s := int(shard[part[0]])) in held:
                    got = held[s].slots([keys[i] for i in part.tolist()], a[part], b[part])
                    out[part] = np.where(got >= 0, got + base[s], -1)
            return out

        for batch in batches:
            seen: dict[tuple[str, str], Counter[bytes]] = {}
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), as_bytes(batch.column("text")), strict=True):
                found = seen.setdefault((lang, source), Counter())
                for some in terms(text):
                    found.update(some)
            for (lang, source), found in seen.items():
                if not found:
                    continue
                at = places([_key(lang, term) for term in found])
                if (lang, source) not in dense:
                    if (len(dense) + 1) * len(name) * 8 > _DENSE:
                        yield from flushed()
                    dense[lang, source] = np.zeros(len(name), np.int64)
                hit = at >= 0
                # each term of the counter is one slot, so no slot is met twice
                dense[lang, source][at[hit]] += np.fromiter(found.values(), np.int64, len(found))[hit]
        yield from flushed()

    return rows.mapInArrow(run, "lang string, source string, slot long, n long")


def _shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return (a % np.uint64(shards)).astype(np.int64)


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * count / total) for count <= total, exact while a total stays under 9 * 10^15: three digits at a time."""
    out, rest = F.lit(0).cast("long"), count.cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, total)
        rest = (rest * 1000) % total
    return out + 1


def _tile_sums(cells: DataFrame) -> DataFrame:
    """(lang, g, h, value): for sources g < h the sum, over terms that occur in either, of |p_g - p_h| less that of two absent terms.

    `cells` (lang, source, tiles, tile, block, slot, p, p0) has a row without slot of each source and block. A task holds one block of terms
    for two tiles of sources.
    """
    met = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, _, low, high = (k.as_py() for k in key)
        names, source = np.unique(np.array(rows.column("source").to_pylist(), object), return_inverse=True)
        slot = rows.column("slot")
        there = slot.is_valid().to_numpy()
        slots, term = np.unique(slot.drop_null().to_numpy(), return_inverse=True)
        zero, tile = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        zero[source], tile[source] = rows.column("p0").to_numpy(), rows.column("tile").to_numpy()
        p = np.repeat(zero[:, None], len(slots), axis=1)
        p[source[there], term] = rows.column("p").drop_null().to_numpy()
        g, h, value = [], [], []
        for i in range(len(names)):
            # pairs of two tiles once, those inside a tile where it meets itself
            to = np.flatnonzero((tile == tile[i]) if low == high else (tile != tile[i]))
            to = to[to > i]
            g.append(np.full(len(to), i))
            h.append(to)
            value.append(np.abs(p[to] - p[i]).sum(axis=1) - len(slots) * np.abs(zero[to] - zero[i]))
        g, h = np.concatenate(g), np.concatenate(h)
        return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": pa.array(names[g].tolist(), pa.string()), "h": pa.array(names[h].tolist(), pa.string()), "value": pa.array(np.concatenate(value), pa.int64())})

    return met.groupBy("lang", "block", "low", "high").applyInArrow(run, "lang string, g string, h string, value long").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, smooth: int = 5, shard_keys: int = 50_000, room: int = 64 << 20, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of each (lang, source) group of `docs`.

    Null text, lang and source are ''. Terms are runs of letters and characters beyond ASCII, A-Z lower-cased. A language keeps the V terms found in
    at least `min_docs` of its rows (repeated rows count as rows). With N kept occurrences in a group, a kept term with `count` has the share
    p = 1 + floor(10^9 * (count + smooth) / (N + smooth * V)); a language as a whole has q likewise. Part `pair`: every other source of the
    language and the sum over kept terms of the difference of their shares, 0 without kept terms. Part `term`: the `top` terms that occur with
    p > q, and p - q. Ranks go by value, largest first, then by the item's bytes. A language of one source has no pairs. An empty table gives no rows.

    The first pass filters terms by exact counts of the terms themselves. What stays is stored in minimal perfect hashes of about `shard_keys`
    keys each; they are broadcast, at most `room` bytes at a time, and a pass over the rows counts into dense slots of each group. More
    keys take more passes, never more memory.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept = materialise(kept_terms(rows, min_docs))
    shards = max(1, -(-kept.count() // shard_keys))
    index = materialise(build_shards(kept, shards))
    largest = index.agg(F.max("size")).first()[0] or 1
    step = max(1, room // largest)
    counted = None
    for first in range(0, shards, step):
        blobs = index.filter(F.col("shard").between(first, first + step - 1)).select("shard", "index").collect()
        if blobs:
            some = _slot_counts(rows, spark.sparkContext.broadcast((shards, [(r[0], bytes(r[1])) for r in blobs])))
            counted = some if counted is None else counted.union(some)
    if counted is None:
        counted = spark.createDataFrame([], "lang string, source string, slot long, n long")
    counts = materialise(counted.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")))

    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).drop("rows")
    groups = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("total", zero).alias("total"))
    # a language without kept terms has no shares
    under = F.greatest(F.col("total") + smooth * F.col("v"), F.lit(1).cast("long"))
    groups = materialise(groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(smooth), under)).otherwise(zero)))
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n") + smooth, under))

    whole = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    of_lang = groups.groupBy("lang").agg(F.max("v").alias("v"), F.sum("total").alias("total"))
    whole = whole.join(of_lang, "lang").select("slot", _share(F.col("n") + smooth, under).alias("q"))
    above = shares.join(whole, "slot").filter("p > q").select("lang", "source", "slot", (F.col("p") - F.col("q")).alias("value"))
    named = above.join(slot_terms(index).select("slot", F.col("term").alias("item")), "slot")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    many = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"), F.max("v").alias("_v"))
    many = many.select("lang", F.ceil(F.col("s") / TILE).cast("int").alias("tiles"), F.greatest(F.lit(1), F.ceil(F.col("_v") / BLOCK)).cast("int").alias("blocks"))
    members = groups.join(many, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int"))
    none = F.lit(None).cast("long")
    marks = members.select("lang", "source", "tiles", "tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), none.alias("slot"), none.alias("p"), "p0")
    cells = shares.select("lang", "source", "slot", "p").join(members, ["lang", "source"])
    cells = cells.select("lang", "source", "tiles", "tile", F.pmod(F.xxhash64("slot"), "blocks").cast("int").alias("block"), "slot", "p", "p0")
    sums = _tile_sums(marks.union(cells))
    one, other = (groups.select("lang", F.col("source").alias(n), "v", F.col("p0").alias(f"p0_{n}")) for n in "gh")
    pairs = sums.join(one, ["lang", "g"]).join(other.drop("v"), ["lang", "h"])
    pairs = pairs.select("lang", "g", "h", (F.col("value") + F.col("v") * F.abs(F.col("p0_g") - F.col("p0_h"))).alias("value"))
    pairs = pairs.union(pairs.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value")).toDF("lang", "source", "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    parts = [x.select("lang", "source", F.lit(n).alias("part"), "item", "value", "rank") for n, x in (("pair", pairs), ("term", best))]
    return parts[0].union(parts[1])
