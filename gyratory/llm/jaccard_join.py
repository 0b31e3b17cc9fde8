"""N-gram Jaccard join: count vectors of shingles as points of a packed R-tree, overlaps bounded by summed minima, survivors verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyratory.llm.bitmaps import with_bit
from gyratory.llm.blocks import SOLID_BYTES, Words, as_bytes, cut, mixed
from gyratory.llm.components import components
from gyratory.session import materialise

#: A level of sizes reaches to this times its first size.
STEP = Fraction(8, 5)
#: Coordinates of a point that are added up to one of the tree, and members of a leaf and of a tile of the tree.
FOLD, LEAF, TILE = 8, 32, 512
#: Keys that may be dealt over several tasks, the commonest of one row of SAMPLE with at least HOT_ROWS there, and tasks that each of them is dealt over.
HOT, SAMPLE, HOT_ROWS, SALTS = 4096, 32, 100, 64
#: One of so many keys names heads; partners of a set that meet it in one task.
STARS, PLACE = 4, 250
_ROUND = np.uint64(0x9E3779B97F4A7C15)
_KNOWN, _PIECE = 1 << 19, 1 << 20
#: Numbers that a batch of keys or sets is given on with, so that neither side of the exchange holds those of all its rows.
_GIVEN = 1 << 17


def _chained(hashes: np.ndarray, words: int, n: int) -> np.ndarray:
    """Hash of each of the first `n` runs of that many words."""
    out = np.full(n, np.uint64(words))
    for k in range(words):
        out = mixed(out * _ROUND + hashes[k : k + n])
    return out


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Of each text the distinct 64-bit hashes of its shingles of `size` words, sorted; fewer words make one shingle, none an empty set."""
    for start, stop in cut(texts, _PIECE):
        words = Words(texts[start:stop], SOLID_BYTES)
        hashes, counts = words.hashes(), np.bincount(words.doc, minlength=stop - start)
        # runs that reach into the next text are never read
        runs = _chained(hashes, size, max(0, len(hashes) - size + 1))
        at = 0
        for n in counts.tolist():
            found = np.sort(runs[at : at + n - size + 1]) if n >= size else _chained(hashes[at : at + n], n, min(n, 1))
            at += n
            yield found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) > 1 else found


@dataclass(frozen=True)
class Level:
    """Sizes from `first` up to `stop`; pairs whose smaller set is in it differ in at most `apart` members; `slices` of the finest vector."""

    number: int
    first: int
    stop: int
    apart: int

    @property
    def slices(self) -> int:
        return self.apart + 3 + self.apart // 10


class Similarity:
    """Link rule intersection / union >= least, in whole numbers, and the levels of sizes that follow from it: each reaches to `step` times its first size.

    The smaller `least`, the smaller `step` has to be: where slices are many for the sets of a level, empty ones become keys that unrelated sets share.
    """

    def __init__(self, least: Fraction, step: Fraction = STEP):
        self.least, self.step = least, step
        self.levels = lru_cache(1 << 16)(self._levels)

    def __reduce__(self):
        return Similarity, (self.least, self.step)

    def need(self, total):
        """Smallest intersection of two sets of `total` members together."""
        up, down = self.least.numerator, self.least.numerator + self.least.denominator
        return -(-total * up // down)

    def largest(self, size: int) -> int:
        """Largest partner of a set of that size."""
        return size * self.least.denominator // self.least.numerator

    def slices(self, size: int) -> int:
        """Slices that a set of that size has in all its levels."""
        return sum(level.slices for level in self.levels(size) if level.apart)

    def _levels(self, size: int) -> list[Level]:
        """Levels that a set of that size has keys in: that of its own size and those of smaller sets that it may be linked to."""
        out, first, number = [], 1, 0
        while first <= size:
            stop = max(first + 1, first * self.step.numerator // self.step.denominator)
            if self.largest(stop - 1) >= size:
                total = stop - 1 + self.largest(stop - 1)
                up, down = self.least.numerator, self.least.numerator + self.least.denominator
                out.append(Level(number, first, stop, total * (down - 2 * up) // down))
            first, number = stop, number + 1
        return out


def slice_keys(members: np.ndarray, level: Level) -> np.ndarray:
    """A key of each slice of the finest count vector, whose groups are the hashes themselves: equal where two sets agree in the slice.

    Sets that differ in at most `apart` members agree in at least slices - apart slices. Empty slices have a key only where a set has so many of
    them that they may be all it agrees in.
    """
    at = ((members >> np.uint64(32)) * np.uint64(level.slices) >> np.uint64(32)).astype(np.int64)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    sums, used = np.add.reduceat(mixed(members ^ _ROUND), starts), at[starts]
    if level.slices - len(used) >= level.slices - level.apart:
        whole = np.zeros(level.slices, np.uint64)
        whole[used] = sums
        sums, used = whole, np.arange(level.slices)
    return mixed(sums + mixed((np.uint64(level.number) << np.uint64(32)) + used.astype(np.uint64)))


def axes_of(size: int) -> int:
    """Coordinates of the point of a set: a power of two, for half a member to one each."""
    return 1 << max(4, size.bit_length())


def point(members: np.ndarray, axes: int) -> np.ndarray:
    """Count vector: members to each of `axes` (a power of two) groups."""
    return np.bincount((members & np.uint64(axes - 1)).astype(np.int64), minlength=axes).astype(np.uint16)


def packed(point: np.ndarray) -> bytes:
    """A point in two bits a coordinate, followed by those over three: almost all counts are smaller."""
    small, large = np.minimum(point, 3).astype(np.uint8), np.flatnonzero(point > 3)
    head = np.array([len(point), len(large)], np.uint32)
    return b"".join(x.tobytes() for x in (head, np.packbits(small & 1), np.packbits(small >> 1), large.astype(np.uint32), point[large].astype(np.uint16)))


def unpacked(data: bytes) -> np.ndarray:
    axes, n = (int(x) for x in np.frombuffer(data, np.uint32, 2))
    plane = axes // 8
    low, high = (np.unpackbits(np.frombuffer(data, np.uint8, plane, 8 + i * plane)) for i in range(2))
    out = (low + 2 * high).astype(np.uint16)
    at = 8 + 2 * plane
    out[np.frombuffer(data, np.uint32, n, at)] = np.frombuffer(data, np.uint16, n, at + 4 * n)
    return out


def folded(points: np.ndarray, axes: int) -> np.ndarray:
    """Points with fewer coordinates: groups whose numbers share their low bits are one."""
    return points.reshape(*points.shape[:-1], -1, axes).sum(axis=-2, dtype=np.uint16)


def leaf_pairs(x: np.ndarray, y: np.ndarray, need, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of points of `x` and `y` (counts by row) whose summed minima reach what the link asks for.

    Both sides are packed into leaves along their size and their first coordinates, by points of a FOLD-th of the coordinates. A leaf is bounded by its
    largest coordinates and its smallest size; leaf pairs that the bound rules out are not opened. Pairs inside them are bounded by their folded
    points first, then by all coordinates. With `same` only pairs in order are given.
    """
    fine_x, fine_y = x, y
    x, y = (folded(p, max(1, p.shape[1] // FOLD)) for p in (x, y))
    sides = []
    for points in (x, y):
        size = points.sum(axis=1, dtype=np.int64)
        order = np.lexsort((*points[:, :3].T[::-1], size))
        cuts = np.arange(0, len(order), LEAF)
        sides.append((size, order, cuts, np.maximum.reduceat(points[order], cuts, axis=0), np.minimum.reduceat(size[order], cuts)))
    (x_size, x_order, x_cuts, x_top, x_low), (y_size, y_order, y_cuts, y_top, y_low) = sides
    one, other = [], []
    for i, at in enumerate(x_cuts):
        inside = x_order[at : at + LEAF]
        bound = np.minimum(x_top[i], y_top).sum(axis=1, dtype=np.int64)
        for j in np.flatnonzero(bound >= need(x_low[i] + y_low)).tolist():
            if same and j < i:
                continue
            across = y_order[y_cuts[j] : y_cuts[j] + LEAF]
            shared = np.minimum(x[inside][:, None, :], y[across][None, :, :]).sum(axis=2, dtype=np.int64)
            a, b = np.nonzero(shared >= need(x_size[inside][:, None] + y_size[across][None, :]))
            a, b = inside[a], across[b]
            if same and i == j:
                a, b = a[a < b], b[a < b]
            for at in range(0, len(a), 4096):
                p, q = a[at : at + 4096], b[at : at + 4096]
                near = np.minimum(fine_x[p], fine_y[q]).sum(axis=1, dtype=np.int64) >= need(x_size[p] + y_size[q])
                one.append(p[near])
                other.append(q[near])
    none = np.zeros(0, np.int64)
    return (np.concatenate(one), np.concatenate(other)) if one else (none, none)


def name_of(members: np.ndarray) -> int:
    """64 bits that name a set."""
    return int.from_bytes(xxhash.xxh3_64_digest(members.tobytes()), "little", signed=True)


def _counted(docs: DataFrame, size: int, rule: Similarity, doc_id: str, text: str) -> DataFrame:
    """(doc_id, node, n, k) of each row: name and size of its set, and how many slices it has in all its levels."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = [], []
            for members in shingle_sets(as_bytes(batch.column("text")), size):
                nodes.append(name_of(members))
                sizes.append(len(members))
            slices = [rule.slices(n) for n in sizes]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (nodes, sizes, slices))], names=["doc_id", "node", "n", "k"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, node long, n long, k long")


def _sets(docs: DataFrame, size: int, text: str) -> DataFrame:
    """(node, set binary) of the rows that have words; a set that a task meets again soon is given once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            nodes, sets, held = [], [], 0
            for members in shingle_sets(as_bytes(batch.column("text")), size):
                node = name_of(members)
                if len(members) and node not in given:
                    given.add(node)
                    nodes.append(node)
                    sets.append(members.tobytes())
                    held += len(members)
                if held > _GIVEN:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])
                    nodes, sets, held = [], [], 0
            if len(given) > _KNOWN:
                given.clear()
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "node long, set binary")


def _asked(docs: DataFrame, nodes: DataFrame, size: int, text: str) -> DataFrame:
    """(node, set) of the sets that `nodes` (node) names, once each; the others do not travel, but for a few."""
    found = with_bit(_sets(docs, size, text), "node", nodes.select(F.col("node").alias("_node")), "_node").filter("_bit").select("node", "set")
    return found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _keys(docs: DataFrame, size: int, rule: Similarity, text: str, hot: Broadcast | None) -> DataFrame:
    """(key, node): the keys of all slices. Keys of `hot` (sorted) are dealt over SALTS keys made of them."""

    def dealt(keys: list[np.ndarray], nodes: list[np.ndarray], many: np.ndarray) -> pa.RecordBatch:
        key, node = np.concatenate(keys), np.concatenate(nodes)
        if len(many):
            at = np.minimum(np.searchsorted(many, key), len(many) - 1)
            key = np.where(many[at] == key, _salted(key, (node & (SALTS - 1)).astype(np.uint64)), key)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], names=["key", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        many = hot.value if hot else np.zeros(0, np.uint64)
        for batch in batches:
            nodes, keys, held = [], [], 0
            for members in shingle_sets(as_bytes(batch.column("text")), size):
                node = name_of(members)
                if not len(members) or node in given:
                    continue
                given.add(node)
                for level in rule.levels(len(members)):
                    if level.apart:
                        made = slice_keys(members, level)
                        nodes.append(np.full(len(made), node))
                        keys.append(made)
                        held += len(made)
                if held > _GIVEN:
                    yield dealt(keys, nodes, many)
                    nodes, keys, held = [], [], 0
            if len(given) > _KNOWN:
                given.clear()
            if keys:
                yield dealt(keys, nodes, many)

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "key long, node long")


def _salted(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return mixed(key ^ mixed(salt + np.uint64(1)))


def _buckets(docs: DataFrame, size: int, rule: Similarity, text: str) -> DataFrame:
    """(key, node): the different sets that share a key with another, each once.

    One shuffle of the keys; a sorted partition is read as a stream, so sets that are alone with a key go at once. Hot keys come in SALTS parts.
    """
    sampled = docs.filter(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0)
    counts = _keys(sampled, size, rule, text, None).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_ROWS)
    hot = np.sort(np.array([r[0] for r in counts.orderBy(F.desc("n"), "key").limit(HOT).collect()], np.int64).view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast(hot)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = _keys(docs, size, rule, text, sent).repartition(parts, "key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = sent.value
        salted = _salted(np.repeat(many, SALTS), np.tile(np.arange(SALTS, dtype=np.uint64), len(many))).view(np.int64)
        order = np.argsort(salted)
        salted, plain = salted[order], np.repeat(many, SALTS).view(np.int64)[order]
        rest, going_on = np.zeros((0, 2), np.int64), False
        for batch in chain(batches, [None]):
            rows = rest if batch is None else np.concatenate((rest, np.stack([batch.column(c).to_numpy() for c in ("key", "node")], axis=1)))
            rows = rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))] if len(rows) else rows
            if not len(rows):
                continue
            # the last row waits for its successor; `going_on` tells whether the first one has had a predecessor
            same = rows[1:, 0] == rows[:-1, 0]
            keep = np.concatenate(([going_on], same))
            keep[:-1] |= same
            key = rows[:, 0]
            if len(salted):
                at = np.minimum(np.searchsorted(salted, key), len(salted) - 1)
                part = salted[at] == key
                keep, key = keep | part, np.where(part, plain[at], key)
            stop = len(rows) if batch is None else len(rows) - 1
            going_on = bool(same[-1]) if len(same) else going_on
            keep[stop:] = False
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(rows[keep, 1])], names=["key", "node"])
            rest = rows[stop:]

    return materialise(lined.mapInArrow(run, "key long, node long"))


def _stars(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(x, y): each set of the buckets with the head it shares most keys with.

    The head of a bucket is its most ordinary set, the one with the least share of keys that no other set has: the text that others were made of,
    where there is one. One key of STARS is enough for that, since nothing is lost here.
    """
    ordinary = met.groupBy("node").agg(F.count(F.lit(1)).alias("met")).join(classes, "node").select("node", ((F.col("k") - F.col("met")) / F.col("k")).alias("alone"))
    some = met.filter(F.pmod("key", F.lit(STARS)) == 0)
    heads = some.join(ordinary, "node").groupBy("key").agg(F.min(F.struct("alone", "node"))["node"].alias("head"))
    shared = some.join(heads, "key").filter("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("node").agg(F.max(F.struct("n", "head"))["head"].alias("head"))
    return best.select(F.col("node").alias("x"), F.col("head").alias("y"))


def _linked(pairs: DataFrame, docs: DataFrame, size: int, rule: Similarity, text: str) -> DataFrame:
    """(x, y) of the `pairs` that are linked, by their sets.

    Sets go to where the other one of the pair is: a set x travels once for each y, each y once for every PLACE of its partners, so no task gets all
    partners of a set. There they are read as a stream behind the set of y.
    """
    pairs = materialise(pairs.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(1 << 20))))
    sizes = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / PLACE).alias("salts"))
    placed = pairs.join(sizes, "y").select("x", "y", F.pmod("salt", "salts").alias("salt"))
    places = placed.select(F.col("x").alias("node"), F.col("y").alias("place"), "salt").union(placed.select("y", "y", "salt").distinct())
    places = materialise(places)
    sets = with_bit(_sets(docs, size, text), "node", places.select(F.col("node").alias("_node")), "_node").filter("_bit").select("node", "set")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # sets of equal rows of several tasks meet here once
    there = sets.dropDuplicates(["node"]).join(places, "node").withColumn("_partner", F.col("node") != F.col("place"))
    lined = there.repartition(parts, "place", "salt").sortWithinPartitions("place", "salt", "_partner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in batches:
            out = []
            for node, place, partner, body in zip(*(batch.column(c).to_pylist() for c in ("node", "place", "_partner")), batch.column("set"), strict=True):
                members = np.frombuffer(body.as_buffer(), np.uint64)
                if not partner:
                    held = members.copy()
                    continue
                both = np.sort(np.concatenate((held, members)))
                if int((both[1:] == both[:-1]).sum()) >= rule.need(len(both)):
                    out.append((node, place))
            x, y = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(x.copy()), pa.array(y.copy())], names=["x", "y"])

    return lined.select("node", "place", "_partner", "set").mapInArrow(run, "x long, y long")


def _searched(opened: DataFrame, docs: DataFrame, size: int, rule: Similarity, text: str, tile: int) -> DataFrame:
    """(x, y): pairs of different roots inside a bucket of `opened` (key, node, root) that the bounds of the tree let through.

    A bucket is cut into tiles by a hash. Each two tiles meet in a task, where their points are packed into leaves.
    """
    sizes = opened.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))

    def pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column("set")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([packed(point(s, axes_of(len(s)))) for s in sets], pa.binary())], names=["node", "point"])

    points = materialise(_asked(docs, opened.select("node").distinct(), size, text).mapInArrow(pointed, "node long, point binary"))
    dealt = opened.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "root").join(points, "node")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = dealt.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high")

    def searched(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own, root = (rows.column(c).to_numpy() for c in ("node", "root"))
        points = [unpacked(p) for p in rows.column("point").to_pylist()]
        axes = min(map(len, points))
        matrix = np.stack([folded(p, axes) for p in points])
        tile, low, high = (rows.column(c).to_numpy() for c in ("tile", "low", "high"))
        same = low[0] == high[0]
        x, y = np.flatnonzero(tile == low[0]), np.flatnonzero(tile == high[0])
        a, b = leaf_pairs(matrix[x], matrix[y], rule.need, same)
        a, b = x[a], y[b]
        other = root[a] != root[b]
        return np.minimum(own[a], own[b])[other], np.maximum(own[a], own[b])[other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            rows = pa.Table.from_batches([b for b in (rest, batch) if b is not None]).combine_chunks() if rest is not None or batch is not None else None
            if rows is None or not len(rows):
                continue
            named = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("key", "low", "high")], axis=1)
            cuts = [0, *(np.flatnonzero((named[1:] != named[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
            # the last run may go on in the next batch
            whole = cuts if batch is None else cuts[:-1]
            found = [searched(rows.slice(s, e - s)) for s, e in zip(whole[:-1], whole[1:], strict=True)]
            rest = None if batch is None else rows.slice(cuts[-2]).combine_chunks().to_batches()[0]
            if found:
                # a pair of several buckets is given once
                pairs = np.unique(np.stack([np.concatenate(c) for c in zip(*found, strict=True)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy()) for i in range(2)], names=["x", "y"])

    return lined.mapInArrow(run, "x long, y long").distinct()


def jaccard_links(docs: DataFrame, classes: DataFrame, size: int, rule: Similarity, tile: int = TILE, text: str = "text", near: DataFrame | None = None) -> DataFrame:
    """(a, b) links that connect all sets of `classes` (node, k) that `rule` links, exactly.

    Pairs `near` (x, y: the one that more pairs share) are verified with the first of the buckets; they only join early what would be found later.
    """
    met = _buckets(docs, size, rule, text)
    pairs = _stars(met, classes)
    if near is not None:
        pairs = pairs.union(near.select("x", "y")).distinct()
    first = materialise(_linked(pairs, docs, size, rule, text))
    named = met.join(components(first.toDF("a", "b")), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    held = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"held{i}") for i in range(2)]
    several = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), *held).filter("lo <> hi")
    # buckets of the same sets are searched once
    several = several.groupBy("n", "held0", "held1").agg(F.min("key").alias("key")).select("key")
    opened = materialise(named.join(several, "key", "left_semi"))
    late = materialise(_linked(_searched(opened, docs, size, rule, text, tile), docs, size, rule, text))
    return first.union(late).toDF("a", "b")


def jaccard_groups(docs: DataFrame, size: int = 4, least: Fraction = Fraction(85, 100), tile: int = TILE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row.

    Words end at ASCII white space, A-Z are lower-cased. A row's set are its distinct shingles of `size` words; fewer words are one shingle. Rows
    link where intersection / union >= `least`; component_id is the smallest doc_id reachable, itself included. Rows without words (null,
    empty, white space) have no shingles and no links. Null doc_ids count for nothing; a component of such rows alone has null. Rows that
    repeat share their component. An empty table gives no rows.

    Equal sets are one node from the start. A set's hashes are a count vector; its slices are the upper nodes of the tree: sets of near sizes that
    link agree in some slice (pigeonhole), so each slice is a key that finds the branch. Inside, every set is verified with the first of a bucket
    that it shares most keys with. What that joins needs no search; buckets that still hold several groups are searched by coarse
    points packed in leaves, whose bound is the sum of the smaller coordinates, and what passes is verified.
    """
    rule = Similarity(least)
    rows = materialise(_counted(docs, size, rule, doc_id, text))
    classes = materialise(rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("k").alias("k")))
    roots = components(jaccard_links(docs, classes, size, rule, tile, text))
    classes = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least_of = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = classes.join(least_of, "root").select("node", "component_id")
    out = rows.join(labels, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
