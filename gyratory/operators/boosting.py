"""Softmax boosting over histograms (H17). The histogram passes also grow the trees of `ensembles`."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyratory.session import materialise

#: Cells of equal width from which bins of near-equal counts are made.
CELLS = 1024
#: Gradients are whole multiples of 1 / UNIT, so that their sums do not depend on the order of rows.
UNIT = float(1 << 24)
#: Rounds after which the scores of the rows are written anew.
KEEP = 20
#: Partitions whose histograms the driver adds itself; more are merged in the cluster first.
FEW = 16
#: Rows of a partition of the binned table where there are more than the cores take.
PART = 20_000
#: Rows for which a partition, and so another core, is worth its task.
SHARE = 2_000
#: Bytes of the histograms of a pass that the driver adds itself, at most.
ADDED = 1 << 27


def _matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    """Values by feature and row; missing ones are NaN."""
    columns = [batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features]
    return np.stack(columns) if columns else np.zeros((0, batch.num_rows))


@dataclass
class Bins:
    """Bins of features: a cell of equal width between the least and the largest value has a bin; bin 0 is for missing values."""

    features: list[str]
    low: np.ndarray
    high: np.ndarray
    of_cell: np.ndarray
    count: int

    def cells(self, values: np.ndarray) -> np.ndarray:
        """Cell of each value, -1 for missing ones; values beyond the range take its ends."""
        width = self.high - self.low
        with np.errstate(invalid="ignore", divide="ignore"):
            at = np.floor((values - self.low[:, None]) / width[:, None] * CELLS)
        at = np.where(width[:, None] > 0, at, 0.0)
        return np.where(np.isnan(values), -1, np.clip(np.nan_to_num(at), 0, CELLS - 1)).astype(np.int64)

    def bins(self, values: np.ndarray) -> np.ndarray:
        at = self.cells(values)
        return np.where(at < 0, 0, np.take_along_axis(self.of_cell, np.maximum(at, 0), axis=1)).astype(np.uint8)

    def upper(self, feature: int, number: int) -> float:
        """Upper border of a bin; the missing one has none."""
        if number == 0:
            return float("-inf")
        last = int(np.flatnonzero(self.of_cell[feature] <= number)[-1])
        return float(self.low[feature] + (last + 1) / CELLS * (self.high[feature] - self.low[feature]))


def fit_bins(df: DataFrame, features: Sequence[str], bins: int = 32) -> Bins:
    """Bins of near-equal counts by one refinement: ranges of all features in one pass, counts of their cells in a second.

    At most CELLS rows of each feature reach the driver, whatever the table holds. A feature without a value has one bin.
    """
    features = list(features)
    numbers = df.select([F.col(f).cast("double").alias(f) for f in features])
    known = [F.when(~F.isnan(f), F.col(f)) for f in features]
    ends = numbers.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(known)], *[F.max(c).alias(f"z{i}") for i, c in enumerate(known)]).first()
    low, high = (np.array([ends[f"{side}{i}"] if ends[f"{side}{i}"] is not None else 0.0 for i in range(len(features))]) for side in "az")
    made = Bins(features, low, high, np.ones((len(features), CELLS), np.int64), 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(features), CELLS), np.int64)
        for batch in batches:
            at = made.cells(_matrix(batch, features))
            for i, row in enumerate(at):
                counts[i] += np.bincount(row[row >= 0], minlength=CELLS)
        feature, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(cell), pa.array(counts[feature, cell])], names=["feature", "cell", "n"])

    counted = numbers.mapInArrow(run, "feature long, cell long, n long").groupBy("feature", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(features), CELLS), np.int64)
    counts[counted["feature"], counted["cell"]] = counted["n"]
    before, total = np.cumsum(counts, axis=1) - counts, counts.sum(axis=1, keepdims=True)
    # a cell's bin follows the rows before it, so equal cells are never parted
    made.of_cell = 1 + before * (bins - 1) // np.maximum(total, 1)
    made.of_cell = np.minimum(made.of_cell, bins - 1)
    made.count = bins
    return made


@dataclass
class Trees:
    """Trees of one round, one of each class, as complete binary trees: feature (-1: leaf), last bin of the left side, value; `gain` is that of the first split."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, classes: int, depth: int) -> Trees:
        inner, whole = (1 << depth) - 1, (1 << depth + 1) - 1
        return cls(np.full((classes, inner), -1, np.int32), np.zeros((classes, inner), np.int32), np.zeros((classes, whole)), np.zeros(classes))

    def nodes(self, x: np.ndarray, tree: int, depth: int) -> np.ndarray:
        """Node that each row of the binned `x` (feature, row) reaches within `depth` steps."""
        at, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        for _ in range(depth):
            feature = self.feature[tree][np.minimum(at, self.feature.shape[1] - 1)]
            inner = (at < self.feature.shape[1]) & (feature >= 0)
            right = x[np.maximum(feature, 0), rows] > self.bin[tree][np.minimum(at, self.feature.shape[1] - 1)]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at

    def full(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, last bin of the left side, value) of the same trees without early leaves: those send all rows left and hand their value down."""
        feature, cut, value = self.feature.astype(np.int64), self.bin.astype(np.int64), self.value.copy()
        for level in range(depth):
            at = np.arange((1 << level) - 1, (1 << level + 1) - 1)
            leaf = feature[:, at] < 0
            feature[:, at], cut[:, at] = np.where(leaf, 0, feature[:, at]), np.where(leaf, 255, cut[:, at])
            for side in (1, 2):
                value[:, 2 * at + side] = np.where(leaf, value[:, at], value[:, 2 * at + side])
        return feature, cut, value

    def scores(self, x: np.ndarray, depth: int) -> np.ndarray:
        """Values (row, tree) of the leaves that the rows of the binned `x` reach, for all trees together."""
        feature, cut, value = self.full(depth)
        # no copy where `x` lies by row, as in the binned table
        values, start = np.ascontiguousarray(x.T).ravel(), np.arange(x.shape[1]) * x.shape[0]
        first, at = np.arange(len(feature))[:, None] * feature.shape[1], np.zeros((len(feature), x.shape[1]), np.int64)
        for _ in range(depth):
            here = at + first
            at = 2 * at + 1 + (values.take(feature.take(here) + start) > cut.take(here))
        return np.take_along_axis(value, at, axis=1).T


def judged(probs: np.ndarray, classes: list[int]) -> list[pa.Array]:
    """Probabilities (row, class) as lists, and the likeliest class of each row: null where there are no classes."""
    ends = pa.array((np.arange(len(probs) + 1) * len(classes)).astype(np.int32))
    best = pa.array(np.array(classes, np.int32)[probs.argmax(axis=1)]) if probs.size else pa.nulls(len(probs), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(probs.ravel())), best]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Booster:
    """A fitted softmax booster."""

    bins: Bins
    classes: list[int]
    depth: int
    base: np.ndarray
    rounds: list[Trees] = field(default_factory=list)
    gains: np.ndarray | None = None

    def probabilities(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys, probs array<double> by class, y_pred) of each row; missing features go left."""
        features = self.bins.features
        given = df.select(*keys, *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
        sent = df.sparkSession.sparkContext.broadcast(self)
        names = [f"_f{i}" for i in range(len(features))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for batch in batches:
                x = np.asfortranarray(model.bins.bins(_matrix(batch, names)))
                scores = np.tile(model.base, (batch.num_rows, 1))
                for trees in model.rounds:
                    scores += trees.scores(x, model.depth)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *judged(softmax(scores) if scores.size else scores, model.classes)], names=[*keys, "probs", "y_pred"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*keys).schema.fields)
        return given.mapInArrow(run, f"{schema + ', ' if schema else ''}probs array<double>, y_pred int")

    def importance(self) -> list[tuple[str, float]]:
        """Share of each feature in the gain of all splits, largest first."""
        gains = self.gains if self.gains is not None else np.zeros(len(self.bins.features))
        shares = gains / gains.sum() if gains.sum() > 0 else gains
        return sorted(zip(self.bins.features, map(float, shares), strict=True), key=lambda r: (-r[1], r[0]))


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Rows of each class in order; rows without a label count for nothing."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).agg(F.count(F.lit(1))).collect()
    return dict(sorted((int(c), int(n)) for c, n in counts))


def few_parts(state: DataFrame, rows: int, most: int = FEW) -> DataFrame:
    """`state` in equal partitions: a level of trees is a pass, and small passes cost what their tasks do.

    Each core gets one while it holds SHARE rows, up to `most`; beyond that a partition holds PART rows.
    """
    cores = min(state.sparkSession.sparkContext.defaultParallelism, most)
    return state.repartition(max(1, -(-rows // PART), min(cores, -(-rows // SHARE))))


def best_splits(worth: Callable[[np.ndarray], np.ndarray], room: Callable[[np.ndarray], np.ndarray], histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, gain) of the best split of each node of `histogram` (node, feature, bin, channel); ties go to the first.

    `worth` values a side by its summed channels; `room` says whether a side is large enough.
    """
    left = np.cumsum(histogram, axis=2)
    whole = left[:, :, -1:]
    gain = worth(left) + worth(whole - left) - worth(whole)
    gain = np.where(room(left) & room(whole - left), gain, -np.inf)[:, :, :-1]
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    return at // gain.shape[2], at % gain.shape[2], flat[np.arange(len(flat)), at]


def grow(
    state: DataFrame, columns: Sequence[str], targets: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], trees: Trees, channels: int, features: int, bins: int, depth: int,
    worth: Callable[[np.ndarray], np.ndarray], room: Callable[[np.ndarray], np.ndarray], value: Callable[[np.ndarray], np.ndarray], unit: float, parts: int,
) -> np.ndarray:
    """Grow all `trees` level by level, a pass over the `parts` partitions of `state` each; returns the gain of each feature.

    `targets` gives whole numbers by (tree, row, channel) of a batch, of which nodes get sums; `value` makes of a node's sums what its leaf says.
    A pass sums the lighter side of each split only: the sums are whole, so those of its sibling are exactly what is left of the parent's.
    """
    gains, state = np.zeros(features), state.select(*columns, "x")
    sums, side = np.zeros(0, np.int64), np.zeros((len(trees.value), 0), np.int8)
    for level in range(depth):
        found = _histograms(state, targets, trees, level, side, channels, features, bins, parts)
        sums = _both_sides(found, sums, side) if level else found
        first, split = (1 << level) - 1, False
        side = np.full((len(trees.value), 1 << level), -1, np.int8)
        for k in range(len(trees.value)):
            histogram = sums[k] / unit
            feature, cut, gain = best_splits(worth, room, histogram)
            if level == 0:
                trees.value[k, 0] = value(histogram[0, 0].sum(axis=0))
            for node in np.flatnonzero(gain > 1e-9).tolist():
                at, f, b = first + node, int(feature[node]), int(cut[node])
                trees.feature[k, at], trees.bin[k, at] = f, b
                left = histogram[node, f, : b + 1].sum(axis=0)
                right = histogram[node, f].sum(axis=0) - left
                trees.value[k, 2 * at + 1], trees.value[k, 2 * at + 2] = value(left), value(right)
                side[k, node] = int(np.abs(left).sum() > np.abs(right).sum())
                gains[f] += gain[node]
                trees.gain[k] += gain[node] if level == 0 else 0.0
                split = True
        if not split:
            break
    return gains


def fit_booster(
    df: DataFrame, features: Sequence[str], label: str = "label", weights: dict[int, float] | None = None, rounds: int = 200, depth: int = 5,
    rate: float = 0.1, subsample: float = 0.8, bins: int = 32, l2: float = 1.0, least: float = 1.0, seed: int = 42,
) -> Booster:
    """One tree of each class a round, fitted to the softmax gradients; `weights` of the classes are balanced if not given.

    Rows are binned once. A level of all trees of a round is one pass: tasks sum gradients by (class, node, feature, bin), partial sums are merged
    by (class, node), and only the merged histograms, whose size the parameters bound, reach the driver. Gradients are whole
    numbers, so splits do not depend on how rows are dealt. Scores are written every KEEP rounds in the shared folder; a lost task repeats
    at most that many rounds of its rows. Of each round a share `subsample` of the rows counts, chosen by a hash of the row's values. Rows
    without a label count for nothing; a table without labels gives a booster of even chances over no class.
    """
    spark, features = df.sparkSession, list(features)
    rows = df.filter(F.col(label).isNotNull())
    counts = class_counts(rows, label)
    total = sum(counts.values())
    weights = {c: total / (len(counts) * n) for c, n in counts.items()} if weights is None else dict(sorted(weights.items()))
    classes = list(weights)
    binned = fit_bins(rows, features, bins)
    model = Booster(binned, classes, depth, np.zeros(len(classes)), gains=np.zeros(len(features)))
    if len(classes) < 2:
        return model
    names = [f"_f{i}" for i in range(len(features))]
    given = rows.select(F.col(label).cast("int").alias("_y"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)])
    given = given.withColumn("_row", F.xxhash64("_y", *names))
    place = {c: i for i, c in enumerate(classes)}

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = binned.bins(_matrix(batch, names)).T.copy()
            y = np.array([place[v] for v in batch.column("_y").to_pylist()], np.int32)
            scores = np.zeros((len(y), len(classes)))
            yield _packed(batch.column("_row"), y, x, scores)

    state = materialise(few_parts(given.mapInArrow(start, SCHEMA), total))
    by_class = np.array([weights[c] for c in classes])
    parts = state.rdd.getNumPartitions()
    fresh: list[Trees] = []

    def worth(sums: np.ndarray) -> np.ndarray:
        g, h = sums[..., 0], sums[..., 1] + l2
        return np.divide(g * g, h, out=np.zeros_like(g), where=h > 0)

    for number in range(rounds):
        trees = Trees.empty(len(classes), depth)

        def gradients(batch: pa.RecordBatch, x: np.ndarray, done: list[Trees] = fresh, turn: int = seed + number) -> np.ndarray:
            scores, y = _scores(batch, len(classes)), batch.column("y").to_numpy()
            scores = scores + sum(t.scores(x, depth) for t in done) if done else scores
            p, own = softmax(scores), np.arange(len(classes))[:, None] == y
            weight = by_class[y] * chosen(batch.column("row").to_numpy(), subsample, turn)
            both = np.stack((weight * (p.T - own), weight * (p * (1 - p)).T), axis=2)
            return np.floor(both * UNIT + 0.5)

        model.gains += grow(state, ["row", "y", "s"], gradients, trees, 2, len(features), bins, depth, worth, lambda sums: sums[..., 1] >= least, lambda sums: -rate * sums[0] / (sums[1] + l2), UNIT, parts)
        model.rounds.append(trees)
        fresh = [*fresh, trees]
        if len(fresh) == KEEP and number + 1 < rounds:
            state, fresh = materialise(_advanced(state, fresh, depth, len(classes))), []
    return model


SCHEMA = "row long, y int, x binary, s binary"


def _packed(row: pa.Array, y: np.ndarray, x: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([row, pa.array(y, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in scores], pa.binary())], names=["row", "y", "x", "s"])


def binned_rows(batch: pa.RecordBatch) -> np.ndarray:
    """Binned values by feature and row."""
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(batch.num_rows, -1).T


def _scores(batch: pa.RecordBatch, classes: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("s").to_pylist())).reshape(batch.num_rows, classes)


def _advanced(state: DataFrame, fresh: list[Trees], depth: int, classes: int) -> DataFrame:
    """`state` with the trees of the last rounds added to its scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = binned_rows(batch)
                yield _packed(batch.column("row"), batch.column("y").to_numpy(), x.T, _scores(batch, classes) + sum(t.scores(x, depth) for t in fresh))

    return state.mapInArrow(run, SCHEMA)


def chosen(row: np.ndarray, share: float, seed: int) -> np.ndarray:
    """Whether a row, named by a hash, belongs to the sample of a round."""
    x = row.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) / 2.0**64 < share


def _both_sides(found: np.ndarray, parents: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Sums of all nodes of a level from those of the side that was counted and those of the parents; children of leaves have none."""
    out = np.zeros((found.shape[0], 2 * found.shape[1], *found.shape[2:]), np.int64)
    for k, node in zip(*np.nonzero(side >= 0)):
        counted = 2 * node + side[k, node]
        out[k, counted] = found[k, node]
        out[k, counted ^ 1] = parents[k, node] - found[k, node]
    return out


def _numbers(blob: bytes, count: int) -> np.ndarray:
    """`count` whole numbers, of four bytes each where they all fit."""
    return np.frombuffer(blob, np.int64 if len(blob) == 8 * count else np.int32)


def _blob(sums: np.ndarray) -> bytes:
    return sums.astype(np.int32 if np.abs(sums).max(initial=0) < 1 << 31 else np.int64).tobytes()


def _histograms(state: DataFrame, targets: Callable, trees: Trees, level: int, side: np.ndarray, channels: int, features: int, bins: int, parts: int) -> np.ndarray:
    """Whole sums by (tree, node, feature, bin, channel): of the root, and on further levels of the child `side` (0 left, 1 right, -1 none) of each node of the level before."""
    count, nodes, first, size = len(trees.value), max(1, side.shape[1]), (1 << level) - 1, features * bins
    cells = channels * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((count, channels, nodes * size)), np.zeros((count, nodes), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = binned_rows(batch)
            wanted, at = targets(batch, x), np.arange(features) * bins + x.T
            for k in range(count):
                node = trees.nodes(x, k, level) - first
                counts = node >= 0
                if level:
                    counts &= (node & 1) == side[k][node >> 1]
                    node = node >> 1
                given = wanted[k] != 0
                used = np.flatnonzero(counts & given.any(axis=1))
                if not len(used):
                    continue
                seen[k, node[used]] = True
                place = at[used] + (node[used] * size)[:, None]
                for c in range(channels):
                    own = given[used, c]
                    here = place if own.all() else place[own]
                    if len(here):
                        total[k, c] += np.bincount(here.ravel(), np.repeat(wanted[k, used[own], c], features), nodes * size)
        k, node = np.nonzero(seen)
        sums = total.reshape(count, channels, nodes, size)
        blobs = [_blob(sums[i, :, j]) for i, j in zip(k.tolist(), node.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(k * nodes + node), pa.array(blobs, pa.binary())], names=["slot", "sums"])

    def merged(rows: pa.Table) -> pa.Table:
        added = sum(_numbers(b, cells).astype(np.int64) for b in rows.column("sums").to_pylist())
        return pa.table({"slot": rows.column("slot").slice(0, 1), "sums": pa.array([_blob(added)], pa.binary())})

    partial = state.mapInArrow(run, "slot long, sums binary")
    # the driver adds few and small ones itself, however wide the trees are
    if parts > FEW or parts * count * nodes * cells * 4 > ADDED:
        partial = partial.groupBy("slot").applyInArrow(merged, "slot long, sums binary")
    out = np.zeros((count * nodes, channels, size), np.int64)
    for slot, sums in partial.collect():
        out[slot] += _numbers(sums, cells).reshape(channels, size)
    return np.moveaxis(out.reshape(count, nodes, channels, features, bins), 2, -1)


def root_splits(df: DataFrame, features: Sequence[str], label: str = "label", bins: int = 32) -> list[tuple[int, str, int, float]]:
    """(class, feature, last bin of the left side, gain) of the first split of every class when all rows count: what a fit starts with."""
    model = fit_booster(df, features, label, rounds=1, depth=1, subsample=1.0, bins=bins)
    trees = model.rounds[0]
    return [(c, model.bins.features[trees.feature[k, 0]], int(trees.bin[k, 0]), float(trees.gain[k])) for k, c in enumerate(model.classes) if trees.feature[k, 0] >= 0]
