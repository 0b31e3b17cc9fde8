"""Class-balanced ensembles (H15, H16): samples drawn in one pass, all their trees grown together, weighted votes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyratory.operators.boosting import Bins, Trees, _matrix, binned_rows, class_counts, few_parts, fit_bins, grow, judged
from gyratory.session import materialise

#: Bytes of the histograms of one pass; trees that do not fit wait for the next pass.
ROOM = 1 << 26
UNIT = float(1 << 20)
#: Cores that get a partition of their own: the histograms of many trees are wide.
WIDE = 8


def balanced_samples(df: DataFrame, label: str, key: str, samples: int, seed: int = 0) -> DataFrame:
    """(key, label, sample) of `samples` draws: in each, as many rows of every class as the rarest one has.

    In draw s the rows of a class with the smallest md5(key:seed + s) are taken, ties by key. All draws come from one pass. The hash's first byte
    parts a class into ranges, which are counted first; ranges under the limit go whole, only the range that holds the limit is ranked, so no
    class is sorted in one task. Rows without a label are in no draw; repeated keys are rows of their own.
    """
    rows = df.filter(F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    drawn = rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    drawn = drawn.withColumn("_h", F.md5(F.concat(F.col("_key").cast("string"), F.lit(":"), (F.col("sample") + seed).cast("string"))))
    drawn = drawn.withColumn("_range", F.substring("_h", 1, 2))
    part = ["sample", "_label", "_range"]
    counts = materialise(drawn.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")))
    most = counts.groupBy("sample", "_label").agg(F.sum("_n").alias("_all")).groupBy("sample").agg(F.min("_all").alias("_most"))
    earlier = F.sum("_n").over(Window.partitionBy("sample", "_label").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    # 256 ranges of each class and draw at most
    ranges = counts.withColumn("_before", F.coalesce(earlier, F.lit(0))).join(most, "sample").filter("_before < _most")
    placed = drawn.join(F.broadcast(ranges), part)
    whole = placed.filter("_before + _n <= _most")
    edge = placed.filter("_before + _n > _most").withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy("_h", "_key")))
    taken = whole.select("_key", "_label", "sample").union(edge.filter("_before + _r <= _most").select("_key", "_label", "sample"))
    return taken.select(F.col("_key").alias(key), F.col("_label").alias(label), "sample")


@dataclass
class Ensemble:
    """Trees with a weight and, in each leaf, the shares of the classes."""

    bins: Bins
    classes: list[int]
    depth: int
    trees: list[Trees] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def shares(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Class shares (row, class) of the binned rows by each tree."""
        for trees, leaves in zip(self.trees, self.leaves, strict=True):
            for k in range(len(leaves)):
                yield leaves[k][trees.nodes(x, k, self.depth)]

    def probabilities(self, df: DataFrame, keys: Sequence[str], each: bool = False) -> DataFrame:
        """(keys, probs, y_pred): the weighted vote; with `each` also `votes`, the probabilities of every tree in order."""
        names = [f"_f{i}" for i in range(len(self.bins.features))]
        given = df.select(*keys, *[F.col(f).cast("double").alias(n) for f, n in zip(self.bins.features, names, strict=True)])
        sent = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            weights = np.array(model.weights) / max(sum(model.weights), 1e-300)
            for batch in batches:
                votes = list(model.shares(model.bins.bins(_matrix(batch, names))))
                votes = np.stack(votes) if votes else np.zeros((0, batch.num_rows, len(model.classes)))
                made = judged(np.tensordot(weights, votes, 1), model.classes)
                if each:
                    made.append(pa.array(votes.transpose(1, 0, 2).tolist(), pa.list_(pa.list_(pa.float64()))))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *made], names=[*keys, "probs", "y_pred", *(["votes"] if each else [])])

        schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.select(*keys).schema.fields)
        return given.mapInArrow(run, f"{schema}probs array<double>, y_pred int" + (", votes array<array<double>>" if each else ""))


def _state(df: DataFrame, features: Sequence[str], label: str, key: str, classes: list[int], binned: Bins, samples: DataFrame, count: int, total: int) -> DataFrame:
    """(y, x, member) of the labelled rows: class, bins, and a bit of each draw that holds the row."""
    names = [f"_f{i}" for i in range(len(features))]
    place = {c: i for i, c in enumerate(classes)}
    drawn = samples.groupBy(F.col(key).alias("_drawn")).agg(F.collect_set("sample").alias("_samples"))
    rows = df.filter(F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)])
    rows = rows.join(drawn, F.col("_key") == F.col("_drawn"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = binned.bins(_matrix(batch, names)).T
            member = np.zeros((batch.num_rows, count), bool)
            for i, found in enumerate(batch.column("_samples").to_pylist()):
                member[i, found or []] = True
            y = pa.array([place[v] for v in batch.column("_y").to_pylist()], pa.int32())
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (np.ascontiguousarray(x), member)]
            weight = pa.array([np.ones(1).tobytes()] * batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([y, *packed, weight], names=["y", "x", "member", "w"])

    return materialise(few_parts(rows.drop("_key", "_drawn").mapInArrow(run, "y int, x binary, member binary, w binary"), total, WIDE))


def _member(batch: pa.RecordBatch, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("member").to_pylist()), bool).reshape(batch.num_rows, count)


def _weight(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("w").to_pylist()))


def _gini(sums: np.ndarray) -> np.ndarray:
    """Rows of a side times its purity: the sum of squared class counts over all."""
    n = sums.sum(axis=-1)
    return np.divide((sums * sums).sum(axis=-1), n, out=np.zeros_like(n), where=n > 0)


def _grown(state: DataFrame, targets, count: int, classes: int, features: int, bins: int, depth: int, least: float, unit: float, parts: int) -> tuple[Trees, np.ndarray]:
    """(trees, class shares of their nodes)."""
    trees = Trees.empty(count, depth)
    leaves = np.zeros((*trees.value.shape, classes))
    # the leaf's sums themselves, a class each, are kept beside the trees
    trees.value = leaves
    grow(state, ["y", "member", "w"], targets, trees, classes, features, bins, depth, _gini, lambda sums: sums.sum(axis=-1) >= least, lambda sums: sums / max(sums.sum(), 1e-300), unit, parts)
    return trees, leaves


def fit_balanced_bag(df: DataFrame, features: Sequence[str], label: str = "label", key: str = "ID", samples: int = 100, depth: int = 6, bins: int = 32, least: float = 2.0, seed: int = 0) -> Ensemble:
    """One decision tree on each of `samples` class-balanced draws, equal votes.

    The trees of all draws grow together, a pass a level for as many as ROOM bytes of histograms hold.
    """
    features, counts = list(features), class_counts(df, label)
    classes = list(counts)
    binned = fit_bins(df.filter(F.col(label).isNotNull()), features, bins)
    if not classes:
        return Ensemble(binned, classes, depth)
    state = _state(df, features, label, key, classes, binned, balanced_samples(df, label, key, samples, seed), samples, sum(counts.values()))
    model, parts = Ensemble(binned, classes, depth), state.rdd.getNumPartitions()
    step = max(1, ROOM // ((1 << depth - 1) * len(features) * bins * len(classes) * 8))
    for first in range(0, samples, step):
        count = min(step, samples - first)

        def targets(batch: pa.RecordBatch, x: np.ndarray, first: int = first, count: int = count) -> np.ndarray:
            own = batch.column("y").to_numpy()[:, None] == np.arange(len(classes))
            return (_member(batch, samples)[:, first : first + count].T[:, :, None] & own[None]).astype(float)

        trees, leaves = _grown(state, targets, count, len(classes), len(features), bins, depth, least, 1.0, parts)
        model.trees.append(trees)
        model.leaves.append(leaves)
        model.weights += [1.0] * count
    return model


def fit_balanced_boost(df: DataFrame, features: Sequence[str], label: str = "label", key: str = "ID", rounds: int = 100, depth: int = 3, rate: float = 1.0, bins: int = 32, least: float = 2.0, seed: int = 0) -> Ensemble:
    """A boosting loop over class-balanced draws: each round fits a tree to its draw by the rows' weights, then raises the weights of what it gets wrong.

    A tree's vote is rate * (log((1 - error) / error) + log(classes - 1)), with the error over the weights of all rows. A round whose error is no
    better than chance, or nothing, ends the loop; the first tree stays in any case. Weights are written each round.
    """
    features, counts = list(features), class_counts(df, label)
    classes = list(counts)
    binned = fit_bins(df.filter(F.col(label).isNotNull()), features, bins)
    if not classes:
        return Ensemble(binned, classes, depth)
    state = _state(df, features, label, key, classes, binned, balanced_samples(df, label, key, rounds, seed), rounds, sum(counts.values()))
    model, parts = Ensemble(binned, classes, depth), state.rdd.getNumPartitions()
    for number in range(rounds):

        def targets(batch: pa.RecordBatch, x: np.ndarray, number: int = number) -> np.ndarray:
            own = batch.column("y").to_numpy()[:, None] == np.arange(len(classes))
            weight = np.floor(_weight(batch) * UNIT + 0.5)
            return (_member(batch, rounds)[:, number] * weight)[None, :, None] * own[None]

        trees, leaves = _grown(state, targets, 1, len(classes), len(features), bins, depth, least / 4, UNIT, parts)

        def judged(batches: Iterator[pa.RecordBatch], trees: Trees = trees, leaves: np.ndarray = leaves) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                wrong = leaves[0][trees.nodes(binned_rows(batch), 0, depth)].argmax(axis=1) != batch.column("y").to_numpy()
                weight = np.floor(_weight(batch) * UNIT + 0.5).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(weight[wrong].sum())]), pa.array([int(weight.sum())]), pa.array([batch.num_rows])], names=["wrong", "total", "n"])

        wrong, total, n = state.mapInArrow(judged, "wrong long, total long, n long").agg(F.sum("wrong"), F.sum("total"), F.sum("n")).first()
        error = (wrong or 0) / max(total or 0, 1)
        worth = rate * (np.log(max(1 - error, 1e-12) / max(error, 1e-12)) + np.log(max(len(classes) - 1, 1)))
        if number and worth <= 0:
            break
        model.trees.append(trees)
        model.leaves.append(leaves)
        model.weights.append(float(max(worth, 1e-12)))
        if worth <= 0 or error == 0 or number + 1 == rounds:
            break
        scale = n * UNIT / (total + (np.exp(worth) - 1) * wrong)

        def reweighted(batches: Iterator[pa.RecordBatch], trees: Trees = trees, leaves: np.ndarray = leaves, up: float = float(np.exp(worth)), scale: float = scale) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                wrong = leaves[0][trees.nodes(binned_rows(batch), 0, depth)].argmax(axis=1) != batch.column("y").to_numpy()
                weight = _weight(batch) * np.where(wrong, up, 1.0) * scale
                yield batch.set_column(3, "w", pa.array([w.tobytes() for w in weight], pa.binary()))

        state = materialise(state.mapInArrow(reweighted, "y int, x binary, member binary, w binary"))
    return model
