"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyratory.llm.blocks import Words, as_bytes, cut, mixed
from gyratory.llm.samples import labelled_sample

#: Prefix lengths whose hashes are features beside the whole word: stems carry over to endings never seen.
PREFIXES = (4, 5)
BLOCK = 2 << 20
#: Probability of any toxicity from which a text counts as toxic.
REJECT = 0.4


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct words and word prefixes of each text, ordered by document. Whole texts count."""
    words = Words(texts)
    found = [words.hashes() % np.uint64(buckets)]
    docs = [words.doc]
    for n in PREFIXES:
        longer = words.end - words.start > n
        start = words.start[longer]
        found.append(mixed(words.hashes(start, start + n) + np.uint64(n)) % np.uint64(buckets))
        docs.append(words.doc[longer])
    pairs = np.unique(np.concatenate(docs).astype(np.int64) * buckets + np.concatenate(found).astype(np.int64))
    return pairs // buckets, pairs % buckets


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(weights . features - thresholds[k]): one weight vector, ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, docs: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        score = np.bincount(docs, weights=self.weights[buckets], minlength=n)
        return sigmoid(score[:, None] - self.thresholds[None, :])


def fit_ordinal(docs: np.ndarray, buckets: np.ndarray, grades: np.ndarray, size: int, steps: int = 300, rate: float = 0.05, decay: float = 1e-5) -> Ordinal:
    """Maximum likelihood of the cumulative-link model by Adam; gaps between thresholds are exponentials, so their order holds."""
    top, n = int(grades.max()) if len(grades) else 0, len(grades)
    share = [float(np.clip((grades > k).mean(), 1e-3, 1 - 1e-3)) for k in range(top)]
    start = [np.log((1 - s) / s) for s in share]
    gaps = np.log(np.maximum(np.diff(start), 0.1)) if top > 1 else np.zeros(0)
    weights, theta = np.zeros(size), np.concatenate((start[:1], gaps))
    moments = [np.zeros(size), np.zeros(size), np.zeros(len(theta)), np.zeros(len(theta))]
    # the likelihood of a grade is the difference of two neighbouring cumulative probabilities
    for step in range(1, steps + 1):
        cuts = np.concatenate((theta[:1], theta[:1] + np.cumsum(np.exp(theta[1:])))) if top else theta
        score = np.bincount(docs, weights=weights[buckets], minlength=n)
        above = np.hstack((np.ones((n, 1)), sigmoid(score[:, None] - cuts[None, :]), np.zeros((n, 1))))
        slope = above * (1 - above)
        rows = np.arange(n)
        here = np.maximum(above[rows, grades] - above[rows, grades + 1], 1e-9)
        by_score = -(slope[rows, grades] - slope[rows, grades + 1]) / here / n
        by_cut = np.zeros((n, top + 2))
        by_cut[rows, grades] += slope[rows, grades] / here / n
        by_cut[rows, grades + 1] -= slope[rows, grades + 1] / here / n
        cut_gradient = by_cut[:, 1 : top + 1].sum(axis=0)
        by_theta = np.array([cut_gradient[k:].sum() * (np.exp(theta[k]) if k else 1.0) for k in range(len(theta))])
        by_weight = np.bincount(buckets, weights=by_score[docs], minlength=size) + decay * weights
        for value, gradient, i in ((weights, by_weight, 0), (theta, by_theta, 2)):
            m, v = moments[i], moments[i + 1]
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient * gradient - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = np.concatenate((theta[:1], theta[:1] + np.cumsum(np.exp(theta[1:])))) if top else theta
    return Ordinal(weights.astype(np.float32), cuts)


def telling(docs: np.ndarray, buckets: np.ndarray, bad: np.ndarray, size: int, least: float = 4.5) -> np.ndarray:
    """Features whose share among toxic texts differs from that among others by over `least` standard errors, seen in three texts at least."""
    n, m = max(1, int(bad.sum())), max(1, int((~bad).sum()))
    inside, outside = np.bincount(buckets[bad[docs]], minlength=size), np.bincount(buckets[~bad[docs]], minlength=size)
    share = (inside + outside) / (n + m)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n + 1 / m))
    return (np.abs(inside / n - outside / m) > least * error) & (inside + outside >= 3)


def grades_of(docs: np.ndarray, buckets: np.ndarray, toxic: np.ndarray, size: int, levels: int) -> np.ndarray:
    """Grades 0..levels from a yes/no label: clean is 0; toxic texts are ranked by how many features they have that mark toxic texts.

    A feature marks toxic texts if it is in at least three of them and far more common there. The rank is cut into `levels` equal parts.
    """
    n, bad = len(toxic), toxic.astype(bool)
    inside = np.bincount(buckets[bad[docs]], minlength=size)
    outside = np.bincount(buckets[~bad[docs]], minlength=size)
    odds = np.log((inside + 0.1) / (bad.sum() + 1) / ((outside + 0.1) / ((~bad).sum() + 1)))
    marks = (inside >= 3) & (odds > 2)
    mass = np.bincount(docs, weights=marks[buckets].astype(float), minlength=n)
    edges = np.quantile(mass[bad], np.arange(1, levels) / levels) if bad.any() else np.zeros(levels - 1)
    return np.where(bad, 1 + (mass[:, None] > edges[None, :]).sum(axis=1), 0)


def fit_severity(docs: DataFrame, labels: DataFrame, levels: int = 3, buckets: int = 1 << 18, most: int = 6000, longest: int = 100_000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Ordinal:
    """A model from at most `most` labelled texts of at most `longest` bytes, none of them held out.

    Executors turn the texts into bucket numbers; the driver gets those of the sample. Without any labelled text all scores are those of grade 0.
    """
    sample = labelled_sample(docs, labels, [label], most, longest, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = as_bytes(batch.column("text")), []
            for start, stop in cut(texts, BLOCK):
                at, found = features(texts[start:stop], buckets)
                out += np.split(found.astype(np.int32), np.searchsorted(at, np.arange(1, stop - start)))
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), batch.column("doc_id").cast(pa.string()), pa.array([x.tobytes() for x in out], pa.binary())], names=["label", "doc_id", "found"])

    rows = sample.select("doc_id", F.col(label).alias("label"), "text").mapInArrow(run, "label int, doc_id string, found binary").collect()
    rows.sort(key=lambda r: (r["doc_id"] or "", bytes(r["found"])))  # the same model however the rows arrived
    if not rows:
        return Ordinal(np.zeros(buckets, np.float32), np.full(levels, 20.0))
    parts = [np.frombuffer(r["found"], np.int32) for r in rows]
    at, found = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts]), np.concatenate(parts)
    told = telling(at, found, np.array([r["label"] for r in rows]) > 0, buckets)[found]
    at, found = at[told], found[told]
    grades = grades_of(at, found, np.array([r["label"] for r in rows]) > 0, buckets, levels)
    if not grades.any():
        return Ordinal(np.zeros(buckets, np.float32), np.full(levels, 20.0))
    return fit_ordinal(at, found, grades, buckets)


def severity(model: Ordinal, spark) -> callable:
    """A function of a text column: struct(severity, toxicity, grade). A null text scores as an empty one.

    severity is the expected grade, toxicity the probability of any grade above 0, grade the number of thresholds passed by half.
    """
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds))

    @F.arrow_udf("severity double, toxicity double, grade int")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, thresholds = shared.value
        held = Ordinal(weights, thresholds)
        for batch in texts:
            rows, parts = as_bytes(batch), []
            for start, stop in cut(rows, BLOCK):
                at, found = features(rows[start:stop], len(weights))
                parts.append(held.above(at, found, stop - start))
            above = np.concatenate(parts) if parts else np.zeros((0, len(thresholds)))
            arrays = [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array((above >= 0.5).sum(axis=1).astype(np.int32))]
            yield pa.StructArray.from_arrays(arrays, names=["severity", "toxicity", "grade"])

    return lambda column: score(column if isinstance(column, Column) else F.col(column))
