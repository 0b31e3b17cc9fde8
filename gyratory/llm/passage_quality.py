"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyratory.llm.blocks import SOLID_BYTES, Words, as_bytes, cut
from gyratory.llm.samples import labelled_sample

PASSAGE = 800
BLOCK = 1 << 20
#: Byte classes: control, line end, space, digit, upper, lower, beyond ASCII, then each ASCII mark of its own in byte order.
CLASSES = np.zeros(256, np.int64)
CLASSES[[9, 10, 32]] = 1, 1, 2
CLASSES[0x30:0x3A], CLASSES[0x41:0x5B], CLASSES[0x61:0x7B], CLASSES[0x80:] = 3, 4, 5, 6
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
CLASSES[_MARKS] = np.arange(7, 7 + len(_MARKS))
_KINDS = 7 + len(_MARKS)
_COARSE = np.minimum(np.arange(_KINDS), 7)
WIDTH = _KINDS + 64 + 8


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(first passage of each text, features of all passages): every byte of a text is in one passage of `PASSAGE` bytes; an empty text has one.

    Features: share of each byte class, of each pair of coarse classes, and word figures (length, distinct, repeats, lines).
    """
    words = Words(texts, SOLID_BYTES)
    lengths = np.array([len(t) for t in texts], np.int64)
    count = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate(([0], np.cumsum(count)))
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    doc = np.repeat(np.arange(len(texts)), lengths + 1)
    inside = np.arange(len(raw)) - words.first[doc]
    passage = first[doc] + np.minimum(inside // PASSAGE, count[doc] - 1)
    total = int(first[-1])
    kind = CLASSES[raw]
    single = np.bincount(passage * _KINDS + kind, minlength=total * _KINDS).reshape(total, _KINDS)
    coarse = _COARSE[kind]
    pairs = np.bincount(passage[1:] * 64 + coarse[:-1] * 8 + coarse[1:], minlength=total * 64).reshape(total, 64)
    size = np.maximum(1, single.sum(axis=1, keepdims=True))
    own = passage[words.start] if len(words.start) else np.zeros(0, np.int64)
    hashes = words.hashes()
    n_words = np.bincount(own, minlength=total)
    least = np.maximum(n_words, 1)
    long = np.bincount(own, weights=np.minimum(words.end - words.start, 100), minlength=total)
    kinds = np.unique(np.stack((own.astype(np.uint64), hashes)), axis=1)[0].astype(np.int64) if len(own) else own
    distinct = np.bincount(kinds, minlength=total)
    def repeats(step: int) -> np.ndarray:
        same = (own[step:] == own[:-step]) & (hashes[step:] == hashes[:-step])
        return np.bincount(own[step:][same], minlength=total)
    lines = single[:, 1]
    figures = np.stack((np.log1p(n_words) / 5, long / least / 10, distinct / least, repeats(1) / least, repeats(2) / least, lines / least, np.log1p(lengths)[np.repeat(np.arange(len(texts)), count)] / 10, (n_words == 0)), axis=1)
    return first, np.hstack((np.sqrt(single / size), np.sqrt(pairs / size), figures)).astype(np.float32)


@dataclass
class Attention:
    """Passages are encoded, weighted by gated attention within their document, and the weighted mean is scored."""

    parts: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, mean: np.ndarray, scale: np.ndarray, hidden: int = 32, gate: int = 16, seed: int = 5) -> Attention:
        rng = np.random.default_rng(seed)
        normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        return cls({"mean": mean, "scale": scale, "enc": normal(len(mean), hidden), "enc0": np.zeros(hidden), "tanh": normal(hidden, gate), "gate": normal(hidden, gate), "att": normal(gate, 1)[:, 0], "out": np.zeros(hidden), "out0": np.zeros(1)})

    def forward(self, first: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        p, doc = self.parts, np.repeat(np.arange(len(first) - 1), np.diff(first))
        x = np.clip((x - p["mean"]) / p["scale"], -5, 5)
        code = np.tanh(x @ p["enc"] + p["enc0"])
        t, g = np.tanh(code @ p["tanh"]), 1 / (1 + np.exp(-(code @ p["gate"])))
        e = (t * g) @ p["att"]
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[doc]) if len(e) else e
        a = e / np.add.reduceat(e, first[:-1])[doc] if len(e) else e
        pooled = np.add.reduceat(a[:, None] * code, first[:-1], axis=0) if len(e) else np.zeros((0, code.shape[1]))
        score = 1 / (1 + np.exp(-np.clip(pooled @ p["out"] + p["out0"][0], -40, 40)))
        return {"x": x, "doc": doc, "code": code, "t": t, "g": g, "a": a, "pooled": pooled, "score": score}

    def gradient(self, first: np.ndarray, x: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.parts, self.forward(first, x)
        doc, code, t, g, a = f["doc"], f["code"], f["t"], f["g"], f["a"]
        d_logit = (f["score"] - label) / len(label)
        d_pooled = d_logit[:, None] * p["out"][None, :]
        d_a = (d_pooled[doc] * code).sum(axis=1)
        d_e = a * (d_a - np.add.reduceat(a * d_a, first[:-1])[doc])
        d_tg = d_e[:, None] * p["att"][None, :]
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_code = a[:, None] * d_pooled[doc] + d_t @ p["tanh"].T + d_g @ p["gate"].T
        d_code *= 1 - code * code
        return {"enc": f["x"].T @ d_code, "enc0": d_code.sum(axis=0), "tanh": code.T @ d_t, "gate": code.T @ d_g, "att": (t * g).T @ d_e, "out": f["pooled"].T @ d_logit, "out0": np.array([d_logit.sum()])}


def fit_attention(first: np.ndarray, x: np.ndarray, label: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.005, decay: float = 1e-4, seed: int = 5) -> Attention:
    """Adam on the log-loss of document labels; the documents of a batch bring all their passages."""
    model = Attention.fresh(x.mean(axis=0), x.std(axis=0) + 1e-2, seed=seed)
    names = [k for k in model.parts if k not in ("mean", "scale")]
    moments = {k: (np.zeros_like(model.parts[k]), np.zeros_like(model.parts[k])) for k in names}
    share = float(np.clip(label.mean(), 0.01, 0.99))
    model.parts["out0"][0] = np.log(share / (1 - share))
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for i in range(0, len(order), batch):
            docs = order[i : i + batch]
            sizes = first[docs + 1] - first[docs]
            edge = np.concatenate(([0], np.cumsum(sizes)))
            rows = np.arange(edge[-1]) - np.repeat(edge[:-1] - first[docs], sizes)
            step += 1
            slower = rate * (1 - 0.9 * epoch / epochs)
            for k, d in model.gradient(edge, x[rows], label[docs]).items():
                d = d + decay * model.parts[k]
                m, v = moments[k]
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                model.parts[k] -= slower * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 6000, longest: int = 50_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Attention | None:
    """A model from at most `most` labelled texts of at most `longest` bytes, none of them held out; None without labels.

    Executors encode the passages of the sample; the driver gets their features, about 600 bytes a passage.
    """
    sample = labelled_sample(docs, labels, [label], most, longest, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = as_bytes(batch.column("text")), []
            for start, stop in cut(texts, BLOCK):
                first, x = passages(texts[start:stop])
                out += [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), batch.column("doc_id").cast(pa.string()), pa.array(out, pa.binary())], names=["label", "doc_id", "x"])

    rows = sample.select("doc_id", F.col(label).alias("label"), "text").mapInArrow(run, "label int, doc_id string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"] or "", bytes(r["x"])))
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in rows]
    first = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return fit_attention(first, np.concatenate(parts), np.array([r["label"] for r in rows], float))


def quality(model: Attention | None, spark) -> callable:
    """A function of a text column: the score, 0 to 1. A null text scores as an empty one; without a model all scores are 0.5."""
    shared = spark.sparkContext.broadcast(model and model.parts)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = shared.value and Attention(shared.value)
        for batch in texts:
            rows, parts = as_bytes(batch), []
            for start, stop in cut(rows, BLOCK):
                parts.append(held.forward(*passages(rows[start:stop]))["score"] if held else np.full(stop - start, 0.5))
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return lambda column: score(column if isinstance(column, Column) else F.col(column))
