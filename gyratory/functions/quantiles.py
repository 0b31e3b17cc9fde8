"""Exact quantiles of many columns at once, by refining histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a refinement, and values of a bin that are few enough to be told one by one.
BINS, FEW = 1024, 4096


@dataclass
class Span:
    """Values of a column that fall into the same bins: the chain of (low, high, bin), how many values lie before it and how many in it."""

    column: int
    low: float
    high: float
    before: int
    count: int
    chain: list[tuple[float, float, int]] = field(default_factory=list)

    @staticmethod
    def bins(values: np.ndarray, low: float, high: float) -> np.ndarray:
        """Bin of each value; values in order have bins in order."""
        # halves keep the width of the widest range finite
        at = np.floor((values / 2 - low / 2) / (high / 2 - low / 2) * BINS)
        return np.clip(np.nan_to_num(at), 0, BINS - 1).astype(np.int64)

    def inside(self, values: np.ndarray) -> np.ndarray:
        """Places of the values that lie in the span."""
        at = np.arange(len(values))
        for low, high, number in self.chain:
            at = at[self.bins(values[at], low, high) == number]
        return at


def _pass(numbers: DataFrame, names: list[str], spans: list[Span], weighted: bool) -> dict[int, list[tuple[float, int]]]:
    """Of each span the counts of its bins, or of its values where they are few, in order. One scan, one shuffle of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, keys, counts = [], [], []
            for i, span in enumerate(spans):
                values = batch.column(names[span.column]).to_numpy(zero_copy_only=False).astype(float)
                known = np.flatnonzero(~np.isnan(values))
                known = known[span.inside(values[known])]
                values = values[known]
                key, place, n = np.unique(values if span.count <= FEW else span.bins(values, span.low, span.high).astype(float), return_inverse=True, return_counts=True)
                if weighted:
                    n = np.zeros(len(key), np.int64)
                    np.add.at(n, place, batch.column("_weight").to_numpy()[known])
                slots.append(np.full(len(key), i))
                keys.append(key)
                counts.append(n)
            if slots:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in ((slots, np.int32), (keys, float), (counts, np.int64))], names=["slot", "key", "n"])

    found: dict[int, list[tuple[float, int]]] = {i: [] for i in range(len(spans))}
    merged = numbers.mapInArrow(run, "slot int, key double, n long").groupBy("slot", "key").agg(F.sum("n").alias("n"))
    for slot, key, n in merged.collect():
        found[slot].append((key, n))
    return {i: sorted(rows) for i, rows in found.items()}


def _edge(low: float, high: float, number: int) -> tuple[float, float]:
    width = high / 2 - low / 2
    return 2 * (low / 2 + width * (number / BINS)), 2 * (low / 2 + width * ((number + 1) / BINS))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], weight: str | None = None) -> list[list[float | None]]:
    """Of each column the quantile of each of `probs`, exact, linear between neighbouring values; None where a column has no value.

    A row counts as often as its whole number `weight` says. Nulls and NaN are missing values. All columns are read together: their ranges first, then the counts of BINS bins, of which only the one that holds a
    wanted rank is refined, until it has few values. Rows are never sorted, repeated by column or sent anywhere; what is
    shuffled and reaches the driver is at most BINS or FEW counts for each column and wanted rank, whatever the table holds.
    """
    names = [f"_c{i}" for i in range(len(columns))]
    often = [F.col(weight).cast("long").alias("_weight")] if weight else []
    numbers = df.select([F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)] + often)
    if not names:
        return []
    known = [F.when(~F.isnan(n), F.col(n)) for n in names]

    def count(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c.isNotNull(), F.col("_weight"))), F.lit(0)) if weight else F.count(c)

    ends = numbers.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(known) for k, f in (("n", count), ("a", F.min), ("z", F.max))]).first()
    value: dict[tuple[int, int], float] = {}
    wanted: list[tuple[Span, list[int]]] = []
    for i in range(len(names)):
        n, low, high = ends[f"n{i}"], ends[f"a{i}"], ends[f"z{i}"]
        ranks = {r for p in probs for r in (int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1))))} if n else set()
        value |= {(i, r): low for r in ranks if r == 0 or low == high} | {(i, r): high for r in ranks if r == n - 1}
        rest = sorted(r for r in ranks if (i, r) not in value)
        if rest:
            wanted.append((Span(i, low, high, 0, n), rest))
    while wanted:
        # infinite ends have no bins, so their values are told one by one
        found = _pass(numbers, names, [span for span, _ in wanted], weight is not None)
        later: list[tuple[Span, list[int]]] = []
        for i, (span, ranks) in enumerate(wanted):
            at, parts = span.before, {}
            for key, n in found[i]:
                for r in ranks:
                    if at <= r < at + n:
                        parts.setdefault(key, (at, n, []))[2].append(r)
                at += n
            for key, (before, n, inside) in parts.items():
                if span.count <= FEW:
                    value |= {(span.column, r): key for r in inside}
                    continue
                low, high = _edge(span.low, span.high, int(key))
                chain = [*span.chain, (span.low, span.high, int(key))]
                # a bin that cannot be parted any more holds values next to each other: they are told one by one
                few = n if low < high and np.isfinite(high - low) and len(chain) < 7 else min(n, FEW)
                later.append((Span(span.column, low, high, before, few, chain), inside))
        wanted = later
    out = []
    for i in range(len(names)):
        row: list[float | None] = []
        for p in probs:
            if not (n := ends[f"n{i}"]):
                row.append(None)
                continue
            spot = p * (n - 1)
            low, high = value[i, int(np.floor(spot))], value[i, int(np.ceil(spot))]
            row.append(float(low + (high - low) * (spot - np.floor(spot)) if low != high else low))
        out.append(row)
    return out
