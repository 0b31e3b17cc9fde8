"""Correlations of all pairs of many columns from one pass of summed products."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block: a task holds six matrices of BLOCK x BLOCK sums for each pair of blocks.
BLOCK = 128
_SUMS = 6


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, correlation) of every pair of `columns`, a before b in their order: Pearson's, over the rows on which both are known.

    Nulls and NaN are missing. `n` counts the rows of the pair; a pair that does not vary has a null correlation. Values are taken from their column's
    mean first, so large offsets cost no digits. Tasks add up products blockwise: counts, sums, squares and products of all pairs come from six
    matrix products of a batch. Partial sums are merged by block; nothing is repeated by pair before the last step.
    """
    columns = list(columns)
    names = [f"_c{i}" for i in range(len(columns))]
    numbers = df.select([F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    blocks = [(i, min(i + BLOCK, len(names))) for i in range(0, len(names), BLOCK)]
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "a string, b string, n long, correlation double")
    means = numbers.agg(*[F.avg(F.when(~F.isnan(n), F.col(n))).alias(n) for n in names]).first()
    shift = np.array([means[n] if means[n] is not None else 0.0 for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(i, j): 0.0 for i in range(len(blocks)) for j in range(i, len(blocks))}
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]) - shift[:, None]
            known = ~np.isnan(x)
            x, known = np.where(known, x, 0.0), known.astype(float)
            for i, j in total:
                (p, q), (r, s) = blocks[i], blocks[j]
                a, b, u, v = x[p:q], x[r:s], known[p:q], known[r:s]
                total[i, j] = total[i, j] + np.stack((u @ v.T, a @ v.T, u @ b.T, (a * a) @ v.T, u @ (b * b).T, a @ b.T))
        kept = {k: v for k, v in total.items() if not np.isscalar(v)}
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int32()), pa.array([k[1] for k in kept], pa.int32()), pa.array([v.tobytes() for v in kept.values()], pa.binary())], names=["i", "j", "sums"])

    def finished(rows: pa.Table) -> pa.Table:
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        (p, q), (r, s) = blocks[i], blocks[j]
        n, x, y, xx, yy, xy = sum(np.frombuffer(b).reshape(_SUMS, q - p, s - r) for b in rows.column("sums").to_pylist())
        with np.errstate(invalid="ignore", divide="ignore"):
            vx, vy = xx - x * x / n, yy - y * y / n
            # what rounding leaves of a constant is no variation
            flat = (vx <= 1e-12 * xx) | (vy <= 1e-12 * yy) | (n < 2)
            corr = np.where(flat, np.nan, np.clip((xy - x * y / n) / np.sqrt(vx * vy), -1, 1))
        a, b = np.nonzero((np.arange(p, q)[:, None] < np.arange(r, s)[None, :]))
        picked = corr[a, b]
        return pa.table({
            "a": pa.array([columns[p + k] for k in a.tolist()], pa.string()), "b": pa.array([columns[r + k] for k in b.tolist()], pa.string()),
            "n": pa.array(n[a, b].astype(np.int64)), "correlation": pa.array(picked, mask=np.isnan(picked)),
        })

    return numbers.mapInArrow(run, "i int, j int, sums binary").groupBy("i", "j").applyInArrow(finished, "a string, b string, n long, correlation double")
