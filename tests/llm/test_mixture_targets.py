"""The registered mixture against its targets, by plain sums over its rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gyratory.llm import queries, raking

#: Cells of smaller tables are too few for their caps to leave a solution.
SF = "/root/testdata/sf0.1"


def feasible(share, own, goal):
    """Tokens of each value: share times one factor, none over its own tokens."""
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(share[v] * middle * goal, own[v]) for v in own) < goal else (low, middle)
    return {v: min(share[v] * high * goal, own[v]) for v in own}


@pytest.mark.parametrize("odd", [False, True])
def test_op3_reaches_its_targets(spark, odd, tmp_path):
    where = SF
    if odd:
        where = str(tmp_path)
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        other = F.when(F.col("doc_id") % 10 == 0, F.lit(None)).when(F.col("doc_id") % 10 == 1, "ja").when(F.col("doc_id") % 10 == 2, "").otherwise(F.col("lang"))
        docs.withColumn("lang", other).withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("source"))).write.parquet(f"{where}/documents.parquet")
    rows = queries.QUERIES["op3_raking"](spark, where).collect()
    assert len(rows) == spark.read.parquet(f"{where}/documents.parquet").count()
    total, goal = sum(r["tokens"] for r in rows), 0.5 * sum(r["tokens"] for r in rows)
    assert sum(r["tokens"] * r["probability"] for r in rows) == pytest.approx(goal, rel=1e-3)
    for axis, target in queries.MIX.items():
        own, reached = Counter(), Counter()
        for r in rows:
            own[r[axis]] += r["tokens"]
            reached[r[axis]] += r["tokens"] * r["probability"]
        if isinstance(target, dict):
            rest = 1 - sum(target.values())
            free = sum(n for v, n in own.items() if v not in target)
            share = {v: target[v] if v in target else n * rest / free if rest > 1e-9 else n / (total - free) for v, n in own.items()}
        else:
            share = {v: n**target for v, n in own.items()}
        share = {v: s / sum(share.values()) for v, s in share.items()}
        aims = feasible(share, own, goal)
        for v in own:
            assert abs(reached[v] - aims[v]) <= 2e-3 * goal, (axis, v)
    assert all(r["kept"] == (u < r["probability"]) for r, u in zip(rows, [r[0] for r in spark.createDataFrame([(r["doc_id"],) for r in rows], "doc_id long").select(raking.uniform(F.col("doc_id"))).collect()]) if abs(u - r["probability"]) > 1e-5)
