"""The skew-safe building blocks against plain Python, on both paths."""

import random

import pytest
from collected import rows
from pyspark.sql import functions as F

from gyratory.functions import ordered
from gyratory.session import GROUP_ROWS_CONF


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    data = []
    for i in range(400):
        key = rng.choice(["hot", "hot", "hot", "a", "b", None])
        data.append((key, rng.randint(0, 60), i, rng.choice([None, 1.0, 2.5, 4.0])))
    return spark.createDataFrame(data, "k string, t int, id int, v double"), data


def by_key(data):
    groups = {}
    for r in data:
        groups.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[1], r[2])) for k, v in groups.items()}


def test_position(spark, table, both_paths):
    df, data = table
    got = {r.id: r.n for r in ordered.position(df, ["k"], ["t", "id"], "n").collect()}
    want = {r[2]: i for g in by_key(data).values() for i, r in enumerate(g, 1)}
    assert got == want


def test_position_without_key(spark, table, both_paths):
    df, data = table
    got = {r.id: r.n for r in ordered.position(df, [], [F.desc("t"), "id"], "n").collect()}
    want = {r[2]: i for i, r in enumerate(sorted(data, key=lambda r: (-r[1], r[2])), 1)}
    assert got == want


def test_framed_reaches_over_tiles(spark, table, both_paths):
    df, data = table

    def step(frame, w):
        return frame.withColumns({
            "back": F.lag("id", 4).over(w), "ahead": F.lead("id", 2).over(w),
            "s": F.sum("v").over(w.rowsBetween(-4, 2)),
        })

    got = {r.id: (r.back, r.ahead, r.s) for r in ordered.framed(df, ["k"], ["t", "id"], 4, 2, step).collect()}
    assert len(got) == len(data)
    for g in by_key(data).values():
        for i, r in enumerate(g):
            vals = [x[3] for x in g[max(0, i - 4):i + 3] if x[3] is not None]
            assert got[r[2]] == (
                g[i - 4][2] if i >= 4 else None, g[i + 2][2] if i + 2 < len(g) else None, sum(vals) if vals else None)


def test_running_last(spark, table, both_paths):
    df, data = table
    got = {r.id: r.f for r in ordered.running_last(df, ["k"], ["t", "id"], "v", "f").collect()}
    for g in by_key(data).values():
        last = None
        for r in g:
            last = r[3] if r[3] is not None else last
            assert got[r[2]] == last


def test_quantiles(spark, table, both_paths):
    import numpy as np

    df, data = table
    out = ordered.aggregate_with_quantiles(df, ["k"], [F.count("v").alias("n")], "v", {"q25": 0.25, "q50": 0.5})
    got = {r.k: (r.n, r.q25, r.q50) for r in out.collect()}
    for k, g in by_key(data).items():
        v = [r[3] for r in g if r[3] is not None]
        assert got[k] == (len(v), pytest.approx(np.quantile(v, 0.25)), pytest.approx(np.quantile(v, 0.5)))


def test_quantiles_of_nothing_are_null(spark, both_paths):
    df = spark.createDataFrame([("a", None)] * 5 + [("b", 1.0)], "k string, v double")
    out = ordered.aggregate_with_quantiles(df, ["k"], [F.count("v").alias("n")], "v", {"q": 0.5})
    assert rows(out, "k") == [("a", 0, None), ("b", 1, 1.0)]


def test_chronological_position(spark, both_paths):
    rng = random.Random(3)
    base = 1_700_000_000_000_000
    data = [(base + rng.choice([0, 1, 250_000, 10**6, 86_400 * 10**6 * rng.randint(0, 3)]), i) for i in range(200)]
    df = spark.createDataFrame(data, "us long, id int").withColumn("ts", F.timestamp_micros("us"))
    out = ordered.chronological_position(df, "ts", ["id"], "pos", "total")
    got = {r.id: (r.pos, r.total) for r in out.collect()}
    assert got == {r[1]: (i, 200) for i, r in enumerate(sorted(data), 1)}


def test_only_large_keys_are_tiled(spark, table):
    df, _ = table
    spark.conf.set(GROUP_ROWS_CONF, "100")
    small, large, n = ordered.split_by_size(df, ["k"])
    spark.conf.unset(GROUP_ROWS_CONF)
    assert {r.k for r in large.select("k").distinct().collect()} == {"hot"}
    assert small.count() + large.count() == df.count() and large.count() == n


def test_checked_broadcast_gives_up_on_large_tables(spark):
    df = spark.range(50)
    assert ordered.checked_broadcast(df, 10) is df
    plan = spark.range(100).join(ordered.checked_broadcast(df, 50), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan
