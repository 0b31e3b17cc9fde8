"""Quantiles and correlations of many columns against numpy."""

import math

import numpy as np
import pytest

from gyratory.functions import gram, quantiles


def columns(seed=1, n=900):
    rng = np.random.default_rng(seed)
    out = {
        "wide": rng.normal(size=n) * 1e12, "few": rng.integers(0, 3, n).astype(float), "one": np.full(n, 7.5), "skewed": np.exp(rng.normal(size=n) * 12),
        "tiny": 1.0 + rng.integers(0, 50, n) * 2.0**-52, "none": np.full(n, np.nan), "hot": np.where(rng.random(n) < 0.6, 3.25, rng.normal(size=n)), "ends": np.where(rng.random(n) < 0.5, -1.7e308, 1.7e308),
        "single": np.where(np.arange(n) == 4, 2.0, np.nan),
    }
    out["wide"][rng.random(n) < 0.2] = np.nan
    return out


def table(spark, data):
    rows = [tuple(None if math.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(zip(*data.values()))]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)


@pytest.mark.parametrize(("bins", "few"), [(1024, 4096), (7, 5), (2, 1)])
def test_exact_quantiles(spark, monkeypatch, bins, few):
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "FEW", few)
    data, probs = columns(), [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(table(spark, data), list(data), probs)
    for name, row in zip(data, got):
        known = np.sort(data[name][~np.isnan(data[name])])
        for p, value in zip(probs, row):
            if not len(known):
                assert value is None
                continue
            spot = p * (len(known) - 1)
            low, high = known[math.floor(spot)], known[math.ceil(spot)]
            assert value == (low if low == high else low + (high - low) * (spot - math.floor(spot))), (name, p)


def test_quantiles_of_nothing(spark):
    empty = table(spark, columns()).limit(0)
    assert quantiles.exact_quantiles(empty, ["wide", "few"], [0.5]) == [[None], [None]]
    assert quantiles.exact_quantiles(empty, [], [0.5]) == []


@pytest.mark.parametrize("block", [128, 2])
def test_correlation_matrix(spark, monkeypatch, block):
    monkeypatch.setattr(gram, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    x[:, 1] = 1e9 + x[:, 0] * 0.5 + rng.normal(size=300)
    x[:, 3] = 4.0
    x[rng.random(x.shape) < 0.1] = np.nan
    x[2:, 4] = np.nan
    names = list("abcde")
    found = {(r["a"], r["b"]): r for r in gram.correlation_matrix(table(spark, dict(zip(names, x.T))), names).collect()}
    assert len(found) == 10
    for i in range(5):
        for j in range(i + 1, 5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = found[names[i], names[j]]
            assert r["n"] == both.sum()
            if 3 in (i, j) or both.sum() < 2:
                assert r["correlation"] is None
            else:
                assert r["correlation"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert gram.correlation_matrix(table(spark, columns()), []).count() == 0


def test_quantiles_of_weighted_rows(spark):
    rows = [(float(i % 97) if i % 5 else None, 1 + i % 4 * 3000) for i in range(300)]
    repeated = sorted(v for v, n in rows if v is not None for _ in range(n))
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "v double, n int"), ["v"], [0.0, 0.5, 0.9, 1.0], "n")[0]
    assert got == pytest.approx(np.quantile(repeated, [0.0, 0.5, 0.9, 1.0]).tolist())
