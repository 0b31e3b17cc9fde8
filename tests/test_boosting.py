"""Booster, balanced draws and ensembles against plain numpy."""

import hashlib
import threading
from collections import Counter, defaultdict

import numpy as np
import pytest

from gyratory.operators import boosting as B
from gyratory.operators import ensembles as N
from gyratory.operators import models as M
from gyratory.operators.metrics import soft_vote

NAMES = ["a", "b", "c"]


def table(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(3)
    y = np.where(x[:, 0] + x[:, 1] > 1, 2, np.where(x[:, 2] > 0.9, 1, 0))
    x[rng.random(x.shape) < 0.05] = np.nan
    rows = [(i, int(y[i]) if i % 50 else None, *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "ID long, label int, a double, b double, c double"), x, y


def test_bins_hold_near_equal_counts(spark):
    df, x, _ = table(spark)
    bins = B.fit_bins(df, NAMES, 8)
    got = bins.bins(x.T)
    for i in range(3):
        known = ~np.isnan(x[:, i])
        assert (got[i][~known] == 0).all() and set(got[i][known]) == set(range(1, 8))
        assert np.bincount(got[i][known])[1:].max() < 600 / 7 * 1.2
        order = np.argsort(x[known, i])
        assert (np.diff(got[i][known][order].astype(int)) >= 0).all()


def test_first_split_equals_a_full_search(spark):
    df, x, y = table(spark)
    known = np.arange(600) % 50 != 0
    found = {c: (f, b, g) for c, f, b, g in B.root_splits(df, NAMES, bins=8)}
    x, y = x[known], y[known]
    binned = B.fit_bins(df.filter("label is not null"), NAMES, 8).bins(x.T).astype(int)
    weight = (len(y) / (3 * np.bincount(y)))[y]
    for k in range(3):
        g, h = weight * (1 / 3 - (y == k)), weight * (2 / 9)
        gains = {}
        for f in range(3):
            for b in range(7):
                left = binned[f] <= b
                if h[left].sum() >= 1 and h[~left].sum() >= 1:
                    gains[NAMES[f], b] = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
        feature, b, gain = found[k]
        assert gain == pytest.approx(max(gains.values()), abs=1e-4) and gains[feature, b] == pytest.approx(gain, abs=1e-4)


def accuracy(model, df, y):
    got = {r["ID"]: r for r in model.probabilities(df, ["ID"]).collect()}
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 for r in got.values())
    return np.mean([got[i]["y_pred"] == y[i] for i in got])


def test_booster_learns_and_does_not_depend_on_partitions(spark, monkeypatch):
    df, _, y = table(spark)
    model = B.fit_booster(df, NAMES, rounds=25, depth=3)
    assert accuracy(model, df, y) > 0.95
    monkeypatch.setattr(B, "PART", 40)
    monkeypatch.setattr(B, "FEW", 2)
    monkeypatch.setattr(B, "KEEP", 4)
    again = B.fit_booster(df.repartition(7), NAMES, rounds=6, depth=3)
    for one, other in zip(model.rounds, again.rounds):
        assert (one.feature == other.feature).all() and (one.bin == other.bin).all() and np.allclose(one.value, other.value)
    assert [n for n, _ in model.importance()[:1]] and sum(v for _, v in model.importance()) == pytest.approx(1)


def test_booster_of_odd_tables(spark):
    df, _, _ = table(spark)
    assert B.fit_booster(df.limit(0), NAMES).probabilities(df, ["ID"]).count() == 600
    for fit in (N.fit_balanced_bag, N.fit_balanced_boost):
        none = fit(df.limit(0), NAMES).probabilities(df, ["ID"])
        assert none.filter("y_pred IS NULL AND size(probs) = 0").count() == 600
    one = B.fit_booster(df.filter("label = 1"), NAMES).probabilities(df, ["ID"]).first()
    assert one["probs"] == [1.0] and one["y_pred"] == 1
    flat = df.selectExpr("ID", "label", "CAST(1 AS DOUBLE) a", "CAST(NULL AS DOUBLE) b", "c")
    assert B.fit_booster(flat, NAMES, rounds=2, depth=2).probabilities(flat, ["ID"]).count() == 600


@pytest.mark.parametrize("samples", [1, 5])
def test_balanced_samples(spark, samples):
    df, _, y = table(spark)
    got = {tuple(r) for r in N.balanced_samples(df, "label", "ID", samples, seed=3).collect()}
    counts = Counter(int(y[i]) for i in range(600) if i % 50)
    want = set()
    for s in range(samples):
        for c in counts:
            ids = sorted((hashlib.md5(f"{i}:{s + 3}".encode()).hexdigest(), i) for i in range(600) if i % 50 and y[i] == c)
            want |= {(i, c, s) for _, i in ids[: min(counts.values())]}
    assert got == want


def test_bag_votes_like_soft_vote(spark, monkeypatch):
    df, _, y = table(spark)
    model = N.fit_balanced_bag(df, NAMES, samples=7, depth=4)
    assert accuracy(model, df, y) > 0.85
    votes = model.probabilities(df, ["ID"], each=True).cache()
    trees = [votes.selectExpr("ID AS sequence_id", f"votes[{i}] AS probs") for i in range(7)]
    voted = {r["sequence_id"]: r for r in soft_vote(trees, model.weights).collect()}
    for r in votes.collect():
        assert r["probs"] == pytest.approx(voted[r["ID"]]["probs"]) and r["y_pred"] == voted[r["ID"]]["y_pred"]
    # trees grown in several passes are the same
    monkeypatch.setattr(N, "ROOM", 1)
    again = N.fit_balanced_bag(df, NAMES, samples=7, depth=4)
    assert len(again.trees) == 7 and all(np.array_equal(np.concatenate([t.bin for t in again.trees]), np.concatenate([t.bin for t in model.trees])) for _ in (0,))
    votes.unpersist()


def test_each_tree_of_a_bag_sees_its_own_draw(spark):
    df, x, y = table(spark)
    model = N.fit_balanced_bag(df, NAMES, samples=3, depth=3, bins=8)
    drawn = defaultdict(list)
    for r in N.balanced_samples(df, "label", "ID", 3).collect():
        drawn[r["sample"]].append(r["ID"])
    for k in range(3):
        rows = np.array(drawn[k])
        shares = np.bincount(y[rows], minlength=3) / len(rows)
        assert model.leaves[0][k][0] == pytest.approx(shares)
        nodes = model.trees[0].nodes(model.bins.bins(x[rows].T), k, 3)
        for node in set(nodes):
            assert model.leaves[0][k][node] == pytest.approx(np.bincount(y[rows][nodes == node], minlength=3) / (nodes == node).sum())


def test_boosting_raises_the_weights_of_errors(spark):
    df, _, y = table(spark)
    model = N.fit_balanced_boost(df, NAMES, rounds=8, depth=2)
    one = N.fit_balanced_boost(df, NAMES, rounds=1, depth=2)
    assert len(model.weights) > 2 and accuracy(model, df, y) > accuracy(one, df, y)
    x = np.array([[np.nan if v is None else v for v in r] for r in df.orderBy("ID").select(*NAMES).collect()], float)
    known = np.arange(600) % 50 != 0
    wrong = one.leaves[0][0][one.trees[0].nodes(one.bins.bins(x[known].T), 0, 2)].argmax(axis=1) != y[known]
    assert one.weights[0] == pytest.approx(np.log((1 - wrong.mean()) / wrong.mean()) + np.log(2))


def test_all_models_give_probabilities(spark):
    df, _, _ = table(spark)
    known = df.filter("label is not null").fillna(0.0, NAMES)
    models = {"random_forest": lambda d: M.train_random_forest(d, NAMES, trees=5, depth=3), "boosted_trees": lambda d: M.train_boosted_trees(d, NAMES, rounds=3, depth=2), "mlp": lambda d: M.train_mlp(d, NAMES, 3, (4,), 5)}
    for fit in models.values():
        assert all(len(r["probs"]) == 3 and abs(sum(r["probs"]) - 1) < 1e-6 for r in M.probabilities(fit(known), known, ["ID"]).collect())
    ranked = M.compare_models(known, known, models)
    assert ranked.count() == 3 and "seconds" not in ranked.columns and M.category_stats(ranked).count() == 3
    assert M.feature_importance(models["random_forest"](known), NAMES, top=2).count() == 2


def test_compared_models_are_fitted_at_the_same_time(spark):
    df, _, _ = table(spark)
    known = df.filter("label is not null").fillna(0.0, NAMES)
    both = threading.Barrier(2)

    def fit(rows):
        # one after the other, the first would wait in vain
        both.wait(timeout=60)
        return M.train_boosted_trees(rows, NAMES, rounds=2, depth=2)

    ranked = [r[2:] for r in M.compare_models(known, known, {"boosted_trees": fit, "other": fit}).collect()]
    assert ranked[0] == ranked[1] == M.score(M.train_boosted_trees(known, NAMES, rounds=2, depth=2), known).first()


def test_binned_rows_use_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(20_000).coalesce(1)
    assert B.few_parts(one, 20_000).rdd.getNumPartitions() == min(cores, 10, B.FEW)
    assert B.few_parts(one, 20_000, 1).rdd.getNumPartitions() == 1
    assert B.few_parts(one, 500).rdd.getNumPartitions() == 1 and B.few_parts(one, 10_000_000).rdd.getNumPartitions() == 500


def test_a_pass_sums_one_side_of_each_split(spark, monkeypatch):
    df, x, y = table(spark)
    real, sent = B._histograms, []

    def counted(state, targets, trees, level, *rest):
        found = real(state, targets, trees, level, *rest)
        sent.append((level, found))
        return found

    monkeypatch.setattr(B, "_histograms", counted)
    model = N.fit_balanced_bag(df, NAMES, samples=4, depth=4, bins=8)
    rows = {level: found.sum(axis=(1, 3, 4))[:, 0] for level, found in sent}
    assert set(rows) == {0, 1, 2, 3} and all((rows[level] <= rows[0] / 2).all() for level in (1, 2, 3))
    # all leaves, also those of the sides that were not counted, hold the rows that reach them
    draws = defaultdict(list)
    for r in N.balanced_samples(df, "label", "ID", 4).collect():
        draws[r["sample"]].append(r["ID"])
    for k, drawn in draws.items():
        at = model.trees[0].nodes(model.bins.bins(x[drawn].T), k, 4)
        for node in set(at):
            assert model.leaves[0][k][node] == pytest.approx(np.bincount(y[drawn][at == node], minlength=3) / (at == node).sum())
    # wide histograms are merged in the cluster, with the same sums
    monkeypatch.setattr(B, "ADDED", 0)
    again = N.fit_balanced_bag(df.repartition(5), NAMES, samples=4, depth=4, bins=8)
    assert np.array_equal(again.trees[0].bin, model.trees[0].bin) and np.array_equal(again.leaves[0], model.leaves[0])


def test_early_leaves_hand_their_value_down():
    rng = np.random.default_rng(5)
    trees = B.Trees(rng.integers(-1, 5, (3, 15)).astype(np.int32), rng.integers(0, 31, (3, 15)).astype(np.int32), rng.normal(size=(3, 31)), np.zeros(3))
    for node in range(1, 15):
        # nothing grows below a leaf
        trees.feature[:, node] = np.where(trees.feature[:, (node - 1) // 2] < 0, -1, trees.feature[:, node])
    x = rng.integers(0, 32, (5, 400)).astype(np.uint8)
    want = np.stack([trees.value[k][trees.nodes(x, k, 4)] for k in range(3)], axis=1)
    assert np.array_equal(trees.scores(x, 4), want) and np.array_equal(trees.scores(np.asfortranarray(x), 4), want)
    assert trees.scores(x[:, :0], 4).shape == (0, 3)
