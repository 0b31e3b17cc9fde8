"""Token spans, shards, mixtures, models and near copies: odd rows, brute force and held-out accuracy."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from odd_documents import SF, odd_table
from pyspark.sql import functions as F

from gyratory.llm import jaccard_join, kd_shards, near_copies, passage_quality, queries, raking, severity, token_spans
from gyratory.llm.golay_simhash import simhash

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "é" * 5000), (5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (6, "x " * 60_000), (7, "one\n\ntwo")]


@pytest.mark.parametrize("rule", token_spans.RULES)
def test_attribution_against_all_pairs(rule):
    rng = random.Random(1)
    for _ in range(200):
        ends = np.cumsum([rng.randrange(1, 5) for _ in range(rng.randrange(0, 12))]).astype(np.int64)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
        low = np.array([rng.randrange(0, 30) for _ in range(4)])
        high = low + np.array([rng.randrange(0, 12) for _ in range(4)])
        tokens, crossing = token_spans.attribute(starts, ends, low, high, rule)
        for i, (a, b) in enumerate(zip(low, high)):
            spans = list(zip(starts, ends))
            if rule == "share":
                want = sum(max(0, min(b, e) - max(a, s)) / (e - s) for s, e in spans)
            else:
                want = sum(a <= ((s + e - 1) // 2 if rule == "middle" else s) < b for s, e in spans)
            assert tokens[i] == pytest.approx(want)
            assert crossing[i] == sum(s < b and e > a and b > a and not (a <= s and e <= b) for s, e in spans)


def test_section_tokens(spark):
    rows = token_spans.section_tokens(odd_table(spark, ODD)).collect()
    whole = {}
    for r in rows:
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for (doc, total), parts in whole.items():
        copies = 2 if doc == 5 else 1
        assert sum(p["tokens"] for p in parts) == copies * total
    assert len([r for r in rows if r["doc_id"] == 7]) == 3 and [r["tokens"] for r in rows if r["doc_id"] in (1, 2)] == [0, 0]
    fields = token_spans.field_sections(odd_table(spark, ODD[4:5]).withColumn("title", F.lit("T: x")), ["title", "text"])
    assert [r["name"] for r in token_spans.section_tokens(fields, "sections").collect()] == ["title", "text"]
    assert token_spans.section_tokens(odd_table(spark, [])).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_shards(spark, shards):
    rng = random.Random(2)
    texts = ODD + [(100 + i, "w" * rng.randrange(1, 200)) for i in range(600)] + [(1000 + i, "same") for i in range(300)]
    table = odd_table(spark, texts)
    rows = kd_shards.shard_documents(table, shards, bucket_rows=20).collect()
    assert len(rows) == len(texts)
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    sizes = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sizes
    total = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(shards)]
    assert max(total) <= sum(total) / shards + 120_010
    wide = kd_shards.with_shard(table, shards)
    assert sorted(str((r["doc_id"], r["shard"])) for r in wide.collect()) == sorted(str((r["doc_id"], r["shard"])) for r in rows)
    assert kd_shards.shard_documents(odd_table(spark, []), shards).count() == 0


def test_rake_reaches_the_margins(spark):
    cells = spark.createDataFrame([(s, la, 1000) for s in "abc" for la in "xy"], "source string, lang string, tokens long")
    got = raking.rake(cells, {"source": {"a": 0.5, "b": 0.25, "c": 0.25}, "lang": {"x": 0.6, "y": 0.4}}, 0.3).toPandas()
    assert got.groupby("source").weight.sum().tolist() == pytest.approx([900, 450, 450])
    assert got.groupby("lang").weight.sum().tolist() == pytest.approx([1080, 720])
    assert (got.weight <= got.tokens).all()


def test_mix_odd_rows(spark):
    table = odd_table(spark, ODD)
    rows = raking.mix_documents(table, queries.MIX, 0.5, raking.topic_of(F.col("text"), queries.TOPICS)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["probability"] <= 1 for r in rows)
    drawn = raking.draw_documents(table, queries.MIX, 0.5, raking.topic_of(F.col("text"), queries.TOPICS))
    assert drawn.columns == table.columns and sorted(str(r["doc_id"]) for r in drawn.collect()) == sorted(str(r["doc_id"]) for r in rows if r["kept"])
    assert raking.mix_documents(odd_table(spark, []), queries.MIX).count() == 0


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 4, 600)
    docs, buckets = np.repeat(np.arange(600), grades), np.concatenate([np.arange(g) for g in grades])
    model = severity.fit_ordinal(docs, buckets, grades, 8)
    above = model.above(docs, buckets, 600)
    assert (np.diff(model.thresholds) > 0).all() and ((above >= 0.5).sum(axis=1) == grades).mean() > 0.95


def test_attention_gradient():
    rng = np.random.default_rng(4)
    first, x, label = np.array([0, 2, 3, 7]), rng.standard_normal((7, 5)), np.array([1.0, 0.0, 1.0])
    model = passage_quality.Attention.fresh(np.zeros(5), np.ones(5), hidden=4, gate=3)
    model.parts["out"] = rng.standard_normal(4)

    def loss():
        p = model.forward(first, x)["score"]
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()

    gradient = model.gradient(first, x, label)
    for name, g in gradient.items():
        flat = model.parts[name].reshape(-1)
        for i in range(min(4, len(flat))):
            keep = flat[i]
            flat[i] = keep + 1e-5
            up = loss()
            flat[i] = keep - 1e-5
            down = loss()
            flat[i] = keep
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("label"))
    for name, column, truth in (("op5_passage_quality", "predicted", "quality"), ("op7_severity", "toxic", "label")):
        got = queries.QUERIES[name](spark, sf).filter("held_out").join(labels, "doc_id").select(F.avg((F.col(column).cast("int") == F.col(truth)).cast("int"))).first()[0]
        assert got > 0.97, name


def test_models_on_odd_rows(spark):
    for labels in ([], [(2, 1, 1), (7, 0, 1), (None, 1, 0), (4, None, None)]):
        table, marks = odd_table(spark, ODD), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        one = passage_quality.quality(passage_quality.fit_quality(table, marks), spark)
        two = severity.severity(severity.fit_severity(table, marks), spark)
        rows = table.select("doc_id", one("text").alias("q"), two("text").alias("t")).collect()
        assert len(rows) == len(ODD) and all(0 <= r["q"] <= 1 and 0 <= r["t"]["toxicity"] <= 1 for r in rows)
        assert odd_table(spark, []).select(one("text"), two("text")).count() == 0


@pytest.mark.parametrize("crowd", [3, 256])
def test_near_copies_against_all_pairs(spark, crowd):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    texts = list(ODD)
    for i in range(30):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 12])):
            words[rng.randrange(200)] = f"n{rng.randrange(10_000)}"
        texts.append((200 + i, " ".join(words)))
    got = {(r["doc_id"], r["row_hash"]): r["keep_id"] for r in near_copies.near_groups(odd_table(spark, texts), crowd=crowd).collect()}
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets, key=lambda i: -1 if i is None else i)
    root = {i: i for i in ids}
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                first = min(x, y, key=ids.index)
                root = {k: first if v in (x, y) else v for k, v in root.items()}
    assert {k[0]: v for k, v in got.items()} == root
    kept = near_copies.first_of_each(odd_table(spark, texts), crowd=crowd)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in root.items() if k == v}
    assert near_copies.first_of_each(odd_table(spark, [])).count() == 0


def _roots(texts, least=0.8):
    """Smallest id of each group, by all pairs."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in texts)}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and root[a] != root[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def _edited(seed, docs):
    """Texts with one copy each that is truncated, appended to or changed in one block, most of them just over 0.8."""
    rng = random.Random(seed)
    texts = []
    for i in range(docs):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        n, fresh = len(words), [f"f{rng.randrange(3000)}" for _ in range(400)]
        copy = [words[: n - int(0.18 * n)], words + fresh[: int(0.2 * n)], words[: n // 2] + fresh[: int(0.09 * n)] + words[n // 2 + int(0.09 * n) :]][i % 3]
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    return texts


@pytest.mark.parametrize("crowd", [3, 256])
def test_near_copies_edited_in_one_place(spark, crowd):
    texts = _edited(6, 90)
    want = _roots(texts)
    got = {r["doc_id"]: r["keep_id"] for r in near_copies.near_groups(odd_table(spark, texts), crowd=crowd).collect()}
    assert sum(k != v for k, v in want.items()) > 60
    assert got == want


def test_near_copies_of_many_bits(spark):
    rng = random.Random(8)
    texts, far = [], 0
    while far < 6:
        words = [f"w{rng.randrange(3000)}" for _ in range(60)]
        pair = [words, words[:50]]
        bits = [simhash([w.encode() for w in x], 1, distinct=True) for x in pair]
        if (bits[0] ^ bits[1]).bit_count() > 11:
            texts += [(2 * far + i, " ".join(x)) for i, x in enumerate(pair)]
            far += 1
    assert {r["doc_id"]: r["keep_id"] for r in near_copies.near_groups(odd_table(spark, texts)).collect()} == {i: i - i % 2 for i, _ in texts}


def test_unrelated_rows_change_no_group(spark):
    texts = _edited(7, 30)
    # texts of a few words share most bits with each other and with many fingerprints of the old rows
    extra = [(1000 + i, f"{texts[i % 60][1]} {' '.join(f'x{i}_{k}' for k in range(len(texts[i % 60][1].split()) // 2))}") for i in range(240)]
    small, large = ({r["doc_id"]: r["keep_id"] for r in near_copies.near_groups(odd_table(spark, rows), crowd=4).collect()} for rows in (texts, texts + extra))
    assert {i: large[i] for i in small} == small == _roots(texts)


def test_repeats_of_the_kept_row_go(spark):
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "A b c d e f"), (2, "a b c d e f"), (None, "q"), (None, "q"), (3, None), (3, None), (3, "other words"), (3, "other words"), (4, "alone")]
    table = odd_table(spark, texts)
    kept = near_copies.first_of_each(table)
    rows = sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in kept.collect())
    assert rows == [("1", "a b c d e f"), ("3", ""), ("3", "other words"), ("4", "alone"), ("None", "q")]
    assert kept.columns == table.columns and kept.dtypes == table.dtypes


def test_rake_hands_on_what_caps_cut_off(spark):
    rng = random.Random(9)
    topics = {"big": 20_000, "mid": 2_000, "scarce": 100}
    cells = spark.createDataFrame([(s, t, round(n * rng.uniform(0.3, 2))) for s in "abcd" for t, n in topics.items()], "source string, topic string, tokens long")
    targets = {"source": 0.7, "topic": {"scarce": 0.3, "mid": 0.2}}
    for fraction in (0.3, 0.9):
        raked = raking.rake(cells, targets, fraction)
        got = raked.toPandas()
        assert got.weight.sum() == pytest.approx(fraction * got.tokens.sum()) and (got.weight <= got.tokens + 1e-6).all()
        told = raking.margins(raked, targets, fraction).toPandas().set_index(["axis", "value"])
        assert (told.reached - told.feasible).abs().max() < 2e-3
        assert told.target["topic", "scarce"] == pytest.approx(0.3) and told.feasible["topic", "scarce"] < 0.02
        assert got[got.topic == "scarce"].weight.sum() == pytest.approx(got[got.topic == "scarce"].tokens.sum(), rel=0.1)
        assert told.groupby("axis").feasible.sum().tolist() == pytest.approx([1, 1])
    # cells that leave no solution: margins say so, and the total holds all the same
    odd = spark.createDataFrame([("a", "x", 10), ("b", "y", 1000)], "source string, topic string, tokens long")
    targets = {"source": {"a": 0.01, "b": 0.99}, "topic": {"x": 0.001, "y": 0.999}}
    raked = raking.rake(odd, targets, 0.5, most=8)
    assert raked.toPandas().weight.sum() == pytest.approx(505)
    told = raking.margins(raked, targets, 0.5).toPandas()
    assert (told.reached - told.target).abs().max() > 2e-3


@pytest.mark.parametrize("sweeps", [12, None])
def test_unnamed_values_keep_a_chance(spark, sweeps):
    names = ["en", "de", "fr", "es", None, "", "ja"]
    docs = spark.createDataFrame([(i, "text " * 40, names[i % 7], None if i % 5 == 0 else "s1") for i in range(700)], "doc_id long, text string, lang string, source string")
    rows = raking.mix_documents(docs, queries.MIX, 0.5, raking.topic_of(F.col("text"), queries.TOPICS), sweeps=sweeps).collect()
    share = {la: sum(r["tokens"] * r["probability"] for r in rows if r["lang"] == la) / sum(r["tokens"] * r["probability"] for r in rows) for la in ("", "ja")}
    assert len(rows) == 700 and all(r["probability"] > 0.1 for r in rows)
    assert share == pytest.approx({"": 2 / 7, "ja": 1 / 7}, abs=0.02)


def test_near_copies_give_few_keys_and_seldom_of_empty_slices():
    rule, rng, empty = jaccard_join.Similarity(Fraction(4, 5), near_copies.STEP), np.random.default_rng(10), 0
    sizes = [*range(100, 400, 7), *range(1000, 1700, 70)]
    for n in sizes:
        members = np.sort(rng.integers(0, 1 << 64, n, np.uint64))
        used = [len(np.unique((members >> np.uint64(32)) * np.uint64(level.slices) >> np.uint64(32))) for level in rule.levels(n)]
        given = [len(jaccard_join.slice_keys(members, level)) for level in rule.levels(n)]
        assert sum(given) <= rule.slices(n) < 0.8 * n
        empty += used != given
    assert empty <= 3
