"""SimHash groups, components and phrase search against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from odd_documents import odd_table
from pyspark.sql import functions as F

from gyratory.llm import decontaminate, golay_simhash
from gyratory.llm.components import components
from gyratory.llm.fm_index import FMIndex


def united(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = united({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [1, 7, 30, 1000])
def test_components_of_blocks(spark, block):
    """Blocks of any size give the same; links that fit one block take a job or two, whatever the chain, where rounds of stars took dozens of stages."""
    rng = random.Random(block)
    links = [(i + 1, i) for i in range(60)] + [(500 - i, 0) for i in range(40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    rng.shuffle(links)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"blocks-{block}", "components")
    found = components(spark.createDataFrame(links, "a long, b long").repartition(5), block)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = united({x for p in links for x in p}, links)
    assert sorted((r["node"], r["root"]) for r in found.collect()) == sorted((n, r) for n, r in want.items() if n != r)
    if block == 1000:
        assert len(tracker.getJobIdsForGroup(f"blocks-{block}")) <= 8


def test_golay_keys_share():
    code, rng = golay_simhash.Golay(), np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 3000)
    for n in (0, 1, 2):
        errors = np.array([sum(1 << b for b in rng.choice(23, n, replace=False)) for _ in words], np.int64)
        for a, b in zip(code.indices(words), code.indices(words ^ errors), strict=True):
            assert set(a[a >= 0]) & set(b[b >= 0])


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_close_links(spark, crowd):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for v in list(values):
        for _ in range(rng.randrange(12)):
            for bit in rng.sample(range(64), rng.randrange(1, 4)):
                v ^= 1 << bit
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = golay_simhash.close_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), crowd)
    got = united(signed, [(r["a"], r["b"]) for r in links.collect()])
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    assert got == united(signed, near)
    assert {(min(r), max(r)) for r in map(tuple, links.collect())} <= set(near)


def test_simhash_groups(spark):
    texts = [(3, "A b  c\td"), (2, "a B c d"), (9, None), (7, ""), (8, " \n"), (5, "one two"), (6, "ONE two"), (None, "one two"), (None, "only null here then"), (4, "É x y"), (12, "é x y"), (11, "w " * 200_000), (11, "w " * 200_000)]
    table = odd_table(spark, texts)
    got = sorted([tuple(r) for r in golay_simhash.simhash_groups(table).collect()], key=str)
    # fingerprints once more with built-in functions
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lists = [(r[0], r[1]) for r in table.select("doc_id", words).collect()]
    shingles = [(i, " ".join(w[k : k + 3])) for i, (_, w) in enumerate(lists) for k in range(max(1, len(w) - 2)) if w]
    hashes = {}
    for i, h in spark.createDataFrame(shingles, "i long, s string").select("i", F.xxhash64("s")).collect():
        hashes.setdefault(i, []).append(h & ((1 << 64) - 1))
    prints = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes.get(i, [])) > len(hashes.get(i, []))) for i in range(len(lists))]
    root = united(range(len(lists)), [(a, b) for a in range(len(lists)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    ids = {r: min((lists[n][0] for n in root if root[n] == r and lists[n][0] is not None), default=None) for r in set(root.values())}
    want = sorted([(lists[i][0], p - (1 << 64) if p >> 63 else p, ids[root[i]]) for i, p in enumerate(prints)], key=str)
    assert got == want
    assert golay_simhash.simhash_groups(odd_table(spark, [])).count() == 0


def test_fm_index():
    rng = np.random.default_rng(5)
    for n, largest in ((1, 1), (60, 2), (500, 3), (2000, 40)):
        text = rng.integers(0, largest + 1, n)
        text = np.concatenate((text, [0], text, [0], text[: n // 2]))
        index = FMIndex(text, largest, sample=5)
        phrases, lengths = rng.integers(1, largest + 1, (60, 5)), rng.integers(1, 6, 60)
        for p, k, low, high in zip(phrases, lengths, *index.search(phrases, lengths), strict=True):
            want = [i for i in range(len(text) - k + 1) if (text[i : i + k] == p[5 - k :]).all()]
            assert sorted(index.locate(np.arange(low, max(low, high))).tolist()) == want


def hits_by_hand(texts, items, size):
    def words(t):
        return list(re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower()))

    windows = {}
    for name, t in items:
        w = [m[0] for m in words(t)]
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(name))
    out = []
    for i, t in texts:
        found = words(t)
        w, hit, names = [m[0] for m in found], set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
                    names |= windows[tuple(w[j : j + k])]
        spans = []
        for j in sorted(hit):
            if j - 1 in hit:
                spans[-1] = (spans[-1][0], found[j].end())
            else:
                spans.append((found[j].start(), found[j].end()))
        out.append((i, len(w), len(hit), sorted(names), spans))
    return sorted(out, key=str)


@pytest.mark.parametrize("phrase_bytes,shard", [(1 << 20, 1 << 20), (100, 50)])
def test_find_phrases(spark, phrase_bytes, shard):
    rng = random.Random(6)
    vocabulary = ["a", "B", "é1", "d", "x9", "ß"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 9)))) for i in range(12)] + [(90, None), (91, "..."), (92, "a,b!a"), (93, "A b A")]
    texts = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice([*vocabulary, "q"]) for _ in range(rng.randrange(0, 60)))) for i in range(30)]
    texts += [(40, None), (41, ""), (42, "..."), (43, "a b a"), (43, "a b a"), (None, "xa B-a"), (44, "z " * 50_000 + "A, b; a")]
    table = odd_table(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_phrases(table, bench, size=4, clean=True, shard_bytes=shard, phrase_bytes=phrase_bytes)
    assert got.columns[:8] == [c for c in table.columns if c != "n_hit"][:8]
    rows = got.collect()
    want = hits_by_hand(texts, items, 4)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in rows], key=str) == want
    by_text = dict(texts)
    for r in rows:
        if r["doc_id"] == 44:
            assert r["text"] == "z " * 50_000 + "\n"
        if not r["spans"]:
            assert r["text"] == by_text[r["doc_id"]]


def test_shards_of_a_batch_leave_one_by_one():
    """A task must not keep the results of a whole batch until its last row is judged."""
    texts = [f"{i} a b c d {'z' * 900}" for i in range(100)] + [None, "", "y" * 20_000, "a b c d"]
    batch = pa.record_batch({"id": pa.array(range(len(texts))), "text": pa.array(texts), "all": pa.array([{"n": i, "s": t} for i, t in enumerate(texts)])})
    made = list(decontaminate.shards_searched(iter([batch, batch.slice(0, 0)]), decontaminate.Phrases([("1", b"A b c d")], 4), 8_000, clean=True))
    assert len(made) >= 13 and all(m.num_rows == 1 or sum(len(t or "") for t in m.column("text").to_pylist()) <= 8_000 for m in made)
    rows = pa.Table.from_batches(made).to_pylist()
    assert [(r["id"], r["all"]) for r in rows] == [(i, {"n": i, "s": t}) for i, t in enumerate(texts)]
    assert [r["n_hit"] for r in rows] == [4] * 100 + [0, 0, 0, 4] and rows[100]["text"] is None and rows[7]["text"] == f"7 \n {'z' * 900}"


def test_find_phrases_in_nothing(spark):
    none, some = spark.createDataFrame([], "item_id long, text string"), odd_table(spark, [(1, "a b")])
    assert [r["n_hit"] for r in decontaminate.find_phrases(some, none).collect()] == [0]
    assert decontaminate.find_phrases(odd_table(spark, []), none).count() == 0
