"""Token alignment, source divergence and the n-gram Jaccard join against brute force."""

import bisect
import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
from odd_documents import SF, odd_table
from pyspark.sql import functions as F
from test_simhash_phrases import united
from tokenizers import Tokenizer

from gyratory.llm import jaccard_join, source_audit, token_alignment
from gyratory.llm.jaccard_join import Similarity

TEXTS = [(1, None), (2, ""), (3, " "), (4, "The cat <|endoftext|> sat.\n\n\tNaïve café “quoted” 日本語 😀"), (5, "a▁b c"), (6, "x" * 3000 + " y"), (7, "same words here"), (7, "same words here"), (None, "same words Here"), (8, "<0x41><s></s> \x00 \x85  z"), (9, " " * 5000 + "end")]


def aligned_by_hand(texts):
    one, two, letters = Tokenizer.from_file(token_alignment.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECES), token_alignment.byte_letters()
    one.encode_special_tokens = True
    rows, counts = [], Counter()
    for doc, text in texts:
        if not text:
            rows.append((doc, None))
            continue
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        a_bytes = [bytes(letters[c] for c in one.id_to_token(t)) for t in a]
        b_bytes = [bytes([int(two.id_to_piece(t)[1:-1], 16)]) if two.is_byte(t) else two.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
            rows.append((doc, None))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            for token, (_, end) in zip(ids, spans[side]):
                groups[bisect.bisect_left(cuts, end)][side].append(str(token))
        links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (t, u) in zip(b, spans[1]) if s < u and t < e]
        counts.update(set(links))
        written = ";".join("|".join(",".join(g) for g in pair) for pair in groups)
        rows.append((doc, (len(a), len(b), len(cuts), links, hashlib.sha256(written.encode()).hexdigest())))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for doc, made in rows:
        if made is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links, digest = made
            out.append((doc, a, b, groups, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [2, 300_000])
def test_token_alignment(spark, frequent):
    got = token_alignment.align_tokens(odd_table(spark, TEXTS), frequent=frequent)
    assert sorted([tuple(r) for r in got.collect()], key=str) == aligned_by_hand(TEXTS)
    assert token_alignment.align_tokens(odd_table(spark, [])).count() == 0


def test_token_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [tuple(r) for r in docs.orderBy("doc_id").limit(60).collect()]
    got = token_alignment.align_tokens(odd_table(spark, texts))
    assert sorted([tuple(r) for r in got.collect()], key=str) == aligned_by_hand(texts)


def test_coalesced_groups_and_overlaps():
    rng = random.Random(3)
    for _ in range(200):
        sides = []
        for _ in range(2):
            at, spans = 0, []
            for _ in range(rng.randrange(0, 9)):
                at += rng.randrange(0, 3)
                spans.append((at, at := at + rng.randrange(1, 5)))
            sides.append(np.array(spans, np.int64).reshape(-1, 2))
        a, b = sides
        pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i][0] < b[j][1] and b[j][0] < a[i][1]]
        x, y = token_alignment.overlaps(a[:, 0], a[:, 1], b[:, 0], b[:, 1])
        assert list(zip(x.tolist(), y.tolist())) == pairs
        whole = np.concatenate(sides)
        group = token_alignment.coalesce(whole[:, 0], whole[:, 1])
        want = united(range(len(whole)), [(i, j + len(a)) for i, j in pairs])
        assert all((group[i] == group[j]) == (want[i] == want[j]) for i in range(len(whole)) for j in range(len(whole)))


def audited_by_hand(rows, min_docs, top, smooth=5):
    texts = [(lang or "", source or "", [t.decode() for t in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))]) for text, lang, source in rows]
    out = []
    for lang in {t[0] for t in texts}:
        docs = Counter(w for t in texts if t[0] == lang for w in set(t[2]))
        kept = [w for w, n in docs.items() if n >= min_docs]
        counts = {s: Counter() for s in {t[1] for t in texts if t[0] == lang}}
        for t in texts:
            if t[0] == lang:
                counts[t[1]].update(t[2])

        def shares(found):
            total = sum(found[w] for w in kept)
            return {w: 1 + 10**9 * (found[w] + smooth) // (total + smooth * len(kept)) for w in kept}

        q, p = shares(sum(counts.values(), Counter())), {s: shares(c) for s, c in counts.items()}
        for s, own in p.items():
            pairs = [(sum(abs(own[w] - p[o][w]) for w in kept), o) for o in p if o != s]
            above = [(own[w] - q[w], w) for w in kept if counts[s][w] and own[w] > q[w]]
            for part, found in (("pair", pairs), ("term", above)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked if part == "pair" else ranked[:top])]
    return sorted(out)


@pytest.mark.parametrize(("shard_keys", "room", "tile"), [(50_000, 1 << 26, 64), (3, 1, 2)])
def test_source_divergence(spark, monkeypatch, shard_keys, room, tile):
    monkeypatch.setattr(source_audit, "TILE", tile)
    monkeypatch.setattr(source_audit, "BLOCK", tile * 3)
    rng = random.Random(4)
    words = [*(f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(24)), "Éa", "éA", "x1y", "don't"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "d", None])) for _ in range(160)]
    rows += [(None, "en", "empty"), ("", "xx", "s"), ("only one here", "yy", "s"), ("\n1 2 3", "yy", "t"), ("wax " * 300, "en", "a"), ("wax " * 300, "en", "a")]
    docs = spark.createDataFrame([(*r, i, -1, "p", "q") for i, r in enumerate(rows)], "text string, lang string, source string, doc_id long, n long, term string, tile string")
    got = source_audit.source_divergence(docs, min_docs=5, top=4, shard_keys=shard_keys, room=room)
    assert sorted(tuple(r) for r in got.collect()) == audited_by_hand(rows, 5, 4)
    assert source_audit.source_divergence(docs.limit(0)).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(source_audit, "_PIECE", 7)
    text = "Abc defghijklmnop é1ab  q".encode() * 20
    assert [t for some in source_audit.terms(text) for t in some] == re.findall(rb"[a-z\x80-\xff]+", text.lower())


def sets_by_hand(text, size=4):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def linked_by_hand(texts):
    sets = [sets_by_hand(t) for _, t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and sets[j]]
    root = united(range(len(texts)), links)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            ids[root[i]].append(doc)
    return sorted([(doc, len(sets[i]), min(ids[root[i]], default=None) if sets[i] else doc) for i, (doc, _) in enumerate(texts)], key=str)


def near_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared, texts = [rng.choice(vocabulary) for _ in range(60)], []
    while len(texts) < n:
        base = [rng.choice(vocabulary) for _ in range(int(2 ** rng.uniform(0, 8.5)))]
        if rng.random() < 0.3:
            base = base[:40] + shared
        for _ in range(rng.randrange(1, 6)):
            words, kind = list(base), rng.random()
            if kind < 0.3:
                words = words[: max(1, int(len(words) * rng.uniform(0.8, 1)))]
            elif kind < 0.6:
                for _ in range(rng.randrange(0, 1 + len(words) // 30)):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            elif kind < 0.8:
                words += [rng.choice(vocabulary) for _ in range(int(len(words) * rng.uniform(0, 0.2)))]
            texts.append((len(texts) + 100, " ".join(words)))
    return texts


ODD = [(None, "a b c d e f g"), (1, None), (2, ""), (3, "x y"), (3, "x y"), (4, "X \t y"), (None, "q q q q q q"), (5, " \n"), (6, "z " * 50_000), (7, "z " * 40_000), (None, " ")]


@pytest.mark.parametrize(("seed", "tile", "hot"), [(1, 512, 100), (2, 6, 2)])
def test_jaccard_groups(spark, monkeypatch, seed, tile, hot):
    if hot < 100:
        # keys of two sets and more count as hot, so that they are met in parts
        monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
        monkeypatch.setattr(jaccard_join, "HOT_ROWS", hot)
    texts = near_texts(seed, 500) + ODD
    got = jaccard_join.jaccard_groups(odd_table(spark, texts), tile=tile)
    assert sorted([tuple(r) for r in got.collect()], key=str) == linked_by_hand(texts)


def test_jaccard_groups_of_nothing(spark):
    assert jaccard_join.jaccard_groups(odd_table(spark, [])).count() == 0


def test_bounds_hold_for_every_pair():
    rule, rng = Similarity(Fraction(85, 100)), np.random.default_rng(5)
    for n in [*range(1, 200), 1000, 5000]:
        m = int(rng.integers(n, rule.largest(n) + 1))
        total = n + m
        assert rule.need(total) == min(i for i in range(total + 1) if 100 * i >= 85 * (total - i))
        shared = {level.number: level for level in rule.levels(n)}.keys() & {level.number for level in rule.levels(m)}
        level = [level for level in rule.levels(n) if level.number in shared and level.first <= n < level.stop]
        if rule.need(total) <= n:
            assert level and total - 2 * rule.need(total) <= level[0].apart


def test_agreeing_sets_share_a_slice_key():
    rule, rng = Similarity(Fraction(85, 100)), np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(7, 400))
        base = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        most = max(k for k in range(n) if n - k >= rule.need(2 * n - k))
        other = np.unique(base[: n - int(rng.integers(0, most + 1))])
        base = np.unique(base)
        keys = [np.concatenate([jaccard_join.slice_keys(s, level) for level in rule.levels(len(s))]) for s in (base, other)]
        assert len(base) == len(other) or np.intersect1d(*keys).size


def test_packed_points():
    rng = np.random.default_rng(8)
    for axes in (16, 1024):
        for most in (1, 4, 70_000):
            made = rng.integers(0, most, axes).astype(np.uint16)
            assert (jaccard_join.unpacked(jaccard_join.packed(made)) == made).all()


def test_leaves_lose_no_pair():
    rule, rng = Similarity(Fraction(85, 100)), np.random.default_rng(7)
    points = rng.poisson(3, (300, 16)).astype(np.uint32)
    points[150:] = np.maximum(points[:150].astype(int) + rng.integers(-1, 2, (150, 16)) * (rng.random((150, 16)) < 0.1), 0)
    sizes = points.sum(axis=1)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if np.minimum(points[i], points[j]).sum() >= rule.need(int(sizes[i] + sizes[j]))}
    a, b = jaccard_join.leaf_pairs(points, points, rule.need, True)
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} == want
    a, b = jaccard_join.leaf_pairs(points[:150], points[150:], rule.need, False)
    assert {(i, j + 150) for i, j in zip(a.tolist(), b.tolist())} == {p for p in want if p[0] < 150 <= p[1]}
