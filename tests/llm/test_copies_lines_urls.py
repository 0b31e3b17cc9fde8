"""Exact copies, line dedup and URL filters: small cases with known answers, and SQL twins."""

import hashlib
import os

import numpy as np
import pytest
from odd_documents import SF, odd_table

from gyratory.llm import exact_copies, line_index, queries, url_rules
from tools.check import compare

TEXTS = [(1, "Ab c"), (2, "aB C"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (9, "x" * 299_999 + "y"), (None, "ab c"), (10, "q"), (10, "q")]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(spark, duck, name):
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    assert compare(queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()) == "ok"


def copies_by_hand(texts):
    distinct = {}
    for i, t in texts:
        body = (t or "").encode().lower()
        distinct.setdefault(body, []).append(i)
    out = set()
    for body, ids in distinct.items():
        keep = max(-1 if i is None else i for i in ids)
        for i in ids:
            out.add((i, keep, len(ids), i == keep, hashlib.sha256(body).hexdigest()))
    return out


@pytest.mark.parametrize("fields", [exact_copies.FIELDS, ((2, 1), (3, 1))], ids=["strong", "colliding"])
@pytest.mark.parametrize("spread", [1 << 25, 1000])
def test_exact_copies(spark, fields, spread):
    got = exact_copies.exact_copies(odd_table(spark, TEXTS), fields=fields, chunk=1 << 12, spread=spread)
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == copies_by_hand(TEXTS) and len(rows) == len(set(TEXTS))


def test_exact_copies_of_nothing(spark):
    assert exact_copies.exact_copies(odd_table(spark, [])).count() == 0


def test_pieces_join_to_the_whole():
    data = np.random.default_rng(1).integers(0, 256, 200_000).astype(np.uint8).tobytes()
    tables = [exact_copies.powers_of(m, b) for m, b in exact_copies.FIELDS]
    whole = exact_copies.fingerprint(data, tables)
    for cut in (0, 1, 65_536, 100_001, len(data)):
        a, b = (exact_copies.fingerprint(x, tables) for x in (data[:cut], data[cut:]))
        for k, (m, _) in enumerate(exact_copies.FIELDS):
            assert exact_copies.joined(a[2 * k], b[2 * k], b[2 * k + 1], m) == whole[2 * k]
    slow = 0
    for x in data[:70_000]:
        slow = (slow * exact_copies.FIELDS[0][1] + x + 1) % exact_copies.FIELDS[0][0]
    assert exact_copies.fingerprint(data[:70_000], tables)[0] == slow


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        made = line_index.PerfectHash.from_bytes(line_index.PerfectHash.build(a, b, np.arange(n)).to_bytes())
        assert sorted(made.index(a, b).tolist()) == list(range(n))
        assert made.counts(a, b).tolist() == list(range(n))
        c, d = (rng.integers(0, 1 << 63, 1000).astype(np.uint64) for _ in range(2))
        assert made.counts(c, d).sum() == 0


def lines_by_hand(texts, min_docs, min_length):
    seen = {}
    for _, t in texts:
        for key in {line_index.line_key(x) for x in (t or "").encode().split(b"\n")}:
            seen[key] = seen.get(key, 0) + 1
    out = []
    for i, t in texts:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if not (len(line_index.line_key(x).decode()) >= min_length and seen[line_index.line_key(x)] >= min_docs)]
        out.append((i, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_length", [1, 3])
@pytest.mark.parametrize("shard_keys", [4, 100_000])
def test_line_dedup(spark, min_length, shard_keys):
    texts = [(1, " A \nb\n\nc"), (2, "a\nB\té"), (3, None), (4, ""), (5, "a\na\na"), (6, "\t\n \n"), (None, "c\n"), (7, "cc\r\nccé"), (7, "cc\r\nccé"), (8, "\n".join(f"l{i}" for i in range(3000)) + "\nCCÉ\nccé\na")]
    got = line_index.drop_frequent_lines(odd_table(spark, texts), min_docs=3, min_length=min_length, blocks=5, shard_keys=shard_keys)
    assert sorted([tuple(r) for r in got.collect()], key=str) == lines_by_hand(texts, 3, min_length)


def test_line_dedup_of_nothing(spark):
    assert line_index.drop_frequent_lines(odd_table(spark, [])).count() == 0
    assert line_index.drop_frequent_lines(odd_table(spark, [(1, None), (2, "")])).count() == 2


def test_urls(spark):
    rules = [("net", "/", "block"), ("Example.net", "/en/", "allow"), ("a.b.org", "/x", "block"), ("a.b.org", "/x/y/z", "allow"), ("org", "", "block"), (None, "/", "block")]
    cases = {
        "http://a.net/": ("net/", "block"), "http://a.net": (None, "allow"), "x://EXAMPLE.NET/en/q?/": ("example.net/en/", "allow"), "http://notexample.net/en/": ("net/", "block"),
        "http://www.a.b.org/xy/1": ("a.b.org/x", "block"), "http://a.b.org/x/y/zzz#k": ("a.b.org/x/y/z", "allow"), "http://b.org": ("org", "block"), "http://org.com/": (None, "allow"),
        "http://": (None, "allow"), "no url": (None, "allow"), "": (None, "allow"), None: (None, "allow"), "http://" + "a." * 3000 + "net" + "/b" * 3000: ("net/", "block"), "http://..net/": ("net/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate([*cases, "http://a.net/"])], "page_id long, url string, host string, key string")
    got = url_rules.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, action string"))
    found = [(r["url"], (r["rule"], r["verdict"])) for r in got.collect()]
    assert len(found) == len(cases) + 1 and dict(found) == cases and got.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict"]
    none = spark.createDataFrame([], "host string, path string, action string")
    assert {r["verdict"] for r in url_rules.filter_urls(pages, none, default="block").collect()} == {"block"}
    assert url_rules.filter_urls(pages.limit(0), none).count() == 0
