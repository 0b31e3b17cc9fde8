"""The stages of the pipeline on odd rows, and the whole of it step by step."""

import re
import zlib

import corpus_pipeline
import pytest
from odd_documents import SF
from pyspark.sql import functions as F

from gyratory.llm.decontaminate import find_phrases
from gyratory.llm.severity import REJECT, fit_severity, severity

EXTRA = "n_hit long, n_words long, items string, spans string, _h long, _g_hash long, _source string, _lang string, _topic string, _chance double, _node int, _text string, _row long, _bit boolean, shard int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
CLASH = (-7, -8, "i", "s", -9, -10, "x", "y", "z", -1.0, -2, "t", -3, True, -4)


def odd(spark, texts):
    return spark.createDataFrame([(i, t, lang, source, n, *CLASH) for i, t, lang, source, n in texts], SCHEMA)


@pytest.fixture(scope="module")
def item(spark):
    text = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    return " ".join(re.findall(r"[^\W_]+", text))


WORDS = [f"word{i}" for i in range(60)]
BASE = " ".join(WORDS)
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE + " more", "en", None, 2), (2, BASE + " more", "en", None, 2), (3, None, None, "b", None), (4, "", "", "", 0), (5, "Short one", "xx", "c", 9),
    (None, "no id here at all", "de", "a", 3), (6, "w " * 40_000, "en", "a", 4), (7, "é\n\n\tü", None, None, 5), (8, " ".join(reversed(WORDS)), "fr", "b", 6),
]


def extras_kept(rows):
    names = [c.split()[0] for c in EXTRA.split(", ")]
    return all(r[n] == v for r in rows for n, v in zip(names, CLASH) if n != "shard")


def test_benchmark_sends_texts_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline.decontaminate, "find_phrases", lambda docs, *a, **k: seen.append(docs) or find_phrases(docs, *a, **k))
    rows = corpus_pipeline.benchmark(spark, odd(spark, ROWS), SF).collect()
    assert len(rows) == len(ROWS) and extras_kept(rows)
    assert seen[0].schema.simpleString().count("text:string") == 2  # the text, and the column _text of the odd rows


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_rows(spark, name, item):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd(spark, [*ROWS, (9, "before " + item + " after", "en", "a", -1), (10, item, "en", "a", -2)])
    rows = stage(spark, docs, SF).collect()
    assert extras_kept(rows) and list(rows[0].asDict()) == ([*[c for c in docs.columns if c != "shard"], "shard"] if name == "sharding" else docs.columns)
    ids = sorted((r["doc_id"] for r in rows), key=str)
    everyone = sorted([1, 2, 2, 3, 4, 5, None, 6, 7, 8, 9, 10], key=str)
    if name == "near_duplicates":
        # the first of the near copies, one of the texts without words; a long passage and the same with two words more are near copies
        assert ids == sorted([1, 3, 5, None, 6, 7, 8, 9, *([] if len(item.split()) > 20 else [10])], key=str)
    elif name == "benchmark":
        assert ids == sorted([i for i in everyone if i != 10], key=str)
        cut = next(r for r in rows if r["doc_id"] == 9)
        assert re.sub(r"\s+", " ", cut["text"]).strip() == "before after" and cut["n_chars"] == len(cut["text"])
        assert {(r["doc_id"], r["text"], r["n_chars"]) for r in rows if r["doc_id"] != 9} == {(i, t, n) for i, t, _, _, n in ROWS}
    elif name == "sharding":
        assert ids == everyone and {r["shard"] for r in rows} <= set(range(24))
        assert len({r["shard"] for r in rows if r["doc_id"] == 2}) == 1
    elif name == "mixture":
        assert set(ids) <= set(everyone) and ids.count(2) in (0, 2)
    else:
        assert ids == everyone
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_equals_its_parts(spark):
    """Every stage's rows follow from those before it, by plainer means where there are any."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    given = {r["doc_id"]: r for r in docs.collect()}
    score = severity(fit_severity(docs, spark.read.parquet(f"{SF}/labels.parquet")), spark)
    toxic = {r["doc_id"]: r["t"] for r in docs.select("doc_id", score("text")["toxicity"].alias("t")).collect()}
    clean = {i: given[i] for i in given if toxic[i] < REJECT}

    def shingles(text):
        words = (text or "").encode().lower().split()
        return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets, root = {i: shingles(r["text"]) for i, r in clean.items()}, {i: i for i in clean}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(clean)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    heads = {i for i in ids if top(i) == i}
    found = find_phrases(docs.filter(F.col("doc_id").isin(*heads)), spark.read.parquet(f"{SF}/benchmark.parquet"), size=10, clean=True)
    texts = {r["doc_id"]: r["text"] for r in found.collect() if not r["spans"] or (r["text"] or "").strip(" \n\t\r")}
    assert set(got) <= set(texts) and all(got[i]["text"] == texts[i] for i in got)
    tokens = {i: -(-len((t or "").encode()) // 4) for i, t in texts.items()}
    taken = sum(tokens[i] for i in got) / sum(tokens.values())
    assert 0.8 < taken < 1
    sizes = [0] * 24
    for r in got.values():
        sizes[r["shard"]] += len((r["text"] or "").encode()) + 8
    assert max(sizes) - sum(sizes) / 24 <= max(len((r["text"] or "").encode()) for r in got.values()) + 8
    assert zlib.crc32(b"") == 0
