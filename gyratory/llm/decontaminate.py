"""Benchmark decontamination: phrases of test items are searched for in an FM-index of each shard of documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyratory.llm.blocks import Words, as_bytes, pieces
from gyratory.llm.fm_index import FMIndex

#: Bytes of benchmark text that a job carries to its tasks; a larger benchmark is searched for block by block.
PHRASE_BYTES = 32 << 20
_FIELDS = [
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
]
_DDL = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


class Phrases:
    """The windows of test items: `size` consecutive words, or all words of a shorter item."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        words = Words([text for _, text in items])
        hashes = words.hashes()
        self.vocabulary, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        self.spelling = [words.data[s:e].tobytes() for s, e in zip(words.start[first], words.end[first], strict=True)]
        number, windows = number + 1, {}
        edge = np.searchsorted(words.doc, np.arange(len(items) + 1))
        for i, (name, _) in enumerate(items):
            own = tuple(number[edge[i] : edge[i + 1]].tolist())
            for j in range(max(1, len(own) - size + 1) if own else 0):
                windows.setdefault(own[j : j + size], set()).add(name)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.windows = np.zeros((len(windows), size), np.int64)
        for i, window in enumerate(windows):
            self.windows[i, size - len(window) :] = window
        self.items = [sorted(x) for x in windows.values()]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers from 1; 0 for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _search_shard(texts: list[bytes], phrases: Phrases, sample: int) -> list[tuple]:
    """(n_words, n_hit, items, spans) of each text; spans are byte ranges of runs of hit words."""
    words = Words(texts)
    number = phrases.numbers(words.hashes())
    found: list[set] = [set() for _ in texts]
    while True:
        # words of no item, and the borders of texts, are separators; a run of them counts as one
        alone = np.flatnonzero(np.diff(words.doc, prepend=-1)) if len(number) else np.zeros(0, np.int64)
        place = np.insert(np.arange(len(number)), alone, -1)
        symbols = np.where(place < 0, 0, number[place]) if len(number) else np.zeros(0, np.int64)
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        symbols, place = symbols[keep], place[keep]
        change = np.zeros(len(number) + 1, np.int64)
        hits = np.zeros(0, np.int64)
        if symbols.any() and len(phrases.windows):
            index = FMIndex(symbols, len(phrases.vocabulary), sample)
            low, high = index.search(phrases.windows, phrases.lengths)
            many = np.maximum(high - low, 0)
            window = np.repeat(np.arange(len(many)), many)
            rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[window]
            hits = place[index.locate(rows)]
            np.add.at(change, hits, 1)
            np.add.at(change, hits + phrases.lengths[window], -1)
        inside = np.cumsum(change[:-1]) > 0
        # exact check of the words found, which were compared by hashes
        wrong = [i for i in np.flatnonzero(inside).tolist() if words.data[words.start[i] : words.end[i]].tobytes() != phrases.spelling[number[i] - 1]]
        if not wrong:
            break
        number[wrong] = 0
    if len(hits):
        pairs = np.unique(words.doc[hits] * len(phrases.windows) + window)
        for doc, w in zip((pairs // len(phrases.windows)).tolist(), (pairs % len(phrases.windows)).tolist(), strict=True):
            found[doc].update(phrases.items[w])
    counts = np.bincount(words.doc, minlength=len(texts))
    hit_counts = np.bincount(words.doc[inside], minlength=len(texts))
    spans: list[list] = [[] for _ in texts]
    at = np.flatnonzero(inside)
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(words.doc[at]) > 0)
        begin, stop = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
        for doc, s, e in zip(words.doc[begin].tolist(), words.start[begin].tolist(), words.end[stop].tolist(), strict=True):
            spans[doc].append((s - int(words.first[doc]), e - int(words.first[doc])))
    return [(int(a), int(b), sorted(x), y) for a, b, x, y in zip(counts, hit_counts, found, spans, strict=True)]


def _merged(old: tuple, new: tuple, text: bytes) -> tuple:
    """Results of two blocks of items for one text; runs of hit words are told again from both."""
    words = Words([text])
    change = np.zeros(len(text) + 2, np.int64)
    for start, end in [*old[3], *new[3]]:
        change[start] += 1
        change[end] -= 1
    at = np.flatnonzero(np.cumsum(change)[words.start] > 0)
    new_run = np.diff(at, prepend=-2) > 1
    begin, stop = at[new_run], at[np.append(np.flatnonzero(new_run)[1:] - 1, len(at) - 1)] if len(at) else at
    spans = list(zip(words.start[begin].tolist(), words.end[stop].tolist(), strict=True))
    return old[0], len(at), sorted({*old[2], *new[2]}), spans


def cleaned(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans; a line break stands for each, so that its neighbours do not become one phrase's line."""
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"\n".join([*out, text[at:]])


def shards_searched(batches: Iterable[pa.RecordBatch], phrases: Phrases, shard_bytes: int, sample: int = 8, text: str = "text", first: bool = True, clean: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` with their results, shard by shard: what is found is added to earlier results unless it is the `first`; with `clean`, texts lose the spans."""
    names = [c for c, _ in _FIELDS]
    for batch in batches:
        for shard in pieces(batch, text, shard_bytes):
            texts = as_bytes(shard.column(text))
            made = _search_shard(texts, phrases, sample)
            if not first:
                olds = zip(*[shard.column(c).to_pylist() for c in names], strict=True)
                olds = [(a, b, c, [(x["start"], x["end"]) for x in d]) for a, b, c, d in olds]
                made = [_merged(o, m, t) if o[3] or m[3] else m for o, m, t in zip(olds, made, texts, strict=True)]
            arrays = {c: shard.column(c) for c in shard.schema.names if c not in names}
            if clean:
                null = shard.column(text).is_null().to_pylist()
                body = [None if x else cleaned(t, m[3]) for t, m, x in zip(texts, made, null, strict=True)]
                arrays[text] = pa.array(body, pa.binary()).cast(pa.string())
            columns = zip(*made, strict=True)
            results = [pa.array([[{"start": s, "end": e} for s, e in x] for x in v] if n == "spans" else v, kind) for (n, kind), v in zip(_FIELDS, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays.values(), *results], names=[*arrays, *names])


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Test items in blocks of at most about `limit` bytes, one block on the driver at a time."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.encode(F.col(text), "UTF-8").alias("text")).dropna()
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row["item"], bytes(row["text"])))
        size += len(block[-1][1]) + 64
        if size > limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_phrases(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", clean: bool = False, shard_bytes: int = 2 << 20, sample: int = 8, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """`docs` with n_words, n_hit, items and spans, which replace columns of these names; with `clean`, the text without the spans.

    Words are runs of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII. A window is `size` consecutive words of an item, or
    the whole of a shorter item. Words inside any occurrence of a window are hit; spans are the byte ranges of runs of hit words. A null text
    has no words and stays null; items with a null or without words have no window. Each row is judged alone; repeated ones alike.

    A task cuts its Arrow batches into shards of about `shard_bytes` (a longer text is a shard of its own), builds the FM-index of each shard over item
    vocabulary numbers, searches all windows together and hands the shard's rows on before the next. Nothing is shuffled. The benchmark goes to the tasks in blocks
    of `phrase_bytes`, however large it is; one block is one pass over the documents.
    """
    names = [c for c, _ in _FIELDS]
    base = docs.drop(*[c for c in names if c in docs.columns])
    # earlier blocks' results, in a column of their own while there are further blocks
    blocks = _blocks(benchmark, item_id, item_text, phrase_bytes)
    block = next(blocks, [])
    out, first = base, True
    schema = f"{', '.join(f'`{c}` {k}' for c, k in base.dtypes)}, {_DDL}"
    context = docs.sparkSession.sparkContext
    while block is not None:
        following = next(blocks, None)
        shared = context.broadcast(block)
        final = clean and following is None

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, final=final) -> Iterator[pa.RecordBatch]:
            return shards_searched(batches, Phrases(shared.value, size), shard_bytes, sample, text, first, final)

        out = out.mapInArrow(run, schema)
        block, first = following, False
    return out
