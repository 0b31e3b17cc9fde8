"""Alignment of two tokenizers: token intervals are coalesced into groups, overlaps expand into links, links are counted over the corpus."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gyratory.llm.blocks import as_bytes, cut
from gyratory.llm.token_spans import PATTERN
from gyratory.session import materialise, scratch

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts that the quick encoder may not split like the file's own: letters added to Unicode of late, and runs that its pattern matcher cannot hold.
_SLOW = re.compile(r"[^\x00-ԯ]|\s{1000}|\S{1000}")
_PIECE = 1 << 19


def byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on in their order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE file of `tokenizers`; special tokens in texts are plain text.

    The vocabulary goes into a quicker encoder too where its numbers are in the order of the merges; `_SLOW` texts take the file's own.
    """

    def __init__(self, file: bytes):
        self.file = file
        said = json.loads(file)
        model, letters = said["model"], byte_letters()
        special = {t["id"] for t in said.get("added_tokens", [])}
        self.tokens = [b""] * (1 + max([*model["vocab"].values(), *special], default=0))
        for token, number in model["vocab"].items():
            self.tokens[number] = bytes(letters[c] for c in token) if number not in special else token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ordered = [model["vocab"].get(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs)))
        plain = {t: i for i, t in enumerate(self.tokens) if i not in special}
        self.quick = tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={}) if ordered else None

    @cached_property
    def own(self) -> Tokenizer:
        made = Tokenizer.from_str(self.file.decode())
        made.encode_special_tokens = True
        return made

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]
        return [self.own.encode(t, add_special_tokens=False).ids if _SLOW.search(t) else self.quick.encode_ordinary(t) for t in texts]


class Pieces:
    """A sentencepiece model; it puts a space before each text itself."""

    def __init__(self, file: bytes):
        self.own = sentencepiece.SentencePieceProcessor(model_proto=file)
        n = self.own.get_piece_size()
        self.tokens = [bytes([int(p[1:-1], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.own.id_to_piece(i)) for i in range(n))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1) if texts else []


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Group of each interval [start, end): sorted by start, a group breaks where a start reaches the largest end before it.

    Groups count from 0 in order; intervals that overlap, also through others, share one.
    """
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of A, of B) of all overlapping intervals. Each side is in order and free of overlaps in itself."""
    low = np.searchsorted(b_end, a_start, "right")
    n = np.maximum(np.searchsorted(b_start, a_end, "left") - low, 0)
    a = np.repeat(np.arange(len(a_start)), n)
    return a, np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(a)) if len(a) else a


class _Names:
    """Decimal numbers followed by a separator, as rows of a byte matrix."""

    SEPARATORS = b",|;"

    def __init__(self, size: int):
        width = len(str(size)) + 1
        rows = [str(i).encode() + self.SEPARATORS[k : k + 1] for k in range(3) for i in range(size)]
        self.size, self.rows = size, np.array(rows, f"S{width}").view(np.uint8).reshape(-1, width)

    def written(self, numbers: np.ndarray, separators: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All of them in one string, and where each one ends."""
        chosen = self.rows[separators * self.size + numbers]
        used = chosen != 0
        return chosen[used].tobytes(), np.cumsum(used.sum(axis=1))


def _aligned(texts: list[bytes], one: ByteLevel, two: Pieces, lengths: list[np.ndarray], names: _Names) -> dict[str, pa.Array]:
    """Columns of some texts: numbers of tokens, groups and links, groups written out, distinct links with how often each occurs."""
    n, width = len(texts), len(two.tokens)
    given = [t.decode("utf-8", "replace") for t in texts]
    asked = [i for i, t in enumerate(texts) if t]
    a_ids = one.encode([" " + given[i] for i in asked])
    b_ids = two.encode([given[i] for i in asked])
    a_of, b_of = one.tokens.__getitem__, two.tokens.__getitem__
    sound = [k for k, (i, a, b) in enumerate(zip(asked, a_ids, b_ids, strict=True)) if b" " + texts[i] == b"".join(map(a_of, a)) == b"".join(map(b_of, b))]
    docs = np.array([asked[k] for k in sound], np.int64)

    def flat(lists: list[list[int]], of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = [lists[k] for k in sound]
        ids = np.fromiter(chain.from_iterable(own), np.int64, sum(map(len, own)))
        doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
        ends = np.cumsum(of[ids])
        return ids, doc, ends - of[ids], ends

    # both sides cover the same bytes, text after text, so one line holds all of them
    a, a_doc, a_start, a_end = flat(a_ids, lengths[0])
    b, b_doc, b_start, b_end = flat(b_ids, lengths[1])
    group = coalesce(np.concatenate((a_start, b_start)), np.concatenate((a_end, b_end)))
    side = np.concatenate((np.zeros(len(a), np.int64), np.ones(len(b), np.int64)))
    order = np.argsort(group * 2 + side, kind="stable")
    ids, doc, group, side = np.concatenate((a, b))[order], np.concatenate((a_doc, b_doc))[order], group[order], side[order]
    fresh = np.ones(len(group), bool)
    fresh[1:] = group[1:] != group[:-1]
    after = np.full(len(group), 2)
    after[:-1] = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
    line, ends = names.written(ids, after)
    last = np.cumsum(np.bincount(doc, minlength=len(docs)))
    stops = ends[last - 1] if len(docs) else np.zeros(0, np.int64)
    written: list[bytes | None] = [None] * n
    begin = 0
    for i, stop in zip(docs.tolist(), stops.tolist(), strict=True):
        written[i], begin = line[begin : stop - 1], stop
    x, y = overlaps(a_start, a_end, b_start, b_end)
    codes, times = np.unique((docs[a_doc[x]] * len(one.tokens) + a[x]) * width + b[y], return_counts=True)
    owner, codes = np.divmod(codes, len(one.tokens) * width)
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32))

    def tally(of: np.ndarray) -> pa.Array:
        return pa.array(np.bincount(docs[of], minlength=n).astype(np.int64))

    return {
        "n_a": tally(a_doc),
        "n_b": tally(b_doc),
        "n_groups": tally(doc[fresh]),
        "n_links": tally(a_doc[x]),
        "groups": pa.array(written, pa.binary()),
        "pairs": pa.ListArray.from_arrays(offsets, pa.array(codes)),
        "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
    }


def token_groups(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups binary, pairs array<long>, times array<int>) of each row.

    A is the byte-level file over space + text, B the sentencepiece model over the text, which puts the space itself. Offsets where tokens
    of both end cut them into groups, written as `a1,a2|b1;a3|b2,b3`. A link is a token of A and one of B whose bytes overlap; `pairs` are
    its distinct A * size of B + B, `times` how often each occurs. Texts that are null, empty or not told by the joined bytes of A and of
    B have no tokens: zeros, null groups, empty lists. Repeated rows give repeated results. An empty table gives no rows.

    Texts are encoded whole. Nothing is shuffled; the files (a few MB, read by the driver) go to the tasks.
    """
    context = docs.sparkSession.sparkContext
    with open(byte_bpe, "rb") as file:
        first = context.broadcast(file.read())
    with open(pieces, "rb") as file:
        second = context.broadcast(file.read())
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = ByteLevel(first.value), Pieces(second.value)
        lengths = [np.array([len(t) for t in x.tokens], np.int64) for x in (one, two)]
        names = _Names(max(len(one.tokens), len(two.tokens)))
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for start, stop in cut(texts, _PIECE):
                made = _aligned(texts[start:stop], one, two, lengths, names)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), *made.values()], names=["doc_id", *made])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups binary, pairs array<long>, times array<int>")


def align_tokens(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, frequent: int = 300_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row; links and groups as in `token_groups`.

    A pair's count is the number of rows of the corpus that hold it linked. `n_best` are the links whose count is the highest of their
    A token, ties included; `count_sum` adds the counts of all links. `groups_sha256` is the lowercase hex of the groups, '' without tokens.

    Counts are summed before they are shuffled. Pairs in at least a `frequent`-th of all (row, pair) are at most `frequent`, so they are
    broadcast; the others, none of which is hot, are joined.
    """
    with open(pieces, "rb") as file:
        width = sentencepiece.SentencePieceProcessor(model_proto=file.read()).get_piece_size()
    made = token_groups(docs, byte_bpe, pieces, doc_id, text)
    digest = F.coalesce(F.sha2("groups", 256), F.lit(""))
    path = scratch(docs.sparkSession, "token-links")
    made = made.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times")
    made.write.option("compression", "zstd").parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("a", F.expr(f"pair div {width}"))
    # one row of each A token at most
    best = counts.groupBy(F.col("a").alias("_a")).agg(F.max("n").alias("most"))
    counts = materialise(counts.join(best, F.col("a") == F.col("_a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * frequent >= total
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    met = links.join(F.broadcast(counts.filter(often)), "pair", "left")
    rare = met.filter("n IS NULL").select("row", "pair", "times").join(counts.filter(~often), "pair")
    both = met.filter("n IS NOT NULL").select("row", "times", "n", "best").union(rare.select("row", "times", "n", "best"))
    sums = both.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    none = F.lit(0).cast("long")
    out = rows.drop("pairs", "times").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
