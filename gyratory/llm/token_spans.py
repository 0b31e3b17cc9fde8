"""Token counts of sections: whole documents are encoded once, token spans meet section spans by character offsets."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("middle", "start", "share")
# White space as the pattern understands it; such runs are one piece of the pattern but for their last character
_LONG_SPACE = re.compile("[\t-\r \x85\xa0  -     　]{4096,}")


class Encoder:
    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, number in ranks.items():
            self.lengths[number] = len(token)

    def encode(self, text: str) -> list[int]:
        """Token numbers of the whole text. Very long runs of white space, which the pattern matcher cannot hold, go in as the pieces they are."""
        if len(text) < 4096:
            return self.encoding.encode_ordinary(text)
        out, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            out += self.encoding.encode_ordinary(text[at : run.start()])
            out += self.encoding._encode_single_piece(text[run.start() : stop])
            at = stop
        return out + self.encoding.encode_ordinary(text[at:]) if at else self.encoding.encode_ordinary(text)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(first character, last character + 1) of each token; a token inside a character spans that character."""
        numbers = np.array(self.encode(text), np.int64)
        ends = np.cumsum(self.lengths[numbers])
        starts = ends - self.lengths[numbers]
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(raw) == len(text):
            return starts, ends
        leads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        return leads[starts + 1] - 1, leads[ends]


def line_sections(text: str) -> tuple[list[int], list[int]]:
    """A section for each line with the \\n that ends it; an empty text is one empty section."""
    breaks = [m.end() for m in re.finditer("\n", text)]
    starts = [0, *breaks]
    return starts, [*breaks, len(text)]


def attribute(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens that cross its borders) for sections [low, high), which may overlap or leave gaps.

    A token belongs to the sections that hold its middle character (the earlier of two), or its first one, or each section
    gets the share of its characters that lies inside. Sections that partition a text add up to its tokens.
    """
    # spans are in order, so each question is a pair of binary searches
    meets = np.maximum(np.searchsorted(starts, high, "left") - np.searchsorted(ends, low, "right"), 0)
    meets = np.where(high > low, meets, 0)
    within = np.searchsorted(ends, high, "right") - np.searchsorted(starts, low, "left")
    crossing = meets - np.maximum(np.minimum(within, meets), 0)
    if rule == "share":
        width = np.maximum(ends - starts, 1)
        whole = np.concatenate(([0.0], np.arange(1, len(starts) + 1)))

        def upto(at: np.ndarray) -> np.ndarray:
            done = np.searchsorted(ends, at, "right")
            if not len(starts):
                return np.zeros(len(at))
            # tokens inside one character share it; what reaches past the border counts by its part before it
            begun = np.searchsorted(starts, at, "left")
            out = whole[done]
            for k in range(int((begun - done).max(initial=0))):
                i = np.minimum(done + k, len(starts) - 1)
                out = out + np.where(done + k < begun, np.clip((at - starts[i]) / width[i], 0, 1), 0)
            return out

        return np.where(high > low, upto(high) - upto(low), 0.0), crossing
    point = (starts + ends - 1) // 2 if rule == "middle" else starts
    counts = np.searchsorted(point, high, "left") - np.searchsorted(point, low, "left")
    return np.maximum(counts, 0).astype(float), crossing


def field_sections(docs: DataFrame, fields: list[str], between: str = "\n") -> DataFrame:
    """`docs` with `text`, its fields joined by `between`, and `sections`, the span of each field; nulls are empty."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    text, sections, at = F.lit(""), [], F.lit(0).cast("long")
    for i, (name, part) in enumerate(zip(fields, parts, strict=True)):
        text = F.concat(text, F.lit(between if i else ""), part)
        at = at + (len(between) if i else 0)
        end = at + F.char_length(part)
        sections.append(F.struct(F.lit(name).alias("name"), at.alias("start"), end.alias("end")))
        at = end
    kept = [c for c in docs.columns if c not in ("text", "sections")]
    return docs.select(*kept, text.alias("text"), F.array(*sections).alias("sections"))


def section_tokens(docs: DataFrame, sections: str | None = None, rule: str = "middle", vocabulary: str = VOCABULARY, pattern: str = PATTERN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, section, name, start, end, tokens, crossing, doc_tokens) of each section of each document.

    `sections` names a column array<struct<name string, start long, end long>> of character spans in any order, which may overlap; without it lines
    are the sections, each with its \\n. `rule` (middle, start, share) allocates tokens that cross a border; `crossing` counts those. A null or empty
    text has no tokens, and one empty section if lines are taken; a null list has no sections and gives no rows. Spans with
    a null or beyond the text count what is inside it. Repeated rows give repeated results.

    Texts are encoded whole, once; nothing is shuffled. The vocabulary (a few MB at `vocabulary`, read by the driver) goes to the tasks.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = dict(docs.dtypes)[doc_id]
    lists = F.col(sections).cast("array<struct<name:string,start:long,end:long>>") if sections else F.lit(None).cast("boolean")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), lists.alias("sections"))
    own = bool(sections)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            owner, number, names, bounds, tokens, crossing, totals = [], [], [], [], [], [], []
            given = batch.column("sections").to_pylist() if own else [None] * batch.num_rows
            for i, (body, spans) in enumerate(zip(batch.column("text").to_pylist(), given, strict=True)):
                body = body or ""
                if own:
                    spans = spans or []
                    low = [min(max(s["start"] or 0, 0), len(body)) if s else 0 for s in spans]
                    high = [min(max(s["end"] if s["end"] is not None else len(body), 0), len(body)) if s else 0 for s in spans]
                    names += [s and s["name"] for s in spans]
                else:
                    low, high = line_sections(body)
                    names += [None] * len(low)
                low, high = np.array(low, np.int64), np.array(high, np.int64)
                start, end = encoder.spans(body)
                part, over = attribute(start, end, low, high, rule)
                owner.append(np.full(len(low), i))
                number.append(np.arange(len(low)))
                bounds.append(np.stack((low, high), axis=1))
                tokens.append(part)
                crossing.append(over)
                totals.append(np.full(len(low), len(start)))
            if owner:
                join, span = np.concatenate, np.concatenate(bounds)
                arrays = [batch.column("doc_id").take(pa.array(join(owner))), pa.array(join(number), pa.int32()), pa.array(names, pa.string()), pa.array(span[:, 0].copy()), pa.array(span[:, 1].copy()), pa.array(join(tokens), pa.float64()), pa.array(join(crossing), pa.int64()), pa.array(join(totals), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "section", "name", "start", "end", "tokens", "crossing", "doc_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, section int, name string, start long, end long, tokens double, crossing long, doc_tokens long")
