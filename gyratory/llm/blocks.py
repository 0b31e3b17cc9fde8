"""Documents of an Arrow batch as byte blocks, and their words as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_MASK = (1 << 64) - 1
_PIECE = 1 << 18

#: Bytes of words: ASCII digits and letters after lower-casing, and every byte of a character beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
#: Bytes of words that end at ASCII white space.
SOLID_BYTES = np.ones(256, bool)
SOLID_BYTES[0x09:0x0E] = SOLID_BYTES[0x20] = False


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def cut(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about that many bytes each; one longer text makes a range of its own."""
    return _ranges(map(len, texts), limit)


def _ranges(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    start = size = stop = 0
    for stop, own in enumerate(sizes, 1):
        if size and size + own > limit:
            yield start, stop - 1
            start, size = stop - 1, 0
        size += own
    if start < stop:
        yield start, stop


def pieces(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices as `cut` has them, without a copy of the batch."""
    for start, stop in _ranges(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist(), limit):
        yield batch.slice(start, stop - start)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of some texts: `doc` (row), `start` and `end` (bytes in `data`), in order of the text."""

    def __init__(self, texts: list[bytes], letters: np.ndarray = WORD_BYTES):
        self.data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)  # lower() of bytes changes A-Z only
        self.first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])).astype(np.int64) if texts else np.zeros(0, np.int64)
        inside = letters[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.first, self.start, "right") - 1

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of every word (or of the given byte ranges, ordered by start), piece by piece."""
        start, end = self.start if start is None else start, self.end if end is None else end
        out = np.zeros(len(start), np.uint64)
        longest = int((end - start).max()) if len(start) else 0
        size = _PIECE + longest + 1
        up, down = _powers(size, _R), _powers(size, pow(_R, -1, 1 << 64))
        i = 0
        while i < len(start):
            base = int(start[i])
            j = int(np.searchsorted(start, base + _PIECE, "left"))
            stop = int(end[i:j].max())
            piece = self.data[base:stop].astype(np.uint64) + np.uint64(1)
            piece *= up[: len(piece)]
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece, out=total[1:])
            s, e = start[i:j] - base, end[i:j] - base
            out[i:j] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
