"""Words of whole texts and hashes of word sequences, for many texts at once.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes, unchanged. A word is its 64-bit hash: a polynomial over its bytes, or xxh3 beyond
``LONG`` bytes, where polynomials modulo a power of two can be made to collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LONG = 64
BASE = 0xD6E8FEB86659FD93
#: Bytes of text that are worked on at once; for portions(), one text may be larger.
PORTION = 1 << 20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(64).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(64)
def _factors(count: int, lane: int) -> np.ndarray:
    return np.random.default_rng((count, lane)).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(2)
def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """Words of texts behind one another; text k has the words first[k] to first[k + 1]."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """Which text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def joined(self, k: int, keep: np.ndarray | None = None) -> bytes:
        """The words of text k, of which keep (for all words) says so, with one space between."""
        i, j = self.first[k], self.first[k + 1]
        starts, ends = self.starts[i:j], self.ends[i:j]
        if keep is not None:
            starts, ends = starts[keep[i:j]], ends[keep[i:j]]
        if not len(starts):
            return b""
        new = np.flatnonzero(starts[1:] - ends[:-1] != 1) + 1  # words behind something else than one blank
        pieces = zip(starts[np.concatenate(([0], new))].tolist(), ends[np.concatenate((new, [len(ends)])) - 1].tolist(), strict=True)
        return b" ".join(self.data[x:y].translate(_BLANK) for x, y in pieces)


_BLANK = bytes(0x20 if SPACE[b] else b for b in range(256))


def words_of(texts: list[bytes | None]) -> Words:
    data = b" ".join(x or b"" for x in texts) + b" "
    each = np.frombuffer(data, np.uint8)
    edge = np.diff((~SPACE[each]).astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.concatenate(([0], np.cumsum([len(x or b"") + 1 for x in texts]))).astype(np.int64)
    return Words(data, starts, ends, np.searchsorted(starts, begins), _hashes(data, each, starts, ends))


def _hashes(data: bytes, each: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A portion at a time; longer words come last, alone."""
    out, at = np.empty(len(starts), np.uint64), 0
    up, down = _powers(BASE, PORTION + LONG), _powers(pow(BASE, -1, 1 << 64), PORTION + LONG)
    lengths = (ends - starts).astype(np.uint64)
    while at < len(starts):
        to = int(np.searchsorted(starts, starts[at] + PORTION))
        begin = starts[at]
        i, j = starts[at:to] - begin, np.minimum(ends[at:to], starts[at:to] + LONG) - begin
        total = np.zeros(j[-1] + 1, np.uint64)
        np.cumsum(_byte_values()[each[begin : begin + j[-1]]] * up[: j[-1]], out=total[1:])
        out[at:to] = mix((total[j] - total[i]) * down[i] + lengths[at:to])
        at = to
    for k in np.flatnonzero(lengths > LONG):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def grams(hashes: np.ndarray, count: int, lane: int = 0) -> np.ndarray:
    """A hash of each ``count`` consecutive words: a multilinear function of theirs, mixed."""
    n = max(len(hashes) - count + 1, 0)
    out = np.full(n, count, np.uint64)
    for k, factor in enumerate(_factors(count, lane)):
        out += hashes[k : k + n] * factor
    return mix(out)


def inside(first: np.ndarray, count: int) -> np.ndarray:
    """Whether ``count`` words from each word on belong to the same text, for every word."""
    n = first[-1]
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + count <= ends


def portions(batches: Iterator[pa.RecordBatch], column: int, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Batches of which the column holds at most so many bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, held = 0, 0
        for k, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            if k > at and held + n > size:
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += n
        yield batch.slice(at)
