"""Words, lines and their codes for a slice of texts, found on the texts' joined bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from tapeloom.llm.batches import strings

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the offset of every text in them."""
    texts = strings(column)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def encoded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the byte strings that ``at`` cuts ``raw`` into, and the distinct strings."""
    if len(at) < 2:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    cut = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]
    )
    found = cut.dictionary_encode()
    return np.asarray(found.indices).astype(np.int64), found.dictionary


@dataclass
class Words:
    codes: np.ndarray  # of every word, text after text
    distinct: pa.Array
    counts: np.ndarray  # words per text
    starts: np.ndarray  # offsets of their first bytes

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words(raw: np.ndarray, at: np.ndarray, lower: bool = False, blank: np.ndarray = SPACE) -> Words:
    """Runs of bytes other than those of ``blank`` (space and \\t to \\r); ``lower`` lowers A-Z."""
    solid = ~blank[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    starts = at[:-1][at[:-1] < at[1:]]
    begins[starts] = solid[starts]
    place = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(place, at))
    before = np.cumsum(solid)
    kept = raw[solid]
    codes, distinct = encoded(LOWER[kept] if lower else kept, np.append(before[place] - 1, len(kept)))
    return Words(codes, distinct, counts, place)


def totals(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between the offsets ``at``."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[at])


def hashes(distinct: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def windows(values: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every ``size`` consecutive values within a text, and the index of their first value."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.repeat(np.cumsum(counts), counts)
    first = np.flatnonzero(np.arange(n) + size <= ends[:n])
    out = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = mixed(out + values[first + j] + np.uint64(0x9E3779B97F4A7C15))
    return out, first
