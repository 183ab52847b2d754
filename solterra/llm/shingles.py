"""Word shingles of Arrow text columns as 64-bit hashes, computed for many rows at once.

A word's hash is a polynomial over a table of random values, one for each byte, taken from a running sum over the
bytes of all rows; A-Z share the values of a-z. Nothing is done once per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import SPACES

#: Bytes taken at once; longer texts are cut between words.
CHUNK = 1 << 16
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_STEP = 0x2545F4914F6CDD1D
_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _values() -> np.ndarray:
    v = mixed(np.arange(1, 257, dtype=np.uint64) * _MULT[0])
    v[65:91] = v[97:123]
    return v


_VALUE = _values()
_power = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of the step and of its inverse mod 2**64."""
    if len(_power["up"]) < n:
        size = max(n, 2 * len(_power["up"]), CHUNK + 1)
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _power[name] = np.cumprod(p, dtype=np.uint64)
    return _power["up"], _power["down"]


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that stand one after another in data, and how many each text has."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    ink = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[0] = True
    cut[ends] = True
    before = np.concatenate([[False], ink[:-1]])
    after = np.concatenate([ink[1:], [False]])
    first = np.flatnonzero(ink & (~before | cut[:-1]))
    last = np.flatnonzero(ink & (~after | cut[1:]))
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
    h = (total[last + 1] - total[first]) * down[first]
    # the length tells runs apart that a sum of values alone could not
    h = mixed(h + (last - first).astype(np.uint64) * _MULT[1])
    return h, np.diff(np.searchsorted(first, ends), prepend=0)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about CHUNK bytes, cut at white space."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and not _SPACE[data[end]]:
            gap = np.flatnonzero(_SPACE[data[end : end + CHUNK]])
            end += int(gap[0]) if len(gap) else CHUNK
        yield data[at:end]
        at = end


def word_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows: the hashes of their words, and each row's number of words (null: none)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null("").cast(pa.large_binary())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        if len(part) > CHUNK:  # one row
            h = np.concatenate([_words(p, np.array([len(p)]))[0] for p in _pieces(part)])
            yield h, np.array([len(h)])
        else:
            yield _words(part, offsets[lo + 1 : hi + 1] - offsets[lo])
        lo = hi


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles.

    Fewer than n words are one shingle; no word, or null, is the empty set.
    """
    mult = _MULT[np.arange(n) % len(_MULT)] + np.arange(n, dtype=np.uint64) // np.uint64(len(_MULT)) * np.uint64(2)
    for h, sizes in word_hashes(column):
        if len(h) >= n:
            rolled = h[: len(h) - n + 1] * mult[0]
            for j in range(1, n):
                rolled += h[j : len(h) - n + 1 + j] * mult[j]
            rolled = mixed(rolled + np.uint64(n))
        at = 0
        for size in sizes.tolist():
            if size >= n:
                s = np.sort(rolled[at : at + size - n + 1])
                if len(s) > 1:
                    new = s[1:] != s[:-1]
                    if not new.all():
                        s = s[np.concatenate([[True], new])]
                yield s
            elif size:
                with np.errstate(over="ignore"):
                    yield mixed(np.array([(h[at : at + size] * mult[:size]).sum() + np.uint64(size)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += size
