"""Word shingles of whole texts as sets of 64-bit hashes, many documents at a time."""

from __future__ import annotations

import numpy as np

from .common import mix64, ragged

_RNG = np.random.default_rng(20240607)
#: A random odd 64-bit number for each byte value, upper-case ASCII as lower case.
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words `[^\\x20\\x09-\\x0D]+` of all rows start and stop, and how many each row has."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1])))
    ends = inside & (edge[1:] | np.concatenate((~inside[1:], [True])))
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.diff(np.searchsorted(starts, offsets))


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes, A-Z taken as lower case."""
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * _powers(_BASE, len(raw)), out=prefix[1:])
    return mix64((prefix[stops] - prefix[starts]) * _powers(_INVERSE, len(raw) + 1)[starts])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, in order, and how many each row has."""
    starts, stops, counts = spans(raw, offsets)
    return span_hashes(raw, starts, stops), counts


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of ``size`` words of each row, ascending within
    the row, and how many each row has. A row of fewer words, but at least one,
    has one: its whole sequence."""
    hashes, counts = words(raw, offsets)
    ends = np.cumsum(counts)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = ragged(ends - counts, runs)
    width = np.repeat(np.minimum(counts, size), runs)
    mixed = width.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            more = width > k
            at = np.minimum(first + k, max(len(hashes) - 1, 0))
            mixed = np.where(more, mix64(mixed * _BASE + hashes[at]), mixed) if len(hashes) else mixed
    row = np.repeat(np.arange(len(runs)), runs)
    order = np.lexsort((mixed, row)) if len(runs) > 1 else np.argsort(mixed, kind="stable")
    mixed, row = mixed[order], row[order]
    fresh = np.ones(len(mixed), bool)
    fresh[1:] = (mixed[1:] != mixed[:-1]) | (row[1:] != row[:-1])
    return mixed[fresh], np.bincount(row[fresh], minlength=len(runs)).astype(np.int64)
