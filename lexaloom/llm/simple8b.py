"""Simple-8b word-aligned coding of token ids, vectorised over blocks.

A 64-bit word has a 4-bit selector in its top bits and 60 bits of payload, in
which the selector says how many values of how many bits lie, lowest first.
Selector 0 is the escape: its payload numbers an entry of a side table of raw
64-bit values. A block restarts the coding, so blocks decode independently;
its last word may be filled up with zeros that the block's count cuts off.

A file (all little-endian 64-bit unsigned numbers):
    magic, documents, values, blocks, words, escapes,
    document ids, document lengths, block offsets in words, words, escaped values.
"""

from __future__ import annotations

import numpy as np

#: How many values of how many bits a word of each selector holds (0 is the escape).
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
#: Values of a block.
BLOCK = 512
MAGIC = 0x31_42_38_53_4D_4F_4F_4C  # "LOOMS8B1"
_HEADER = 6


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, block offsets (in words) and escaped values of unsigned 64-bit ``values``."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        none = np.zeros(0, np.uint64)
        return none, none, none
    blocks = -(-n // block)
    wide = values >= np.uint64(1) << np.uint64(60)
    table = values[wide]
    number = np.cumsum(wide) - 1
    plain = np.where(wide, np.uint64(0), values)
    length = np.minimum(np.frexp(plain.astype(np.float64))[1], 60).astype(np.uint8)
    length[wide] = 64
    places = np.arange(n, dtype=np.int32)
    left = np.minimum((places // block + 1) * block, n) - places
    # for every place the selector that holds most values from there on; better ones overwrite
    best, takes = np.zeros(n, np.int8), np.ones(n, np.int32)
    # without escapes, no selector beyond the first that holds every value is ever better
    enough = len(BITS) - 1 if len(table) else int(np.argmax(BITS[1:] >= length.max())) + 1
    for s in range(enough, 0, -1):
        fits = length <= BITS[s]
        some = int(np.count_nonzero(fits))
        if some > n // 4:
            own, reach, most = slice(None), np.minimum.accumulate(np.where(fits, np.int32(n), places)[::-1])[::-1] - places, left
        else:  # few values are that short: only their runs are looked at
            own = np.flatnonzero(fits)
            ends = np.flatnonzero(np.diff(own, append=n + 1) != 1)
            reach = np.repeat(own[ends] + 1, np.diff(ends, prepend=-1)) - own
            most = left[own]
        fit = np.minimum(most, np.int32(COUNTS[s]))
        good = reach >= fit
        if isinstance(own, slice):
            np.copyto(best, np.int8(s), where=good)
            np.copyto(takes, fit, where=good)
        else:
            best[own[good]], takes[own[good]] = s, fit[good]
    stop = np.minimum((np.arange(blocks) + 1) * block, n)
    at, owner = np.arange(blocks) * block, np.arange(blocks)
    heads, owners = [], []
    while len(at):
        heads.append(at)
        owners.append(owner)
        at = at + takes[at]
        alive = at < stop[owner]
        at, owner = at[alive], owner[alive]
    head, owner = np.concatenate(heads), np.concatenate(owners)
    selector, take = best[head].astype(np.int64), takes[head].astype(np.int64)
    order = np.argsort(head, kind="stable")
    head, selector, take, owner = head[order], selector[order], take[order], owner[order]
    word = selector.astype(np.uint64) << np.uint64(60)
    for k in range(int(COUNTS.max())):
        own = np.flatnonzero((take > k) & (BITS[selector] > 0))
        if not len(own):
            break
        word[own] |= plain[head[own] + k] << (BITS[selector[own]] * k).astype(np.uint64)
    escaped = selector == 0
    word[escaped] = number[head[escaped]].astype(np.uint64)
    return word, np.searchsorted(owner, np.arange(blocks)).astype(np.uint64), table


def decode(words: np.ndarray, offsets: np.ndarray, table: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """All ``n`` values; slices of whole blocks may be decoded alone."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    payload = words & np.uint64((1 << 60) - 1)
    take = COUNTS[selector]
    # the last word of each block is cut to what the block still holds
    sizes = np.minimum(block, n - np.arange(len(offsets)) * block)
    sums = np.add.reduceat(take, offsets.astype(np.int64))
    last = np.append(offsets[1:], len(words)).astype(np.int64) - 1
    take = take.copy()
    take[last] -= sums - sizes
    which = np.repeat(np.arange(len(words)), take)
    k = np.arange(n) - np.repeat(np.cumsum(take) - take, take)
    bits = BITS[selector[which]].astype(np.uint64)
    out = (payload[which] >> (bits * k.astype(np.uint64))) & ((np.uint64(1) << bits) - np.uint64(1))
    raw = selector[which] == 0
    if raw.any():
        out[raw] = table[payload[which[raw]].astype(np.int64)]
    return out


def write_file(doc_ids: np.ndarray, counts: np.ndarray, values: np.ndarray) -> bytes:
    words, offsets, table = encode(values)
    header = np.array([MAGIC, len(doc_ids), len(values), len(offsets), len(words), len(table)], np.uint64)
    parts = (header, np.asarray(doc_ids, np.int64).view(np.uint64), np.asarray(counts, np.uint64), offsets, words, table)
    return b"".join(p.astype("<u8").tobytes() for p in parts)


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their numbers of values, and all values."""
    numbers = np.frombuffer(data, "<u8").astype(np.uint64, copy=False)
    magic, docs, n, blocks, words, escapes = map(int, numbers[:_HEADER])
    if magic != MAGIC or len(numbers) != _HEADER + 2 * docs + blocks + words + escapes:
        raise ValueError("not a file of this format")
    bounds = np.cumsum([_HEADER, docs, docs, blocks, words, escapes])
    doc_ids, counts, offsets, word, table = (numbers[a:b] for a, b in zip(bounds, bounds[1:], strict=False))
    return doc_ids.view(np.int64), counts.astype(np.int64), decode(word, offsets, table, n)
