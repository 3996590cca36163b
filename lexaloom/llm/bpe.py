"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up all pairs of
neighbours by binary search over the sorted keys of the merge table, takes in
every word the pair of the lowest rank, and merges it wherever it stands.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ragged

#: The pattern that splits a text before the merges, as published with the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose ids a worker keeps; beyond, it starts anew.
CACHED_WORDS = 800_000
_NONE = np.int64(1) << 40
_LONG_SPACE = re.compile(r"\s\s")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself
    where it is printable Latin-1, else the next character from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """A vocabulary file of the tokenizers library with byte-level pre-tokenising."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        table = [b""] * size
        for token, i in vocab.items():
            table[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            table[i] = token.encode()
        self.token_lengths = np.array([len(t) for t in table], np.int64)
        self.token_starts = np.concatenate(([0], np.cumsum(self.token_lengths)[:-1]))
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.splitter = regex.compile(WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.after_blank: dict[str, int] = {}
        self.flat = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.shown: list[str] = []
        for token, i in self.special.items():
            self.known[token] = len(self.known)
            self._keep(np.array([i], np.int64), np.array([1], np.int64))

    def _keep(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.flat, self.counts = np.concatenate((self.flat, flat)), np.concatenate((self.counts, counts))
        digits = list(map(str, flat.tolist()))
        ends = np.cumsum(counts).tolist()
        self.shown += [",".join(digits[e - c : e]) for e, c in zip(ends, counts.tolist(), strict=True)]

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        encoded = [w.encode() for w in words]
        lengths = np.array([len(e) for e in encoded], np.int64)
        symbols = self.first[np.frombuffer(b"".join(encoded), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            key = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(hit, self.ranks[at], _NONE), _NONE)
            begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.append(begins, len(word)))
            least = np.repeat(best, sizes)
            over = least == _NONE
            if over.any():  # words without a pair left
                done_symbols.append(symbols[over])
                done_words.append(word[over])
            chosen = np.flatnonzero((rank == least) & ~over)
            if len(chosen):
                # of overlapping occurrences every second one, from the left
                starts = np.concatenate(([True], chosen[1:] != chosen[:-1] + 1))
                run = np.maximum.accumulate(np.where(starts, np.arange(len(chosen)), 0))
                chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            symbols = symbols.copy()
            symbols[chosen] = self.made[at[chosen]]
            stay = ~over
            stay[chosen + 1] = False
            symbols, word = symbols[stay], word[stay]
        if not done_symbols:
            return np.zeros(0, np.int64), lengths
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words)).astype(np.int64)

    def _fallback(self, text: str) -> list[str]:
        """Pieces of a text whose blanks don't all stand between two words, or that holds a special token."""
        parts = self.specials.split(text) if self.specials is not None else [text]
        return [w for part in parts for w in ([part] if part in self.special else self.splitter.findall(part))]

    def _learn(self, fresh: list[str]) -> None:
        """Adds the ids of stretches of text that the pattern may split further."""
        pieces = [self.splitter.findall(w) for w in fresh]
        counts = np.array([len(p) for p in pieces], np.int64)
        flat, sizes = self.merge_words([w for own in pieces for w in own])
        running = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.cumsum(counts)
        base = len(self.counts)
        self._keep(flat, running[ends] - running[ends - counts])
        self.known.update(zip(fresh, range(base, base + len(fresh)), strict=True))

    def word_codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cache numbers of stretches of all texts, and how many each text has.

        A single blank between two other characters always begins a piece of the
        pattern, so texts without longer white space are cut there first and
        only distinct stretches go through the pattern."""
        if len(self.known) > CACHED_WORDS:
            self._forget()
        split = []
        for text in texts:
            if _LONG_SPACE.search(text) or any(s in text for s in self.special):
                split.append((None, self._fallback(text)))
            else:
                head, *rest = text.split(" ")
                split.append((head, rest))
        known, after = self.known, self.after_blank
        fresh = {w for head, own in split if head is None for w in own if w not in known}
        fresh |= {head for head, _ in split if head and head not in known}
        spaced = {w for head, own in split if head is not None for w in own if w not in after}
        fresh |= {w for s in spaced if (w := f" {s}") not in known}
        if fresh:
            self._learn(sorted(fresh))
        after.update((s, known[f" {s}"]) for s in spaced)
        codes, counts = [], []
        for head, own in split:
            if head is None:
                new = [known[w] for w in own]
            else:
                new = [known[head]] if head else []
                new += [after[w] for w in own]
            counts.append(len(new))
            codes += new
        return np.array(codes, np.int64), np.array(counts, np.int64)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The ids of all texts one after the other, how many each has, and each text's ids joined by commas."""
        codes, words = self.word_codes(texts)
        starts = np.cumsum(self.counts) - self.counts
        ids = self.flat[ragged(starts[codes], self.counts[codes])]
        ends = np.cumsum(words)
        running = np.concatenate(([0], np.cumsum(self.counts[codes])))
        shown, plain = self.shown, codes.tolist()
        joined = [",".join([shown[c] for c in plain[e - n : e] if shown[c]]) for e, n in zip(ends.tolist(), words.tolist(), strict=True)]
        return ids, running[ends] - running[ends - words], joined

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        lengths = self.token_lengths[ids]
        raw = self.token_bytes[ragged(self.token_starts[ids], lengths)].tobytes()
        running = np.concatenate(([0], np.cumsum(lengths)))
        ends = np.cumsum(counts)
        bounds = zip(running[ends - counts].tolist(), running[ends].tolist(), strict=True)
        return [raw[a:b].decode("utf-8", "replace") for a, b in bounds]


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One vocabulary per worker process."""
    return ByteBpe(path)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids
    joined by commas) and decoded_sha256 (of the text decoded from the ids).

    vocabulary: path of a byte-level BPE file, present on every executor. Null and empty texts have no ids; an empty table gives no rows; repeated rows and null ids
    are kept. Columns of ``docs`` other than the two named are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocabulary)
        for batch in batches:
            for part in chunks(batch, "text", 4_000_000):
                ids, counts, joined = coder.encode_batch(pc.fill_null(part.column("text"), "").to_numpy(zero_copy_only=False).tolist())
                decoded = coder.decode_batch(ids, counts)
                sha = lambda texts: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), sha(joined), sha(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
