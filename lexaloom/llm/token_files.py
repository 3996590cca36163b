"""Token-id output: documents become Simple-8b files in ascending document order.

The files are the binary cells of a Parquet table in the shared folder, so they
can live in any store that Spark writes to and are written by its committer.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import chunks, kept_between_tasks, materialize, ragged, range_split, shuffle_partitions
from .simple8b import read_file, write_file

#: A file is closed when it has this many ids; a longer document has a file of its own.
FILE_IDS = 1 << 20
#: Distinct words whose ids a worker keeps; beyond, it starts anew.
CACHED_WORDS = 1_000_000
_SPECIAL = "<|"
# Where the tokenizer's pattern cuts lower-cased text besides between letters and other characters.
_PIECES = r"('(?:s|t|re|ve|m|ll|d)|\pN|[^\s\pL\pN]+)"
#: What a word of visible characters below U+0300, but for the capital I with a dot, doesn't have.
_UNCOMMON = r"[^\x21-\x7E\x{A1}-\x{12F}\x{131}-\x{2FF}]|<\|"


class WordCache:
    """Ids of texts by a tokenizer that drops white space, so that a text's ids
    are its words' ids one after the other; each distinct word is encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = dict(enumerate(byte_letters()))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has.

        Words of common characters, which no normal form changes, are cut into
        pieces as the tokenizer's pattern cuts them; of these, only distinct ones
        go to the tokenizer's model. Any other word goes through the whole tokenizer."""
        odd = np.asarray(pc.match_substring_regex(words, _UNCOMMON).to_numpy(zero_copy_only=False), bool)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.filter(pa.array(~odd))), _PIECES, r" \1 "))
        coded = lists.flatten().dictionary_encode()
        model, letters = self.tokenizer.model, self.letters
        shown = [t if t.isascii() else t.encode().decode("latin-1").translate(letters) for t in coded.dictionary.to_pylist()]
        found = [[t.id for t in model.tokenize(piece)] for piece in shown]
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(words.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)] if odd.any() else []

        flat_of = lambda ids: np.fromiter((i for own in ids for i in own), np.uint32)
        sizes_of = lambda ids: np.fromiter(map(len, ids), np.int64, len(ids))
        sizes, codes = sizes_of(found), np.asarray(coded.indices, np.int64)
        plain = flat_of(found)[ragged((np.cumsum(sizes) - sizes)[codes], sizes[codes])]
        running = np.concatenate(([0], np.cumsum(sizes[codes])))
        ends = np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))
        counts = np.empty(len(words), np.int64)
        counts[~odd] = running[ends] - running[np.concatenate(([0], ends[:-1]))] if len(ends) else 0
        counts[odd] = sizes_of(whole)
        owner = np.repeat(odd, counts)
        flat = np.empty(len(owner), np.uint32)
        flat[~owner], flat[owner] = plain, flat_of(whole)
        return flat, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, _SPECIAL)).as_py():
            texts = pc.ascii_lower(texts)  # as the tokenizer does, but for the names of special tokens
        lists = pc.ascii_split_whitespace(texts)
        per_text = np.asarray(pc.list_value_length(lists), np.int64)
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(names) > CACHED_WORDS:
            self._forget()
        own = np.fromiter((self.known.get(w, -1) for w in names), np.int64, len(names))
        fresh = np.flatnonzero(own < 0)
        if len(fresh):
            flat, counts = self._learn(coded.dictionary.take(pa.array(fresh)))
            own[fresh] = np.arange(len(self.counts), len(self.counts) + len(fresh))
            self.known.update((names[i], n) for i, n in zip(fresh.tolist(), own[fresh].tolist(), strict=True))
            self.counts = np.concatenate((self.counts, counts))
            self.flat = np.concatenate((self.flat, flat))
        starts = np.cumsum(self.counts) - self.counts
        codes = own[np.asarray(coded.indices)] if len(names) else np.zeros(0, np.int64)
        sizes = self.counts[codes]
        ids = self.flat[ragged(starts[codes], sizes)]
        running = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.cumsum(per_text)
        return ids, running[ends] - running[ends - per_text]


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordCache:
    """One vocabulary per worker process."""
    return WordCache(path)


kept_between_tasks(load.cache_clear)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written files: part, file (number within the part), start (ids before
    it within the part), n_ids, unnamed (its documents have null ids), data. Parts, files and the documents inside
    ascend by document id; equal ids are ordered by text, null ids come first.

    vocabulary: path of a tokenizer file whose splitting drops white space, present on every executor."""
    parts = shuffle_partitions(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = slim.withColumn("part", range_split(slim, "doc_id", parts)).repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocabulary)
        part, number, start, held_null = 0, 0, 0, False
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal number, start
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [[part], [number], [start], [len(ids)], [held_null], [write_file(doc_ids, counts, ids)]]
            number, start = number + 1, start + len(ids)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["part", "file", "start", "n_ids", "unnamed", "data"])

        for batch in batches:
            for piece in chunks(batch, "text", 4_000_000):
                part = piece.column("part")[0].as_py()
                ids, counts = coder.encode(piece.column("text"))
                with_end = np.full(len(ids) + len(counts), end_id, np.uint32)
                with_end[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                named = piece.column("doc_id")
                # null ids come first; a file tells how many of its documents have none
                for null in (True, False):
                    own = np.asarray(named.is_null()) == null
                    if own.any() and held and held_null != null:
                        yield close()
                    if own.any():
                        held_null = null
                        held.append((np.asarray(named.fill_null(0), np.int64)[own], counts[own] + 1, with_end[np.repeat(own, counts + 1)] if not own.all() else with_end))
                if sum(len(h[2]) for h in held) >= FILE_IDS:
                    yield close()
        if held:
            yield close()

    return materialize(dealt.mapInArrow(run, "part int, file int, start long, n_ids long, unnamed boolean, data binary"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    start counts the ids of all documents before it in all files. Only one number
    per part comes to the driver."""
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    bases = [0, *accumulate(n for _, n in sums)][: len(sums)]
    base = files.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sums, bases, strict=True)], "part int, base long")
    placed = files.join(F.broadcast(base), "part").select((F.col("base") + F.col("start")).alias("start"), "unnamed", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, unnamed, data in zip(batch.column("start").to_pylist(), batch.column("unnamed").to_pylist(), batch.column("data"), strict=True):
                doc_ids, counts, values = read_file(data.as_buffer())
                raw = memoryview(values.astype("<u4").tobytes())
                ends = np.cumsum(counts)
                sums = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(doc_ids), pa.int64()) if unnamed else pa.array(doc_ids), pa.array(start + ends - counts), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, vocabulary: str, end_id: int = 1, **columns) -> DataFrame:
    """One row per row of ``docs``, from files that were written and read back:
    doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers).

    Null and empty texts have the end id alone; repeated rows are written each;
    null ids come first and stay null; an empty table gives no rows. Other columns of ``docs`` are not looked at."""
    return read_token_files(write_token_files(docs, vocabulary, end_id, **columns))
