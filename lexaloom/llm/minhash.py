"""MinHash near-duplicate detection.

SuperMinHash signatures (each element spreads correlated ranks 0, 1, 2, ...
over the registers in its own random order, stopping as soon as no register
can fall any more), banding, verification of the candidates on their full
shingle sets, and union-find grouping.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import chunks, key_filter, lighten, materialize, maybe_in, mix64, only_rows, ragged, range_split, release, row_key, shuffle_partitions, utf8
from .components import Sets, bucket_components
from .shingles import shingle_sets

#: Registers of a signature; bands of ROWS registers each. A pair of similarity
#: 0.8 misses all bands with probability (1 - 0.8**4)**32, about 5e-8.
REGISTERS, ROWS = 128, 4
#: A sketch rules out candidates before their texts are fetched: the elements of
#: a set are dealt to BINS by hash, and three bits of the least of each bin are
#: kept, and which bins have any. Bins that differ count elements that differ;
#: a candidate goes if they are DEVIATIONS standard deviations too many.
BINS, PLANES, DEVIATIONS = 512, 4, 4.5
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _step(k: int) -> np.uint64:
    return np.uint64(k * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def super_minhash(sets: np.ndarray, counts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """One row of ``registers`` 64-bit ranks per set. sets: the sets' elements
    one set after the other; counts: how many each has.

    Round j gives each element's j-th register the rank j plus a random
    fraction; a set leaves the rounds when all its registers are below j."""
    rows = len(counts)
    out = np.full((rows, registers), np.iinfo(np.uint64).max, np.uint64)
    element, owner = sets, np.repeat(np.arange(rows), counts)
    order = None
    for j in range(registers):
        if not len(element):
            break
        draw = mix64(element + _step(2 * j + 1))
        swap = j + (mix64(element + _step(2 * j + 2)) % np.uint64(registers - j)).astype(np.int64)
        if j == 0:
            place = swap
            touched = [swap]
        else:
            if order is None:
                order = np.broadcast_to(np.arange(registers, dtype=np.uint8), (len(element), registers)).copy()
                order[np.arange(len(element)), touched[0]] = 0
                order[:, 0] = touched[0]
            here = np.arange(len(element))
            place = order[here, swap].astype(np.int64)
            order[here, swap] = order[:, j]
            order[:, j] = place
        rank = (np.uint64(j) << np.uint64(56)) | (draw >> np.uint64(8))
        np.minimum.at(out.reshape(-1), owner * registers + place, rank)
        bound = (np.uint64(j + 1)) << np.uint64(56)
        stay = (out.max(axis=1) >= bound)[owner]
        if not stay.all():
            element, owner = element[stay], owner[stay]
            if j == 0:
                touched = [swap[stay]]
            else:
                order = order[stay]
    return out


def _sketch(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each set: PLANES planes of BINS bits (the first: filled bins), then its size."""
    rows = len(counts)
    empty = np.iinfo(np.uint64).max
    least = np.full(rows * BINS, empty, np.uint64)
    value = mix64(sets ^ _GOLDEN) >> np.uint64(1)
    np.minimum.at(least, np.repeat(np.arange(rows), counts) * BINS + (sets >> np.uint64(64 - 9)).astype(np.int64), value)
    least = least.reshape(rows, BINS)
    filled = least != empty
    planes = [filled, *(filled & ((least >> np.uint64(k)) & np.uint64(1)).astype(bool) for k in range(PLANES - 1))]
    bits = np.concatenate([np.packbits(p, axis=1) for p in planes], axis=1)
    return np.concatenate((np.ascontiguousarray(bits).view(np.int64), counts[:, None]), axis=1)


def likely(percent: int):
    """Whether two sketches may be of sets of that similarity."""

    def near(a: Column, b: Column) -> Column:
        words = BINS // 64
        add = lambda parts: functools.reduce(lambda x, y: x + y, parts)
        differ = add(F.bit_count(functools.reduce(lambda x, y: x.bitwiseOR(y), [a[k * words + w].bitwiseXOR(b[k * words + w]) for k in range(PLANES)])) for w in range(words))
        filled = add(F.bit_count(a[w].bitwiseOR(b[w])) for w in range(words))
        share = 1 - percent / 100
        # the least of a bin is drawn from the bin's elements without replacement
        union = (a[PLANES * words] + b[PLANES * words]) / (1 + percent / 100)
        rest = F.greatest(F.lit(0.02), 1 - filled / union)
        likely_few = differ <= share * filled + DEVIATIONS * F.sqrt(filled * (share * (1 - share)) * rest) + 2
        # and each bin that differs has an element that only one set has, which sets of few elements can't have many of
        both = a[PLANES * words] + b[PLANES * words]
        return ((100 - percent) * both >= (100 + percent) * differ) & likely_few

    return near


_SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>"


def _sign(size: int):
    """doc_id, text -> doc_id, n_shingles, two hashes of the whole set, a hash for each band, a sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for batch in batches:
            for part in chunks(batch, "text", 1_000_000):
                sets, counts = shingle_sets(*utf8(part.column("text")), size)
                ends = np.concatenate(([0], np.cumsum(counts)))
                sums = [np.concatenate(([0], np.cumsum(mix64(sets + np.uint64(k))))).astype(np.uint64) for k in (1, 2)]
                finger = [mix64(s[ends[1:]] - s[ends[:-1]] + counts.astype(np.uint64)).view(np.int64) for s in sums]
                ranks = super_minhash(sets, counts)
                bands = ranks.reshape(len(counts), -1, ROWS)
                key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
                for k in range(ROWS):
                    key = mix64(key * _GOLDEN + bands[:, :, k])
                lists = lambda x: pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * x.shape[1], pa.array(x.reshape(-1)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), *map(pa.array, finger), lists(key.view(np.int64)), lists(_sketch(sets, counts))], ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"])

    return run


def _verify(size: int, percent: int):
    """Pairs with both texts -> those whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text_b", 1_000_000):
                n = part.num_rows
                # texts of one side are often all the same hub: each distinct text is shingled once
                texts = pa.concat_arrays([part.column("text_a"), part.column("text_b")]).dictionary_encode()
                sets, counts = shingle_sets(*utf8(texts.dictionary), size)
                ends = np.cumsum(counts)
                at = np.asarray(texts.indices)
                a, b = at[:n], at[n:]
                pair_of_a = np.repeat(np.arange(n), counts[a])
                in_a = sets[ragged(ends[a] - counts[a], counts[a])]
                pair_of_b = np.repeat(np.arange(n), counts[b])
                in_b = sets[ragged(ends[b] - counts[b], counts[b])]
                both, pair = np.concatenate((in_a, in_b)), np.concatenate((pair_of_a, pair_of_b))
                order = np.lexsort((both, pair))
                both, pair = both[order], pair[order]
                same = (both[1:] == both[:-1]) & (pair[1:] == pair[:-1])
                shared = np.bincount(pair[1:][same], minlength=n)
                union = counts[a] + counts[b] - shared
                good = pa.array((100 * shared >= percent * union) & (shared > 0))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], ["a", "b"])

    return run


def _elements(size: int):
    """doc_id, text -> doc_id, element: the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1_000_000):
                sets, counts = shingle_sets(*utf8(part.column("text")), size)
                owner = np.repeat(np.asarray(part.column("doc_id"), dtype=np.int64), counts)
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(sets.view(np.int64))], ["doc_id", "element"])

    return run


def _texts_of(texts: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The texts (doc_id, text) of the ids (k), and a few others that a bitmap lets through, so that the rest stays out of shuffles."""
    wanted = materialize(key_filter(ids), name)
    return texts.withColumnRenamed("doc_id", "k").where(maybe_in(wanted)).withColumnRenamed("k", "doc_id")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    pairs = materialize(pairs, "minhash-pairs")
    near = _texts_of(texts, pairs.select(F.col("a").alias("k")).union(pairs.select("b")), "minhash-filter")
    left = pairs.join(near.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    full = left.join(near.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(_verify(size, percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * shared >= similarity_percent * union of
    their sets of distinct word shingles; components are closed over links.

    - Copies of a set are one class, joined again at the end; only one member
      of a class takes part in the search.
    - A bucket of a band first links its members with its smallest member
      alone. Pairs inside a bucket follow only between what the first links
      left in different components and what can be alike by shingles that others
      have too, sizes and sketches, so a large group of copies costs one pair per member.
    - Every link is confirmed on the full sets (of 64-bit hashes of the words).
      A pair at exactly 80% misses all bands with probability 5e-8, and its sketches
      rule it out with probability 3.4e-6 (4.5 standard deviations); copies of
      a set are found by two 64-bit hashes of it. Closer pairs are lost less often.
    - An empty table gives no rows.
    - Null and blank texts: n_shingles 0, linked with nothing, kept. Repeated
      rows of one id appear once; where their texts differ, the smallest
      text stands for the id. A null id: left out. Other columns of ``docs``
      are not looked at."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    signed = materialize(texts.mapInArrow(_sign(shingle_words), _SIGNED), "minhash-signed")
    once = signed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if once:
        texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
        signed = materialize(texts.mapInArrow(_sign(shingle_words), _SIGNED), "minhash-signed")

    filled = signed.where("n_shingles > 0")
    classes = filled.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    placed = filled.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2"]).select("doc_id", "n_shingles", "rep")
    member = materialize(placed.union(signed.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id")), "minhash-member")
    reps = materialize(signed.where("n_shingles > 0").join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").select("doc_id", "n_shingles", "bands", "sketch"), "minhash-reps")
    release(signed)
    rows = reps.select("doc_id", F.explode("bands").alias("band"))
    elements = lambda some: _texts_of(texts, some.select(F.col("doc_id").alias("k")), "minhash-open-filter").join(some, "doc_id", "left_semi").mapInArrow(_elements(shingle_words), "doc_id long, element long")
    sets = Sets(similarity_percent, reps.select("doc_id", F.col("n_shingles").alias("n"), "sketch", "bands"), likely(similarity_percent), elements, REGISTERS // ROWS)
    groups = bucket_components(rows, lambda pairs: _confirmed(pairs, texts, shingle_words, similarity_percent), "minhash", sets)
    release(reps)
    whole = member.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return whole.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, keep_null_ids: bool = False, **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one of the smallest id.

    Where ids are repeated or null, every different pair of id and text is a
    document of its own: by id, those of null ids last, then by a hash of the
    text. Wholly equal ones stay or go together. Rows of null ids are left out
    unless ``keep_null_ids``."""
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    if not keep_null_ids:
        docs = docs.where(F.col(id_col).isNotNull())
    if not docs.groupBy(id_col).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull()).limit(1).count():
        kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("kept").select(F.col("doc_id").alias("kept_doc_id"))
        return docs.join(kept, docs[id_col] == kept["kept_doc_id"], "left_semi")
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    each = materialize(keyed.groupBy("key").agg(F.min("id").alias("id"), F.min("text").alias("text")), "minhash-documents")
    # ranges of ids, then blocks of the key's hash for null ids, so that no task numbers everything
    group = [F.col("id").isNull(), F.when(F.col("id").isNull(), F.shiftright("key.k1", 54).cast("int")).otherwise(range_split(each.where("id is not null"), "id", shuffle_partitions(docs.sparkSession)))]
    order = [F.asc_nulls_last("id"), F.asc("key")]
    own = materialize(numbered(each.select("key", "id"), group, order, "doc_id").select("key", "doc_id"), "minhash-numbers")
    kept = near_duplicates(each.join(own, "key").select("doc_id", "text"), **options).where("kept")
    return only_rows(docs, own.join(kept.select("doc_id"), "doc_id", "left_semi"), id_col, text_col)
