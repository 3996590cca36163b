"""Packing into optimal length buckets.

Documents become token ids and are cut into pieces of at most ``longest``
tokens. A dynamic program over the histogram of all lengths chooses the bucket
boundaries that need the least padding; inside a bucket, consecutive pieces form
batches of as many rows as the token budget holds at the bucket's length.
Batches are written with their ids and padding and read back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialize, ragged, range_split, release, shuffle_partitions
from .token_files import load

#: Longest piece, number of buckets and padded tokens of a batch.
LONGEST, BUCKETS, BUDGET = 2048, 12, 65_536
#: Ids at the end of a document, and in places of a batch that no piece fills.
END_ID, PAD_ID = 1, 0
_IDS = np.dtype("<u4")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries b1 < b2 < ... = max(lengths), at most ``buckets``, of least total
    padding when every length is padded to the next boundary.

    cost[j], of the first j lengths in k buckets, is the least over i < j of
    cost[i] in k - 1 buckets plus what padding lengths i .. j-1 to the last takes.
    Of equal costs the fewest buckets and the smallest i win."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    huge = np.iinfo(np.int64).max // 4
    cost = np.full(n + 1, huge, np.int64)
    cost[0] = 0
    choices, best = [], None
    for k in range(1, min(buckets, n) + 1):
        new, choice = np.full(n + 1, huge, np.int64), np.zeros(n + 1, np.int64)
        for j in range(k, n + 1):
            total = cost[k - 1 : j] + lengths[j - 1] * (rows[j] - rows[k - 1 : j]) - (tokens[j] - tokens[k - 1 : j])
            at = int(total.argmin())
            new[j], choice[j] = total[at], at + k - 1
        choices.append(choice)
        cost = new
        if best is None or cost[n] < best[0]:
            best = (cost[n], k)
    out, j = [], n
    for k in range(best[1], 0, -1):
        out.append(int(lengths[j - 1]))
        j = int(choices[k - 1][j])
    return out[::-1]


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID, longest: int = LONGEST) -> DataFrame:
    """(doc_id, tie, piece, start, length, ids), the pieces of documents (doc_id, text) with an id for each document's end. Written once.

    The ids are bytes, two for each id if the vocabulary allows it, else four: they are the bulk of what is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocabulary)
        kind = np.dtype("<u2") if max(end_id, *coder.tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else _IDS
        for batch in batches:
            for part in chunks(batch, "text", 4_000_000):
                ids, counts = coder.encode(part.column("text"))
                whole = np.full(len(ids) + len(counts), end_id, kind)
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                sizes = counts + 1
                each = -(-sizes // longest)
                owner = np.repeat(np.arange(len(sizes)), each)
                piece = ragged(np.zeros(len(each), np.int64), each)
                start = piece * longest
                length = np.minimum(longest, sizes[owner] - start)
                ends = np.concatenate(([0], kind.itemsize * np.cumsum(length))).astype(np.int64)
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(whole)])
                known = [part.column(c).take(pa.array(owner)) for c in ("doc_id", "tie")]
                yield pa.RecordBatch.from_arrays([*known, pa.array(piece), pa.array(start), pa.array(length), cells.cast(pa.binary())], ["doc_id", "tie", "piece", "start", "length", "ids"])

    return materialize(docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, "doc_id long, tie long, piece long, start long, length long, ids binary"), "packing-ids", compression="zstd")


_LISTS = ("doc_id", "piece", "start", "length")


def _row(bucket: int, bucket_length: int, batch: int, place: int, lists: dict[str, list], ids: bytes, whole: bool) -> pa.RecordBatch:
    own = [pa.array([bucket], pa.int32()), pa.array([bucket_length], pa.int64()), pa.array([batch], pa.int64()), pa.array([place], pa.int32())]
    own += [pa.array([lists[k]], pa.list_(pa.int64())) for k in _LISTS]
    return pa.RecordBatch.from_arrays([*own, *[pa.array([ids if whole == kept else None], pa.binary()) for kept in (True, False)]], ["bucket", "bucket_length", "batch", "place", *_LISTS, "ids", "some_ids"])


def _batches(pad_id: int, budget: int):
    """Ranked pieces -> one row per batch whose places come one after the other, with
    its padded ids as bytes; of other batches one row per run of places, its ids in another column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> pa.RecordBatch:
            first = held[0]
            cells = np.full((len(held), first["bucket_length"]), pad_id, _IDS)
            for row, piece in zip(cells, held, strict=True):
                row[: piece["length"]] = np.frombuffer(piece["ids"], f"<u{len(piece['ids']) // piece['length']}")
            lists = {k: [p[k] for p in held] for k in _LISTS}
            whole = len(held) == max(1, budget // first["bucket_length"])
            held.clear()
            return _row(first["bucket"], first["bucket_length"], first["batch"], first["place"], lists, cells.tobytes(), whole)

        for batch in batches:
            for piece in batch.to_pylist():
                if held and (held[0]["bucket"], held[0]["batch"], held[0]["place"] + len(held)) != (piece["bucket"], piece["batch"], piece["place"]):
                    yield close()
                held.append(piece)
        if held:
            yield close()

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of places, those of a batch together and in order -> one row per batch."""
    held: list[dict] = []

    def close() -> pa.RecordBatch:
        first = held[0]
        row = _row(first["bucket"], first["bucket_length"], first["batch"], first["place"], {k: [x for p in held for x in p[k]] for k in _LISTS}, b"".join(p["some_ids"] for p in held), True)
        held.clear()
        return row.drop_columns(["place", "some_ids"])

    for batch in batches:
        for part in batch.to_pylist():
            if held and (held[0]["bucket"], held[0]["batch"]) != (part["bucket"], part["batch"]):
                yield close()
            held.append(part)
    if held:
        yield close()


_BATCHES = "bucket int, bucket_length long, batch long, doc_id array<long>, piece array<long>, start array<long>, length array<long>, ids binary"
_PARTS = _BATCHES.replace("batch long,", "batch long, place int,") + ", some_ids binary"
_PLACES = "doc_id long, piece long, start long, length long, bucket int, bucket_length long, batch long, place int, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Written batches -> a row per place, all from the batch: the digest is that of its unpadded ids."""
    for batch in batches:
        for row in batch.to_pylist():
            n, width = len(row["length"]), row["bucket_length"]
            raw = memoryview(row["ids"])
            sums = [zlib.crc32(raw[4 * width * k : 4 * (width * k + size)]) for k, size in enumerate(row["length"])]
            same = {k: pa.array([row[k]] * n, t) for k, t in (("bucket", pa.int32()), ("bucket_length", pa.int64()), ("batch", pa.int64()))}
            own = {k: pa.array(row[k], pa.int64()) for k in ("doc_id", "piece", "start", "length")}
            yield pa.RecordBatch.from_arrays([*own.values(), *same.values(), pa.array(range(n), pa.int32()), pa.array(sums, pa.int64())], [*own, *same, "place", "ids_crc32"])


def write_batches(docs: DataFrame, vocabulary: str, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET, end_id: int = END_ID, pad_id: int = PAD_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written batches: bucket (from 0), bucket_length, batch (from 0 inside the
    bucket), lists of doc_id, piece, start and length of its places, and ids: a
    row of bucket_length little-endian 32-bit ids for each place, padded with ``pad_id``.

    Every token of every document is in exactly one piece. Batches hold
    budget // bucket_length rows (at least one); only the last of a bucket may hold fewer. Pieces are taken by
    ascending document id, then piece; repeated rows one after the other, by text; null ids first.

    Ranks inside a bucket come from counts per range of documents, so that no
    task sees a whole bucket; only the histogram (``longest`` rows at most) comes to the driver.
    Ids are shuffled once, to their range and bucket; only batches that ranges share are put together by another shuffle."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = tokenized(slim, vocabulary, end_id, longest)
    histogram = coded.groupBy("length").agg(F.count("*").alias("n")).collect()
    ends = optimal_boundaries(np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64), buckets)
    if not ends:
        ends = [longest]
    table = F.array(*[F.lit(e).cast("long") for e in ends])
    bucket = F.size(F.filter(table, lambda e: e < F.col("length")))
    pieces = coded.withColumn("bucket", bucket).withColumn("part", range_split(coded, "doc_id", shuffle_partitions(spark)))

    counts = pieces.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket", "part").orderBy("doc_id", "tie", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(bases), ["bucket", "part"]).withColumn("rank", F.col("rank") + F.col("base")).withColumn("bucket_length", F.get(table, F.col("bucket")))
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length")))
    placed = ranked.select(*_LISTS, "bucket", "bucket_length", F.floor(F.col("rank") / rows).alias("batch"), (F.col("rank") % rows).cast("int").alias("place"), "ids")
    parts = materialize(placed.mapInArrow(_batches(pad_id, budget), _PARTS), "packing-batches", compression="zstd")
    release(coded)
    shared = parts.where("some_ids is not null").select("bucket", "bucket_length", "batch", "place", *_LISTS, "some_ids")
    dealt = shared.repartition(shuffle_partitions(spark), "bucket", "batch").sortWithinPartitions("bucket", "batch", "place")
    rest = materialize(dealt.mapInArrow(_joined, _BATCHES), "packing-shared-batches", compression="zstd")
    return parts.where("ids is not null").select(*rest.columns).union(rest)


def pack(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """One row per piece, read back from the written batches: doc_id, piece (from 0), start, length, bucket (from 0),
    bucket_length, batch (from 0 inside the bucket), place (row of the batch), ids_crc32 (of the piece's ids as little-endian 32-bit numbers).

    vocabulary: path of a tokenizer file whose splitting drops white space, present on every executor; other options as of write_batches.
    Null and empty texts have the end id alone; repeated rows are packed each;
    null ids are kept, and come first; an empty table gives no rows. Other columns of ``docs`` are not looked at."""
    return write_batches(docs, vocabulary, **options).mapInArrow(_read, _PLACES)
