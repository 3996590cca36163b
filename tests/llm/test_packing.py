import random
from collections import Counter, defaultdict
from itertools import combinations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexaloom.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
CODER = Tokenizer.from_file(WORDS)


def ids_of(text):
    return [*CODER.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= length) - length) for length, n in histogram.items())


def test_boundaries_are_optimal():
    rnd = random.Random(0)
    for _ in range(60):
        histogram = {rnd.randint(1, 40): rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))}
        lengths = np.array(list(histogram))
        for k in (1, 2, 3, 12):
            ends = packing.optimal_boundaries(lengths, np.array(list(histogram.values())), k)
            best = min(padding(histogram, [*c, max(histogram)]) for size in range(min(k, len(histogram))) for c in combinations(sorted(histogram)[:-1], size))
            assert ends == sorted(set(ends)) and len(ends) <= k and ends[-1] == max(histogram) and padding(histogram, ends) == best
    assert packing.optimal_boundaries(np.array([]), np.array([]), 3) == []


def test_every_token_once_and_full_batches(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 30, 31, 99, 100, 250])), "x") for i in rnd.sample(range(1000), 300)]
    rows += [(2000, None, "x"), (None, "a b", "x"), (None, "a c", "x"), (2003, "", "x"), (2004, "Don't stop, naïve ÉTÉ 2x", "x"), (2001, "q " * 5000, "x"), (2002, "same", "x"), (2002, "same", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch string")
    got = packing.pack(docs, WORDS, longest=100, buckets=4, budget=500).collect()
    covered = defaultdict(list)
    for r in got:
        covered[r["doc_id"]].append((r["start"], r["length"], r["piece"], r["ids_crc32"]))
        assert 1 <= r["length"] <= r["bucket_length"]
    for i in {i for i, *_ in rows}:
        every = [ids_of(t) for k, t, _ in rows if k == i]
        want = sorted((s, len(own[s : s + 100]), s // 100, zlib.crc32(np.array(own[s : s + 100], "<u4").tobytes())) for own in every for s in range(0, len(own), 100))
        assert sorted(covered[i]) == want
    ends = packing.optimal_boundaries(*map(np.array, zip(*Counter(r["length"] for r in got).items(), strict=True)), 4)
    assert {r["bucket_length"] for r in got} == set(ends)
    batches = defaultdict(list)
    for r in got:
        batches[r["bucket"], r["batch"]].append(r)
        assert ends[r["bucket"]] == r["bucket_length"] and (r["bucket"] == 0 or r["length"] > ends[r["bucket"] - 1])
    for (bucket, batch), own in batches.items():
        rows_each = max(1, 500 // ends[bucket])
        assert sorted(r["place"] for r in own) == list(range(len(own)))
        last = (bucket, batch + 1) not in batches
        assert len(own) <= rows_each and (last or len(own) == rows_each)
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
    for bucket in range(4):
        seq = [order(r) for r in sorted((r for r in got if r["bucket"] == bucket), key=lambda r: (r["batch"], r["place"]))]
        assert seq == sorted(seq)


def test_batches_are_padded(spark):
    rows = [(i, "w " * n) for i, n in enumerate((3, 1, 9, 2, 7))]
    written = packing.write_batches(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, longest=8, buckets=2, budget=16).collect()
    for r in written:
        cells = np.frombuffer(r["ids"], "<u4").reshape(len(r["doc_id"]), r["bucket_length"])
        for row, i, start, length in zip(cells, r["doc_id"], r["start"], r["length"], strict=True):
            assert row[:length].tolist() == ids_of(rows[i][1])[start : start + length] and (row[length:] == packing.PAD_ID).all()


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []


def test_ids_are_shuffled_once(spark, monkeypatch):
    """Whole batches are written where their pieces were ranked, from two bytes an id; only batches that ranges share are put together from parts."""
    written = {}

    def seen(df, name, **options):
        written[name] = materialize(df, name, **options)
        return written[name]

    materialize = packing.materialize
    monkeypatch.setattr(packing, "materialize", seen)
    monkeypatch.setattr(packing, "release", lambda *tables: None)
    rows = [(i, "word " * (i % 40)) for i in range(2000)]
    got = packing.write_batches(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, longest=16, buckets=3, budget=64).collect()
    assert written["packing-ids"].where("length(ids) <> 2 * length").count() == 0
    once, parts = (written["packing-batches"].where(f"{c} is not null") for c in ("ids", "some_ids"))
    assert once.count() > 0.8 * len(got) and parts.count() <= 2 * 3 * 4 + 3  # two of each bucket and range
    assert once.count() + parts.select("bucket", "batch").distinct().count() == len(got) == len({(r["bucket"], r["batch"]) for r in got})


def test_ids_of_four_bytes(spark):
    """An id that two bytes don't hold."""
    rows = [(1, "a b"), (2, "c " * 20)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, longest=8, end_id=1 << 17).collect()
    for i, text in rows:
        own = [*ids_of(text)[:-1], 1 << 17]
        assert {r["start"]: r["ids_crc32"] for r in got if r["doc_id"] == i} == {s: zlib.crc32(np.array(own[s : s + 8], "<u4").tobytes()) for s in range(0, len(own), 8)}
