import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexaloom.llm import bpe, simple8b, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a", "a\n\n b ", "it's we'll I'd", "<|endoftext|>", "a<|endoftext|>b  c<|startoftext|>", "é é ́x Σ ΑΣ", "aaaaaaaaaaaaaaaa", "日本語 ½ x² \x85\x1c", "word." * 50, "a" * 5000]


def library(path):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab 'sté1!\n<|endoftx>", max_size=60)), max_size=8))
def test_byte_bpe_is_the_library(texts):
    coder, own = library(BYTES), bpe.load(BYTES)
    ids, counts, joined = own.encode_batch(texts)
    want = [e.ids for e in coder.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))
    assert joined == [",".join(map(str, w)) for w in want]
    assert own.decode_batch(ids, counts) == [coder.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="abΣ 'sté1!\n<|endoftx>AB", max_size=60), st.none()), max_size=8))
def test_word_cache_is_the_library(texts):
    ids, counts = token_files.load(WORDS).encode(pa.array(texts, pa.string()))
    want = [e.ids for e in library(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))


def test_caches_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(token_files, "CACHED_WORDS", 3)
    one, two = bpe.ByteBpe(BYTES), token_files.WordCache(WORDS)
    for text in ("a b c d", "e f g", "a b c d"):
        assert one.encode_batch([text])[0].tolist() == library(BYTES).encode(text).ids
        assert two.encode(pa.array([text]))[0].tolist() == library(WORDS).encode(text).ids


def test_round_trip_query(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, None])] + [(0, ODD[2]), (None, "x")]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), BYTES).collect()
    coder, sha = library(BYTES), lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = coder.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(coder.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), BYTES).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 65535), st.integers(0, 2**64 - 1)), max_size=1500), st.integers(1, 300))
def test_simple8b_round_trip(values, block):
    given_ = np.array(values, np.uint64)
    words, offsets, table = simple8b.encode(given_, block)
    assert simple8b.decode(words, offsets, table, len(values), block).tolist() == values
    assert len(table) == sum(v >= 2**60 for v in values)
    for k in range(len(offsets)):  # a block decodes alone
        end = int(offsets[k + 1]) if k + 1 < len(offsets) else len(words)
        part = values[k * block : (k + 1) * block]
        assert simple8b.decode(words[int(offsets[k]) : end], np.zeros(1, np.uint64), table, len(part), block).tolist() == part


def test_simple8b_packs():
    assert len(simple8b.encode(np.zeros(480, np.uint64))[0]) == 4
    assert len(simple8b.encode(np.full(480, 1023, np.uint64))[0]) == 80
    data = simple8b.write_file(np.array([5, -1]), np.array([2, 0]), np.array([7, 2**63], np.uint64))
    assert [x.tolist() for x in simple8b.read_file(data)] == [[5, -1], [2, 0], [7, 2**63]]
    with pytest.raises(ValueError):
        simple8b.read_file(data[:-8])


def test_token_files(spark, monkeypatch):
    rnd = random.Random(0)
    rows = [(i, " ".join(rnd.choice(ODD + ["plain words here"]) for _ in range(rnd.randint(0, 30)))) for i in rnd.sample(range(1000), 80)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    files = token_files.write_token_files(docs, WORDS)
    got = sorted(map(tuple, token_files.read_token_files(files).collect()))
    coder, start, want = library(WORDS), 0, []
    for i, t in sorted(rows):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    ordered = [d for row in files.orderBy("part", "file").collect() for d in simple8b.read_file(bytes(row["data"]))[0].tolist()]
    assert ordered == sorted(i for i, _ in rows)
    assert token_files.token_file_digests(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []
    twice = token_files.token_file_digests(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string"), WORDS).collect()
    assert [(r["doc_id"], r["start"]) for r in sorted(twice, key=lambda r: r["start"])] == [(None, 0), (1, 2), (1, 4)]
    mixed = spark.createDataFrame([(-1, "a b", "x"), (0, "c", "y"), (None, "a b", "z"), (None, None, "z")], "doc_id long, text string, start string")
    got = token_files.token_file_digests(mixed, WORDS).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(None, 0, 1), (None, 1, 3), (-1, 4, 3), (0, 7, 2)]


def test_round_trip_beside_clashing_columns(spark):
    rows = [(1, "a  b", 7, b"x"), (1, "a  b", 8, b"y"), (None, None, 9, None), (2, "z" * 60_000, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids_sha256 binary")
    got = bpe.round_trip(docs, BYTES).collect()
    coder = library(BYTES)
    want = [(i, len(coder.encode(t or "", add_special_tokens=False).ids), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows]
    assert sorted(((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got), key=str) == sorted(want, key=str)
    assert bpe.round_trip(docs.limit(0), BYTES).collect() == []
