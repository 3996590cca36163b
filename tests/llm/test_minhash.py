import random
import re

import numpy as np

from lexaloom.llm import minhash
from lexaloom.llm.common import mix64, utf8
from lexaloom.llm.components import connected_components
from lexaloom.llm.shingles import shingle_sets

import pyarrow as pa


def brute_sets(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(sets, percent=80):
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * len(sets[i] | sets[j]):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def corpus(seed, copies=14):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(3))
    texts = [None, "", " \n\t", "One", "ONE", "one two", "été Été", "É"]
    passage = [word() for _ in range(40)]
    for _ in range(5):
        base = [word() for _ in range(rnd.randint(20, 90))]
        texts += [" ".join(base)] * 3
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, 6)):
                own[rnd.randrange(len(own))] = word()
            texts.append("  ".join(own))
    texts += [" ".join(passage + [word() for _ in range(rnd.randint(5, 60))]) for _ in range(20)]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return [(i * 3, texts[k], "de") for i, k in enumerate(order)]


def check(spark, rows, size):
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, size).collect()}
    sets = {i: brute_sets(t, size) for i, t, _ in rows}
    want = brute_components(sets)
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_against_all_pairs(spark):
    check(spark, corpus(1), 2)
    check(spark, corpus(2), 5)


def test_chain_reaches_its_smallest(spark):
    # each text resembles the next; the ends share too little
    words = [f"w{i}" for i in range(60)]
    rows = [(100 - k, " ".join(words[2 * k : 2 * k + 40]), "") for k in range(10)]
    check(spark, rows, 1)


def test_edges(spark):
    schema = "doc_id long, text string, rep string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "z", "y"), (None, "a", ""), (2, None, ""), (3, "a b c d e f", "")], schema)
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(rows).collect())
    assert got == [(1, 1, True), (2, 2, True), (3, 1, False)]
    assert sorted(r["doc_id"] for r in minhash.drop_near_duplicates(rows).collect()) == [1, 1, 1, 2]


def test_long_text(spark):
    rnd = random.Random(3)
    base = [str(rnd.randrange(10**6)) for _ in range(30_000)]
    near = list(base)
    near[5] = "x"
    rows = [(7, " ".join(near), ""), (4, " ".join(base), "")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, c string")).collect()}
    assert got == {4: 4, 7: 4}


def test_shingles_match_sets():
    for size in (1, 2, 5):
        texts = [t for _, t, _ in corpus(5)]
        sets, counts = shingle_sets(*utf8(pa.array(texts)), size)
        assert counts.tolist() == [len(brute_sets(t, size)) for t in texts]
        ends = np.cumsum(counts)
        same = {}
        for t, e, n in zip(texts, ends, counts, strict=True):
            assert same.setdefault(frozenset(brute_sets(t, size)), sets[e - n : e].tolist()) == sets[e - n : e].tolist()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for shared in (0, 50, 150, 190):
        for n in range(20):
            common = mix64(rng.integers(0, 2**60, shared).astype(np.uint64))
            own = [mix64(rng.integers(0, 2**60, 200 - shared).astype(np.uint64)) for _ in range(2)]
            sets = [np.concatenate((common, o)) for o in own]
            ranks = minhash.super_minhash(np.concatenate(sets), np.array([200, 200]))
            true = shared / (400 - shared)
            errors.append((ranks[0] == ranks[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04
    # a set of one element fills all registers, each with another rank
    ranks = minhash.super_minhash(np.array([5], np.uint64), np.array([1, 0]))
    assert sorted((ranks[0] >> np.uint64(56)).tolist()) == list(range(minhash.REGISTERS)) and (ranks[1] == np.iinfo(np.uint64).max).all()


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(3, 3), (5, None)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
