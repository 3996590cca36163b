import hashlib
import random

import numpy as np

from lexaloom.llm import editprints as E
from lexaloom.llm.common import mix64


def slow_print(text):
    """The walk, one character at a time."""
    bits = []
    for base in range(0, len(text), E.SEGMENT):
        part = text[base : base + E.SEGMENT]
        at = 0
        for j in range(E.STEPS * len(part)):
            h = int(mix64(np.array([(ord(part[at]) + 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]) if at < len(part) else 0
            bits.append(h * int(E._SHOW[j]) % 2**64 >> 63)
            at += h * int(E._MOVE[j]) % 2**64 >> 63
    chosen = sorted(range(len(bits)), key=lambda p: int(mix64(np.array([p], np.uint64))[0]))[: E.BITS]
    packed = np.packbits(np.array([bits[p] for p in chosen], np.uint8)).tobytes().hex()
    return f"{len(text):x}:{packed}"


def test_against_slow_walk():
    rnd = random.Random(0)
    texts = ["", "a", "日本", "ab" * 100, "".join(rnd.choice("abc dé") for _ in range(1300))]
    assert E.fingerprints(texts) == [slow_print(t) for t in texts]
    assert E.fingerprints(texts[::-1]) == [slow_print(t) for t in texts[::-1]]
    assert E.fingerprints([]) == []


def test_samples_nest():
    for small, large in ((3, 10), (700, 900), (900, 5000), (170, 171)):
        a, b = E.sampled_steps(small), E.sampled_steps(large)
        inside = b[b < E.STEPS * small]
        assert len(a) == min(E.BITS, E.STEPS * small) and len(set(a.tolist())) == len(a)
        assert a[: len(inside)].tolist() == inside.tolist()


def test_likeness_follows_edits():
    rnd = random.Random(1)
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))

    def edited(t, share):
        out = list(t)
        for _ in range(int(len(t) * share)):
            out[rnd.randrange(len(out))] = rnd.choice("xyz")
        return "".join(out)

    bases = [text(3000) for _ in range(20)]
    prints = E.fingerprints(bases)
    means = []
    for share in (0, 0.005, 0.02, 0.1):
        means.append(np.mean([E.likeness(a, b) for a, b in zip(prints, E.fingerprints([edited(t, share) for t in bases]), strict=True)]))
    assert means[0] == 1 and means == sorted(means, reverse=True) and means[1] > 0.85
    assert np.mean([E.likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)]) < 0.25
    assert E.likeness(prints[0], E.fingerprints([""])[0]) == 0 and E.likeness(*E.fingerprints(["", ""])) == 1


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (-r[0], r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        e = E.edited_text(t, after)
        p, q, r = E.fingerprints([t, e, after])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, E.likeness(p, q), E.likeness(p, r)))
    return sorted(out)


def test_query_against_slow_order(spark):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("ab cdé日") for _ in range(rnd.choice([0, 1, 5, 300, 2000])))) for i in rnd.sample(range(500), 60)]
    rows += [(700, None), (701, ""), (702, "z" * 60_000), (703, "same"), (703, "other"), (None, "left out")]
    for part in (1, 7):
        got = E.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(part)).collect()
        assert sorted(map(tuple, got)) == expected(rows)
    one = [(4, "only one text")]
    assert sorted(map(tuple, E.fingerprint_edits(spark.createDataFrame(one, "doc_id long, text string")).collect())) == expected(one)
    assert E.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_near_duplicates(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    rows, groups = [], {}
    for g in range(6):
        base = text(1500)
        for c in range(4):
            own = list(base)
            for _ in range(c):
                own[rnd.randrange(len(own))] = "x"
            i = 10 * c + g
            rows.append((i, "".join(own)))
            groups[i] = g
    rows += [(900, None), (901, ""), (902, rows[0][1])]
    groups |= {900: 900, 901: 900, 902: groups[rows[0][0]]}
    got = {r["doc_id"]: r["component_id"] for r in E.edit_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: min(k for k in groups if groups[k] == g) for i, g in groups.items()}


def altered(rnd, text):
    """Base texts and copies with replaced, inserted, deleted and appended characters."""
    out = []
    for n in (40, 150, 600, 1500, 4000):
        for _ in range(12):
            t = text(n + rnd.randrange(n // 8))
            k, few = rnd.randrange(len(t)), max(1, len(t) // 400)
            out += [t, t[:k] + "x" + t[k + 1 :], t[:k] + text(few) + t[k:], t[:k] + t[k + few :], *(t + text(len(t) * percent // 100) for percent in (5, 10, 15))]
    return out


def test_near_texts_share_bands():
    rnd = random.Random(6)
    prints = E.fingerprints(altered(rnd, lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))))
    keys = [set(E.band_keys(p)) for p in prints]
    near = [(i, j) for j in range(len(prints)) for i in range(j - j % 7, j) if E.likeness(prints[i], prints[j]) >= 0.8]
    assert len(near) > 500 and all(keys[i] & keys[j] for i, j in near)


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(8)
    rows = list(enumerate(altered(rnd, lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n)))))
    prints = E.fingerprints([t for _, t in rows])
    group = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if group[i] != group[j] and E.likeness(prints[i], prints[j]) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    got = E.edit_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["component_id"] for r in sorted(got)] == group


def test_clashing_columns(spark):
    rows = [(1, "first text", "f", 1.0), (2, "second text", "g", 2.0), (3, None, "h", 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, near_next double")
    plain = sorted(map(tuple, E.fingerprint_edits(docs.select("doc_id", "text")).collect()))
    assert sorted(map(tuple, E.fingerprint_edits(docs).collect())) == plain and len(plain) == 3
