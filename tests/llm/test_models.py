import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaloom.llm import langid, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out(spark, docs, labels):
    scored = quality.score_quality(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert scored.count() == docs.count() and len(rows) > 60
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.95
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["predicted"] for r in good) / len(good) >= 0.97
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_quality_learns_nothing_from_held_out_rows(docs, labels):
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one = {r["doc_id"]: r["score"] for r in quality.score_quality(docs.limit(50), labels).collect()}
    two = {r["doc_id"]: r["score"] for r in quality.score_quality(docs.limit(50), turned).collect()}
    assert one == two


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b", "x"), (3, "\n\n", "x"), (5, "x" * 200_000, "y")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (None, 0), (3, 7)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(docs, one).collect()} == {1.0}
    both = spark.createDataFrame([(1, 1), (3, 0), (5, 0), (2, 1)], "doc_id long, quality int")
    got = quality.score_quality(docs, both).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    same = [r["score"] for r in got if r["doc_id"] in (1, 2)]
    assert len(set(same)) == 1
    assert quality.score_quality(docs.limit(0), both).collect() == []


def test_statistics_do_not_depend_on_neighbours():
    import pyarrow as pa

    from lexaloom.llm.common import utf8

    texts = ["", "A b\nA b\n!!", "| x | y", "été 123", "word " * 500]
    together = quality.document_statistics(*utf8(pa.array(texts)))
    alone = np.concatenate([quality.document_statistics(*utf8(pa.array([t]))) for t in texts])
    assert np.array_equal(together, alone) and np.isfinite(together).all()


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = [rng.normal(size=(400, d)) @ rng.normal(size=(d, d)) + k for k in (0, 1)]
    model = quality.fit_moments({k: (len(v), v.sum(0), v.T @ v) for k, v in enumerate(x)}, 0.1)
    at = rng.normal(size=(5, d))
    mean = np.concatenate(x).mean(0)
    scale = np.sqrt((np.concatenate(x) ** 2).mean(0) - mean**2)
    logs = []
    for v in x:
        v = v / scale
        c = np.cov(v.T, bias=True)
        c = 0.9 * c + 0.1 * np.trace(c) / d * np.eye(d)
        z = at / scale - v.mean(0)
        logs.append(-0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(c), z) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(model.score(at), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-6)


def test_languages_on_held_out(docs):
    rows = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.98 and all(0 <= r["score"] <= 1 for r in rows)


def test_languages_ignore_held_out_rows(docs):
    turned = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))
    one = sorted(map(tuple, langid.identify_languages(docs).collect()))
    assert one == sorted(map(tuple, langid.identify_languages(turned).collect()))


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score string"
    assert langid.identify_languages(spark.createDataFrame([], schema)).collect() == []
    nothing = langid.identify_languages(spark.createDataFrame([(1, "abc", None, "s")], schema)).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]
    rnd = random.Random(0)
    make = lambda alphabet: " ".join("".join(rnd.choice(alphabet) for _ in range(5)) for _ in range(30))
    rows = [(i, make("abcde") if i % 2 else make("vwxyz"), "a" if i % 2 else "v", "s") for i in range(60)]
    rows += [(100, None, "a", ""), (101, "12 !?", "a", ""), (101, "12 !?", "a", ""), (102, "", None, ""), (None, "abcab", None, ""), (103, "x" * 300_000, None, "")]
    got = langid.identify_languages(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(by_id[i] == rows[i][2] for i in range(60))
    assert [by_id[i] for i in (100, 101, 102, None, 103)] == ["und", "und", "und", "a", "v"]


def test_training_is_sparse_and_calibrated():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):
        label = k % 2
        at = np.unique(np.concatenate((rng.integers(0, 40, 5) + 40 * label, rng.integers(80, 400, 10))))
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at))), label if rng.random() > 0.2 else 1 - label))
    weights, bias = langid.train_ftrl(rows, 2, 400)
    assert (weights == 0).mean() > 0.02
    logits = np.array([x @ weights[at] + bias for at, x, _ in rows])
    labels = np.array([y for *_, y in rows])
    t = langid.fit_temperature(logits, labels)
    loss = lambda s: -np.log(langid.softmax(logits / s)[np.arange(300), labels]).mean()
    assert loss(t) <= min(loss(t * 1.05), loss(t / 1.05)) + 1e-9
