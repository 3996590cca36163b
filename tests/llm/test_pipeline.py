from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexaloom.llm import langid, minhash, packing, quality
from lexaloom.llm.queries import ORACLES, QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_columns(stages):
    *filters, _ = (stages[name] for name, _ in corpus_pipeline.STAGES)
    for df in filters:
        assert df.dtypes == stages["documents"].dtypes


def test_decisions_take_effect(spark, stages):
    scored = quality.score_quality(stages["documents"], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(stages["quality"]) == ids(scored.where("predicted = 1"))
    found = langid.identify_languages(stages["quality"])
    assert ids(stages["language"]) == ids(found.where("lang_pred <> 'und' and score >= 0.5"))
    assert ids(stages["lines"]) == ids(stages["language"])
    assert stages["lines"].where("n_chars <> length(text)").count() == 0
    assert ids(stages["near_duplicates"]) == ids(minhash.near_duplicates(stages["lines"]).where("kept"))
    assert sorted(map(tuple, stages["packing"].collect())) == sorted(map(tuple, packing.pack(stages["near_duplicates"], vocabulary("word_bpe_49k.json")).collect()))


def test_line_stage_against_brute_force(stages):
    from test_linededup import brute

    before = [(r["doc_id"], r["text"]) for r in stages["language"].orderBy("doc_id").collect()]
    after = {r["doc_id"]: r["text"] for r in stages["lines"].collect()}
    assert [after[i] for i, _ in before] == brute([t for _, t in before])


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages["packing"].collect()))


def test_queries_cover_every_operator():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_null_and_repeated_ids(spark, stages):
    changed = F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.floor(F.col("doc_id") / 4))
    docs = corpus_pipeline.materialize(stages["documents"].withColumn("doc_id", changed.cast("long")), "changed-ids")
    count = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    good = count(quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1"))
    every = count(docs)
    assert 0 < good[None] and any(0 < good[i] < n for i, n in every.items() if i is not None)
    assert count(corpus_pipeline.keep_quality(spark, docs, SF)) == good
    found = langid.identify_languages(docs).where("lang_pred <> 'und' and score >= 0.5")
    assert count(corpus_pipeline.keep_languages(spark, docs, SF)) == count(found)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " end"), (None, c), (None, c + " end"), (None, a), (3, None), (None, None), (4, c[:20])]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    kept = [(r["doc_id"], r["text"]) for r in got]
    last = [r for r in kept if r[0] is None and r[1] in (c, c + " end")]
    assert len(last) == 1 and sorted((r for r in kept if r not in last), key=str) == sorted([(1, a), (1, b), (3, None), (None, None), (4, c[:20])], key=str)


def test_freed_memory_goes_back(spark):
    """What the driver's JVM has freed outside its heap doesn't stay with it after a table is written."""
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def anonymous():
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon")) / 1024

    for _ in range(5):  # the heap grows at first
        corpus_pipeline.materialize(spark.range(1), "before")
    start, held = anonymous(), []
    for _ in range(4000):
        held.append(jvm.java.util.zip.Deflater())
        held[-1].deflate(bytearray(16))
    for one in held[:-1]:
        one.end()
    freed = anonymous()
    corpus_pipeline.materialize(spark.range(1), "after")
    assert freed > start + 150 and anonymous() < freed - 0.5 * (freed - start)


def test_workers_forget_words(spark):
    """The words that packing has left in a worker process go when tasks start that don't use them."""
    import pyarrow as pa

    from lexaloom.llm import token_files

    path = vocabulary("word_bpe_49k.json")
    text = pa.record_batch([pa.array([1]), pa.array(["some words of a text"])], ["doc_id", "text"])
    before = token_files.load(path).encode(text.column("text"))[0].tolist()
    assert token_files.load(path).known
    assert len(list(minhash._sign(5)(iter([text])))) == 1
    assert not token_files.load(path).known
    assert token_files.load(path).encode(text.column("text"))[0].tolist() == before
