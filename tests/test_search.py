import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import StorageLevel
from pyspark.sql import functions as F

from lexaloom.operators import index as I
from lexaloom.plans import boolean as B
from lexaloom.plans import queries
from lexaloom.sources import files

DOCS = ["фильм триллер 1999", "режиссёр снял фильм", "стихотворение осень", "Фильмы осени, режиссёры", "film noir 1999"]
GOLDEN = {
    "фильм": [1, 2, 4], "ФИЛЬМ": [1, 2, 4], "фильмы 1999": [1], "фильм && 1999": [1], "фильм || осень": [1, 2, 3, 4], "!фильм": [3, 5], "!!фильм": [1, 2, 4],
    "фильм !1999": [2, 4], "фильм || осень 1999": [1, 2, 4], "(фильм || film) 1999": [1, 5], "(фильм || осень) (режиссёр || стихотворение)": [2, 3, 4],
    "!(фильм || film)": [3], "фильм !режиссёр || осень": [1, 3, 4], "фильм || !осень 1999": [1, 2, 4, 5], "фильм || нетслова": [1, 2, 4], "фильм нетслова": [],
    "(фильм": [1, 2, 4], "фильм)": [1, 2, 4], "фильм (1999": [1], "фильм) 1999": [1], ", фильм": [1, 2, 4], "«фильм": [1, 2, 4], "!-фильм": [3, 5], "фильм && -1999": [1],
    "фильм, 1999": [], "фильм & 1999": [], "фильм.": [], "«фильм»": [], "e-mail": [], "фильм || || осень": [], "&& фильм": [], "() фильм": [], "фильм !": [], "()": [], "...": [],
}


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(DOCS)], "doc_id long, text string")
    meta = docs.select("doc_id", (F.col("doc_id") * 10).alias("page_id"), F.concat(F.lit("t"), F.col("doc_id")).alias("title"), F.lit("ruwiki").alias("source"))
    built = I.build_index([(docs, meta)])
    return I.Index(built.postings.cache(), built.dictionary.cache(), built.docs.cache())


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.mark.parametrize("query", GOLDEN)
def test_golden(small, query):
    assert ids(B.hits(small, query)) == GOLDEN[query]


def test_postfix():
    text = lambda q: " ".join(t.text if isinstance(t, B.Term) else t for t in B.postfix(B.scan(q)))
    assert text("фильм || осень 1999") == "фильм осен 1999 AND OR"
    assert text("«фильм»") == "фильм AND AND"
    assert text("фильм !1999") == "фильм 1999 NOT AND"
    assert text("!!фильм") == "фильм NOT NOT"
    assert text("&& фильм") == "фильм AND"


def test_lenient(small):
    assert ids(B.hits(small, "фильм, 1999.", lenient=True)) == [1]


def expressions():
    word = st.sampled_from(["фильм", "осень", "1999", "режиссёр", "film", "нет"])
    return st.recursive(word, lambda e: st.one_of(e.map(lambda x: f"!({x})"), st.tuples(e, st.sampled_from([" && ", " || ", " "]), e).map(lambda t: f"({t[0]}{t[1]}{t[2]})")), max_leaves=6)


@settings(max_examples=12, deadline=None)
@given(expressions())
def test_flags_sets_and_plain_python_agree(small, query):
    index = {}
    for n, text in enumerate(DOCS, 1):
        for token in B.scan(text.replace(",", " ")):
            if isinstance(token, B.Term):
                index.setdefault(token.text, set()).add(n)
    everything = set(range(1, len(DOCS) + 1))
    want = B.fold(B.parse(query), lambda t: index.get(t, set()), lambda a, b: a & b, lambda a, b: a | b, lambda a: everything - a)
    assert ids(B.hits(small, query)) == sorted(want) == ids(B.hits_by_sets(small, query))


def test_pages(small):
    page = B.search(small, "фильм", offset=1, limit=1).collect()
    assert [(r["total"], r["doc_id"], r["page_id"], r["url"]) for r in page] == [(3, 2, 20, "https://ru.wikipedia.org/?curid=20")]
    assert B.search(small, "фильм", offset=9).collect() == []
    many = B.search_many(small, ["фильм", " ", "()", "фильм"], offset=9).orderBy("query_id").collect()
    assert [(r["query_id"], r["total"], r["doc_id"]) for r in many] == [(0, 3, None), (2, 0, None), (3, 3, None)]
    assert B.search_many(small, ["", "\t"]).collect() == []
    assert B.format_results(page, 3, 1, 1) == "OK\ttotal=3\toffset=1\tlimit=1\n2\t20\tt2\thttps://ru.wikipedia.org/?curid=20\n"
    assert B.page_offsets("50", 120) == (50, 0, 100) and B.page_offsets("x", 10) == (0, None, None) and B.page_offsets("-5", 60) == (0, None, 50)


def test_index_invariants(spark, small):
    terms = {r["term"]: (r["df"], r["postings_off"]) for r in small.dictionary.collect()}
    lists = {r["term"]: r["docs"] for r in I.postings_lists(small.postings).collect()}
    at = 0
    for term in sorted(terms, key=str.encode):
        df, off = terms[term]
        assert off == at and lists[term] == sorted(set(lists[term])) and len(lists[term]) == df
        at += 4 * df
    assert lists["фильм"] == [1, 2, 4] and lists["осен"] == [3, 4]


def test_several_inputs(spark):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    meta = lambda rows: spark.createDataFrame(rows, "doc_id long, page_id long, title string, source string, line int")
    one = docs([(1, "а"), (2, "б"), (0, "в"), (3, "")]), meta([(1, 5, "x", "ruwiki", 1), (2, 6, "", "ruwiki", 2), (0, 7, "z", "ruwiki", 3), (3, 8, "y", None, 4), (1, 9, "w", "other", 5)])
    two = docs([(4, "г")]), meta([(4, 1, "v", "ru_wikisource", 1)])
    rows = I.global_ids(I.combined([one, two])).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["page_id"], r["title"], r["source_id"]) for r in rows] == [(1, 9, "w", 3), (2, 8, "y", 0), (3, 1, "v", 2)]
    built = I.build_index([one, two])
    # a document without a token belongs to the universe
    assert ids(B.hits(built, "!а")) == [2, 3]


def test_saved_and_binary_index(spark, small, tmp_path):
    small.save(str(tmp_path / "index"))
    loaded = I.load_index(spark, str(tmp_path / "index"))
    assert ids(B.hits(loaded, "фильм || осень")) == [1, 2, 3, 4]
    plan = B.hits(loaded, "фильм")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(term" in plan or "PushedFilters: [In(term" in plan or "IsNotNull(term), EqualTo(term" in plan
    files.write_binary_index(small, str(tmp_path / "index.bin"))
    again = files.read_binary_index(spark, str(tmp_path / "index.bin"))
    for name in ("postings", "dictionary", "docs"):
        a, b = getattr(small, name), getattr(again, name)
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_numbering_crosses_groups(spark, monkeypatch):
    monkeypatch.setattr(I, "NUMBERS_AT_ONCE", 3)
    rows = [(s, i) for s in (1, 0) for i in random.Random(1).sample(range(1, 40), 11)]
    got = I.global_ids(spark.createDataFrame(rows, "source_ord int, local_id long")).collect()
    assert [(r["source_ord"], r["local_id"]) for r in sorted(got, key=lambda r: r["doc_id"])] == sorted(rows)
    assert sorted(r["doc_id"] for r in got) == list(range(1, 23))


def cuts(df):
    """How often a plan cuts texts into tokens."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_texts_of_a_block_go_to_many_tasks(spark):
    docs = spark.range(1, 401).select(F.lit(0).alias("source_ord"), F.col("id").alias("local_id"), F.lit("т").alias("text"))
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in fixed}
    try:
        for k, v in fixed.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in I.global_ids(docs).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 400 and max(sizes) < 200


def test_saving_cuts_each_text_once(spark, tmp_path, monkeypatch):
    cut = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def counted(text):
        cut.add(1)
        return text.split()

    monkeypatch.setattr(I, "tokens", counted)
    docs = spark.range(1, 101).select(F.col("id").alias("doc_id"), F.concat(F.lit("общее слово"), "id").alias("text"))
    meta = docs.select("doc_id", F.col("doc_id").alias("page_id"), F.lit("t").alias("title"), F.lit("ruwiki").alias("source"))
    built = I.build_index([(docs, meta)])
    built.save(str(tmp_path / "index"))
    assert cut.value == 100
    assert built.postings.storageLevel == StorageLevel.NONE
    assert I.load_index(spark, str(tmp_path / "index")).postings.count() == 200


def test_repeated_numbers(spark):
    rows = [(0, 5), (0, 2), (0, 5), (1, 2), (0, 5), (1, 1)]
    got = I.global_ids(spark.createDataFrame(rows, "source_ord int, local_id long")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(*r, n) for n, r in enumerate(sorted(rows), 1)]


def test_index_statistics(spark):
    docs = spark.createDataFrame([(1, "Фильм фильмы, режиссёр"), (2, None), (3, "film, film 1999"), (4, "фильмами")], "doc_id long, text string")
    meta = docs.select("doc_id", F.col("doc_id").alias("page_id"), F.concat(F.lit("т"), F.col("doc_id")).alias("title"), F.lit("ruwiki").alias("source"))
    stats = I.index_statistics(I.combined([(docs, meta)]))
    assert cuts(stats) == 1
    # 3 x фильм, режиссёр, 2 x film, 1999: four terms in five pairs; titles of 3 bytes
    terms = 10 + 16 + 4 + 4
    assert stats.collect() == [(4, 4, 7, (3 * 10 + 16 + 2 * 4 + 4) / 7, terms / 4, 4 * 20 + terms, 4 * 5, 8 + 4 * (24 + 3))]
    assert I.index_statistics(I.combined([(docs.limit(0), meta)])).collect() == [(0, 0, 0, 0.0, 0.0, 0, 0, 8)]
    assert I.index_statistics(I.combined([(docs, meta)]), stemmed=False).first()["terms_count"] == 6


def test_index_stats_reads_texts_once(spark, tmp_path):
    spark.createDataFrame([(0, "a b", "src0"), (1, "b", "src9")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    stats = queries.index_stats(spark, str(tmp_path))
    assert cuts(stats) == 1
    assert stats.collect() == [(2, 2, 3, 1.0, 1.0, 42, 12, 8 + 2 * (24 + 5))]
