import json

from pyspark.sql import functions as F

from lexaloom.operators import corpus, crawl, terms
from lexaloom.sources import files, wiki
from lexaloom.streaming.crawl_stream import CrawlState, changed_stream, crawl_stream


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_sizes(spark):
    sizes = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 10)], "source string, size int")
    total = corpus.size_statistics(sizes).where("source is null").first()
    assert tuple(total)[1:] == (4, 16, 1, 2, 4, 10)


def test_collect_and_counters(spark):
    long = "слово " * 50
    pages = spark.createDataFrame([("s", 3, 30, "c", long, "<p>"), ("s", 1, 10, "a", "short", "<p>"), ("s", 2, 20, "b", long + "\nСсылки\nx", "<p>"), ("s", 4, 40, "d", long, None), ("r", 1, 1, "e", long, "<p>"), ("r", 2, 2, "f", None, "<p>")], "source string, seq long, page_id long, title string, text string, html string")
    assert rows(corpus.collect_corpus(pages), "source", "doc_id", "page_id") == [("r", 1, 1), ("s", 1, 20), ("s", 2, 30)]
    watched, seen = corpus.crawl_counters(pages)
    watched.count()
    assert seen.get == {"saved": 3, "skipped": 2, "failed": 1}


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tuple(corpus.token_totals(corpus.token_statistics(empty)).first()) == (0, 0, 0, 0.0, 0.0)
    assert terms.rank_frequency(terms.term_frequency(empty)).collect() == []
    assert terms.mandelbrot_best(terms.mandelbrot_candidates(terms.rank_frequency(terms.term_frequency(empty)))).collect() == []


def test_stemmed_statistics_count_whole_words(spark):
    docs = spark.createDataFrame([(1, "фильмами, осень")], "doc_id long, text string")
    assert tuple(corpus.token_statistics(docs).first()) == (1, 2, 13, 28)
    assert rows(corpus.exploded_tokens(docs, stemmed=True), "pos", "term") == [(0, "фильм"), (1, "осен")]


def test_zipf(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 4), ("c", 4), ("d", 1)], "term string, count long")
    ranked = terms.rank_frequency(counts)
    assert rows(ranked, "rank", "frequency") == [(1, 10), (2, 4), (3, 4), (4, 1)]
    assert [round(r["zipf"], 3) for r in terms.zipf_curve(ranked).orderBy("rank").collect()] == [10, 5, 3.333, 2.5]
    assert terms.curves(ranked).where("mandelbrot > 0").count() == 4


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"one \xff two")
    (tmp_path / "in" / "deep" / "B.TXT").write_text("три")
    (tmp_path / "in" / "00000007.tok").write_bytes("а\r\nб\n\nв".encode())
    (tmp_path / "in" / "x.tok").write_text("z\n")
    assert rows(files.read_texts(spark, str(tmp_path / "in")), "path", "text") == [("a.txt", "one � two"), ("deep/B.TXT", "три")]
    assert rows(files.read_tokens(spark, str(tmp_path / "in")), "term") == [("z",), ("а",), ("б",), ("в",)]
    assert rows(files.read_token_documents(spark, str(tmp_path / "in")), "doc_id") == [(7,)]
    (tmp_path / "seeds").write_text(" https://a/ \n\nhttps://b/\n")
    assert rows(files.read_seeds(spark, str(tmp_path / "seeds")), "url") == [("https://a/",), ("https://b/",)]
    made = spark.createDataFrame([("s", 1, 5, 'a "b"', "text", "<p>")], "source string, doc_id long, page_id long, title string, text string, html string")
    files.write_corpus(made, str(tmp_path / "out"))
    assert rows(files.read_meta(spark, str(tmp_path / "out/meta")), "doc_id", "title", "text_file") == [(1, 'a "b"', "00000001.txt")]
    assert files.CrawlConfig.from_dict({"logic": {"delay_sec": 1}, "sources": [{"name": "s", "kind": "seed_file", "path": "p"}]}).delay_sec == 1


def test_wiki_source(spark, tmp_path):
    def record(params, answer):
        (tmp_path / wiki.recording_name(params)).write_text(json.dumps(answer))

    record({**wiki.LISTING, "cmtitle": "C"}, {"query": {"categorymembers": [{"pageid": 1, "title": "a"}, {"pageid": 2, "title": "b"}]}, "continue": {"cmcontinue": "m"}})
    record({**wiki.LISTING, "cmtitle": "C", "cmcontinue": "m"}, {"query": {"categorymembers": [{"pageid": 3, "title": "c"}]}})
    for page in (1, 2, 3):
        record({**wiki.EXTRACT, "pageids": str(page)}, {"query": {"pages": {str(page): {"extract": f"text {page}"} if page != 2 else {}}}})
    for page in (1, 2):
        record({**wiki.MARKUP, "pageid": str(page)}, {"parse": {"text": {"*": f"<p>{page}"}}})
    wiki.register(spark)
    got = spark.read.format("mediawiki").option("replay", str(tmp_path)).option("category", "C").option("pagesPerPartition", 2).load()
    assert rows(got.where("error is null"), "seq", "page_id", "title", "text", "html") == [(0, 1, "a", "text 1", "<p>1"), (1, 2, "b", "", "<p>2")]
    assert rows(got.where("error is not null"), "page_id", "text", "html") == [(3, "text 3", None)]


def test_crawl_loop(spark, tmp_path):
    state = CrawlState(spark, str(tmp_path / "state"))
    found = spark.createDataFrame([(1, "http://h/a", "w"), (2, "HTTP://H:80/a#x", "w"), (3, "http://h/b?utm_id=1", "w")], "seq long, url string, source string")
    state.seed(found)
    state.seed(found)
    assert rows(state.frontier(), "id", "norm_url", "next_fetch_at") == [(1, "http://h/a", 0), (2, "http://h/b", 0)]
    assert rows(crawl.due(state.frontier(), 0, 5), "id") == [(1,), (2,)]

    body = b"<p>" + b"word " * 300
    batches = [
        [("http://h/a", 200, body, "e1", None, 100, None), ("http://h/b", None, None, None, None, 101, "timeout")],
        [("http://h/a", 304, None, None, None, 200, None), ("http://h/b", 200, b"short", "e2", None, 201, None)],
        [("http://h/a", 200, body, "e3", None, 300, None), ("http://h/b", 503, None, None, None, 301, None)],
        [("http://h/a", 200, b"tiny", "e4", None, 400, None)],
    ]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, crawl.RESPONSES).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(crawl.RESPONSES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = crawl_stream(state, stream, str(tmp_path / "checkpoint"), availableNow=True)
    query.awaitTermination(120)
    assert query.exception() is None
    docs = {r["norm_url"]: r for r in state.docs().collect()}
    assert docs["http://h/a"]["etag"] == "e4" and docs["http://h/a"]["fetched_at"] == 400 and bytes(docs["http://h/a"]["html"]) == b"tiny"
    assert docs["http://h/b"]["etag"] == "e2"
    front = {r["norm_url"]: r for r in state.frontier().collect()}
    assert (front["http://h/a"]["tries"], front["http://h/a"]["next_fetch_at"]) == (0, 400 + 86400)
    assert (front["http://h/b"]["tries"], front["http://h/b"]["next_fetch_at"], front["http://h/b"]["err"]) == (1, 303, "HTTP 503")
    # the text of a page that became too short stays
    assert state.texts().count() == 1
    requests = crawl.conditional_requests(crawl.due(state.frontier(), 10**6, 5), state.docs())
    assert rows(requests, "norm_url", "if_none_match") == [("http://h/a", "e4"), ("http://h/b", "e2")]


def test_changed_stream(spark, tmp_path):
    for i, batch in enumerate([[("k", 1, "a"), ("k", 2, "a"), ("l", 1, None)], [("k", 3, "a"), ("k", 4, "b"), ("l", 2, "x")]]):
        spark.createDataFrame(batch, "key string, seq long, content_hash string").coalesce(1).write.parquet(str(tmp_path / f"{i}"))
    stream = spark.readStream.schema("key string, seq long, content_hash string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    query = changed_stream(stream).writeStream.format("memory").queryName("changes").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert rows(spark.table("changes"), "key", "seq") == [("k", 1), ("k", 4), ("l", 2)]


def test_seeds(spark):
    members = spark.createDataFrame([(1, 5), (2, 0), (3, 7), (4, 8)], "seq long, page_id long")
    assert rows(crawl.category_seeds(members, "https://h/?curid={pageid}", "w", 2), "seq", "url") == [(1, "https://h/?curid=5"), (3, "https://h/?curid=7")]


def test_change_log(spark):
    log = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("l", 1, None)], "key string, seq long, content_hash string")
    assert rows(crawl.change_log(log).where(F.lit(True)), "key", "seq") == [("k", 1), ("k", 3)]


def test_last_meta_line_counts(spark, tmp_path):
    from lexaloom.operators.index import combined
    from lexaloom.sources.files import META, read_meta

    head = "\t".join(f.split()[0] for f in META.split(", "))
    (tmp_path / "meta.tsv").write_text(head + "\n1\t9\tz\tx\tr\tt\n2\t5\tb\tx\tr\tt\n1\t2\ta\truwiki\tr\tt\n")
    meta = read_meta(spark, str(tmp_path / "meta.tsv"))
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "doc_id long, text string")
    got = {r["local_id"]: (r["page_id"], r["title"], r["source_id"]) for r in combined([(docs, meta)]).collect()}
    assert got == {1: (2, "a", 1), 2: (5, "b", 3)}


def test_seeds_lose_all_white_space(spark, tmp_path):
    from lexaloom.sources.files import read_seeds

    (tmp_path / "seeds.txt").write_text("\thttps://a/\t\n\n \t \n  https://b/x y\x0b\n")
    assert [r["url"] for r in read_seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["https://a/", "https://b/x y"]


def test_new_urls_of_one_source_are_spread(spark):
    """Ids follow the order of URLs, and no task orders all URLs of a host."""
    from lexaloom.operators import crawl

    schema = "url string, norm_url string, source string, html binary, fetched_at long, etag string, last_modified string, content_hash string"
    urls = [f"https://ru.wikipedia.org/?curid={i * 37}" for i in range(300)] + ["https://a.org/", "https://a.org/x", "https://a.or/", "http://ru.wikipedia.org/?curid=1", "http:///", "odd", ""]
    news = spark.createDataFrame([(u, u, "w", b"", 1, None, None, "h") for u in urls], schema)
    got = crawl.upsert_docs(spark.createDataFrame([], crawl.DOCS), news).orderBy("id").collect()
    assert [r["norm_url"] for r in got] == sorted(urls) and [r["id"] for r in got] == list(range(1, len(urls) + 1))


def test_ranks_of_many_equal_counts(spark, monkeypatch):
    from lexaloom.operators import terms

    monkeypatch.setattr(terms, "RANKS_AT_ONCE", 4)
    counts = [5, 5, 3] + [1] * 23
    ranked = terms.rank_frequency(spark.createDataFrame([(f"t{i}", c) for i, c in enumerate(counts)], "term string, count long")).orderBy("rank").collect()
    assert [(r["rank"], r["frequency"]) for r in ranked] == list(enumerate(sorted(counts, reverse=True), 1))
