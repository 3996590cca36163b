"""Queries over the test tables, one per operator, and their DuckDB oracles.

The documents table stands in for a corpus: document n has local number n + 1,
page id n and title `doc-n`; its sources src0 and src1 count as the two known
ones. Where Cyrillic is needed, Latin letters are transliterated.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import normalize_url
from ..operators import corpus, crawl, index, terms
from ..sources import files
from . import boolean

LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхиыклмнопярстувьюйз"
PATTERN = "[0-9A-Za-zА-Яа-яЁё]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, cyrillic: bool = False) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.withColumn("text", F.translate(F.lower("text"), LATIN, CYRILLIC)) if cyrillic else docs


def _inputs(spark: SparkSession, sf_dir: str, several: bool = False) -> list:
    docs = _table(spark, sf_dir, "documents")
    source = F.when(F.col("source") == "src0", "ruwiki").when(F.col("source") == "src1", "ru_wikisource").otherwise(F.col("source"))
    own = docs.select((F.col("doc_id") + 1).alias("doc_id"), "text")
    meta = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("doc_id").alias("page_id"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("title"), source.alias("source"))
    out = [(own, meta)]
    if several:
        items = _table(spark, sf_dir, "benchmark")
        out.append((items.select((F.col("item_id") + 1).alias("doc_id"), "text"), items.select((F.col("item_id") + 1).alias("doc_id"), F.col("item_id").alias("page_id"), F.concat(F.lit("item-"), F.col("item_id")).alias("title"), F.lit("ru_wikisource").alias("source"))))
    return out


def _index(spark: SparkSession, sf_dir: str, several: bool = False) -> index.Index:
    return index.build_index(_inputs(spark, sf_dir, several))


#: Where the index of a table was saved by this session.
_SAVED: dict[tuple[str, str], str] = {}


def _saved_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index that all searches use; the first of them builds it, if ``index_saved`` did not."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SAVED:
        path = files.scratch(spark, "index")
        _index(spark, sf_dir).save(path)
        _SAVED[key] = path
    return index.load_index(spark, _SAVED[key])


def index_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds and saves the index anew; its dictionary, read back."""
    _SAVED.pop((spark.sparkContext.applicationId, sf_dir), None)
    return _saved_index(spark, sf_dir).dictionary


# --- tokens and corpus -------------------------------------------------------


def tokens_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exploded_tokens(_documents(spark, sf_dir))


def token_stats_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.token_statistics(_documents(spark, sf_dir))


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = corpus.token_totals(corpus.token_statistics(_documents(spark, sf_dir)))
    return sums.withColumns({c: F.round(c, 6) for c in ("avg_token_len", "tokens_per_kb")})


def stem_translit(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = terms.term_frequency(_documents(spark, sf_dir, cyrillic=True)).select("term")
    return words.select("term", T.stem(F.col("term")).alias("stem"))


STEM_CASES = (
    "фильм", "фильмы", "фильмами", "режиссёра", "режиссёр", "осень", "осени", "самая", "моими", "снимается", "снялись", "учиться", "боялась",
    "войны", "новых", "мою", "день", "дня", "семья", "стихотворениями", "объявлениями", "большой", "film", "фильм2", "он", "xфильмы", "1999",
)


def stem_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.range(1).select(F.explode(F.array(*map(F.lit, STEM_CASES))).alias("term"))
    return words.select("term", T.stem(F.col("term")).alias("stem"))


def doc_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where(corpus.long_enough(F.col("text"), 200)).select("doc_id")


TAIL_CASES = ("A\nЛитература\nB\nСсылки\nC", "  A  ", " x\nСм. также\ny", "Ссылки\nA", "A\nСсылки", "\nВнешние ссылки\n")


def clean_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1).select(F.posexplode(F.array(*map(F.lit, TAIL_CASES))).alias("n", "text"))
    return rows.select("n", T.clean_tail(F.col("text")).alias("cleaned"))


def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _documents(spark, sf_dir).groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"))
    return sizes.select("source", T.human_bytes(F.col("bytes")).alias("size"))


def corpus_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.size_statistics(_documents(spark, sf_dir).select("source", F.octet_length("text").alias("size")))


def corpus_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    pages = docs.select("source", F.col("doc_id").alias("seq"), F.col("doc_id").alias("page_id"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("title"), "text", F.when(F.col("doc_id") % 17 != 3, F.lit("<p>")).alias("html"))
    return corpus.collect_corpus(pages).select("source", "doc_id", "page_id", "title", F.length("text").cast("long").alias("n_chars"))


# --- terms -------------------------------------------------------------------


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequency(_documents(spark, sf_dir))


def term_frequency_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequency(_documents(spark, sf_dir, cyrillic=True), stemmed=True)


def term_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.totals(terms.term_frequency(_documents(spark, sf_dir)))


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.top_terms(terms.term_frequency(_documents(spark, sf_dir)), 100)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.rank_frequency(terms.term_frequency(_documents(spark, sf_dir)))


def zipf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


def zipf_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.zipf_curve(_ranked(spark, sf_dir))


def _rounded(fits: DataFrame) -> DataFrame:
    return fits.select("b", F.round("s", 6).alias("s"), F.round("c", 2).alias("c"), F.round("err", 2).alias("err"))


def mandelbrot_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(terms.mandelbrot_candidates(_ranked(spark, sf_dir)))


def mandelbrot_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(terms.mandelbrot_best(terms.mandelbrot_candidates(_ranked(spark, sf_dir))))


# --- index -------------------------------------------------------------------


def postings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings


def postings_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings_lists(_index(spark, sf_dir).postings).select("term", F.array_join(F.transform("docs", lambda d: d.cast("string")), ",").alias("docs"))


def dictionary_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).dictionary


def index_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, several=True).docs


def doc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_offsets(_index(spark, sf_dir).docs)


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = index.index_statistics(index.combined(_inputs(spark, sf_dir)))
    return stats.withColumns({c: F.round(c, 6) for c in ("avg_token_bytes", "avg_term_bytes")})


def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _index(spark, sf_dir, several=True).docs
    return docs.groupBy("source_id").agg(F.count("*").alias("docs"), F.min(index.document_url(F.col("source_id"), F.col("page_id"))).alias("first_url"))


# --- search ------------------------------------------------------------------

BOOLEAN = {
    "bool_and": "the && with",
    "bool_or": "the || und",
    "bool_not": "!the",
    "bool_nested": "(the && !and) || (of with)",
    "bool_implicit_and": "the of and",
    "bool_precedence": "the || of with",
    "bool_double_not": "!!the",
    "bool_missing_term": "the || nosuchterm",
    "bool_malformed_empty": "the, with",
    "bool_unbalanced": "(the (with)) )",
    "bool_de_morgan": "!(the || with) && !und",
}
#: What each query means, as conditions on has('term').
MEANING = {
    "bool_and": "{the} AND {with}",
    "bool_or": "{the} OR {und}",
    "bool_not": "NOT {the}",
    "bool_nested": "({the} AND NOT {and}) OR ({of} AND {with})",
    "bool_implicit_and": "{the} AND {of} AND {and}",
    "bool_precedence": "{the} OR ({of} AND {with})",
    "bool_double_not": "{the}",
    "bool_missing_term": "{the} OR {nosuchterm}",
    "bool_malformed_empty": "false",
    "bool_unbalanced": "{the} AND {with}",
    "bool_de_morgan": "NOT {the} AND NOT {with} AND NOT {und}",
}
BATCH = ("the && with", "   ", "", "!the", "the, with", "nosuchterm")


def _hits(query: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolean.hits(_saved_index(spark, sf_dir), query)


def search_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolean.search(_saved_index(spark, sf_dir), "the && !und", offset=20, limit=50)


def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolean.total(boolean.hits(_saved_index(spark, sf_dir), "of || (with !the)"))


def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolean.search_many(_saved_index(spark, sf_dir), BATCH, limit=10)


def search_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolean.hits_by_sets(_saved_index(spark, sf_dir), BOOLEAN["bool_nested"])


# --- crawl -------------------------------------------------------------------


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


def html_min_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_to_text(spark, sf_dir).where(F.length("text") >= crawl.TEXT_CHARS).select("page_id", F.length("text").cast("long").alias("n_chars"))


def content_hash_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.sha1(F.col("html").cast("binary")).alias("content_hash"))


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", normalize_url(F.col("url")).alias("norm_url"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url", F.lit("web").alias("source"))


def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 0 to 9 were found before; then all are, and each again without its parameters."""
    found = _found(spark, sf_dir)
    known = crawl.add_to_frontier(spark.createDataFrame([], crawl.FRONTIER), found.where("seq < 10"))
    bare = found.select((F.col("seq") + 1_000_000_000).alias("seq"), F.regexp_replace("url", "[?#].*$", "").alias("url"), "source")
    return crawl.add_to_frontier(known, found.union(bare)).select("id", "norm_url", "url")


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select(
        F.col("page_id").alias("id"), "url", normalize_url(F.col("url")).alias("norm_url"), F.lit("web").alias("source"), F.lit(crawl.PENDING).alias("status"),
        (F.col("page_id") % 15).cast("int").alias("tries"), F.lit(None).cast("long").alias("last_try"), (F.col("page_id") * 7919 % 100_000).alias("next_fetch_at"), F.lit(None).cast("string").alias("err"),
    )


def frontier_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.due(_frontier(spark, sf_dir), now=50_000, n=25).select("id", "next_fetch_at")


def frontier_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 15).select(F.col("id").alias("tries"), T.backoff_seconds(F.col("id")).alias("seconds"))


def _responses(pages: DataFrame) -> DataFrame:
    n = F.col("page_id") % 5
    return pages.select(
        normalize_url(F.col("url")).alias("norm_url"), F.when(n == 0, 304).when(n == 1, 500).otherwise(200).alias("status"), F.col("html").cast("binary").alias("html"),
        F.lit("e").alias("etag"), F.lit(None).cast("string").alias("last_modified"), (F.lit(60_000) + F.col("page_id")).alias("fetched_at"), F.when(n == 2, F.lit("timeout")).alias("error"),
    )


def _one_per_url(pages: DataFrame) -> DataFrame:
    first = pages.withColumn("norm_url", normalize_url(F.col("url"))).groupBy("norm_url").agg(F.min_by(F.struct("page_id", "url", "html"), F.col("page_id")).alias("p"))
    return first.select("p.*")


def frontier_reschedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _one_per_url(_table(spark, sf_dir, "pages"))
    some = _responses(pages.where("page_id % 7 < 5"))
    return crawl.reschedule(_frontier(spark, sf_dir), some).select("id", "tries", "last_try", "next_fetch_at", "err")


def _stored(pages: DataFrame) -> DataFrame:
    """Documents of two pages in three; of these every fourth has changed since."""
    old = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("old"))).otherwise(F.col("html")).cast("binary")
    return pages.where("page_id % 3 < 2").select(
        (F.col("page_id") + 1).alias("id"), "url", normalize_url(F.col("url")).alias("norm_url"), F.lit("web").alias("source"), old.alias("html"),
        F.lit(5).cast("long").alias("fetched_at"), F.lit("d").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.sha1(old).alias("content_hash"),
    )


def docs_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _one_per_url(_table(spark, sf_dir, "pages"))
    docs, responses = _stored(pages), _responses(pages)
    news = crawl.changed(responses, docs).join(pages.select(normalize_url(F.col("url")).alias("u"), "url"), F.col("norm_url") == F.col("u")).withColumn("source", F.lit("web"))
    return crawl.upsert_docs(docs, news).select("id", "norm_url", "fetched_at", "etag", "content_hash")


def conditional_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _one_per_url(_table(spark, sf_dir, "pages"))
    tasks = crawl.due(_frontier(spark, sf_dir), now=50_000, n=25)
    return crawl.conditional_requests(tasks, _stored(pages)).select("id", "norm_url", "if_none_match")


def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    fetches = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.sha1(F.col("event_type").cast("binary")).alias("content_hash"))
    return crawl.change_log(fetches)


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.col("page_id"))
    return crawl.category_seeds(members, "https://ru.wikipedia.org/?curid={pageid}", "ruwiki", 100)


# --- sources and sinks: written to the shared folder and read back ------------


def terms_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "terms")
    files.write_tsv(term_frequency(spark, sf_dir), path)
    return files.read_tsv(spark, path, "term string, count long")


def zipf_tsv_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "zipf")
    files.write_tsv(_ranked(spark, sf_dir), path)
    return terms.zipf_curve(files.read_tsv(spark, path, "rank long, frequency long"))


def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "tokens")
    files.write_tokens(corpus.exploded_tokens(_documents(spark, sf_dir)), path)
    return files.read_tokens(spark, path).groupBy("term").agg(F.count("*").alias("count"))


def token_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "token-meta")
    stats = corpus.token_statistics(_documents(spark, sf_dir))
    files.write_token_meta(stats.withColumn("doc_path", F.concat(F.lit("docs/"), F.format_string("%08d", "doc_id"), F.lit(".txt"))), path)
    return files.read_tsv(spark, path, "doc_path string, tok_file string, tokens_count long, token_chars long, bytes_in long")


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and characters of the text files of every source, a line feed after each text."""
    path = files.scratch(spark, "texts")
    _documents(spark, sf_dir).select(F.coalesce("text", F.lit("")).alias("text"), "source").write.partitionBy("source").text(path)
    source = F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")
    sizes = files.scan_files(spark, path).groupBy(source).agg(F.sum("length").alias("bytes"))
    chars = files.read_texts(spark, path).groupBy(source).agg(F.sum(F.length("text")).alias("chars"))
    return sizes.join(chars, "source")


def seed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "seeds")
    urls = _table(spark, sf_dir, "pages").select(F.concat(F.lit("\t "), "url", F.lit(" \t")).alias("value"))
    urls.union(spark.createDataFrame([("",), (" \t ",)], "value string")).write.text(path)
    return files.read_seeds(spark, path)


def meta_last_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document has two lines of metadata, an old one first."""
    path = files.scratch(spark, "meta")
    [(docs, meta)] = _inputs(spark, sf_dir)
    line = lambda n, page, title: meta.select(F.lit(n).alias("n"), "doc_id", page.alias("page_id"), title.alias("title"), "source", F.lit("r").alias("raw_file"), F.lit("t").alias("text_file"))
    both = line(0, F.col("page_id") + 1_000_000, F.lit("zzz")).union(line(1, F.col("page_id"), F.col("title")))
    files.write_tsv(both.orderBy("n", "doc_id").coalesce(1).drop("n"), path)
    return index.combined([(docs, files.read_meta(spark, path))]).select("local_id", "page_id", "title")


def search_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested query over an index that was saved and loaded: postings of other terms are not read."""
    path = files.scratch(spark, "index")
    _index(spark, sf_dir).save(path)
    return boolean.hits(index.load_index(spark, path), BOOLEAN["bool_nested"])


def leading_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(".tok"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit("_a9.tok")))
    return _documents(spark, sf_dir).select("doc_id", T.leading_doc_id(name).alias("leading"))


QUERIES = {
    f.__name__: f
    for f in (
        tokens_exploded, token_stats_per_doc, token_totals, stem_translit, stem_fixture, doc_min_length, clean_tail, human_bytes, corpus_size_stats, corpus_collect,
        term_frequency, term_frequency_stemmed, term_totals, top_terms, zipf_rank, zipf_curve, mandelbrot_candidates, mandelbrot_best,
        postings_long, postings_array, dictionary_df, index_docs, doc_offsets, index_stats, source_lookup, search_paged, search_total, search_batch, search_sets,
        html_to_text, html_min_chars, content_hash_sha1, url_normalize, url_dedup, frontier_due, frontier_backoff, frontier_reschedule, docs_upsert, conditional_requests, change_detection, page_urls,
        terms_tsv, zipf_tsv_curve, token_lines, token_meta, text_files, seed_lines, meta_last_line, index_saved, search_saved, leading_ids,
    )
}
QUERIES |= {name: partial(_hits, query) for name, query in BOOLEAN.items()}

# --- oracles -----------------------------------------------------------------

_WORDS = f"list_transform(regexp_extract_all(coalesce(text, ''), '{PATTERN}'), lambda w: lower(w))"
_CYR = f"list_transform(regexp_extract_all(translate(lower(coalesce(text, '')), '{LATIN}', '{CYRILLIC}'), '{PATTERN}'), lambda w: lower(w))"
_CUT = "CASE WHEN strlen({w}) < 6 OR regexp_matches({w}, '[0-9]') OR NOT regexp_matches({w}, '[а-яё]') OR strlen(regexp_replace({w}, '{rx}', '')) < 6 THEN {w} ELSE regexp_replace({w}, '{rx}', '') END"


def _stem_sql(table: str) -> str:
    """SQL that adds ``stem`` to a table of ``term``: three cuts, one after the other."""
    # fixed values: the endings, the longest that fits is cut
    endings = (
        "(иями|ями|ами|ыми|ими|ого|его|ому|ему|ых|их|ах|ях|ов|ев|ом|ем|ам|ям|ую|юю|ая|яя|ое|ее|ый|ий|ые|ие"
        "|а|я|о|е|ы|и|у|ю)$"
    )
    one, two, three = (_CUT.format(w=w, rx=rx) for w, rx in (("term", "(ся|сь)$"), ("s1", endings), ("s2", "[ьъ]$")))
    return f"SELECT * EXCLUDE (s1, s2), {three} AS stem FROM (SELECT *, {two} AS s2 FROM (SELECT *, {one} AS s1 FROM ({table})))"


_TERM = f"SELECT unnest({_WORDS}) AS term FROM documents"
_COUNTS = f"SELECT term, count(*) AS count FROM ({_TERM}) GROUP BY term"
_RANKED = f"SELECT row_number() OVER (ORDER BY count DESC, term) AS rank, count AS frequency FROM ({_COUNTS})"
_OFFSETS = "SELECT unnest([0.0, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0]::DOUBLE[]) AS b"
_FITS = f"""WITH r AS (SELECT * FROM ({_RANKED}) WHERE rank <= 2000), p AS (SELECT r.*, o.b FROM r CROSS JOIN ({_OFFSETS}) o),
l AS (SELECT b, -regr_slope(ln(frequency), ln(rank + b)) AS s, exp(regr_intercept(ln(frequency), ln(rank + b))) AS c FROM p GROUP BY b),
f AS (SELECT l.b, l.s, l.c, avg(pow(l.c / pow(p.rank + p.b, l.s) - p.frequency, 2)) AS err FROM p JOIN l ON l.b = p.b GROUP BY l.b, l.s, l.c)"""
_P = f"SELECT DISTINCT term, CAST(n AS INT) AS doc_id FROM (SELECT row_number() OVER (ORDER BY doc_id) AS n, unnest({_WORDS}) AS term FROM documents)"
_DOCS = """SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INT) AS doc_id, CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END AS source_id, doc_id AS page_id, 'doc-' || doc_id AS title, text FROM documents"""
_TWO = """SELECT CAST(row_number() OVER (ORDER BY o, page_id) AS INT) AS doc_id, source_id, page_id, title FROM (
 SELECT 0 AS o, CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END AS source_id, doc_id AS page_id, 'doc-' || doc_id AS title FROM documents
 UNION ALL SELECT 1, 2, item_id, 'item-' || item_id FROM benchmark)"""
_URL = "CASE source_id WHEN 2 THEN 'https://ru.wikisource.org/?curid=' ELSE 'https://ru.wikipedia.org/?curid=' END || page_id"


def _has(condition: str) -> str:
    import re

    return re.sub(r"\{(\w+)\}", r"EXISTS (SELECT 1 FROM p WHERE p.doc_id = d.doc_id AND p.term = '\1')", condition)


def _search_sql(condition: str) -> str:
    return f"WITH p AS ({_P}), d AS ({_DOCS}), h AS (SELECT d.* FROM d WHERE {_has(condition)})"


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?>.*?</script>', ' ', 'g'),
 '(?is)<style.*?>.*?</style>', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '\x{A0}', ' ', 'g')"""
_HTML_TEXT = rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \t\r\f\x0B]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM pages"
# the test URLs have lower-case hosts, no ports and at most the parameters below
_NORM = r"""regexp_replace(CASE WHEN regexp_matches(u, '^https?://[^/?]*$') THEN u || '/' ELSE u END, '\?$', '')"""
_NORMS = rf"""SELECT *, {_NORM} AS norm_url FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[^=&]*|gclid|fbclid|yclid)=[^&]*', '\1', 'g'), '&+$', '') AS u FROM pages)"""
_FIRST = f"SELECT * FROM ({_NORMS}) QUALIFY row_number() OVER (PARTITION BY norm_url ORDER BY page_id) = 1"
_STORED = f"""SELECT page_id + 1 AS id, norm_url, sha1(CASE WHEN page_id % 4 = 0 THEN html || 'old' ELSE html END) AS content_hash FROM ({_FIRST}) WHERE page_id % 3 < 2"""
_DUE = "SELECT page_id AS id, page_id * 7919 % 100000 AS next_fetch_at, norm_url FROM ({n}) WHERE page_id * 7919 % 100000 <= 50000 ORDER BY 2, 1 LIMIT 25"

ORACLES = {
    "tokens_exploded": f"SELECT doc_id, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS term FROM (SELECT doc_id, {_WORDS} AS w FROM documents)",
    "token_stats_per_doc": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens_count, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS token_chars, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes_in FROM (SELECT doc_id, text, {_WORDS} AS w FROM documents)",
    "token_totals": f"SELECT n AS tokens_count, c AS token_chars, b AS bytes_in, round(c / n, 6) AS avg_token_len, round(n / (b / 1024.0), 6) AS tokens_per_kb FROM (SELECT CAST(sum(len(w)) AS BIGINT) AS n, CAST(sum(length(array_to_string(w, ''))) AS BIGINT) AS c, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS b FROM (SELECT text, {_WORDS} AS w FROM documents))",
    "stem_translit": _stem_sql(f"SELECT DISTINCT unnest({_CYR}) AS term FROM documents"),
    "stem_fixture": _stem_sql("SELECT unnest([" + ", ".join(f"'{w}'" for w in STEM_CASES) + "]) AS term"),
    "doc_min_length": r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200",
    "clean_tail": "SELECT CAST(unnest([0, 1, 2, 3, 4, 5]) AS INT) AS n, unnest(['A', '  A  ', 'x', 'Ссылки' || chr(10) || 'A', 'A' || chr(10) || 'Ссылки', '']) AS cleaned",
    "human_bytes": "SELECT source, CASE WHEN b < 1024 THEN printf('%d B', b) WHEN b < 1048576 THEN printf('%d B (%.2f KB)', b, b / 1024.0) WHEN b < 1073741824 THEN printf('%d B (%.2f MB)', b, b / 1048576.0) ELSE printf('%d B (%.2f GB)', b, b / 1073741824.0) END AS size FROM (SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS b FROM documents GROUP BY source)",
    "corpus_size_stats": "SELECT source, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS total, CAST(min(strlen(text)) AS INT) AS min_size, CAST(trunc(median(strlen(text))) AS BIGINT) AS median_size, CAST(trunc(avg(strlen(text))) AS BIGINT) AS mean_size, CAST(max(strlen(text)) AS INT) AS max_size FROM documents GROUP BY ROLLUP (source)",
    "corpus_collect": r"SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS doc_id, doc_id AS page_id, 'doc-' || doc_id AS title, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200 AND doc_id % 17 <> 3",
    "term_frequency": _COUNTS,
    "term_frequency_stemmed": "SELECT stem AS term, count(*) AS count FROM (" + _stem_sql(f"SELECT unnest({_CYR}) AS term FROM documents") + ") GROUP BY stem",
    "term_totals": f"SELECT count(*) AS unique_terms, CAST(sum(count) AS BIGINT) AS total_tokens FROM ({_COUNTS})",
    "top_terms": f"SELECT * FROM ({_COUNTS}) ORDER BY count DESC, term LIMIT 100",
    "zipf_rank": _RANKED,
    "zipf_curve": f"SELECT rank, frequency, (SELECT max(count) FROM ({_COUNTS})) / rank AS zipf FROM ({_RANKED})",
    "mandelbrot_candidates": f"{_FITS} SELECT b, round(s, 6) AS s, round(c, 2) AS c, round(err, 2) AS err FROM f",
    "mandelbrot_best": f"{_FITS} SELECT b, round(s, 6) AS s, round(c, 2) AS c, round(err, 2) AS err FROM f ORDER BY f.err, b LIMIT 1",
    "postings_long": _P,
    "postings_array": f"SELECT term, string_agg(doc_id, ',' ORDER BY doc_id) AS docs FROM ({_P}) GROUP BY term",
    "dictionary_df": f"SELECT term, df, CAST(coalesce(sum(4 * df) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS postings_off FROM (SELECT term, count(*) AS df FROM ({_P}) GROUP BY term)",
    "index_docs": _TWO,
    "doc_offsets": f"SELECT doc_id, CAST(coalesce(sum(16 + strlen(title)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM ({_DOCS})",
    "index_stats": f"""WITH p AS ({_P}), t AS (SELECT term, count(*) AS df FROM p GROUP BY term), w AS ({_TERM}), d AS ({_DOCS})
SELECT (SELECT count(*) FROM d) AS docs_count, (SELECT count(*) FROM t) AS terms_count, (SELECT count(*) FROM w) AS total_tokens,
 (SELECT round(avg(strlen(term)), 6) FROM w) AS avg_token_bytes, (SELECT round(avg(strlen(term)), 6) FROM t) AS avg_term_bytes,
 (SELECT CAST(sum(20 + strlen(term)) AS BIGINT) FROM t) AS dict_bytes, (SELECT CAST(4 * sum(df) AS BIGINT) FROM t) AS postings_bytes, (SELECT CAST(8 + sum(24 + strlen(title)) AS BIGINT) FROM d) AS docs_bytes""",
    "source_lookup": f"SELECT source_id, count(*) AS docs, min({_URL}) AS first_url FROM ({_TWO}) GROUP BY source_id",
    "search_paged": f"{_search_sql('{the} AND NOT {und}')} SELECT (SELECT count(*) FROM h) AS total, doc_id, page_id, title, {_URL} AS url FROM h ORDER BY doc_id LIMIT 50 OFFSET 20",
    "search_total": f"{_search_sql('{of} OR ({with} AND NOT {the})')} SELECT count(*) AS total FROM h",
    "search_batch": f"""WITH p AS ({_P}), d AS ({_DOCS}), h AS (
 SELECT 0 AS query_id, d.* FROM d WHERE {_has("{the} AND {with}")} UNION ALL SELECT 3, d.* FROM d WHERE {_has("NOT {the}")}),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS r FROM h),
q AS (SELECT unnest([0, 3, 4, 5]) AS query_id)
SELECT q.query_id, (SELECT count(*) FROM h WHERE h.query_id = q.query_id) AS total, k.doc_id, k.page_id, k.title, CASE WHEN k.doc_id IS NOT NULL THEN {_URL} END AS url
FROM q LEFT JOIN k ON k.query_id = q.query_id AND k.r <= 10""",
    "search_sets": f"{_search_sql(MEANING['bool_nested'])} SELECT doc_id FROM h",
    "html_to_text": _HTML_TEXT,
    "html_min_chars": f"SELECT page_id, CAST(length(text) AS BIGINT) AS n_chars FROM ({_HTML_TEXT}) WHERE length(text) >= 800",
    "content_hash_sha1": "SELECT page_id, sha1(html) AS content_hash FROM pages",
    "url_normalize": f"SELECT page_id, norm_url FROM ({_NORMS})",
    "url_dedup": f"""WITH a AS (SELECT page_id AS seq, url, norm_url FROM ({_NORMS})),
known AS (SELECT min(seq) AS seq, norm_url FROM a WHERE seq < 10 GROUP BY norm_url),
bare AS (SELECT page_id + 1000000000 AS seq, url, norm_url FROM (SELECT *, {_NORM} AS norm_url FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, regexp_replace(url, '[?#].*$', '') AS u FROM pages))),
every AS (SELECT * FROM a UNION ALL SELECT * FROM bare),
f AS (SELECT min(seq) AS seq, norm_url FROM every GROUP BY norm_url)
SELECT row_number() OVER (ORDER BY f.norm_url NOT IN (SELECT norm_url FROM known), f.seq) AS id, f.norm_url, e.url FROM f JOIN every e ON e.seq = f.seq AND e.norm_url = f.norm_url""",
    "frontier_due": f"SELECT id, next_fetch_at FROM ({_DUE.format(n=_NORMS)})",
    "frontier_backoff": "SELECT tries, least(3600, CAST(pow(2, least(tries + 1, 12)) AS BIGINT)) AS seconds FROM range(0, 15) t(tries)",
    "frontier_reschedule": f"""WITH r AS (SELECT norm_url, page_id % 5 AS k, 60000 + page_id AS at FROM ({_FIRST}) WHERE page_id % 7 < 5),
f AS (SELECT page_id AS id, norm_url, CAST(page_id % 15 AS INT) AS tries, page_id * 7919 % 100000 AS next_fetch_at FROM ({_NORMS}))
SELECT id, CASE WHEN k IS NULL THEN tries WHEN k IN (1, 2) THEN tries + 1 ELSE 0 END AS tries, r.at AS last_try,
 CASE WHEN k IS NULL THEN next_fetch_at WHEN k IN (1, 2) THEN r.at + least(3600, CAST(pow(2, least(tries + 1, 12)) AS BIGINT)) ELSE r.at + 86400 END AS next_fetch_at,
 CASE k WHEN 1 THEN 'HTTP 500' WHEN 2 THEN 'timeout' END AS err FROM f LEFT JOIN r ON r.norm_url = f.norm_url""",
    "docs_upsert": f"""WITH p AS (SELECT *, sha1(html) AS new_hash FROM ({_FIRST})), s AS ({_STORED}),
n AS (SELECT p.norm_url, p.page_id, p.new_hash FROM p LEFT JOIN s ON s.norm_url = p.norm_url WHERE p.page_id % 5 > 2 AND s.content_hash IS DISTINCT FROM p.new_hash)
SELECT s.id, s.norm_url, CASE WHEN n.norm_url IS NULL THEN 5 ELSE 60000 + n.page_id END AS fetched_at, CASE WHEN n.norm_url IS NULL THEN 'd' ELSE 'e' END AS etag, coalesce(n.new_hash, s.content_hash) AS content_hash
FROM s LEFT JOIN n ON n.norm_url = s.norm_url
UNION ALL SELECT (SELECT max(id) FROM s) + row_number() OVER (ORDER BY norm_url), norm_url, 60000 + page_id, 'e', new_hash FROM n WHERE norm_url NOT IN (SELECT norm_url FROM s)""",
    "conditional_requests": f"WITH s AS ({_STORED}) SELECT d.id, d.norm_url, CASE WHEN s.norm_url IS NOT NULL THEN 'd' END AS if_none_match FROM ({_DUE.format(n=_NORMS)}) d LEFT JOIN s ON s.norm_url = d.norm_url",
    "change_detection": "SELECT key, seq, content_hash FROM (SELECT user_id AS key, event_id AS seq, sha1(event_type) AS content_hash, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_type FROM events) WHERE before IS DISTINCT FROM event_type",
    "page_urls": "SELECT page_id AS seq, 'https://ru.wikipedia.org/?curid=' || page_id AS url, 'ruwiki' AS source FROM pages WHERE page_id > 0 ORDER BY page_id LIMIT 100",
}
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(doc_path, ''), lambda x: ord(x)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"
ORACLES |= {
    "terms_tsv": _COUNTS,
    "index_saved": ORACLES["dictionary_df"],
    "zipf_tsv_curve": ORACLES["zipf_curve"],
    "token_lines": _COUNTS,
    "token_meta": f"SELECT doc_path, lpad(lower(hex({_FNV}::UBIGINT)), 16, '0') || '.tok' AS tok_file, tokens_count, token_chars, bytes_in FROM (SELECT *, printf('docs/%08d.txt', doc_id) AS doc_path FROM ({ORACLES['token_stats_per_doc']}))",
    "text_files": "SELECT source, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS chars FROM documents GROUP BY source",
    "seed_lines": r"SELECT regexp_replace(url, '^\s+|\s+$', '', 'g') AS url FROM pages",
    "meta_last_line": "SELECT doc_id + 1 AS local_id, doc_id AS page_id, 'doc-' || doc_id AS title FROM documents",
    "search_saved": f"{_search_sql(MEANING['bool_nested'])} SELECT doc_id FROM h",
    "leading_ids": r"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE CAST(doc_id AS INT) END AS leading FROM documents",
}
ORACLES |= {name: f"{_search_sql(condition)} SELECT doc_id FROM h" for name, condition in MEANING.items()}
