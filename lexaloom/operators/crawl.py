"""The state of an incremental crawler as tables that are rewritten by joins.

docs: id, url, norm_url, source, html, fetched_at, etag, last_modified, content_hash
frontier: id, url, norm_url, source, status, tries, last_try, next_fetch_at, err
responses: norm_url, status, html, etag, last_modified, fetched_at, error
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import backoff_seconds, html_bytes_to_text
from ..functions.urls import normalize_url
from .corpus import NUMBERS_AT_ONCE
from .ranking import numbered

PENDING = "pending"
RECRAWL_SECONDS = 86_400
TEXT_CHARS = 800

FRONTIER = "id long, url string, norm_url string, source string, status string, tries int, last_try long, next_fetch_at long, err string"
DOCS = "id long, url string, norm_url string, source string, html binary, fetched_at long, etag string, last_modified string, content_hash string"
RESPONSES = "norm_url string, status int, html binary, etag string, last_modified string, fetched_at long, error string"


def add_to_frontier(frontier: DataFrame, found: DataFrame) -> DataFrame:
    """``frontier`` and those of ``found`` (seq, url, source) whose normalized URL is
    new, the first of each by seq, due at once."""
    fresh = found.withColumn("norm_url", normalize_url(F.col("url"))).join(frontier.select("norm_url"), "norm_url", "left_anti")
    first = fresh.groupBy("norm_url").agg(F.min_by(F.struct("seq", "url", "source"), F.col("seq")).alias("f"))
    top = frontier.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    first = numbered(first, [F.floor(F.col("f.seq") / NUMBERS_AT_ONCE)], [F.col("f.seq")], "rank")
    added = first.select(
        (top + F.col("rank")).cast("long").alias("id"), F.col("f.url").alias("url"), "norm_url", F.col("f.source").alias("source"), F.lit(PENDING).alias("status"),
        F.lit(0).alias("tries"), F.lit(None).cast("long").alias("last_try"), F.lit(0).cast("long").alias("next_fetch_at"), F.lit(None).cast("string").alias("err"),
    )
    return frontier.unionByName(added)


def category_seeds(members: DataFrame, pattern: str, source: str, most: int) -> DataFrame:
    """(seq, url, source) of the first ``most`` positive page ids of (seq, page_id)."""
    good = members.where("page_id > 0").orderBy("seq").limit(most)
    return good.select("seq", F.replace(F.lit(pattern), F.lit("{pageid}"), F.col("page_id").cast("string")).alias("url"), F.lit(source).alias("source"))


def due(frontier: DataFrame, now: int, n: int = 1) -> DataFrame:
    """The next ``n`` tasks: pending and due, earliest first, then by id."""
    return frontier.where((F.col("status") == PENDING) & (F.col("next_fetch_at") <= now)).orderBy("next_fetch_at", "id").limit(n)


def conditional_requests(tasks: DataFrame, docs: DataFrame) -> DataFrame:
    """Each task with the validators of its stored document."""
    return tasks.join(docs.select("norm_url", "etag", "last_modified"), "norm_url", "left").select("id", "url", "norm_url", "source", F.col("etag").alias("if_none_match"), F.col("last_modified").alias("if_modified_since"))


#: Characters after the common beginning of a host's URLs by which new ones are dealt to tasks.
PREFIX = 3


def changed(responses: DataFrame, docs: DataFrame) -> DataFrame:
    """Successful responses whose content is new: (the responses' columns, content_hash)."""
    good = responses.where("error is null and status = 200").withColumn("content_hash", F.sha1("html"))
    known = docs.select(F.col("norm_url").alias("known_url"), F.col("content_hash").alias("known_hash"))
    return good.join(known, F.col("norm_url") == F.col("known_url"), "left").where(~F.col("known_hash").eqNullSafe(F.col("content_hash"))).drop("known_url", "known_hash")


def upsert_docs(docs: DataFrame, news: DataFrame) -> DataFrame:
    """``docs`` with every row of ``news`` (url, norm_url, source, html, fetched_at,
    etag, last_modified, content_hash) put in: a known URL keeps its id, the other
    columns are replaced; new ones get the next ids in order of their URLs."""
    fields = ["url", "source", "html", "fetched_at", "etag", "last_modified", "content_hash"]
    given = news.select(F.col("norm_url").alias("new_url"), F.struct(*fields).alias("new"))
    both = docs.join(given, F.col("norm_url") == F.col("new_url"), "full")
    top = docs.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    old = both.where("norm_url is not null").select("id", "norm_url", *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in fields])
    new = both.where("norm_url is null").select("new_url", "new")
    # a host's URLs are told apart by what follows their common beginning, so that no task orders a whole source
    host = F.regexp_extract("new_url", "^[^/]*(//[^/]*/?)?", 0)
    ends = new.groupBy(host.alias("host")).agg(F.min("new_url").alias("low"), F.max("new_url").alias("high"))
    alike = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("low"))), lambda i: F.left("low", i) == F.left("high", i)))
    known_host = ends.select(F.col("host"), alike.alias("alike"))
    marked = new.select(F.col("new_url"), host.alias("host")).join(known_host, "host")
    ranks = numbered(marked, [F.col("host"), F.left("new_url", F.col("alike") + PREFIX)], [F.col("new_url")], "rank").select(F.col("new_url").alias("ranked_url"), "rank")
    fresh = new.join(ranks, F.col("new_url") == F.col("ranked_url"))
    added = fresh.select((top + F.col("rank")).cast("long").alias("id"), F.col("new_url").alias("norm_url"), *[F.col(f"new.{c}").alias(c) for c in fields])
    return old.unionByName(added).select(*[f.split()[0] for f in DOCS.split(", ")])


def reschedule(frontier: DataFrame, responses: DataFrame, recrawl_seconds: int = RECRAWL_SECONDS) -> DataFrame:
    """After a success (200 or 304) the next fetch is ``recrawl_seconds`` later and
    tries are 0; after a failure tries grow and so does the wait."""
    met = responses.select(F.col("norm_url").alias("met_url"), "fetched_at", F.when(F.col("status").isin(200, 304) & F.col("error").isNull(), F.lit(None)).otherwise(F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status").cast("string")))).alias("failure"))
    joined = frontier.join(met, F.col("norm_url") == F.col("met_url"), "left")
    hit, bad = F.col("met_url").isNotNull(), F.col("failure").isNotNull()
    wait = F.when(bad, backoff_seconds(F.col("tries"))).otherwise(F.lit(recrawl_seconds))
    return joined.select(
        "id", "url", "norm_url", "source", "status",
        F.when(hit & bad, F.col("tries") + 1).when(hit, 0).otherwise(F.col("tries")).alias("tries"),
        F.when(hit, F.col("fetched_at")).otherwise(F.col("last_try")).alias("last_try"),
        F.when(hit, F.col("fetched_at") + wait).otherwise(F.col("next_fetch_at")).alias("next_fetch_at"),
        F.when(hit, F.col("failure")).otherwise(F.col("err")).alias("err"),
    )


def extracted_texts(news: DataFrame, least: int = TEXT_CHARS) -> DataFrame:
    """(name, text) of changed pages with enough text, a keyed output of its own."""
    return news.select(F.concat(F.sha1("norm_url"), F.lit(".txt")).alias("name"), html_bytes_to_text(F.col("html")).alias("text")).where(F.length("text") >= least)


def change_log(fetches: DataFrame) -> DataFrame:
    """Of (key, seq, content_hash): those fetches that differ from the key's fetch before."""
    before = F.lag("content_hash").over(Window.partitionBy("key").orderBy("seq"))
    return fetches.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("content_hash"))).drop("before")
