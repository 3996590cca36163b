"""Corpus operators: length filters, document numbers, sizes, token statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import clean_tail, ratio, stems, strip, tokens
from .ranking import numbered

#: Shortest texts that a crawl and a robot keep, in characters.
CRAWL_CHARS, ROBOT_CHARS = 200, 800
#: Document numbers of one source that are numbered by one task.
NUMBERS_AT_ONCE = 1 << 16


def long_enough(text: Column, least: int = CRAWL_CHARS) -> Column:
    return F.length(strip(text)) >= least


def collect_corpus(pages: DataFrame, least: int = CRAWL_CHARS) -> DataFrame:
    """Fetched pages (source, seq, page_id, title, text, html) as a corpus: tails cut,
    short texts dropped, failed fetches (null html) dropped, dense numbers per source in order of seq."""
    kept = pages.withColumn("text", clean_tail(F.coalesce("text", F.lit("")))).where(long_enough(F.col("text"), least) & F.col("html").isNotNull())
    block = F.floor(F.col("seq") / NUMBERS_AT_ONCE)
    # only (source, seq), which name a fetch, are ordered; texts are moved once, by both
    slim = numbered(kept.select("source", "seq"), [F.col("source"), block], [F.col("seq")], "__all")
    first = slim.groupBy("source").agg(F.min("__all").alias("__first"))
    numbers = slim.join(first, "source").select(F.col("source").alias("__source"), F.col("seq").alias("__seq"), (F.col("__all") - F.col("__first") + 1).alias("doc_id"))
    named = kept.join(numbers, F.col("source").eqNullSafe(F.col("__source")) & (F.col("seq") == F.col("__seq")))
    return named.select("source", "doc_id", "page_id", "title", "text", "html")


def crawl_counters(pages: DataFrame, least: int = CRAWL_CHARS) -> tuple[DataFrame, Observation]:
    """``pages`` unchanged, and counters (saved, skipped, failed) that any action on them fills."""
    seen = Observation("crawl")
    text = clean_tail(F.coalesce("text", F.lit("")))
    short = ~long_enough(text, least)
    failed = ~short & F.col("html").isNull()
    return pages.observe(seen, F.count_if(~short & ~failed).alias("saved"), F.count_if(short).alias("skipped"), F.count_if(failed).alias("failed")), seen


def size_statistics(sizes: DataFrame) -> DataFrame:
    """Of (source, size): per source and over all (source null): count, total, min, median, mean, max; the
    median and the mean are cut to whole numbers."""
    return sizes.rollup("source").agg(
        F.count("size").alias("n_files"), F.sum("size").alias("total"), F.min("size").alias("min_size"),
        F.percentile("size", F.lit(0.5)).cast("long").alias("median_size"), F.avg("size").cast("long").alias("mean_size"), F.max("size").alias("max_size"),
    )


def exploded_tokens(docs: DataFrame, stemmed: bool = False) -> DataFrame:
    """(doc_id, pos, term): all tokens in order, from 0."""
    words = tokens(F.col("text"))
    return docs.select("doc_id", F.posexplode(stems(words) if stemmed else words).alias("pos", "term"))


def token_statistics(docs: DataFrame) -> DataFrame:
    """Per document, without a shuffle: tokens_count, token_chars (characters before stemming), bytes_in."""
    words = tokens(F.col("text"))
    return docs.select("doc_id", F.size(words).cast("long").alias("tokens_count"), F.length(F.array_join(words, "")).cast("long").alias("token_chars"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes_in"))


def token_totals(statistics: DataFrame) -> DataFrame:
    """One row: sums, the average token length and tokens per KB of 1024 bytes."""
    sums = statistics.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tokens_count", "token_chars", "bytes_in")])
    return sums.withColumns({"avg_token_len": ratio(F.col("token_chars"), F.col("tokens_count")), "tokens_per_kb": ratio(F.col("tokens_count"), F.col("bytes_in") / 1024)})


def speed_kb_s(bytes_in: float, seconds: float) -> float:
    return bytes_in / 1024 / seconds if seconds > 0 else 0.0
