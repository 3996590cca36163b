"""The inverted index as tables: postings, dictionary, documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ratio, stem, stems, tokens
from .ranking import running_total

# Numbers of the known sources and the address of a page in each.
SOURCE_IDS = {"ruwiki": 1, "ru_wikisource": 2}
OTHER_SOURCE = 3
PAGE_ADDRESSES = {1: "https://ru.wikipedia.org/?curid=", 2: "https://ru.wikisource.org/?curid="}
DEFAULT_ADDRESS = PAGE_ADDRESSES[1]

#: Local document numbers that one task turns into global ones.
NUMBERS_AT_ONCE = 1 << 16


def source_id(name: Column) -> Column:
    """The number of a source; 0 for null, OTHER_SOURCE for unknown ones."""
    out = F.when(name.isNull(), 0)
    for known, number in SOURCE_IDS.items():
        out = out.when(name == known, number)
    return out.otherwise(OTHER_SOURCE)


def document_url(source: Column, page_id: Column) -> Column:
    base = F.when(F.lit(False), "")
    for number, address in PAGE_ADDRESSES.items():
        base = base.when(source == number, address)
    return F.concat(base.otherwise(DEFAULT_ADDRESS), page_id.cast("string"))


def combined(inputs: Sequence[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(source_ord, local_id, text, page_id, title, source_id) of several pairs of
    documents (doc_id, text) and metadata (doc_id, page_id, title, source), in order.

    Documents need a positive number and metadata with a title. Of repeated
    metadata the last line counts, by the column ``line`` that ``read_meta`` gives."""
    out: DataFrame | None = None
    for place, (docs, meta) in enumerate(inputs):
        order = F.col("line") if "line" in meta.columns else F.struct("page_id", "title", "source")
        last = meta.groupBy("doc_id").agg(F.max_by(F.struct("page_id", "title", "source"), order).alias("m"))
        good = last.where((F.col("doc_id") > 0) & (F.octet_length("m.title") > 0))
        one = docs.select("doc_id", "text").join(good, "doc_id").select(F.lit(place).alias("source_ord"), F.col("doc_id").cast("long").alias("local_id"), "text", F.col("m.page_id").cast("long").alias("page_id"), F.col("m.title").alias("title"), source_id(F.col("m.source")).alias("source_id"))
        out = one if out is None else out.unionByName(one)
    assert out is not None, "an index needs an input"
    return out


def global_ids(docs: DataFrame) -> DataFrame:
    """Adds doc_id: 1, 2, ... over (source_ord, local_id). Only these two are ordered, in
    blocks; texts are moved by both, so that no task gets the texts of a whole block."""
    key = ["source_ord", "local_id"]
    block = F.floor(F.col("local_id") / NUMBERS_AT_ONCE)
    slim = docs.groupBy(*key).agg(F.count("*").alias("__rows"))
    before = running_total(slim, [F.col("source_ord"), block], [F.col("local_id")], F.col("__rows"), "__before").select(*key, "__before")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("local_id"))  # over 1 where a number is repeated
    return docs.join(before, key).select(*docs.columns, (F.col("__before") + place).cast("int").alias("doc_id"))


def _words(docs: DataFrame, stemmed: bool, *kept: str) -> DataFrame:
    """The columns ``kept``, ``words`` and ``distinct``: each word or stem of the text once. Every step has a projection of its own, else texts are cut again for each use."""
    cut = docs.select(*kept, tokens(F.col("text")).alias("words"))
    once = cut.withColumn("distinct", F.array_distinct("words"))
    return once.withColumn("distinct", F.array_distinct(stems(F.col("distinct")))) if stemmed else once


def postings(docs: DataFrame, stemmed: bool = True) -> DataFrame:
    """(term, doc_id), each pair once: repeats go before the rows are multiplied, so there is no shuffle."""
    # explode() would add a filter on the size of the array, and with it cut every text a second time, ahead of the join
    return _words(docs, stemmed, "doc_id").select(F.explode_outer("distinct").alias("term"), "doc_id").where("term is not null")


def dictionary(pairs: DataFrame) -> DataFrame:
    """(term, df, postings_off): document frequency and the byte offset of the term's
    postings of 4 bytes each, in byte order of terms."""
    counted = pairs.groupBy("term").agg(F.count("*").alias("df"))
    return running_total(counted, [F.substring("term", 1, 2)], [F.col("term")], F.col("df") * 4, "postings_off")


def postings_lists(pairs: DataFrame) -> DataFrame:
    """(term, docs): ascending document numbers, as the binary file stores them."""
    return pairs.groupBy("term").agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))


def document_offsets(index_docs: DataFrame) -> DataFrame:
    """(doc_id, off): byte offset of each record of 16 bytes and the title."""
    block = F.floor(F.col("doc_id") / NUMBERS_AT_ONCE)
    return running_total(index_docs, [block], [F.col("doc_id")], F.lit(16) + F.octet_length("title"), "off").select("doc_id", "off")


@dataclass(frozen=True)
class Index:
    """postings (term, doc_id), dictionary (term, df, postings_off), docs (doc_id, source_id, page_id, title)."""

    postings: DataFrame
    dictionary: DataFrame
    docs: DataFrame

    def save(self, path: str) -> None:
        """Postings sorted by term, so that row groups of other terms are skipped. Texts are cut once: the ranges of the files are
        drawn from rows that are kept on disk meanwhile, and the dictionary is made from the written postings."""
        ours = self.postings.storageLevel == StorageLevel.NONE
        pairs = self.postings.persist(StorageLevel.DISK_ONLY) if ours else self.postings
        try:
            pairs.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        finally:
            if ours:
                pairs.unpersist(blocking=True)
        written = self.postings.sparkSession.read.parquet(f"{path}/postings")
        dictionary(written).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/dictionary")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")


def build_index(inputs: Sequence[tuple[DataFrame, DataFrame]], stemmed: bool = True) -> Index:
    docs = global_ids(combined(inputs))
    pairs = postings(docs, stemmed)
    return Index(pairs, dictionary(pairs), docs.select("doc_id", "source_id", "page_id", "title"))


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "dictionary", "docs")))


def index_statistics(docs: DataFrame, stemmed: bool = True) -> DataFrame:
    """One row of the index of ``combined`` documents: counts, average bytes of a token and of a term, bytes of the file's sections.

    Nothing of it depends on the documents' numbers, so texts are read and cut once: a document's own figures go with its first token."""
    words = _words(docs.withColumn("title_bytes", F.octet_length("title")), stemmed, "title_bytes").withColumn("df", F.size("distinct"))
    each = words.select("title_bytes", "df", F.posexplode_outer("words").alias("pos", "term"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    own = {"docs": F.lit(1), "df": F.col("df"), "title_bytes": F.col("title_bytes")}
    counted = each.groupBy("term").agg(F.count("term").alias("count"), *[F.sum(F.when(first, c)).alias(name) for name, c in own.items()])
    if stemmed:
        counted = counted.groupBy(stem(F.col("term")).alias("term")).agg(*[F.sum(c).alias(c) for c in ("count", *own)])
    sums = {"tokens": F.sum("count"), "token_bytes": F.sum(F.octet_length("term") * F.col("count")), "terms": F.count("term"), "term_bytes": F.sum(F.octet_length("term"))} | {c: F.sum(c) for c in own}
    known = counted.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in sums.items()])
    return known.select(
        F.col("docs").alias("docs_count"), F.col("terms").alias("terms_count"), F.col("tokens").alias("total_tokens"),
        ratio(F.col("token_bytes"), F.col("tokens")).alias("avg_token_bytes"), ratio(F.col("term_bytes"), F.col("terms")).alias("avg_term_bytes"),
        (20 * F.col("terms") + F.col("term_bytes")).alias("dict_bytes"), (4 * F.col("df")).alias("postings_bytes"), (8 + 8 * F.col("docs") + 16 * F.col("docs") + F.col("title_bytes")).alias("docs_bytes"),
    )
