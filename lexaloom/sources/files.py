"""File sources and sinks of the text pipeline."""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fnv1a64_hex, leading_doc_id, strip, valid_text
from ..operators.index import Index, document_offsets, postings_lists

META = "doc_id long, page_id long, title string, source string, raw_file string, text_file string"


def scan_files(spark: SparkSession, folder: str, ending: str = ".txt", recursive: bool = True) -> DataFrame:
    """(path relative to the folder, length, content) of files with an ending, whatever its case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    relative = F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path"))
    return found.where(F.endswith(F.lower("path"), F.lit(ending.lower()))).select(relative.alias("path"), "length", "content")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of all text files below a folder."""
    return scan_files(spark, folder).select("path", valid_text(F.col("content")).alias("text"))


def read_token_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of the token files in a folder whose names begin with a positive number."""
    docs = scan_files(spark, folder, ".tok", recursive=False)
    name = F.substring_index("path", "/", -1)
    return docs.select(leading_doc_id(name).alias("doc_id"), valid_text(F.col("content")).alias("text")).where("doc_id > 0")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(term) one row per line of token files; carriage returns at the end and empty lines are dropped."""
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").option("pathGlobFilter", "*.tok").text(folder)
    return lines.select(F.regexp_replace("value", "\\r+$", "").alias("term")).where("term <> ''")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(url) each line that isn't blank, trimmed."""
    return spark.read.text(path).select(strip(F.col("value")).alias("url")).where("url <> ''")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """The columns of META and ``line``, which rises from line to line: the file's
    name, then the place in it. A file is split by bytes, so the block and the
    place in the block keep the order of lines without counting them all."""
    rows = spark.read.schema(META).option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"').csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return rows.select(*rows.columns, place.alias("line"))


def read_queries(spark: SparkSession, path: str) -> list[str]:
    """The lines of a query file; a query is as long as a person types, so they fit the driver."""
    return [r["value"] for r in spark.read.text(path).collect()]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a local session that names none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = f"file://{tempfile.mkdtemp(prefix='lexaloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Column ``term``, one per line, as .tok files; tokens have no character that needs quotes."""
    tokens.select("term").write.mode("overwrite").option("extension", "tok").option("quote", "").csv(path)


def write_token_meta(statistics: DataFrame, path: str) -> None:
    """One line per document (doc_path, tokens_count, token_chars, bytes_in) with the name of its token file."""
    write_tsv(statistics.select("doc_path", token_file_name(F.col("doc_path")).alias("tok_file"), "tokens_count", "token_chars", "bytes_in"), path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").option("escape", '"').csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", "true").option("escape", '"').csv(path)


def token_file_name(path: Column) -> Column:
    return F.concat(fnv1a64_hex(path), F.lit(".tok"))


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Texts and markup as Parquet per source, metadata beside them with the names that the files of a plain corpus have."""
    corpus.select("source", "doc_id", "text", "html").write.mode("overwrite").partitionBy("source").parquet(f"{path}/docs")
    number = F.format_string("%08d", F.col("doc_id"))
    meta = corpus.select("doc_id", "page_id", "title", "source", F.concat(number, F.lit(".html")).alias("raw_file"), F.concat(number, F.lit(".txt")).alias("text_file"))
    write_tsv(meta, f"{path}/meta")


@dataclass(frozen=True)
class SourceConfig:
    """One thing to crawl: kind 'wiki_category' or 'seed_file'."""

    name: str
    kind: str
    api: str | None = None
    category: str | None = None
    url_pattern: str | None = None
    path: str | None = None
    max_seed: int = 40_000

    def __post_init__(self) -> None:
        needed = {"wiki_category": ("api", "category", "url_pattern"), "seed_file": ("path",)}
        if self.kind not in needed:
            raise ValueError(f"unknown kind of source: {self.kind}")
        if missing := [n for n in needed[self.kind] if not getattr(self, n)]:
            raise ValueError(f"{self.name} lacks {', '.join(missing)}")


@dataclass(frozen=True)
class CrawlConfig:
    sources: tuple[SourceConfig, ...]
    delay_sec: float = 0.2
    timeout_sec: int = 30
    recrawl_sec: int = 86_400
    min_text_chars: int = 800
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, given: dict) -> CrawlConfig:
        """From a parsed configuration file with ``logic`` and ``sources``; unknown settings are kept in ``extra``."""
        logic = dict(given.get("logic") or {})
        sources = tuple(SourceConfig(**s) for s in given.get("sources") or ())
        if not sources:
            raise ValueError("no sources")
        known = {k: logic.pop(k) for k in ("delay_sec", "timeout_sec", "recrawl_sec", "min_text_chars") if k in logic}
        return cls(sources=sources, extra=logic, **known)


# The binary index: a header of 128 bytes, then dictionary, postings and documents; all numbers little-endian.
MAGIC = b"MAIIRIDX"  # fixed value of the format
_HEADER = struct.Struct("<8sIIQQQQQQQQ48x")
_RECORD = struct.Struct("<IIII")


def write_binary_index(index: Index, path: str) -> None:
    """One file for readers of the binary format, written term by term by the driver, which holds a document's or a term's row at a time."""
    docs = index.docs.orderBy("doc_id")
    n_docs = docs.count()
    sizes = index.dictionary.selectExpr("count(*) n", "coalesce(sum(20 + octet_length(term)), 0) dict", "coalesce(sum(df) * 4, 0) post").first()
    doc_bytes = 8 + 8 * n_docs + (index.docs.selectExpr("coalesce(sum(16 + octet_length(title)), 0) b").first()["b"])
    at_dict = _HEADER.size
    at_post = at_dict + sizes["dict"]
    at_docs = at_post + sizes["post"]
    with open(path, "wb") as file:
        file.write(_HEADER.pack(MAGIC, 2, 3, n_docs, sizes["n"], at_dict, sizes["dict"], at_post, sizes["post"], at_docs, doc_bytes))
        for row in index.dictionary.orderBy("term").toLocalIterator():
            term = row["term"].encode()
            file.write(struct.pack("<I", len(term)) + term + struct.pack("<QII", row["postings_off"], row["df"], 0))
        for row in postings_lists(index.postings).orderBy("term").toLocalIterator():
            file.write(struct.pack(f"<{len(row['docs'])}I", *row["docs"]))
        file.write(struct.pack("<Q", n_docs))
        for row in document_offsets(index.docs).orderBy("doc_id").toLocalIterator():
            file.write(struct.pack("<Q", row["off"]))
        for row in docs.toLocalIterator():
            title = row["title"].encode()
            file.write(_RECORD.pack(row["doc_id"], row["source_id"], row["page_id"], len(title)) + title)


def _sections(data: bytes) -> tuple:
    magic, version, _, *numbers = _HEADER.unpack_from(data)
    if magic != MAGIC or version != 2:
        raise ValueError("not a binary index of version 2")
    return tuple(numbers)


def _terms(data: bytes) -> Iterator[tuple[str, int, int]]:
    _, n_terms, at, *_ = _sections(data)
    for _ in range(n_terms):
        (size,) = struct.unpack_from("<I", data, at)
        offset, df, _ = struct.unpack_from("<QII", data, at + 4 + size)
        yield data[at + 4 : at + 4 + size].decode(), df, offset
        at += 20 + size


def _documents(data: bytes) -> Iterable[tuple[int, int, int, str]]:
    n_docs, *_, at_docs, _ = _sections(data)
    base = at_docs + 8 + 8 * n_docs
    for i in range(n_docs):
        (offset,) = struct.unpack_from("<Q", data, at_docs + 8 + 8 * i)
        doc, source, page, size = _RECORD.unpack_from(data, base + offset)
        yield doc, source, page, data[base + offset + 16 : base + offset + 16 + size].decode()


def read_binary_index(spark: SparkSession, path: str) -> Index:
    """The tables of a binary index file, as large as one machine can hold."""
    with open(path, "rb") as file:
        data = file.read()
    at_postings = _sections(data)[4]
    terms = list(_terms(data))
    pairs = ((t, d) for t, df, off in terms for d in struct.unpack_from(f"<{df}I", data, at_postings + off))
    return Index(
        spark.createDataFrame(list(pairs), "term string, doc_id int"),
        spark.createDataFrame(terms, "term string, df long, postings_off long"),
        spark.createDataFrame([(d, s, p, t) for d, s, p, t in _documents(data)], "doc_id int, source_id int, page_id long, title string"),
    )
