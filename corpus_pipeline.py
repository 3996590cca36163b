"""The training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's rows to the shared folder and reads them again as the next one's
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaloom.llm import langid, linededup, minhash, packing, quality
from lexaloom.llm.common import materialize, only_rows
from lexaloom.llm.queries import vocabulary

#: Documents whose likeliest language has a lower probability than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own quality score reaches the operator's threshold, whatever their id: null and repeated ones too."""
    scored = quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keyed=True)
    return only_rows(docs, scored.where("predicted = 1"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with letters whose own language is clear, whatever their id: null and repeated ones too."""
    found = langid.identify_languages(docs, keyed=True)
    return only_rows(docs, found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one resembles; n_chars follows the text. Rows of null ids stay as they are."""
    cut = linededup.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"]))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by five-word shingles; each
    text of a repeated id is a document, and so is each of a null id, after all others."""
    return minhash.drop_near_duplicates(docs, keep_null_ids=True)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in length-bucketed batches of token ids, which are written and read back."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("language", keep_languages),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_documents),
]

#: SQL can't express a trained classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
