"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, redaction of personal data, packing.

Each stage works on all that its predecessor kept and returns the columns of ``documents``; the last returns the packed
pieces. ``run`` writes every stage's result as Parquet in the shared folder, reads it again for the next and deletes it
once the next is written.

All stages take empty tables (and give none), more columns than ``COLUMNS`` (which don't pass the first stage), and rows
without an id; what they do with null and empty texts and with repeated rows is said at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import langid, linejoin, packing, pii, simhash
from tracewarden.llm.common import discard, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "word_bpe_49k.json"
#: A trained model and an iterative graph are no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognized; those without a letter (null and empty texts too) or without a likely language go.

    Repeated rows go or stay together. Rows without doc_id or lang aren't learned from.
    """
    docs = docs.select(*COLUMNS)
    found = langid.predict(docs, langid.fit(docs.filter(~langid.held_out()).select("doc_id", "text", "lang")))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= langid.REJECT_BELOW)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier line.

    A null text stays null; a text that loses all its lines becomes empty; repeated rows (id and text) are one document and
    get one result; rows without an id come first.
    """
    return _recounted(linejoin.dedup_lines(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Near copies are linked by SimHash fingerprints and verified on their shingle sets; an exact join of the sets finds those
    whose fingerprints don't meet.

    Texts without a word (null and empty ones) are copies of one another; one of equal rows stays; rows without an id come
    after all others.
    """
    return simhash.keep_one_of_each(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null and empty texts stay as they are, equal rows get equal texts."""
    return _recounted(pii.redact_documents(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of bounded length; null and empty texts are pieces of the end token alone."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from documents; the rows of the last."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            discard(before)
        before = docs
    return docs
