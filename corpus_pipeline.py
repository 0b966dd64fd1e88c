"""A training-corpus pipeline over ``documents``: five stages, each one operator over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitory.llm import jaccard, langid, lines, packing, secrets
from visitory.llm.common import scratch, written
from visitory.llm.queries import VOCABULARY


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text, and n_chars to match if there is such a column."""
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, learned from those that are labelled; a missing lang becomes the predicted one.
    Those without any letter go, and those of many different runs of letters that are like no language of the table
    (see :func:`langid.detect`). Short or monotonous texts stay, and all with letters do where no language was learned."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), langid.held_out("doc_id", 3).alias("held_out"))
    languages = langid.learn(rows.filter("not held_out"))
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), langid.detect(F.col("text"), languages).alias("found"))
    found = found.filter("found.reason is null")
    if languages:
        lang = F.coalesce(F.col("row.lang"), F.col("found.lang_pred").cast(docs.schema["lang"].dataType))
        found = found.select(F.col("row").withField("lang", lang).alias("row"))
    return found.select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many documents share."""
    found = lines.drop_repeated(docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    return _with_text(found.select(F.col("row").withField("text", text).alias("row")).select("row.*"), F.col("text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id. A row goes for its own text only,
    never for its doc_id; documents with a null doc_id or without text stay."""
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return _with_text(docs, secrets.redacted(F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: No SQL: stages use trained profiles, nested decoding and a tokenizer; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next; what a stage wrote besides
    its result goes when it ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(written(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
