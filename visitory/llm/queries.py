"""Registered queries of this subpackage, one for each operator, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, caps, codes, html, jaccard, langid, lexical, lines, mixing, packing, secrets, sharding

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and what they decode to, as digests."""
    return bpe.digests(_table(spark, sf_dir, "documents"), VOCABULARY)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document by five-word shingles at a similarity of 0.8."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4,096 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), VOCABULARY)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text, learned from the documents that are not held out."""
    return mixing.scores(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text and in what is encoded in it."""
    return secrets.digests(_table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id 50 divides."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every whole text."""
    return langid.predictions(_table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that three or more share."""
    return lines.digests(_table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return html.main_text(_table(spark, sf_dir, "pages"))


def op10_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95."""
    return caps.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.best(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all vectors under codebooks that six rounds have refined."""
    return codes.coded(_table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of even row counts, in a uniformly random order."""
    return sharding.assignments(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_jaccard, op3_pack, op4_mixing, op5_secrets, op6_ann, op7_langid, op8_lines, op9_html, op10_caps, op11_search, op12_codes, op13_sharding)
}

ORACLE_SQL: dict[str, str] = {"op8_lines": lines.ORACLE_SQL, "op11_search": lexical.ORACLE_SQL, "op12_codes": codes.ORACLE_SQL}
