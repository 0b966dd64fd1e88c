"""The pipeline's stages on a small corpus with odd rows, and its parts together on a test table."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from visitory.llm.common import written

LINE = "All rights reserved by nobody in particular."


@pytest.fixture(scope="module")
def docs(spark):
    body = "the quick brown fox jumps over the lazy dog and runs away from it all every day number"
    rows = [(k, f"{body} {k} {k * 7} {k * 13}\n{LINE}", "en", "s", 10, "x") for k in range(12)]
    words = " ".join(f"word{k}" for k in range(60))
    rows += [(50, words, "en", "s", 1, None), (51, words + " more", "en", "s", 1, None), (52, words, None, "s", 1, None), (60, "12345 --- !!", "en", "s", 1, None), (61, None, "en", "s", None, None), (62, "", "en", "s", 0, None)]
    rows += [(70, 'my token = "abcdefghijklmnop" is here for a while and nobody will ever see it', "en", "s", 1, None), (None, "a document without any id in the table", "en", "s", 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")


def test_stages(spark, docs):
    got = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, at, ""), name)
        if name != "packing":
            assert made.columns == docs.columns
        got[name], at = {r.doc_id: r for r in made.collect()}, made
    assert set(got["language_id"]) == {r.doc_id for r in docs.collect()} - {60, 61, 62}
    texts = got["line_dedup"]
    assert all(LINE not in texts[k].text for k in range(11)) and LINE in texts[11].text
    assert all(r.n_chars == len(r.text) for r in texts.values())
    assert set(got["near_dedup"]) == set(texts) - {51, 52}
    assert got["secret_scan"][70].text == 'my [redacted]" is here for a while and nobody will ever see it'
    assert set(got["packing"]) == set(got["secret_scan"])


@pytest.mark.parametrize("lang", [None, "und"])
def test_language_stage_keeps_documents_of_any_label(spark, docs, lang):
    kept = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(lang).cast("string")), "")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {60, 61, 62}


def test_language_stage_labels_and_rejects(spark):
    en = [(k, " ".join(random.Random(k).choices("the and of to in was with that from".split(), k=30)), "en" if k else None) for k in range(20)]
    rows = [*en, (30, "".join(random.Random(1).choices("абвгдежзиклмнопрстуфхц ", k=600)), None), (31, "да", None)]
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert kept == {k: "en" for k in [*range(20), 31]}


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_near_stage_decides_by_row(spark, order):
    a = " ".join(f"word{k}" for k in range(60))
    rows = [(3, a), (5, a + " more"), (5, " ".join(f"other{k}" for k in range(60)))]
    made = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string").repartition(1)
    assert sorted(tuple(r) for r in corpus_pipeline.near_dedup(spark, made, "").collect()) == [rows[0], rows[2]]


def test_empty(spark, docs):
    at = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, ""), name)
        assert at.count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert 0 < len(ids) <= docs.count()
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
