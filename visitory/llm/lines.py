"""Removal of lines that many documents share, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, with A-Z (no other letters) in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, mark, pos, h1, h2) of every line whose key is long enough; h1 and h2 are 128 bits of its key."""
    each = rows.filter("doc_id is not null").select("doc_id", "mark", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    each = each.select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least_chars)
    return each.select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def drop_repeated(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops every line whose key is found in at least ``least_docs`` documents, except in the largest id holding it.

    Returns, per row of ``docs``: row (a struct of all its columns, whatever their names), kept (the text without the
    dropped lines), n_lines (before dropping), n_dropped. A null or empty text is one empty line. Rows with a null id
    keep all lines and count for no key; rows that repeat an id count once. An empty table gives an empty result.

    Keys travel as 128-bit hashes, never as text. They are counted by (key, id) first, so a key that a third of all
    documents hold is spread out and combined before its final count. Texts move once, to meet their dropped positions.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))  # tells rows of one id with different texts apart
    lines = _lines(rows, least_chars)
    held = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("stays"))
    common = written(held.filter(F.col("n") >= least_docs).select("h1", "h2", "stays"), "common-lines")
    lost = lines.join(common, ["h1", "h2"]).filter("doc_id <> stays")
    lost = lost.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    met = rows.join(lost, ["doc_id", "mark"], "left").select("row", F.split("text", "\n", -1).alias("lines"), F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))

    def between(k: Column) -> Column:
        """The lines between the dropped ones numbered k - 1 and k."""
        first = F.when(k == 0, 1).otherwise(F.get("lost", k - 1) + 2)
        last = F.coalesce(F.get("lost", k), F.size("lines"))
        return F.slice("lines", first, last - first + 1)

    stay = F.flatten(F.transform(F.sequence(F.lit(0), F.size("lost")), between))
    return met.select(
        "row",
        F.when(F.size("lost") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(stay, "\n")).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("lost").cast("long").alias("n_dropped"),
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    found = drop_repeated(docs)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.stays AS lost
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
