"""Deterministic structural overlay on the given tables, in Spark and in SQL.

The given text has no headings, lists or references; the overlay derives them
from (doc_id, para_id, n, line) over the whole ``documents`` table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import table
from folioscope.sources.documents import by_document, parts_for

CASE = """CASE
  WHEN para_id = 1 AND doc_id % 4 = 0 THEN 'Book Title: ' || t0
  WHEN para_id = 1 AND doc_id % 4 = 1 THEN 'CHAPTER ' || (doc_id % 9 + 1)
  WHEN para_id = 1 AND doc_id % 4 = 2 THEN 'Introduction'
  WHEN para_id = 2 AND doc_id % 8 = 0 THEN 'Chapter 2'
  WHEN para_id = 3 AND doc_id % 3 <> 2 THEN 'Overview'
  WHEN doc_id % 3 = 0 AND n >= 8 AND para_id = floor(7 * n / 10) THEN 'References'
  WHEN doc_id % 3 = 0 AND n >= 8 AND para_id > floor(7 * n / 10) AND para_id % 6 <> 5 THEN para_id || '. Smith, J. et al. Journal of Tests. ' || (1990 + para_id % 30) || ';10:1-5. doi:10.1000/' || doc_id
  WHEN doc_id % 3 = 1 AND n >= 8 AND para_id = n - 5 THEN 'Sources'
  WHEN doc_id % 3 = 1 AND n >= 8 AND para_id > n - 5 AND para_id % 5 <> 0 THEN 'Smith, J. (' || (1990 + para_id % 30) || '). Press vol. ' || para_id
  WHEN (doc_id * 5 + para_id) % 23 = 0 THEN '<note>'
  WHEN (doc_id * 5 + para_id) % 23 = 3 THEN '</note>'
  WHEN (doc_id * 5 + para_id) % 31 = 7 THEN '<red flag>'
  WHEN (doc_id * 5 + para_id) % 31 = 11 THEN '</red flag>'
  WHEN (doc_id * 3 + para_id) % 13 = 0 THEN '<H1>' || t0
  WHEN (doc_id * 3 + para_id) % 17 = 0 THEN '<H3>' || t0
  WHEN (doc_id * 3 + para_id) % 19 = 0 THEN 'Table ' || para_id || '. ' || t0
  WHEN (doc_id * 3 + para_id) % 19 = 1 THEN 'Figure ' || para_id || '. ' || t0
  WHEN (doc_id * 3 + para_id) % 19 = 2 THEN 'Source: ' || t0
  WHEN (doc_id * 7 + CAST(floor(para_id / 3) AS BIGINT)) % 5 = 1 THEN '• ' || t0
  WHEN (doc_id * 7 + CAST(floor(para_id / 3) AS BIGINT)) % 5 = 3 THEN (para_id % 3 + 1) || '. ' || t0
  ELSE t0 END"""

GIVEN_CASE = """CASE
  WHEN (doc_id + para_id) % 11 = 0 THEN CASE (doc_id + para_id) % 5
    WHEN 0 THEN 'SK_H2' WHEN 1 THEN 'TBL-TXT' WHEN 2 THEN 'EFP_BX-TTL' WHEN 3 THEN 'H5' ELSE 'XYZ' END
  WHEN text LIKE '<H1>%' THEN 'H1' WHEN text LIKE '<H3>%' THEN 'H3' WHEN text LIKE '• %' THEN 'UL-MID'
  WHEN regexp_like(text, '^[0-9]') THEN 'NL-MID' WHEN text LIKE 'Table %' THEN 'T1'
  WHEN text LIKE 'Figure %' THEN 'FIG-LEG' ELSE 'TXT' END"""

GOLD_CASE = """CASE
  WHEN (doc_id + 2 * para_id) % 17 = 0 THEN 'UNMAPPED'
  WHEN text LIKE '<H1>%' THEN 'H1' WHEN text LIKE '<H3>%' THEN 'H3' WHEN text LIKE '• %' THEN 'UL-MID'
  WHEN regexp_like(text, '^[0-9]') THEN 'NL-MID' WHEN text LIKE 'Table %' THEN 'T1'
  WHEN text LIKE 'Figure %' THEN 'FIG-LEG' ELSE 'TXT' END"""

CONFIDENCE = "round(0.5 + ((doc_id * 13 + para_id * 7) % 50) / 100.0D, 2)"
SCORE = "round(1 - (para_id % 30) / 100.0D, 2)"


def _duck(expr: str) -> str:
    return expr.replace("regexp_like(", "regexp_matches(").replace("100.0D", "100.0::DOUBLE")


def _rows(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return _derive(table(spark, sf_dir, "documents"), columns)


def _derive(documents: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Whole documents placed by doc_id and split, with derived columns.

    The columns are built inside the document's line array, before the split,
    so every query reads them as plain values.
    """
    docs = documents.select("doc_id", "text")
    docs = by_document(docs, parts=parts_for(docs))
    kept = docs.select("doc_id", F.expr("filter(split(text, '\\n'), t -> trim(t) <> '')").alias("_k"))
    fields = "struct(CAST(i + 1 AS BIGINT) AS para_id, CAST(size(_k) AS BIGINT) AS n, t0)"
    expr = f"transform(_k, (t0, i) -> {fields})"
    for name, sql in columns.items():
        body = re.sub(r"\b(para_id|n|t0|text|tag)\b(?! AS)(?=([^']*'[^']*')*[^']*$)", r"r.\1", sql)
        kept_fields = ", ".join(f"r.{c} AS {c}" for c in ["para_id", "n", "t0", *columns][: 3 + list(columns).index(name)])
        expr = f"transform({expr}, r -> struct({kept_fields}, {body} AS {name}))"
    return kept.select("doc_id", F.expr(f"inline({expr})"))


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the whole documents, for what is made of them and as much work."""
    return parts_for(table(spark, sf_dir, "documents"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, para_id, n, t0)."""
    return _rows(spark, sf_dir, {})


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, para_id, n, text)."""
    return _rows(spark, sf_dir, {"text": CASE}).drop("t0")


def given_of(documents: DataFrame) -> DataFrame:
    return _derive(
        documents, {"text": CASE, "tag": GIVEN_CASE, "confidence": CONFIDENCE}
    ).drop("t0")


def given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlay plus the stand-in tagger's (tag, confidence)."""
    return given_of(table(spark, sf_dir, "documents"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(
        spark, sf_dir, {"text": CASE, "gold_tag": GOLD_CASE, "alignment_score": SCORE}
    ).drop("t0", "n")


LINES_SQL = """
_dl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t0,
               generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
_lines AS (SELECT * FROM _dl WHERE trim(t0) <> ''),
_p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS para_id,
              count(*) OVER (PARTITION BY doc_id) AS n, t0 FROM _lines)"""
OVERLAY_SQL = LINES_SQL + f""",
o AS (SELECT doc_id, para_id, n, {CASE} AS text FROM _p)"""
GIVEN_SQL = OVERLAY_SQL + f""",
g AS (SELECT *, {_duck(GIVEN_CASE)} AS tag, {_duck(CONFIDENCE)} AS confidence FROM o)"""
GOLD_SQL = OVERLAY_SQL + f""",
gold AS (SELECT doc_id, para_id, text, {_duck(GOLD_CASE)} AS gold_tag, {_duck(SCORE)} AS alignment_score FROM o)"""


def with_overlay(body: str) -> str:
    return f"WITH {OVERLAY_SQL} {body}"


def with_given(body: str) -> str:
    return f"WITH {GIVEN_SQL} {body}"


def with_gold(body: str) -> str:
    return f"WITH {GOLD_SQL} {body}"
