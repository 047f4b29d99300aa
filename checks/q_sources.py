"""Sources, vocabularies and plain projections."""

from pyspark.sql import functions as F

from checks import overlay as ov
from checks import sqlbits as sb
from checks.registry import query, table
from folioscope import fixed
from folioscope.functions.text import preview
from folioscope.session import fresh_path
from folioscope.sources import documents as docs
from folioscope.sources import gold as gold_io
from folioscope.sources import vocabulary as vocab


@query("paragraphs", f"""
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
  generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
s AS (SELECT doc_id, ln, {sb.strip('raw')} AS text FROM d)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS para_id,
  count(*) OVER (PARTITION BY doc_id) AS n, text FROM s WHERE text <> ''""")
def _(spark, sf):
    return docs.paragraphs(table(spark, sf, "documents"))


@query("html_blocks", f"""
WITH c AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', '', 'g') AS h FROM pages),
m AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<(h[1-6]|p|li|td|th)(?:\\s[^>]*)?>', chr(1) || '\\1' || chr(2), 'g'),
   '(?i)</(?:h[1-6]|p|li|td|th)>', chr(1), 'g') AS h FROM c),
p AS (SELECT page_id, unnest(string_split(h, chr(1))) AS piece, generate_subscripts(string_split(h, chr(1)), 1) AS pos FROM m),
b AS (SELECT page_id, pos, lower(split_part(piece, chr(2), 1)) AS tag, split_part(piece, chr(2), 2) AS body FROM p WHERE contains(piece, chr(2))),
t AS (SELECT *, {sb.collapse("replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')")} AS text FROM b)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS para_id, tag, text,
  {sb.has('body', '(?i)<(b|strong)>')} AS is_bold, {sb.has('body', '(?i)<a[[:space:]]')} AS has_link,
  {sb.has('tag', '^h[1-6]$')} AS is_heading, tag IN ('td', 'th') AS is_table,
  {sb.has('text', fixed.BULLET_PATTERN)} AS has_bullet, {sb.has('text', fixed.NUMBERING_PATTERN)} AS has_numbering,
  tag = 'li' AS has_xml_list
FROM t WHERE text <> ''""")
def _(spark, sf):
    return docs.html_blocks(table(spark, sf, "pages"))


@query("table_cells", f"""
WITH {ov.LINES_SQL},
c AS (SELECT doc_id, para_id, n, t0, (para_id - 1) // 4 AS row_idx, (para_id - 1) % 4 AS col_idx FROM _p),
x AS (SELECT *, unnest(string_split(t0, '. ')) AS raw, generate_subscripts(string_split(t0, '. '), 1) - 1 AS para_in_cell FROM c),
s AS (SELECT *, {sb.strip('raw')} AS text FROM x)
SELECT doc_id, (n + 3) // 4 AS n_rows, least(n, 4) AS n_cols, row_idx, col_idx, para_in_cell, text,
  row_idx = 0 AS is_header_row, col_idx = 0 AS is_stub_col, row_idx = (n + 3) // 4 - 1 AS is_last_row,
  ((n + 3) // 4) || 'x' || least(n, 4) AS table_size
FROM s WHERE text <> ''""")
def _(spark, sf):
    whole = table(spark, sf, "documents").select(
        "doc_id", F.filter(F.split("text", "\n"), lambda t: F.trim(t) != "").alias("k")
    ).where(F.size("k") > 0)
    grid = whole.select(
        "doc_id",
        F.transform(
            F.sequence(F.lit(0), F.floor((F.size("k") - 1) / 4).cast("int")),
            lambda r: F.transform(F.slice("k", r * 4 + 1, F.lit(4)), lambda c: F.split(c, r"\. ")),
        ).alias("rows"),
    )
    return docs.table_cells(grid, ["doc_id"])


@query("truncate_preview", ov.with_overlay("""
SELECT doc_id, para_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS text_200,
  CASE WHEN length(text) > 160 THEN left(text, 160) || '...' ELSE text END AS text_160,
  CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS text_100 FROM o"""))
def _(spark, sf):
    t = F.col("text")
    return ov.overlay(spark, sf).select(
        "doc_id", "para_id", *[preview(t, k).alias(f"text_{k}") for k in (200, 160, 100)]
    )


def gold_table(spark, sf):
    """Gold rows in the stored shape (string ids, notes, zone)."""
    return ov.gold(spark, sf).select(
        F.concat(F.lit("book"), (F.col("doc_id") % 50).cast("string"), F.lit("_"), F.col("doc_id")).alias("doc_id"),
        F.col("para_id").cast("int").alias("para_index"),
        "text",
        "gold_tag",
        F.col("gold_tag").alias("canonical_gold_tag"),
        "alignment_score",
        F.concat(F.lit("pair:"), F.col("doc_id")).alias("notes"),
        F.lit("body").alias("zone"),
    )


GOLD_ROWS = """SELECT 'book' || (doc_id % 50) || '_' || doc_id AS doc_id, para_id AS para_index, text,
  gold_tag AS canonical_gold_tag, alignment_score FROM gold"""


@query("gold_load", ov.with_gold(GOLD_ROWS + """
WHERE gold_tag <> 'UNMAPPED' AND alignment_score >= 0.75 AND (doc_id + para_id) % 13 <> 0"""))
def _(spark, sf):
    path = fresh_path(spark, "gold-lines")
    rows = gold_table(spark, sf)
    packed = F.to_json(F.struct(*rows.columns))
    number = F.substring_index("doc_id", "_", -1).cast("long")
    # Every thirteenth line is cut off, as a broken writer would leave it.
    broken = (number + F.col("para_index")) % 13 == 0
    rows.select(F.when(broken, F.substring(packed, 1, 20)).otherwise(packed).alias("value")).write.text(path)
    return gold_io.usable_gold(gold_io.read_gold(spark, path)).select(
        "doc_id", "para_index", "text", "canonical_gold_tag", "alignment_score"
    )


@query("gold_sink_roundtrip", ov.with_gold(GOLD_ROWS))
def _(spark, sf):
    path = fresh_path(spark, "gold-sink")
    gold_io.write_gold(gold_table(spark, sf), path)
    return gold_io.read_gold(spark, path).select(
        "doc_id", "para_index", "text", "canonical_gold_tag", "alignment_score"
    )


FALLBACK = [(n,) for n in fixed.default_vocabulary()]


@query("vocab_build", ov.with_gold(f""", obs AS (SELECT DISTINCT gold_tag || ' ' AS style FROM gold),
listed AS (SELECT DISTINCT source AS style FROM documents),
fb AS (SELECT style FROM {sb.values(FALLBACK, 'style')} WHERE (SELECT count(*) FROM listed) < 50)
SELECT DISTINCT trim(style) AS style FROM (SELECT * FROM obs UNION ALL SELECT * FROM listed UNION ALL SELECT * FROM fb)
WHERE trim(style) <> ''"""))
def _(spark, sf):
    observed = ov.gold(spark, sf).select(F.concat("gold_tag", F.lit(" ")).alias("style")).distinct()
    listed = table(spark, sf, "documents").select(F.col("source").alias("style"))
    return vocab.build_vocabulary(observed, listed, spark.createDataFrame(FALLBACK, "style string"))


RAW = "' ' || tag || CASE WHEN doc_id % 3 = 0 THEN '-FIRST ' ELSE '' END"


@query("vocab_load", ov.with_given(f""", raw AS (
  SELECT DISTINCT {RAW} AS style FROM g UNION SELECT 'PMI' UNION SELECT 'H2 after H1'),{sb.normalize_steps('raw', 'style', 'norm')}
SELECT DISTINCT norm AS style FROM nz9 WHERE norm <> '' AND norm NOT IN {sb.in_list(fixed.INVALID_VOCABULARY_ENTRIES)}"""))
def _(spark, sf):
    raw = ov.given(spark, sf).select(F.expr(RAW).alias("style")).distinct()
    extra = spark.createDataFrame([("PMI",), ("H2 after H1",)], "style string")
    return vocab.load_vocabulary(raw.unionByName(extra))


FOLD = "CASE WHEN tag = 'TXT' AND doc_id % 2 = 1 THEN 'Txt' WHEN tag = 'T1' AND para_id % 2 = 0 THEN 't1' ELSE tag END"


@query("casefold_unique", ov.with_given(f""", v AS (SELECT DISTINCT {FOLD} AS style FROM g)
SELECT lower(style) AS folded, min(style) AS original FROM v GROUP BY 1 HAVING count(*) = 1"""))
def _(spark, sf):
    return vocab.casefold_lookup(ov.given(spark, sf).select(F.expr(FOLD).alias("style")))


NAME = "source || '_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.txt' ELSE '.docx.bak' END"


@query("file_filter", f"""WITH f AS (SELECT doc_id, {NAME} AS name FROM documents)
SELECT doc_id, name FROM f WHERE contains(name, '.') AND lower(split_part(name, '.', -1)) = 'docx'""")
def _(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.expr(NAME).alias("name"))
    return docs.document_files(files)
