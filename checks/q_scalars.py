"""Row predicates and text functions over the whole overlay."""

from pyspark.sql import functions as F

from checks import overlay as ov
from checks import sqlbits as sb
from checks.registry import query, table
from folioscope import fixed
from folioscope.functions import patterns as pt
from folioscope.functions import styles as st
from folioscope.functions import text as tx
from folioscope.operators import cache, review
from folioscope.operators.quality import alternatives, confidence_band, flagged_band
from folioscope.operators.rules import with_features

KEY = ["doc_id", "para_id"]
L = sb.low("text")


def TEXT():
    """Made when a query runs: importing must not need a session."""
    return F.col("text")


def rows(name, sql_columns: str, build):
    """Register a projection of the overlay: key columns plus ``build``."""
    query(name, ov.with_overlay(f"SELECT doc_id, para_id, {sql_columns} FROM o"))(
        lambda spark, sf: ov.overlay(spark, sf).select(*KEY, *build())
    )


rows("zone_flags",
     f"""{sb.any_has(L, fixed.METADATA_PATTERNS)} AS metadata, {sb.any_has(L, fixed.FRONT_MATTER_PATTERNS)} AS front_matter,
     {sb.any_has(L, fixed.CHAPTER_OPENER_PATTERNS)} AS opener, {sb.any_has(L, fixed.BODY_START_PATTERNS)} AS body_start,
     {sb.any_has(L, fixed.BACK_MATTER_PATTERNS)} AS back_matter""",
     lambda: [pt.has_metadata(TEXT()).alias("metadata"), pt.has_front_matter(TEXT()).alias("front_matter"),
              pt.is_chapter_opener(TEXT()).alias("opener"), pt.is_body_start(TEXT()).alias("body_start"),
              pt.is_back_matter(TEXT()).alias("back_matter")])
rows("box_markers",
     f"CASE WHEN {sb.box_start('text')} THEN 'start' WHEN {sb.box_end('text')} THEN 'end' END AS box_marker",
     lambda: [pt.box_marker(TEXT()).alias("box_marker")])
rows("box_type",
     f"{sb.box_type('text')} AS box_type, {sb.box_zone(sb.box_type('text'))} AS box_zone",
     lambda: [pt.box_type(TEXT()).alias("box_type"), pt.box_zone(pt.box_type(TEXT())).alias("box_zone")])
rows("caption_type", f"{sb.caption('text')} AS caption_type", lambda: [pt.caption_type(TEXT()).alias("caption_type")])
rows("source_line", f"{sb.any_has(L, fixed.SOURCE_LINE_PATTERNS)} AS source_line",
     lambda: [pt.is_source_line(TEXT()).alias("source_line")])
NAMED = "CASE (doc_id + para_id) % 29 WHEN 0 THEN 'Red Flag' WHEN 1 THEN 'note' WHEN 2 THEN 'Box ' || para_id || ' ' || text WHEN 3 THEN '<BT>' || text ELSE text END"
query("box_label_title", ov.with_overlay(f""", m AS (SELECT doc_id, para_id, {NAMED} AS text FROM o)
SELECT doc_id, para_id, CASE WHEN {L} IN {sb.in_list(fixed.BOX_PREFIXES)} THEN {L} END AS box_label,
  {sb.any_has(L, fixed.BOX_TITLE_PATTERNS)} AS box_title FROM m"""))(
    lambda spark, sf: ov.overlay(spark, sf).select(*KEY, F.expr(NAMED).alias("text")).select(
        *KEY, pt.box_label(TEXT()).alias("box_label"), pt.is_box_title(TEXT()).alias("box_title")))
rows("list_flags",
     f"""{sb.has(sb.strip('text'), fixed.BULLET_PATTERN)} AS has_bullet, {sb.has(sb.strip('text'), fixed.NUMBERING_PATTERN)} AS has_numbering,
     CAST(floor(para_id % 7 * 0.3::DOUBLE / 0.25) AS BIGINT) AS indent_level""",
     lambda: [pt.has_bullet(TEXT()).alias("has_bullet"), pt.has_numbering(TEXT()).alias("has_numbering"),
              pt.indent_level(F.col("para_id") % 7 * 0.3).alias("indent_level")])
rows("list_kind",
     f"""CASE WHEN {sb.has(sb.strip('text'), fixed.BULLET_PATTERN)} THEN 'bullet' WHEN {sb.has(sb.strip('text'), fixed.NUMBERING_PATTERN)} THEN 'numbered'
     WHEN para_id % 9 = 0 THEN 'unordered' WHEN {sb.has(sb.strip('text'), fixed.LETTERED_ITEM_PATTERN)} THEN 'unordered' END AS list_kind""",
     lambda: [pt.list_kind(pt.has_bullet(TEXT()), pt.has_numbering(TEXT()), F.col("para_id") % 9 == 0, TEXT()).alias("list_kind")])

CELL = "CASE para_id % 9 WHEN 0 THEN 'TableBody' WHEN 1 THEN 'tableheader' WHEN 2 THEN 'My Bullet' WHEN 3 THEN 'TFN' WHEN 4 THEN 'UNT-x' ELSE NULL END"
query("infer_table_style", ov.with_overlay(f""", c AS (SELECT doc_id, para_id, text, upper({CELL}) AS s, (para_id - 1) // 4 = 0 AS h, (para_id - 1) % 4 = 0 AS f FROM o)
SELECT doc_id, para_id, CASE WHEN s IN ('T', 'TABLEBODY', 'GT') THEN CASE WHEN f THEN 'T4' ELSE 'T' END
  WHEN s IN ('T2', 'TABLECOLUMNHEAD1', 'TABLEHEADER') THEN 'T2' WHEN contains(s, 'TBL') OR contains(s, 'BULLET') THEN 'TBL-MID'
  WHEN s IN ('TFN', 'TABLEFOOTNOTE') THEN 'TFN' WHEN starts_with(s, 'UNT') THEN CASE WHEN h THEN 'T2' WHEN f THEN 'T4' ELSE 'T' END
  WHEN h THEN 'T2' WHEN f THEN 'T4' WHEN left(text, 1) IN ('•', '-', '●', '○', chr(9)) THEN 'TBL-MID' ELSE 'T' END AS inferred_style FROM c"""))(
    lambda spark, sf: ov.overlay(spark, sf).select(
        *KEY, pt.infer_cell_style(F.expr(CELL), TEXT(), F.col("para_id") <= 4, (F.col("para_id") - 1) % 4 == 0).alias("inferred_style")))

rows("ref_entry", f"{sb.ref_entry('text')} AS ref_entry", lambda: [pt.is_reference_entry(TEXT()).alias("ref_entry")])
rows("citation_flags", f"{sb.citation('text', True)} AS strict, {sb.citation('text', False)} AS relaxed",
     lambda: [pt.is_citation(TEXT()).alias("strict"), pt.is_citation(TEXT(), strict=False).alias("relaxed")])
rows("ref_feature_any", f"{sb.feature_any('text')} AS ref_feature", lambda: [pt.has_reference_feature(TEXT()).alias("ref_feature")])
rows("numbered_not_ref", f"{sb.numbered_not_ref('text')} AS numbered_not_ref",
     lambda: [pt.is_numbered_not_reference(TEXT()).alias("numbered_not_ref")])
rows("ref_headings", f"{sb.ref_heading('text')} AS primary_heading, {sb.secondary_heading('text')} AS secondary_heading",
     lambda: [pt.is_reference_heading(TEXT()).alias("primary_heading"), pt.is_secondary_reference_heading(TEXT()).alias("secondary_heading")])
rows("zone_exit", f"{sb.zone_exit('text')} AS zone_exit", lambda: [pt.is_zone_exit(TEXT()).alias("zone_exit")])
query("t4_heading", ov.with_overlay(f""", c AS (SELECT doc_id, para_id, {sb.strip('text')} AS t FROM o),
w AS (SELECT *, list_filter(string_split_regex(t, '[[:space:]]+'), lambda x: x <> '') AS ws FROM c),
k AS (SELECT *, len(ws) AS nw, len(list_filter(ws, lambda x: {sb.has("regexp_replace(x, '[^A-Za-z0-9]', '', 'g')", '^[A-Z]')})) AS tw FROM w)
SELECT doc_id, para_id, (t <> '' AND length(t) <= 60 AND NOT {sb.has('t', '[.!?;:][[:space:]]*$')} AND NOT {sb.has('t', fixed.T4_NUMERIC_PATTERN)}
  AND ({sb.has('t', fixed.T4_CAPS_PATTERN)} OR (nw >= 2 AND tw >= greatest(1, floor(0.7::DOUBLE * nw))))) AS t4_heading FROM k"""))(
    lambda spark, sf: ov.overlay(spark, sf).select(
        *KEY, pt.is_t4_heading(F.expr("text")).alias("t4_heading")))
rows("inline_heading", "CASE WHEN regexp_matches(text, '(?i)^\\s*<H[1-6]>[\\p{L}\\p{N}_]') THEN 'H' || regexp_extract(text, '<[hH]([1-6])>', 1) END AS inline_heading",
     lambda: [pt.inline_heading(TEXT()).alias("inline_heading")])

W_SQL = "list_filter(string_split_regex(t, '[\\s\\x{00A0}]+'), lambda x: x <> '')"
query("rule_features", ov.with_overlay(f""", f AS (SELECT doc_id, para_id, text, {sb.strip('text')} AS t, CASE para_id % 5 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'BOX_NBX' WHEN 2 THEN 'BACK_MATTER' ELSE 'BODY' END AS zone FROM o),
w AS (SELECT *, {W_SQL} AS ws FROM f)
SELECT doc_id, para_id, length(text) AS length, len(ws) AS word_count, t = '' AS is_empty, length(t) < 50 AS is_short, length(t) > 500 AS is_long,
  {sb.has('t', fixed.FEATURE_NUMBERED_PATTERN)} AS has_number_prefix, {sb.has('t', fixed.FEATURE_LETTERED_PATTERN)} AS has_letter_prefix,
  {sb.has('t', fixed.FEATURE_ROMAN_PATTERN)} AS has_roman_prefix, {sb.has('t', fixed.REF_BULLET_PATTERN)} AS has_bullet,
  {sb.has('t', fixed.FEATURE_ALL_CAPS_PATTERN)} AS is_all_caps, {sb.has('t', '^[0-9]')} AS starts_with_digit,
  right(t, 1) = '.' AS ends_with_period, right(t, 1) = ':' AS ends_with_colon, {sb.has('text', fixed.YEAR_PATTERN)} AS has_citation_year,
  (t <> '' AND length(t) <= 200 AND NOT {sb.has('t', '[.!?][[:space:]]*$')} AND len(list_filter(ws, lambda x: {sb.has('x', '^[[:upper:]]')} OR {sb.has('x', '^[ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ]')})) >= greatest(1, floor(0.6::DOUBLE * len(ws)))) AS looks_like_heading,
  {sb.has('lower(t)', '^(figure|table|fig[.]|tab[.])')} AS looks_like_caption,
  (t <> '' AND ({sb.has('t', fixed.FEATURE_NUMBERED_PATTERN)} OR {sb.has('t', fixed.REF_BULLET_PATTERN)} OR (({sb.has('lower(t)', fixed.YEAR_PATTERN)} OR contains(lower(t), 'doi') OR contains(lower(t), 'et al')) AND {sb.count_chars('text', '.;:,')} >= 2))) AS looks_like_reference,
  (left(t, 1) IN ('*', '†', '‡') OR {sb.has('t', '^[a-z][)]')}) AS looks_like_footnote,
  zone = 'TABLE' AS is_in_table, starts_with(zone, 'BOX_') AS is_in_box, zone = 'BACK_MATTER' AS is_in_back_matter, zone,
  CASE WHEN para_id % 4 = 0 THEN 'bullet' END AS list_kind, CASE WHEN para_id % 4 = 0 THEN 'MID' END AS list_position FROM w"""))(
    lambda spark, sf: with_features(
        ov.overlay(spark, sf).drop("n"),
        zone=F.expr("CASE para_id % 5 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'BOX_NBX' WHEN 2 THEN 'BACK_MATTER' ELSE 'BODY' END"),
        list_kind=F.expr("CASE WHEN para_id % 4 = 0 THEN 'bullet' END"),
        list_position=F.expr("CASE WHEN para_id % 4 = 0 THEN 'MID' END")).drop("text"))

rows("text_normalize",
     f"""{sb.matching('text')} AS matching, lower({sb.collapse('text')}) AS comparison, {sb.collapse('text')} AS style,
     regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS stem""",
     lambda: [tx.matching_text(TEXT()).alias("matching"), tx.comparison_text(TEXT()).alias("comparison"),
              tx.style_text(TEXT()).alias("style"), tx.stem_key(TEXT()).alias("stem")])
query("tokenize", ov.with_overlay(f""", t AS (SELECT doc_id, para_id, regexp_extract_all({sb.matching('text')}, {sb.lit(fixed.TOKEN_PATTERN)}) AS ts FROM o)
SELECT doc_id, para_id, len(ts) AS n_tokens, array_to_string(ts, ' ') AS tokens FROM t"""))(
    lambda spark, sf: ov.overlay(spark, sf).select(*KEY, tx.tokens(tx.matching_text(TEXT())).alias("ts")).select(
        *KEY, F.size("ts").alias("n_tokens"), F.array_join("ts", " ").alias("tokens")))

query("string_similarity", ov.with_overlay("""
, d AS (SELECT doc_id, para_id, regexp_replace(lower(text), '[^a-z .]', '', 'g') AS a, lead(regexp_replace(lower(text), '[^a-z .]', '', 'g')) OVER (PARTITION BY doc_id ORDER BY para_id) AS b FROM o)
SELECT doc_id, para_id, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) AS similarity FROM d WHERE b IS NOT NULL"""))(
    lambda spark, sf: ov.overlay(spark, sf).select(
        *KEY, F.expr("regexp_replace(lower(text), '[^a-z .]', '')").alias("a"),
        F.expr("lead(regexp_replace(lower(text), '[^a-z .]', '')) OVER (PARTITION BY doc_id ORDER BY para_id)").alias("b"),
    ).where("b IS NOT NULL").select(*KEY, F.round(tx.edit_similarity(F.col("a"), F.col("b")), 6).alias("similarity")))


@query("string_similarity_ratio")
def _(spark, sf):
    """Ratio mode (Python, deduplicated pairs): benchmark names against tags."""
    pairs = ov.given(spark, sf).select(
        F.col("tag").alias("a"), F.expr("CASE WHEN para_id % 2 = 0 THEN upper(text) ELSE 'TXT-FLUSH' END").alias("b")
    ).distinct()
    return pairs.select("a", "b", F.round(tx.sequence_ratio(F.col("a"), F.col("b")), 6).alias("similarity"))


RAW_TAG = "CASE (doc_id + para_id) % 10 WHEN 0 THEN ' ' || tag || '  ' WHEN 1 THEN 'EFP_' || tag WHEN 2 THEN 'BX-' || tag WHEN 3 THEN tag || '-FIRST' WHEN 4 THEN 'BX4-' || tag || '-MID' WHEN 5 THEN 'EYU_BX-' || tag || '-LAST' WHEN 6 THEN 'REF-H1' WHEN 7 THEN 'NBX1-BL-LAST' WHEN 8 THEN 'TBL-H' || (para_id % 8) ELSE tag END"
query("normalize_style", ov.with_given(f", r AS (SELECT doc_id, para_id, {RAW_TAG} AS raw FROM g),{sb.normalize_steps('r', 'raw', 'style')} SELECT doc_id, para_id, raw, style FROM nz9"))(
    lambda spark, sf: ov.given(spark, sf).select(*KEY, F.expr(RAW_TAG).alias("raw")).select(
        *KEY, "raw", st.normalize_style(F.col("raw")).alias("style")))

FAMILY_SQL = """CASE WHEN norm = '' THEN 'TXT' WHEN starts_with(norm, 'H') AND regexp_matches(norm, '[0-9]') THEN 'H3'
  WHEN contains(norm, 'BL') OR contains(upper(norm), 'BULLET') THEN 'BL-MID' WHEN contains(norm, 'NL') OR contains(upper(norm), 'NUMBER') THEN 'NL-MID'
  WHEN contains(norm, 'REF') THEN 'REF-U' WHEN contains(norm, 'FIG') THEN 'FIG-LEG' WHEN starts_with(norm, 'T') AND regexp_matches(norm, '[0-9]') THEN 'T' ELSE 'TXT' END"""
# Tags as replies spell them, with free text mixed in.
WILD_TAG = f"CASE WHEN (doc_id + para_id) % 7 = 3 THEN upper(regexp_replace(text, '[^A-Za-z]', '-')) ELSE {RAW_TAG} END"
query("normalize_tag", ov.with_given(f""", r AS (SELECT DISTINCT {WILD_TAG.replace("'-')", "'-', 'g')")} AS raw FROM g),{sb.normalize_steps('r', 'raw', 'norm')},
x AS (SELECT raw, norm FROM nz9), un AS (SELECT * FROM x WHERE norm NOT IN {sb.VOCAB_SQL}),
near AS {sb.nearest_table('un', 'norm', 'style', True)}
SELECT raw, CASE WHEN norm IN {sb.VOCAB_SQL} THEN norm ELSE coalesce(near.style, {FAMILY_SQL}) END AS tag FROM x LEFT JOIN near ON near.tag = x.norm"""))(
    # The few bytes of the distinct tags are much work: they are dealt out as the documents are.
    lambda spark, sf: ov.given(spark, sf).select(F.expr(WILD_TAG).alias("raw")).distinct().repartition(ov.parts(spark, sf), "raw")
    .withColumn("norm", st.normalize_style(F.col("raw")))
    .select("raw", st.enforce_membership(F.col("norm"), sb.VOCAB).alias("tag")))

REPLY = "CASE (doc_id + para_id) % 6 WHEN 0 THEN 'Tag: ' || lower(tag) WHEN 1 THEN '**' || tag || '**' WHEN 2 THEN '' WHEN 3 THEN '???' WHEN 4 THEN 'likely T1 or H1' ELSE tag END"
query("sanitize_tag", ov.with_given(f""", r AS (SELECT doc_id, para_id, {REPLY} AS raw FROM g), u AS (SELECT *, upper(trim(raw)) AS up FROM r),
c AS (SELECT *, unnest(regexp_extract_all(up, '[A-Z0-9]+(?:[_-][A-Z0-9]+)*')) AS cand, generate_subscripts(regexp_extract_all(up, '[A-Z0-9]+(?:[_-][A-Z0-9]+)*'), 1) AS pos FROM u),{sb.normalize_steps('c', 'cand', 'norm')},
b AS (SELECT doc_id, para_id, min_by(cand, pos) FILTER (WHERE norm IN {sb.VOCAB_SQL}) AS known, min_by(cand, pos) AS any_tok FROM nz9 GROUP BY ALL)
SELECT u.doc_id, u.para_id, CASE WHEN up = '' THEN 'TXT' WHEN regexp_matches(up, '^[A-Z0-9]+(?:[_-][A-Z0-9]+)*$') THEN up ELSE coalesce(known, any_tok, 'TXT') END AS tag
FROM u LEFT JOIN b USING (doc_id, para_id)"""))(
    lambda spark, sf: ov.given(spark, sf).select(*KEY, F.expr(REPLY).alias("raw")).select(
        *KEY, st.sanitize_tag(F.col("raw"), sb.VOCAB).alias("tag")))

FOREIGN = "CASE (doc_id + para_id) % 8 WHEN 0 THEN 'Head-1' WHEN 1 THEN 'table_body' WHEN 2 THEN 'Figure Legend' WHEN 3 THEN 'BulletList1_first' WHEN 4 THEN 'EOC_NL' WHEN 5 THEN '<Red Flag>' WHEN 6 THEN 'para FL' ELSE tag END"
FOREIGN_V = sb.values(list(fixed.FOREIGN_STYLES.items()), "k, v")
query("style_map", ov.with_given(f""", r AS (SELECT doc_id, para_id, {FOREIGN} AS raw, confidence * 100 AS conf FROM g), m AS (SELECT k, v FROM {FOREIGN_V})
SELECT doc_id, para_id, raw, coalesce(a.v, b.v, c.v, 'TXT') AS tag, CASE WHEN coalesce(a.v, b.v, c.v) IS NULL THEN least(round(conf, 6), 50) ELSE round(conf, 6) END AS confidence
FROM r LEFT JOIN m a ON a.k = replace(replace(upper(raw), '-', ' '), '_', ' ') LEFT JOIN m b ON b.k = replace(replace(upper(raw), ' ', '-'), '_', '-') LEFT JOIN m c ON c.k = upper(raw)"""))(
    lambda spark, sf: ov.given(spark, sf).select(*KEY, F.expr(FOREIGN).alias("raw"), F.round(F.col("confidence") * 100, 6).alias("conf"))
    .withColumn("hit", st.foreign_style(F.col("raw")))
    .select(*KEY, "raw", F.coalesce("hit", F.lit("TXT")).alias("tag"),
            F.when(F.col("hit").isNull(), F.least("conf", F.lit(50.0))).otherwise(F.col("conf")).alias("confidence")))

ALT_CASE = "CASE tag " + " ".join(f"WHEN {sb.lit(k)} THEN {sb.lit('|'.join(v))}" for k, v in fixed.ALTERNATIVE_TAGS.items()) + " ELSE '' END"


query("alternatives", ov.with_given(f"SELECT doc_id, para_id, tag, CASE WHEN confidence * 100 >= 85 THEN '' ELSE {ALT_CASE} END AS alternatives FROM g"))(
    lambda spark, sf: ov.given(spark, sf).select(
        *KEY, "tag", F.array_join(alternatives(F.col("tag"), F.col("confidence") * 100), "|").alias("alternatives")))
query("confidence_bands", ov.with_given("""SELECT doc_id, para_id, CASE WHEN round(confidence * 100) >= 95 THEN 'high' WHEN round(confidence * 100) >= 85 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN round(confidence * 100) < 70 THEN 'low' ELSE 'medium' END AS flagged_band FROM g"""))(
    lambda spark, sf: ov.given(spark, sf).select(
        *KEY, confidence_band(F.round(F.col("confidence") * 100)).alias("band"), flagged_band(F.round(F.col("confidence") * 100)).alias("flagged_band")))

query("content_hash", ov.with_overlay("SELECT doc_id, sha256(string_agg(text, '' ORDER BY para_id)) AS content_hash FROM o GROUP BY doc_id"))(
    lambda spark, sf: cache.content_hash(ov.overlay(spark, sf)))
query("cache_key", ov.with_overlay(f"SELECT doc_id, para_id, left(sha256(doc_id || ':' || para_id || ':' || {sb.matching('text')} || ':' || 'BODY'), 16) AS cache_key FROM o"))(
    lambda spark, sf: ov.overlay(spark, sf).select(
        *KEY, cache.cache_key(F.col("doc_id"), F.col("para_id"), TEXT(), F.lit("BODY")).alias("cache_key")))

query("apply_markers", ov.with_given("SELECT doc_id, para_id, CASE WHEN starts_with(ltrim(text), '<') THEN text ELSE '<' || tag || '> ' || text END AS marked FROM g"))(
    lambda spark, sf: ov.given(spark, sf).select(
        *KEY, review.marked_text(TEXT(), F.col("tag")).alias("marked")))
