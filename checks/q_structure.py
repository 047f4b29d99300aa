"""Zones, boxes, lists, reference zones, per-document measures."""

from pyspark.sql import functions as F

from checks import overlay as ov
from checks import sqlbits as sb
from checks import structure_sql as ss
from checks.registry import query, table
from folioscope import fixed
from folioscope.functions import styles as st
from folioscope.operators import quality, references, review, zones

KEY = ["doc_id", "para_id"]


def structured(spark, sf):
    return zones.structure(ov.given(spark, sf))


def referenced(spark, sf):
    return references.with_reference_zone(structured(spark, sf))


@query("zone_segmentation", f"WITH {ov.GIVEN_SQL},{ss.zones()} SELECT doc_id, para_id, zone, box_type FROM z6")
def _(spark, sf):
    return zones.segment_zones(ov.overlay(spark, sf)).select(*KEY, "zone", "box_type")


@query("box_membership", f"WITH {ov.GIVEN_SQL},{ss.zones()} SELECT doc_id, para_id, box_marker, in_box, box_type FROM z6")
def _(spark, sf):
    return zones.with_boxes(ov.overlay(spark, sf)).select(*KEY, "box_marker", "in_box", "box_type")


@query("zone_counts", f"WITH {ov.GIVEN_SQL},{ss.zones()} SELECT doc_id, zone, count(*) AS n FROM z6 GROUP BY ALL")
def _(spark, sf):
    return zones.segment_zones(ov.overlay(spark, sf)).groupBy("doc_id", "zone").agg(F.count("*").alias("n"))


@query("table_cell_zone", f"""WITH {ov.GIVEN_SQL},{ss.zones()}
SELECT doc_id, para_id, 'TABLE' AS zone, coalesce(CASE WHEN in_box THEN {sb.box_zone('box_type')} END, 'TABLE') AS table_cell_zone, box_type FROM z6""")
def _(spark, sf):
    return zones.cell_zones(ov.overlay(spark, sf)).select(*KEY, "zone", "table_cell_zone", "box_type")


@query("document_section", f"""WITH {ov.GIVEN_SQL},{ss.zones()} SELECT doc_id, para_id, zone,
  CASE WHEN starts_with(zone, 'BOX_') THEN 'BODY' WHEN zone = 'METADATA' THEN 'FRONT_MATTER' ELSE zone END AS legacy_section,
  CASE WHEN starts_with(zone, 'BOX_') THEN 'BODY' ELSE zone END AS document_section FROM z6""")
def _(spark, sf):
    return zones.document_section(zones.segment_zones(ov.overlay(spark, sf))).select(
        *KEY, "zone", "legacy_section", "document_section")


@query("list_positions", ss.with_structure("SELECT doc_id, para_id, list_kind, list_position, CASE WHEN list_kind IS NOT NULL THEN 0 END AS list_level FROM s"))
def _(spark, sf):
    return structured(spark, sf).select(*KEY, "list_kind", "list_position", "list_level")


@query("ref_zone_start", ss.with_references("SELECT DISTINCT doc_id, ref_start, ref_trigger FROM rz"))
def _(spark, sf):
    return references.with_reference_start(ov.overlay(spark, sf)).groupBy("doc_id").agg(
        F.first("ref_start").alias("ref_start"), F.first("ref_trigger").alias("ref_trigger"))


@query("reference_zone", ss.with_references("SELECT doc_id, para_id, in_ref, ref_trigger, ref_start, ref_end FROM rz"))
def _(spark, sf):
    return references.with_reference_zone(ov.overlay(spark, sf)).select(
        *KEY, "in_ref", "ref_trigger", "ref_start", "ref_end")


PLAIN = "regexp_replace(text, '^References$', 'Entries')"


@query("ref_zone_density", f"""WITH {ov.GIVEN_SQL}, p AS (SELECT * REPLACE ({PLAIN} AS text) FROM g),{ss.references('p', density=True)}
SELECT doc_id, para_id, in_ref, ref_trigger, ref_start, ref_end FROM rz""")
def _(spark, sf):
    # Without the explicit heading, so the dense-window trigger has work to do.
    plain = ov.overlay(spark, sf).withColumn("text", F.expr(PLAIN))
    return references.with_reference_zone(plain, use_density=True).select(
        *KEY, "in_ref", "ref_trigger", "ref_start", "ref_end")


@query("ref_examples", ss.with_references("""SELECT doc_id, rank, para_id, snippet FROM (SELECT doc_id, para_id, left(text, 60) AS snippet,
  row_number() OVER (PARTITION BY doc_id ORDER BY para_id) AS rank FROM rz WHERE in_ref) WHERE rank <= 5"""))
def _(spark, sf):
    return references.reference_examples(referenced(spark, sf))


@query("doc_stats", ss.with_structure("""SELECT doc_id, count(*) AS total_paragraphs, sum(length(text))::BIGINT AS total_characters,
  (sum(length(text)) // 4)::BIGINT AS estimated_tokens, 0 AS table_paragraphs, count_if(has_numbering) AS numbered_items, count_if(has_bullet) AS bulleted_items FROM s GROUP BY doc_id"""))
def _(spark, sf):
    return quality.document_stats(zones.with_blocks(ov.overlay(spark, sf)))


@query("tag_distribution", ov.with_given("""SELECT doc_id, tag, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, tag) AS rank FROM
  (SELECT doc_id, tag, count(*) AS n FROM g GROUP BY ALL)) WHERE rank <= 12"""))
def _(spark, sf):
    return quality.tag_distribution(ov.given(spark, sf), per_document=12)


@query("list_tag", ss.with_structure(f"SELECT doc_id, para_id, {sb.list_tag('list_kind', 'list_position', 'zone', 'box_type', 'has_bullet', 'tag')} AS list_tag FROM s"))
def _(spark, sf):
    c = F.col
    return structured(spark, sf).select(
        *KEY, st.list_tag(c("list_kind"), c("list_position"), c("zone"), c("box_type"), c("has_bullet") | c("has_xml_list"), c("tag")).alias("list_tag"))


@query("zone_valid_exact", ss.with_structure(f"SELECT doc_id, para_id, zone, tag, {sb.exact_zone_ok('tag', 'zone')} AS valid FROM s"))
def _(spark, sf):
    return structured(spark, sf).select(*KEY, "zone", "tag", st.zone_accepts_exact("tag", "zone", sb.ZONES).alias("valid"))


@query("zone_valid_prefix", ss.with_structure(f"SELECT doc_id, para_id, zone, tag, {sb.wildcard_zone_ok('tag', 'zone')} AS valid FROM s"))
def _(spark, sf):
    return structured(spark, sf).select(*KEY, "zone", "tag", st.zone_accepts_wildcard("tag", "zone").alias("valid"))


ZONE_ROWS = [(z, s) for z, names in sb.ZONES.items() for s in names]


@query("zone_summary", ss.with_structure(f""", zr AS (SELECT zone, style FROM {sb.values(ZONE_ROWS, 'zone, style')}),
p AS (SELECT zone, CASE WHEN contains(style, '-') THEN split_part(style, '-', 1) || '-*' ELSE style END AS prefix FROM zr),
d AS (SELECT zone, list_sort(list(DISTINCT prefix)) AS ps FROM p GROUP BY zone), n AS (SELECT zone, count(*) AS rows_in_zone FROM s GROUP BY zone)
SELECT n.zone, n.rows_in_zone, CASE WHEN ps IS NULL THEN 'Full style range (no restrictions)' ELSE array_to_string(ps[1:15], ', ') ||
  CASE WHEN len(ps) > 15 THEN ' (+' || (len(ps) - 15) || ' more)' ELSE '' END END AS summary FROM n LEFT JOIN d USING (zone)"""))
def _(spark, sf):
    from folioscope.operators.dimensions import zone_summary

    found = structured(spark, sf).groupBy("zone").agg(F.count("*").alias("rows_in_zone"))
    return zone_summary(found, sb.ZONES)


@query("render_lines", ss.with_structure("""SELECT doc_id, para_id, '[' || para_id || ']' || CASE WHEN hints = '' THEN '' ELSE ' [' || hints || ']' END || ' ' ||
  CASE WHEN has_bullet AND NOT regexp_matches(text, '^\\s*[\\x{2022}\\-*\\x{25CF}\\x{25CB}\\x{25AA}]') THEN '• ' || text
       WHEN NOT has_bullet AND has_numbering AND NOT regexp_matches(text, '^\\s*[\\p{L}\\p{N}_]+\\.') THEN '1. ' || text ELSE text END AS line
FROM (SELECT *, concat_ws(' | ', CASE WHEN zone <> 'BODY' THEN zone END, CASE WHEN box_type IS NOT NULL THEN 'box:' || box_type END,
  CASE WHEN list_kind IS NOT NULL THEN 'LIST:' || concat_ws(',', list_kind, list_position) END,
  CASE WHEN caption_type IS NOT NULL THEN 'CAPTION:' || caption_type END, CASE WHEN source_line THEN 'SOURCE_LINE' END,
  CASE WHEN box_marker IS NOT NULL THEN 'BOX_MARKER:' || box_marker END) AS hints FROM s)"""))
def _(spark, sf):
    return structured(spark, sf).select(*KEY, review.prompt_line().alias("line"))


@query("chunk_paragraphs", ov.with_given("""SELECT doc_id, para_id, (rn - 1) // 30 + 1 AS chunk, (cnt + 29) // 30 AS chunk_count,
  min(para_id) OVER (PARTITION BY doc_id, (rn - 1) // 30) AS first_id, max(para_id) OVER (PARTITION BY doc_id, (rn - 1) // 30) AS last_id
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_id) AS rn, count(*) OVER (PARTITION BY doc_id) AS cnt FROM g WHERE confidence < 0.75)"""))
def _(spark, sf):
    return review.chunks(ov.given(spark, sf).where("confidence < 0.75"), size=30).select(
        *KEY, "chunk", "chunk_count", "first_id", "last_id")


@query("prompt_batches")
def _(spark, sf):
    return review.prompt_batches(structured(spark, sf))


@query("neighbor_context", ov.with_given("""SELECT doc_id, para_id, tag, before_tag, after_tag FROM (SELECT *, lag(tag) OVER w AS before_tag, lead(tag) OVER w AS after_tag
  FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY para_id)) WHERE confidence < 0.75"""))
def _(spark, sf):
    return review.neighbor_context(ov.given(spark, sf), below=0.75).select(*KEY, "tag", "before_tag", "after_tag")


# --- quality ---------------------------------------------------------------------

HEADINGS = """hv AS (SELECT *, CASE WHEN tag = 'H2' THEN NOT coalesce(max((tag = 'H1')::INT) OVER b, 0) = 1
  WHEN tag = 'H3' THEN coalesce(last_value(CASE WHEN tag IN ('H1', 'H2') THEN tag END IGNORE NULLS) OVER b, '') <> 'H2' ELSE false END AS heading_violation
  FROM {src} WINDOW b AS (PARTITION BY doc_id ORDER BY para_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
BOXES = """b1 AS (SELECT *, coalesce(box_marker = 'start', false) OR coalesce(starts_with(zone, 'BOX_'), false) AS inb FROM {src}),
b2 AS (SELECT *, inb AND (coalesce(box_marker = 'start', false) OR NOT coalesce(lag(inb AND coalesce(box_marker, '') <> 'end') OVER (PARTITION BY doc_id ORDER BY para_id), false)) AS st FROM b1),
b3 AS (SELECT *, sum(st::INT) OVER (PARTITION BY doc_id ORDER BY para_id ROWS UNBOUNDED PRECEDING) AS span FROM b2),
bx AS (SELECT doc_id, span, (NOT (bool_or(ends_with(tag, '-TYPE')) AND bool_or(ends_with(tag, '-TTL'))))::INT
  + coalesce(bool_or(box_label IS NOT NULL AND box_title AND ends_with(tag, '-TTL')), false)::INT AS v FROM b3 WHERE inb GROUP BY ALL)"""
ORPHANS = """orph AS (SELECT *, tag IN ('FIG-LEG', 'FIG-CRED', 'FIG-SRC', 'UNFIG-LEG', 'UNFIG-SRC') AND sum((tag IN ('FIG-LEG', 'FIG-CRED', 'FIG-SRC', 'UNFIG-LEG', 'UNFIG-SRC'))::INT) OVER w <= 1 AS figure_orphan,
  starts_with(tag, 'TFN') AND sum(regexp_matches(tag, '^(T|UNT|UNBX-T|TBL|TNL|TUL)')::INT) OVER w <= 1 AS table_orphan FROM {src}
  WINDOW w AS (PARTITION BY doc_id ORDER BY para_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"""
# The stand-in tagger has no H2 and few box, note or source tags; these do.
RETAG = """CASE WHEN tag = 'H1' AND para_id % 3 = 1 THEN 'H2' WHEN tag = 'TXT' AND para_id % 17 = 3 THEN 'NBX-TYPE' WHEN tag = 'TXT' AND para_id % 13 = 5 THEN 'BX2-TTL'
  WHEN tag = 'TXT' AND para_id % 19 = 7 THEN 'TFN' WHEN tag IN ('XYZ', 'H5') THEN 'TXT' ELSE tag END"""


def retagged(spark, sf):
    return structured(spark, sf).withColumn("tag", F.expr(RETAG))


RETAG_SQL = f"tg AS (SELECT * REPLACE ({RETAG} AS tag) FROM s)"


@query("heading_violations", ss.with_structure(f", {RETAG_SQL}, {HEADINGS.format(src='tg')} SELECT doc_id, para_id, tag, heading_violation FROM hv"))
def _(spark, sf):
    return quality.with_heading_violations(retagged(spark, sf)).select(*KEY, "tag", "heading_violation")


@query("box_integrity", ss.with_structure(f", {RETAG_SQL}, {BOXES.format(src='tg')} SELECT doc_id, sum(v)::BIGINT AS box_violations, count(*) AS spans FROM bx GROUP BY doc_id"))
def _(spark, sf):
    flagged = quality.with_box_violations(retagged(spark, sf))
    lagged = flagged.withColumn("inb", F.col("box_marker").eqNullSafe("start") | F.coalesce(F.col("zone").startswith("BOX_"), F.lit(False)))
    from folioscope.operators.ordered import ordered

    starts = F.col("inb") & (
        F.col("box_marker").eqNullSafe("start")
        | ~F.lag(F.col("inb") & ~F.col("box_marker").eqNullSafe("end"), 1, False).over(ordered())
    )
    return lagged.withColumn("st", starts).groupBy("doc_id").agg(
        F.sum("box_violations").alias("box_violations"), F.count_if("st").alias("spans")).where("spans > 0")


@query("figure_orphans", ss.with_structure(f", {RETAG_SQL}, {ORPHANS.format(src='tg')} SELECT doc_id, para_id, figure_orphan FROM orph"))
def _(spark, sf):
    return quality.with_orphans(retagged(spark, sf)).select(*KEY, "figure_orphan")


@query("table_orphans", ss.with_structure(f", {RETAG_SQL}, {ORPHANS.format(src='tg')} SELECT doc_id, para_id, table_orphan FROM orph"))
def _(spark, sf):
    return quality.with_orphans(retagged(spark, sf)).select(*KEY, "table_orphan")


def quality_sql(source: str, prefix: str = "") -> str:
    """CTEs ending in `q`: one scored row per document of `source` (columns tag, confidence)."""
    return f"""{sb.normalize_steps(source, 'tag', 'ntag', 'qn')},
q0 AS (SELECT * EXCLUDE (ntag) REPLACE (ntag AS tag) FROM qn9), {HEADINGS.format(src='q0')}, {ORPHANS.format(src='hv')}, {BOXES.format(src='q0')},
q1 AS (SELECT doc_id, count(*) AS total, count_if(tag = 'TXT') AS txt, count_if(confidence < 0.6) AS low, count_if(tag <> '' AND tag NOT IN {sb.VOCAB_SQL}) AS unknown_style_count,
  count_if(heading_violation) AS heading_violations, count_if(figure_orphan) AS figure_violations, count_if(table_orphan) AS table_violations FROM orph GROUP BY doc_id),
q2 AS (SELECT q1.*, coalesce(bv, 0) AS box_violations, txt / total AS tr, low / total AS lr FROM q1 LEFT JOIN (SELECT doc_id, sum(v)::BIGINT AS bv FROM bx GROUP BY doc_id) USING (doc_id)),
q3 AS (SELECT *, CASE WHEN unknown_style_count = 0 THEN greatest(0, least(100, round_even(100 - tr * 60 - lr * 20 - heading_violations * 5 - box_violations * 8 - figure_violations * 6 - table_violations * 6, 0)))::INT END AS score FROM q2),
q AS (SELECT doc_id, total, unknown_style_count, heading_violations, box_violations, figure_violations, table_violations, score, round(tr, 4) AS txt_ratio, round(lr, 4) AS low_conf_ratio,
  CASE WHEN score >= 85 THEN 'PASS' WHEN score >= 70 THEN 'RETRY' WHEN score IS NOT NULL THEN 'REVIEW' END AS action FROM q3)"""


# TXT is spread over list tags so that all three actions occur.
QTAG = "CASE WHEN tag = 'XYZ' AND doc_id % 10 <> 9 THEN 'PMI' WHEN tag = 'H5' THEN 'H1' WHEN tag = 'TXT' AND doc_id % 3 > 0 AND (para_id + doc_id) % 4 <> 0 THEN 'BL-MID' ELSE tag END"


@query("quality_score", ss.with_structure(f", qt AS (SELECT * REPLACE ({QTAG} AS tag) FROM s),{quality_sql('qt')} SELECT * FROM q"))
def _(spark, sf):
    tagged = structured(spark, sf).withColumn("tag", F.expr(QTAG))
    return quality.score_documents(tagged, sb.VOCAB, on_unknown="flag")


@query("confidence_summary", ov.with_given("""SELECT doc_id, count(*) AS total_paragraphs, count_if(c >= 85) AS auto_applied, count_if(c < 85) AS needs_review,
  round(100.0::DOUBLE * count_if(c >= 85) / count(*), 1) AS auto_apply_percentage, round(avg(c), 6) AS average_confidence FROM (SELECT doc_id, round(confidence * 100) AS c FROM g) GROUP BY doc_id"""))
def _(spark, sf):
    return quality.confidence_summary(ov.given(spark, sf).withColumn("confidence", F.round(F.col("confidence") * 100)))


@query("route_profile", ss.with_structure("""SELECT doc_id, round(r / n, 6) AS ref_ratio, round(t / n, 6) AS table_ratio, round(b / n, 6) AS box_ratio,
  CASE WHEN r / n >= 0.06 THEN 'reference_heavy' WHEN t / n >= 0.10 THEN 'table_heavy' WHEN b / n >= 0.05 THEN 'box_heavy' ELSE 'default' END AS profile
FROM (SELECT doc_id, count(*) AS n, 0 AS t, sum((contains(lower(text), 'doi') OR contains(lower(text), 'et al') OR contains(lower(text), 'journal'))::INT
    + (contains(lower(text), 'references') OR contains(lower(text), 'bibliography'))::INT + regexp_matches(lower(text), '(^\\\\d+\\\\.|\\\\[\\\\d+\\\\]|\\\\(\\\\d{4}\\\\))')::INT) AS r,
  sum((starts_with(zone, 'BOX_') OR box_marker IS NOT NULL)::INT + (contains(lower(text), 'box') OR contains(lower(text), 'key points') OR contains(lower(text), 'clinical pearl')
    OR contains(lower(text), 'skill') OR contains(lower(text), 'case'))::INT) AS b FROM s GROUP BY doc_id)"""))
def _(spark, sf):
    return quality.route_profile(structured(spark, sf))


# --- review ----------------------------------------------------------------------


@query("suspicious_top50", ov.with_given("""SELECT doc_id, para_id, tag, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
  ORDER BY confidence, CASE WHEN tag = 'TXT' THEN 0 ELSE 1 END, para_id) AS rank FROM g) WHERE rank <= 50"""))
def _(spark, sf):
    return review.suspicious(ov.given(spark, sf)).select(*KEY, "tag", "confidence", "rank")


@query("review_order", ov.with_given("""SELECT doc_id, para_id, queue, row_number() OVER (PARTITION BY doc_id, queue ORDER BY CASE WHEN queue = 'review' THEN confidence END, para_id) AS rank
  FROM (SELECT *, CASE WHEN confidence >= 0.85 THEN 'auto' ELSE 'review' END AS queue FROM g)"""))
def _(spark, sf):
    return review.review_order(ov.given(spark, sf), threshold=0.85).select(*KEY, "queue", "rank")
