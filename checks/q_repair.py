"""Repair ladder, passes, zone post-check and the flagship composition."""

from pyspark.sql import functions as F

from checks import overlay as ov
from checks import sqlbits as sb
from checks import structure_sql as ss
from checks.q_structure import KEY, quality_sql, referenced, structured
from checks.registry import query
from folioscope import fixed
from folioscope.functions import styles as st
from folioscope.operators import quality, references, repair, zones
from folioscope.plans.structure import structure_corpus

V = sb.VOCAB
OUT = ["doc_id", "para_id", "tag", "confidence", "repaired", "repair_reason"]


class Ladder:
    """Builds one CTE per rung."""

    def __init__(self, source: str, prefix: str = "k"):
        self.ctes, self.last, self.prefix, self.n = [], source, prefix, 0

    def add(self, select: str) -> "Ladder":
        self.n += 1
        name = f"{self.prefix}{self.n}"
        self.ctes.append(f"{name} AS ({select.replace('@', self.last)})")
        self.last = name
        return self

    def norm(self, column: str, out: str) -> "Ladder":
        self.n += 1
        p = f"{self.prefix}n{self.n}_"
        self.ctes.append(sb.normalize_steps(self.last, column, out, p).strip())
        self.last = f"{p}9"
        return self

    def step(self, cond: str, value: str, reason: str) -> "Ladder":
        return self.add(
            f"SELECT * REPLACE (CASE WHEN {cond} THEN {value} ELSE tag END AS tag, "
            f"CASE WHEN {cond} THEN why || {reason if reason.startswith('(') else sb.lit(',' + reason)} ELSE why END AS why) FROM @"
        )

    def sql(self) -> str:
        return ",\n".join(self.ctes)


LIST = sb.list_tag("list_kind", "list_position", "zone", "box_type", "has_bullet", "tag")


def prepared(source: str = "rz", prefix: str = "k") -> Ladder:
    lad = Ladder(source, prefix)
    lad.add(f"SELECT *, tag AS input_tag, '' AS why, {sb.strip('text')} AS t, {sb.ref_entry('text')} AS entry, coalesce({sb.box_prefix('zone', 'box_type')}, 'NBX') AS fam FROM @")
    lad.norm("tag", "norm")
    lad.add(f"SELECT *, norm IN {sb.VOCAB_SQL} AND confidence >= 0.9 AS lock, CASE WHEN {sb.has('t', fixed.REF_BULLET_PATTERN)} THEN 'REF-U' ELSE 'REF-N' END AS reftag FROM @")
    return lad


def table_rungs(lad: Ladder) -> None:
    foot = "(starts_with(lower(t), 'note') OR starts_with(lower(t), 'source') OR left(t, 1) IN ('*', '†') OR regexp_matches(t, '(?i)^[a-z][)]'))"
    here = "NOT lock AND zone = 'TABLE'"
    lad.step(f"{here} AND regexp_matches(input_tag, '^(SK_H|TBL-H)[1-6]$')", "'TH' || right(input_tag, 1)", "zone-table-heading-map")
    lad.step(f"{here} AND {foot}", "'TFN'", "zone-table-footnote")
    lad.step(f"{here} AND tag = 'TBL-TXT'", "'TD'", "zone-table-txt-to-td")
    t4 = f"""(t <> '' AND length(t) <= 60 AND NOT {sb.has('t', '[.!?;:][[:space:]]*$')} AND NOT {sb.has('t', fixed.T4_NUMERIC_PATTERN)} AND ({sb.has('t', fixed.T4_CAPS_PATTERN)} OR
      (len(list_filter(string_split_regex(t, '[[:space:]]+'), lambda x: x <> '')) >= 2 AND len(list_filter(string_split_regex(t, '[[:space:]]+'), lambda x: regexp_matches(regexp_replace(x, '[^A-Za-z0-9]', '', 'g'), '^[A-Z]')))
       >= greatest(1, floor(0.7::DOUBLE * len(list_filter(string_split_regex(t, '[[:space:]]+'), lambda x: x <> '')))))))"""
    lad.add(f"SELECT *, CASE WHEN NOT ({here}) THEN '' WHEN regexp_matches(tag, '^(BL|UL|NL)-') THEN 'T|zone-table-list' WHEN tag IN ('TXT', 'TXT-FLUSH', 'T') AND NOT {foot} THEN "
            f"CASE WHEN hdr THEN 'T2|zone-table-header-row' WHEN stub THEN 'T4|zone-table-stub-col' WHEN confidence < 0.9 AND {t4} THEN 'T4|zone-table-t4-heuristic' ELSE 'T|zone-table-text' END ELSE '' END AS cellhit FROM @")
    lad.step("cellhit <> ''", "split_part(cellhit, '|', 1)", "(',' || split_part(cellhit, '|', 2))")


def back_matter_rung(lad: Ladder) -> None:
    whens = " ".join(f"WHEN {sb.lit(k)} THEN {sb.lit(next(c for c in chain if c in V.names))}" for k, chain in fixed.BACK_MATTER_CHAINS.items())
    lad.step(f"NOT lock AND zone = 'BACK_MATTER' AND coalesce(CASE tag {whens} END, tag) <> tag", f"CASE tag {whens} END", "zone-backmatter-normalize")


def ladder_sql(prefix: str = "k") -> Ladder:
    lad = prepared(prefix=prefix).add("SELECT *, false AS hdr, false AS stub FROM @")
    lad.step("NOT lock AND norm <> '' AND norm <> tag", "norm", "style-canonicalize")
    lad.step("NOT lock AND box_marker IS NOT NULL AND tag <> 'PMI'", "'PMI'", "box-marker")
    lad.step("NOT lock AND zone = 'METADATA' AND tag <> 'PMI'", "'PMI'", "metadata-zone")
    inline = "CASE WHEN regexp_matches(text, '(?i)^\\s*<H[1-6]>[\\p{L}\\p{N}_]') THEN 'H' || regexp_extract(text, '<[hH]([1-6])>', 1) END"
    lad.step(f"NOT lock AND zone <> 'TABLE' AND coalesce({inline}, tag) <> tag", inline, "inline-heading-marker")
    lad.step("NOT lock AND coalesce(caption_type, '') = 'table' AND tag <> 'T1'", "'T1'", "table-caption")
    lad.step("NOT lock AND coalesce(caption_type, '') = 'figure' AND tag <> 'FIG-LEG'", "'FIG-LEG'", "figure-caption")
    lad.step("NOT lock AND source_line AND tag <> 'TSN'", "'TSN'", "source-line")
    lad.step("NOT lock AND starts_with(zone, 'BOX_') AND box_label IS NOT NULL AND tag <> fam || '-TYPE'", "fam || '-TYPE'", "box-type-label")
    lad.step("NOT lock AND starts_with(zone, 'BOX_') AND box_label IS NULL AND box_title AND tag <> fam || '-TTL'", "fam || '-TTL'", "box-title")
    lad.add("SELECT * REPLACE (lock AND NOT (in_ref AND NOT starts_with(norm, 'REF-')) AS lock) FROM @")
    table_rungs(lad)
    back_matter_rung(lad)
    lad.add(f"SELECT *, {LIST} AS ltag FROM @").norm("tag", "norm2")
    lad.step("""NOT in_ref AND NOT lock AND ltag IS NOT NULL AND CASE
      WHEN NOT regexp_matches(tag, '-(FIRST|MID|LAST)$') AND NOT (starts_with(norm2, 'REF') OR norm2 IN ('BIB', 'SR', 'SRH1')) AND NOT entry THEN true
      WHEN regexp_matches(tag, '^(BL|NL|UL|TBL|TNL|TUL)') THEN tag <> ltag AND NOT (starts_with(tag, 'BL-') AND starts_with(ltag, 'UL-')) ELSE false END""", "ltag", "list-position")
    ok = sb.exact_zone_ok("tag", "zone")
    lad.step(f"NOT lock AND zone = 'TABLE' AND NOT {ok} AND tag <> CASE WHEN starts_with(tag, 'BX4-') THEN 'BX4-TXT' ELSE 'T' END", "CASE WHEN starts_with(tag, 'BX4-') THEN 'BX4-TXT' ELSE 'T' END", "table-inferred")
    lad.add(f"SELECT * REPLACE ({LIST} AS ltag) FROM @")
    fb = "CASE WHEN zone = 'TABLE' THEN 'T' WHEN zone = 'BACK_MATTER' THEN coalesce(ltag, 'REF-U') ELSE coalesce(ltag, 'TXT') END"
    lad.step(f"NOT lock AND zone <> 'BODY' AND NOT {ok} AND tag <> {fb}", fb, "zone-fallback")
    lad.add("SELECT *, NOT lock AND tag IN ('H4', 'H5') AS from_h4h5 FROM @")
    lad.step("from_h4h5", "'H3'", "heading-canonicalize")
    lad.add("""SELECT *, CASE WHEN NOT in_ref THEN '' WHEN starts_with(lower(t), '<ref-h2>') THEN 'REFH2|ref-zone-heading' WHEN regexp_matches(tag, '^(UL|BL)-') THEN reftag || '|ref-zone-list-override'
      WHEN starts_with(tag, 'APX-REF') OR tag IN ('SR', 'SRH1') THEN '' WHEN entry THEN reftag || '|ref-zone-pre-allowed' ELSE '' END AS rhit FROM @""")
    lad.step("rhit <> '' AND split_part(rhit, '|', 1) <> tag", "split_part(rhit, '|', 1)", "(',' || split_part(rhit, '|', 2))")
    lad.norm("tag", "norm3")
    src = lad.last
    lad.ctes.append(f"{prefix}near AS {sb.nearest_table(f'(SELECT * FROM {src} WHERE norm3 NOT IN {sb.VOCAB_SQL})', 'norm3', 'close', False)}")
    lad.add(f"""SELECT x.*, CASE WHEN norm3 IN {sb.VOCAB_SQL} THEN norm3 ELSE coalesce({sb.chain_case('norm3')}, {sb.family_pick('norm3')}, nr.close, 'TXT') END AS ensured
      FROM @ x LEFT JOIN {prefix}near nr ON nr.tag = x.norm3""")
    lad.step("ensured <> tag", "ensured", "not-allowed")
    lad.add("SELECT * REPLACE (CASE WHEN why <> '' THEN least(confidence, 80) ELSE confidence END AS confidence), why <> '' AS repaired, CASE WHEN why <> '' THEN substr(why, 2) END AS repair_reason FROM @")
    return lad


def amend(lad: Ladder, cond: str, value: str, reason: str, conf: str | None = None) -> None:
    extra = f", CASE WHEN {cond} THEN {conf} ELSE confidence END AS confidence" if conf else ""
    lad.add(f"SELECT * REPLACE (CASE WHEN {cond} THEN {value} ELSE tag END AS tag, repaired OR ({cond}) AS repaired, "
            f"CASE WHEN {cond} THEN concat_ws(',', repair_reason, {sb.lit(reason)}) ELSE repair_reason END AS repair_reason{extra}) FROM @")


def preserve_sql(lad: Ladder) -> None:
    lad.norm("tag", "pnow").norm("input_tag", "pown")
    lad.add(f"SELECT *, pown IN {sb.in_list(repair.KEPT_REFERENCE_TAGS)} AND pown IN {sb.VOCAB_SQL} AS pkeep, pnow IN ('SRH1', 'REFH1') OR starts_with(upper({sb.strip('text')}), '<REF>') AS popen FROM @")
    lad.add("SELECT *, CASE WHEN pnow IN ('H1', 'H2', 'CN', 'CT') AND NOT pkeep THEN 'E' WHEN popen THEN 'T' END AS pev FROM @")
    lad.add("SELECT *, popen OR coalesce(last_value(pev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'T' AS pin FROM @")
    amend(lad, "pin AND pkeep AND tag <> input_tag", "input_tag", "ref-section-preserve")


def anchor_sql(lad: Ladder, tag: str = "a") -> None:
    """True fold as a recursive query over each document's rows."""
    cur = lad.last
    p = f"{lad.prefix}{tag}"
    lad.ctes.append(f"""{p}e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_id) AS pos, para_id,
  (starts_with(tag, 'FIG-') OR tag IN ('T1', 'T2', 'T4', 'TFN', 'TSN')) AS anc, zone = 'BACK_MATTER' AND (starts_with(tag, 'FIG-') OR tag IN ('T1', 'T2', 'T4', 'TFN', 'TSN', 'TBL-FIRST', 'TBL-MID', 'TBL-LAST')) AS cand,
  CASE WHEN in_ref THEN 'REF-U' ELSE 'TSN' END AS newtag FROM {cur})""")
    lad.ctes.append(f"{p}f AS (SELECT *, coalesce(sum(anc::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), 0) > 0 AS ahead FROM {p}e)")
    lad.ctes.append(f"{p}g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM {p}f WHERE anc OR cand)")
    lad.ctes.append(f"""{p}r AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS para_id, -100::BIGINT AS last, false AS down, '' AS newtag FROM (SELECT DISTINCT doc_id FROM {p}g)
  UNION ALL SELECT q.doc_id, q.k, q.para_id,
   CASE WHEN (NOT q.cand OR q.ahead OR q.pos - r.last <= 10) THEN CASE WHEN q.anc THEN q.pos ELSE r.last END ELSE CASE WHEN q.newtag = 'TSN' THEN q.pos ELSE r.last END END,
   NOT (NOT q.cand OR q.ahead OR q.pos - r.last <= 10), q.newtag FROM {p}r r JOIN {p}g q ON q.doc_id = r.doc_id AND q.k = r.k + 1)""")
    lad.add(f"SELECT x.*, coalesce(d.down, false) AS adown, d.newtag AS anew FROM {cur} x LEFT JOIN (SELECT * FROM {p}r WHERE down) d USING (doc_id, para_id)")
    amend(lad, "adown", "anew", "zone-backmatter-downgrade")


def flush_sql(lad: Ladder) -> None:
    lad.norm("tag", "fnow").add("SELECT *, lag(fnow) OVER (PARTITION BY doc_id ORDER BY para_id) AS fprev FROM @")
    amend(lad, f"""coalesce(fprev, '') IN ('H1', 'H2', 'H3', 'APX-H1', 'APX-H2', 'APX-H3') AND fnow = 'TXT' AND zone IN ('BODY', 'BACK_MATTER', 'REFERENCE')
      AND list_kind IS NULL AND caption_type IS NULL AND NOT source_line""", "'TXT-FLUSH'", "heading-following-flush")


def hierarchy_sql(lad: Ladder) -> None:
    """True fold as a recursive query over each document's headings."""
    lad.norm("tag", "hnow")
    cur, p = lad.last, f"{lad.prefix}h"
    lad.ctes.append(f"""{p}e AS (SELECT doc_id, para_id, tag, confidence AS cf, from_h4h5 AS came, hnow IN {sb.VOCAB_SQL} AND confidence >= 0.9 AS sure, right(tag, 1)::INT AS l,
  row_number() OVER (PARTITION BY doc_id ORDER BY para_id) AS k FROM {cur} WHERE regexp_matches(tag, '^H[1-6]$'))""")
    lad.ctes.append(f"""{p}r AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS para_id, '' AS outt, false AS h1, false AS h2, 0 AS last FROM (SELECT DISTINCT doc_id FROM {p}e)
  UNION ALL SELECT doc_id, k, para_id, outt,
    CASE WHEN outt = 'H1' THEN true ELSE h1 END, CASE WHEN outt = 'H1' THEN false WHEN outt = 'H2' THEN true ELSE h2 END,
    CASE outt WHEN 'H1' THEN 1 WHEN 'H2' THEN 2 WHEN 'H3' THEN 3 ELSE last END
  FROM (SELECT q.doc_id, q.k, q.para_id, r.h1, r.h2, r.last,
    CASE WHEN q.sure THEN q.tag
      WHEN r.last > 0 AND q.l > r.last + 1 THEN CASE WHEN q.cf >= 0.7 THEN 'H' || least(r.last + 1, 2) ELSE 'TXT' END
      WHEN q.l = 3 AND NOT r.h2 AND NOT q.came THEN 'H2'
      WHEN q.l = 2 AND NOT r.h1 THEN CASE WHEN q.cf >= 0.7 THEN 'H1' ELSE 'TXT' END
      WHEN q.l >= 4 THEN 'H3' ELSE q.tag END AS outt
    FROM {p}r r JOIN {p}e q ON q.doc_id = r.doc_id AND q.k = r.k + 1))""")
    lad.add(f"SELECT x.*, coalesce(d.outt, x.tag) AS hout FROM {cur} x LEFT JOIN (SELECT * FROM {p}r WHERE k > 0) d USING (doc_id, para_id)")
    amend(lad, "hout <> tag", "hout", "heading-hierarchy", "least(confidence, 80)")


def guard_sql(lad: Ladder) -> None:
    t = sb.strip("text")
    ref = f"CASE WHEN {sb.has(t, fixed.REF_BULLET_PATTERN)} THEN 'REF-U' ELSE 'REF-N' END"
    amend(lad, f"in_ref AND starts_with(lower({t}), '<ref-h2>')", "'REFH2'", "ref-zone-heading", "greatest(confidence, 0.99)")
    amend(lad, f"in_ref AND NOT starts_with(lower({t}), '<ref-h2>') AND tag NOT IN ('SR', 'SRH1') AND NOT starts_with(tag, 'APX-REF') AND {sb.ref_entry('text')} AND tag <> {ref}",
          ref, "ref-zone-final", "greatest(confidence, 0.99)")


def refs_with(lad: Ladder, body: str) -> str:
    return f"WITH RECURSIVE {ov.GIVEN_SQL},{ss.zones()},{ss.lists()},{ss.references()},\n{lad.sql()} {body.replace('@', lad.last)}"


PICK = "SELECT doc_id, para_id, tag, confidence, repaired, repair_reason FROM @"

_lad = ladder_sql()


@query("repair_rows", refs_with(_lad, PICK))
def _(spark, sf):
    return repair.repair_rows(referenced(spark, sf), V, sb.ZONES).select(*OUT)


query("trust_lock", refs_with(prepared(), "SELECT doc_id, para_id, lock AND NOT (in_ref AND NOT starts_with(norm, 'REF-')) AS trusted FROM @"))(
    lambda spark, sf: referenced(spark, sf).withColumn("norm", st.normalize_style(F.col("tag"))).select(
        *KEY, (st.trust_lock(F.col("norm"), F.col("tag"), F.col("confidence"), F.col("text"), V)
               & ~(F.col("in_ref") & ~F.col("norm").startswith("REF-"))).alias("trusted")))

CELLS = "SELECT * EXCLUDE (zone) REPLACE (false AS in_ref), 'TABLE' AS zone, para_id <= 4 AS hdr, (para_id - 1) % 4 = 0 AS stub FROM @"
_tab = Ladder("rz", "c").add(CELLS)
_tab2 = prepared(_tab.last, "t")
table_rungs(_tab2)
_tab.ctes += _tab2.ctes
_tab.last = _tab2.last


@query("repair_table_zone", refs_with(_tab, "SELECT doc_id, para_id, tag, CASE WHEN why <> '' THEN substr(why, 2) END AS repair_reason FROM @"))
def _(spark, sf):
    cells = referenced(spark, sf).withColumns({
        "zone": F.lit("TABLE"), "in_ref": F.lit(False),
        "is_header_row": F.col("para_id") <= 4, "is_stub_col": (F.col("para_id") - 1) % 4 == 0})
    return repair.repair_table_zone(cells, V).select(*KEY, "tag", "repair_reason")


SMALL = st.Vocabulary(["TXT", "PMI", "UNFIG-LEG", "BM-TTL", "TSN", "REF-N"])
_bm = " ".join(f"WHEN {sb.lit(k)} THEN {sb.lit(next(c for c in chain if c in SMALL.names))}" for k, chain in fixed.BACK_MATTER_CHAINS.items())


@query("repair_backmatter", ss.with_references(f"""SELECT doc_id, para_id, CASE WHEN hit THEN CASE tag {_bm} END ELSE tag END AS tag, CASE WHEN hit THEN 'zone-backmatter-normalize' END AS repair_reason
FROM (SELECT *, coalesce(CASE tag {_bm} END, tag) <> tag AND NOT (tag IN {sb.in_list(SMALL.names)} AND confidence >= 0.9) AS hit FROM (SELECT * REPLACE ('BACK_MATTER' AS zone) FROM rz))"""))
def _(spark, sf):
    rows = referenced(spark, sf).withColumn("zone", F.lit("BACK_MATTER"))
    return repair.repair_back_matter(rows, SMALL).select(*KEY, "tag", "repair_reason")


def repaired_base(spark, sf):
    return repair.repair_rows(referenced(spark, sf), V, sb.ZONES)


def pass_query(name, build_sql, apply):
    lad = ladder_sql()
    build_sql(lad)

    @query(name, refs_with(lad, PICK))
    def _(spark, sf):
        return apply(repaired_base(spark, sf)).select(*OUT)


# Rows of the overlay with reference tags, back-matter floats and deeper headings.
MIXED = """CASE WHEN text = 'References' THEN 'REFH1' WHEN text LIKE '%Journal of Tests%' AND para_id % 3 = 0 THEN 'SR' WHEN text LIKE '%Journal of Tests%' THEN 'REF-N' ELSE input_tag END"""
NOW = """CASE WHEN text = 'References' THEN 'REFH1' WHEN para_id % 7 = 5 THEN 'H1' ELSE tag END"""


def _preserve_lad():
    lad = ladder_sql()
    lad.add(f"SELECT * REPLACE ({MIXED} AS input_tag, {NOW} AS tag) FROM @")
    preserve_sql(lad)
    return lad


query("ref_section_preserve", refs_with(_preserve_lad(), PICK))(
    lambda spark, sf: repair.preserve_reference_section(
        repaired_base(spark, sf).withColumns({"input_tag": F.expr(MIXED), "tag": F.expr(NOW)}), V).select(*OUT))

FLOATS = "CASE (doc_id * 7 + para_id * 5) % 23 WHEN 0 THEN 'FIG-LEG' WHEN 1 THEN 'TBL-MID' WHEN 2 THEN 'TBL-FIRST' WHEN 7 THEN 'T1' ELSE CASE WHEN tag IN ('T1', 'FIG-LEG', 'TSN', 'TFN') THEN 'TXT' ELSE tag END END"


def _anchor_lad():
    lad = ladder_sql()
    lad.add(f"SELECT * REPLACE ({FLOATS} AS tag, 'BACK_MATTER' AS zone) FROM @")
    anchor_sql(lad)
    return lad


query("anchor_check", refs_with(_anchor_lad(), PICK))(
    lambda spark, sf: repair.check_anchors(
        repaired_base(spark, sf).withColumns({"tag": F.expr(FLOATS), "zone": F.lit("BACK_MATTER")}), V).select(*OUT))

pass_query("heading_flush", flush_sql, lambda df: repair.flush_after_heading(df, V))

DEEP = "CASE WHEN tag IN ('TXT', 'H1', 'H3', 'UL-MID') THEN CASE (doc_id * 5 + para_id * 3) % 13 WHEN 0 THEN 'H1' WHEN 1 THEN 'H2' WHEN 2 THEN 'H3' WHEN 3 THEN 'H4' WHEN 4 THEN 'H5' WHEN 5 THEN 'H3' WHEN 6 THEN 'H6' ELSE tag END ELSE tag END"


def _hierarchy_lad():
    lad = ladder_sql()
    lad.add(f"SELECT * REPLACE ({DEEP} AS tag, (doc_id + para_id) % 3 = 0 AS from_h4h5) FROM @")
    hierarchy_sql(lad)
    return lad


query("heading_hierarchy", refs_with(_hierarchy_lad(), PICK))(
    lambda spark, sf: repair.fix_heading_hierarchy(
        repaired_base(spark, sf).withColumns({"tag": F.expr(DEEP), "from_h4h5": (F.col("doc_id") + F.col("para_id")) % 3 == 0}), V).select(*OUT))


def _guard_lad():
    lad = ladder_sql()
    lad.add("SELECT * REPLACE (CASE WHEN para_id % 4 = 0 THEN 'TXT' ELSE tag END AS tag) FROM @")
    guard_sql(lad)
    return lad


query("ref_zone_enforce", refs_with(_guard_lad(), PICK))(
    lambda spark, sf: repair.guard_reference_zone(
        repaired_base(spark, sf).withColumn("tag", F.expr("CASE WHEN para_id % 4 = 0 THEN 'TXT' ELSE tag END"))).select(*OUT))


def full_ladder(prefix: str = "k") -> Ladder:
    lad = ladder_sql(prefix)
    preserve_sql(lad)
    anchor_sql(lad)
    flush_sql(lad)
    hierarchy_sql(lad)
    guard_sql(lad)
    return lad


_full = full_ladder()


@query("structure_corpus", refs_with(_full, f""", {quality_sql(f'(SELECT * FROM {_full.last})').strip()}
SELECT doc_id, total, score, action, heading_violations, box_violations, figure_violations, table_violations, txt_ratio, low_conf_ratio, auto_applied, needs_review, repaired_rows
FROM q JOIN (SELECT doc_id, count_if(confidence >= 0.85) AS auto_applied, count_if(confidence < 0.85) AS needs_review, count_if(repaired) AS repaired_rows FROM @ GROUP BY doc_id) USING (doc_id)"""))
def _(spark, sf):
    """Flagship: zones -> reference zones -> repair -> score, one exchange."""
    from folioscope.plans.structure import document_results

    rows = structure_corpus(ov.given(spark, sf), V, sb.ZONES)
    return document_results(rows, V, review_below=0.85).select(
        "doc_id", "total", "score", "action", "heading_violations", "box_violations", "figure_violations", "table_violations",
        "txt_ratio", "low_conf_ratio", "auto_applied", "needs_review", "repaired_rows")


@query("repair_corpus", refs_with(_full, PICK))
def _(spark, sf):
    return structure_corpus(ov.given(spark, sf), V, sb.ZONES).select(*OUT)


@query("semantic_remap", ov.with_given(f""", r AS (SELECT DISTINCT CASE WHEN (doc_id + para_id) % 3 = 0 THEN upper(regexp_replace(left(text, 4), '[^A-Za-z]', '-', 'g')) ELSE tag END AS raw FROM g
  UNION SELECT k FROM {sb.values([(k,) for k in fixed.FALLBACK_CHAINS], 'k')}),{sb.normalize_steps('r', 'raw', 'norm')},
un AS (SELECT * FROM nz9 WHERE norm NOT IN {sb.VOCAB_SQL}), near AS {sb.nearest_table('un', 'norm', 'close', False)}
SELECT raw, CASE WHEN norm IN {sb.VOCAB_SQL} THEN norm ELSE coalesce({sb.chain_case('norm')}, {sb.family_pick('norm')}, near.close, 'TXT') END AS tag FROM nz9 LEFT JOIN near ON near.tag = nz9.norm"""))
def _(spark, sf):
    seen = ov.given(spark, sf).select(F.expr("CASE WHEN (doc_id + para_id) % 3 = 0 THEN upper(regexp_replace(left(text, 4), '[^A-Za-z]', '-')) ELSE tag END").alias("raw"))
    chains = spark.createDataFrame([(k,) for k in fixed.FALLBACK_CHAINS], "raw string")
    tags = seen.unionByName(chains).distinct().withColumn("norm", st.normalize_style(F.col("raw")))
    return tags.select("raw", st.ensure_allowed(F.col("norm"), V).alias("tag"))
