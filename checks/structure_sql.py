"""Checking SQL for zones, boxes, lists, reference zones and repaired rows."""

from __future__ import annotations

from checks import overlay as ov
from checks import sqlbits as sb
from folioscope import fixed

L = sb.low("text")
UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
W = "PARTITION BY doc_id ORDER BY para_id"


def zones(source: str = "g") -> str:
    """CTEs z1..z6; z6 = source columns + box and zone columns."""
    return f"""
z1 AS (SELECT *, CASE WHEN {sb.box_start('text')} THEN 'start' WHEN {sb.box_end('text')} THEN 'end' END AS box_marker,
  {sb.box_type('text')} AS kind0 FROM {source}),
z2 AS (SELECT *, coalesce(last_value(box_marker IGNORE NULLS) OVER ({W} {BEFORE}), 'end') AS prev_ev FROM z1),
z3 AS (SELECT *, (coalesce(box_marker, '') = 'start' OR prev_ev = 'start') AS in_box,
  (coalesce(box_marker, '') = 'start' AND prev_ev <> 'start') AS opens FROM z2),
z4 AS (SELECT *, sum(opens::INT) OVER ({W} {UPTO}) AS seg,
  last_value(CASE WHEN opens THEN kind0 END IGNORE NULLS) OVER ({W} {UPTO}) AS kind1,
  first_value(CASE WHEN {sb.any_has(L, fixed.METADATA_PATTERNS)} THEN 'METADATA' WHEN {sb.any_has(L, fixed.CHAPTER_OPENER_PATTERNS)} THEN 'FRONT_MATTER'
    WHEN {sb.any_has(L, fixed.BODY_START_PATTERNS)} THEN 'BODY' ELSE 'FRONT_MATTER' END) OVER ({W} {UPTO}) AS z_first FROM z3),
z5 AS (SELECT *, CASE WHEN in_box THEN kind1 END AS box_type, {sb.box_zone('kind1')} AS kzone,
  CASE WHEN seg = 0 THEN z_first ELSE {sb.box_zone('kind1')} END AS z0,
  {sb.any_has(L, fixed.BODY_START_PATTERNS)} AS bs, {sb.any_has(L, fixed.CHAPTER_OPENER_PATTERNS)} AS op, {sb.any_has(L, fixed.BACK_MATTER_PATTERNS)} AS bm FROM z4),
z5b AS (SELECT *, coalesce(max(bs::INT) OVER (PARTITION BY doc_id, seg, in_box ORDER BY para_id {BEFORE}), 0) = 1 OR z0 = 'BODY' AS body_before,
  max(bs::INT) OVER (PARTITION BY doc_id, seg, in_box ORDER BY para_id {UPTO}) = 1 OR z0 = 'BODY' AS body_now,
  max(op::INT) OVER (PARTITION BY doc_id, seg, in_box ORDER BY para_id {UPTO}) = 1 AS open_now FROM z5),
z6 AS (SELECT * EXCLUDE (kind0, prev_ev, opens, seg, kind1, z_first, kzone, z0, bs, op, bm, body_before, body_now, open_now),
  CASE WHEN in_box THEN kzone
    WHEN max((bm AND body_before)::INT) OVER (PARTITION BY doc_id, seg, in_box ORDER BY para_id {UPTO}) = 1 THEN 'BACK_MATTER'
    WHEN body_now THEN 'BODY' WHEN open_now THEN 'FRONT_MATTER' ELSE z0 END AS zone FROM z5b)"""


def lists(source: str = "z6") -> str:
    """CTEs ending in `s`: block features and list positions."""
    t = sb.strip("text")
    return f"""
l1 AS (SELECT *, {sb.has(t, fixed.BULLET_PATTERN)} AS has_bullet, {sb.has(t, fixed.NUMBERING_PATTERN)} AS has_numbering,
  {sb.caption('text')} AS caption_type, {sb.any_has(L, fixed.SOURCE_LINE_PATTERNS)} AS source_line,
  CASE WHEN {L} IN {sb.in_list(fixed.BOX_PREFIXES)} THEN {L} END AS box_label, {sb.any_has(L, fixed.BOX_TITLE_PATTERNS)} AS box_title,
  {sb.list_kind('text')} AS list_kind FROM {source}),
l2 AS (SELECT *, CASE WHEN list_kind IS NOT NULL THEN list_kind || '|' || zone || '|' || coalesce(box_type, '-') END AS lkey FROM l1),
l3 AS (SELECT *, (lag(lkey) OVER ({W})) IS DISTINCT FROM lkey OR para_id = 1 AS fresh FROM l2),
l4 AS (SELECT *, sum(fresh::INT) OVER ({W} {UPTO}) AS run FROM l3),
s AS (SELECT * EXCLUDE (lkey, fresh, run), CASE WHEN lkey IS NULL THEN NULL
  WHEN row_number() OVER (PARTITION BY doc_id, run ORDER BY para_id) = 1 THEN 'FIRST'
  WHEN row_number() OVER (PARTITION BY doc_id, run ORDER BY para_id DESC) = 1 THEN 'LAST' ELSE 'MID' END AS list_position FROM l4)"""


def references(source: str = "s", out: str = "rz", density: bool = False) -> str:
    """CTEs ending in `out`: ref_start, ref_trigger, ref_end, in_ref."""
    dense = ""
    third, trigger3 = "NULL", ""
    if density:
        dense = f"""
d1 AS (SELECT *, sum({sb.citation('text', True)}::INT) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS c_mid,
  sum({sb.numbered_not_ref('text')}::INT) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS f_mid,
  sum(CASE WHEN at0 < 20 THEN {sb.citation('text', True)}::INT ELSE 0 END) OVER (PARTITION BY doc_id) AS c_top,
  sum(CASE WHEN at0 < 20 THEN {sb.numbered_not_ref('text')}::INT ELSE 0 END) OVER (PARTITION BY doc_id) AS f_top FROM r2),
d2 AS (SELECT * EXCLUDE (c_mid, f_mid, c_top, f_top), min(CASE WHEN at0 >= floor(0.8::DOUBLE * cnt) AND CASE WHEN at0 < 10 THEN c_top ELSE c_mid END >= 16
  AND CASE WHEN at0 < 10 THEN f_top ELSE f_mid END = 0 THEN at0 END) OVER (PARTITION BY doc_id) AS dn FROM d1),"""
        third, trigger3 = "CASE WHEN dn IS NOT NULL THEN greatest(dn - 10, 0) END", "WHEN dn IS NOT NULL THEN 'strict_patterns'"
    last = "d2" if density else "r2"
    t = sb.strip("text")
    return f"""
r1 AS (SELECT *, row_number() OVER ({W}) - 1 AS at0, count(*) OVER (PARTITION BY doc_id) AS cnt,
  coalesce(sum({sb.citation('text', True)}::INT) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS next5 FROM {source}),
r2 AS (SELECT *, min(CASE WHEN {sb.ref_heading('text')} THEN at0 END) OVER (PARTITION BY doc_id) AS s1,
  min(CASE WHEN {sb.secondary_heading('text')} AND at0 >= floor(0.75::DOUBLE * cnt) AND next5 >= 3 THEN at0 END) OVER (PARTITION BY doc_id) AS s2 FROM r1),{dense}
r3 AS (SELECT *, coalesce(s1, s2, {third}) AS ref_start, CASE WHEN s1 IS NOT NULL THEN 'heading_match' WHEN s2 IS NOT NULL THEN 'secondary_heading_validated' {trigger3} ELSE 'none' END AS ref_trigger FROM {last}),
r4 AS (SELECT *, (at0 > ref_start AND {sb.zone_exit('text')}) AS ex,
  CASE WHEN ref_trigger = 'heading_match' THEN {sb.feature_any('text')} ELSE {sb.citation('text', False)} END AS likely,
  (at0 > ref_start AND length({t}) >= 10 AND NOT {sb.zone_exit('text')}) AS solid FROM r3),
r5 AS (SELECT *, sum(coalesce(solid AND likely, false)::INT) OVER ({W} {UPTO}) AS seen FROM r4),
r6 AS (SELECT *, sum(coalesce(solid AND NOT likely, false)::INT) OVER (PARTITION BY doc_id, seen ORDER BY para_id {UPTO}) AS streak FROM r5),
r7 AS (SELECT *, min(CASE WHEN ex THEN at0 END) OVER (PARTITION BY doc_id) AS exit_at,
  min(CASE WHEN solid AND seen >= 3 AND streak >= CASE WHEN ref_trigger = 'heading_match' THEN 15 ELSE 12 END THEN at0 END) OVER (PARTITION BY doc_id) AS hit_at FROM r6),
r8 AS (SELECT *, max(CASE WHEN at0 = hit_at THEN hit_at - streak + 1 END) OVER (PARTITION BY doc_id) AS streak_end FROM r7),
r9 AS (SELECT *, CASE WHEN ref_start IS NULL THEN NULL WHEN exit_at IS NOT NULL AND (hit_at IS NULL OR exit_at < hit_at) THEN exit_at
  WHEN hit_at IS NOT NULL THEN streak_end ELSE cnt END AS ref_end FROM r8),
{out} AS (SELECT * EXCLUDE (at0, cnt, next5, s1, s2, ex, likely, solid, seen, streak, exit_at, hit_at, streak_end{', dn' if density else ''}),
  coalesce(at0 >= ref_start AND at0 < ref_end, false) AS in_ref FROM r9)"""


def with_structure(body: str) -> str:
    return f"WITH {ov.GIVEN_SQL},{zones()},{lists()} {body}"


def with_references(body: str, density: bool = False) -> str:
    return f"WITH {ov.GIVEN_SQL},{zones()},{lists()},{references(density=density)} {body}"
