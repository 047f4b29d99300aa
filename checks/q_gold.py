"""Gold building and evaluation over a paired copy of the overlay."""

from pyspark.sql import functions as F

from checks import overlay as ov
from checks import sqlbits as sb
from checks import structure_sql as ss
from checks.q_structure import referenced
from checks.registry import query, table
from folioscope import fixed
from folioscope.functions import styles as st
from folioscope.operators import evaluation as ev
from folioscope.operators import gold as gd

KEY = ["doc_id", "para_id"]
STYLES = ["TXT", "H1", "H3", "UL-MID", "NL-MID", "T1", "PMI", "REFH1", "Unique-Style", "dup", "DUP"]
ALIASES = {"Head One": "H1", "Fig": "FIG-LEG", "BodyText": "TXT", "Ref Head": "refh1"}
RAW = """CASE (doc_id + para_id) % 9 WHEN 0 THEN lower(tag) WHEN 1 THEN ' Head  One' WHEN 2 THEN 'head one' WHEN 3 THEN 'REF HEAD' WHEN 4 THEN 'Dup' WHEN 5 THEN 'unique-style' WHEN 6 THEN '' ELSE tag END"""


def _fold(names):
    folds = {}
    for n in names:
        folds.setdefault(n.lower(), []).append(n)
    return folds


AV = sb.values(list(ALIASES.items()), "k, v")
SV = sb.values([(s,) for s in STYLES], "s")
LOOKUPS = f"""sv AS (SELECT s FROM {SV}), av AS (SELECT k, v FROM {AV}),
f AS (SELECT lower(s) AS f, min(s) AS s FROM sv GROUP BY 1 HAVING count(*) = 1),
lk AS (SELECT r.*, sv.s AS d, a1.v AS a, f.s AS fd, a2.v AS av, f2.s AS avf, (a2.v IN (SELECT s FROM sv)) AS avok
  FROM r LEFT JOIN sv ON sv.s = c LEFT JOIN (SELECT * FROM av WHERE v IN (SELECT s FROM sv)) a1 ON a1.k = c LEFT JOIN f ON f.f = lower(c) LEFT JOIN av a2 ON lower(a2.k) = lower(c) LEFT JOIN f f2 ON f2.f = lower(a2.v))"""
CANONICAL = "CASE WHEN c = '' THEN 'UNMAPPED' WHEN d IS NOT NULL THEN c WHEN a IS NOT NULL THEN a WHEN fd IS NOT NULL THEN fd WHEN avok THEN av WHEN avf IS NOT NULL THEN avf ELSE 'UNMAPPED' END"
TAG_NOTE = """CASE WHEN c = '' THEN 'empty_manual_style' WHEN d IS NOT NULL THEN 'tag_map:direct' WHEN a IS NOT NULL THEN 'tag_map:alias' WHEN fd IS NOT NULL THEN 'tag_map:direct_casefold' WHEN avok THEN 'tag_map:alias_casefold'
   WHEN avf IS NOT NULL THEN 'tag_map:alias_casefold_to_allowed_casefold' ELSE 'tag_map:unmapped' END"""
query("canonicalize_gold", ov.with_given(f""", r AS (SELECT doc_id, para_id, {sb.collapse(f'({RAW})')} AS c FROM g), {LOOKUPS}
SELECT doc_id, para_id, {CANONICAL} AS canonical_gold_tag, {TAG_NOTE} AS tag_note FROM lk"""))(
    lambda spark, sf: gd.canonicalize(ov.given(spark, sf).withColumn("gold_tag", F.expr(RAW)), STYLES, ALIASES).select(*KEY, "canonical_gold_tag", "tag_note"))

# --- document names ------------------------------------------------------------------
MANUAL = "source || '-ch' || doc_id"
ORIGINAL = "CASE WHEN doc_id % 7 = 0 THEN 'x' || (doc_id * 31) || source ELSE upper(source) || ' CH_' || doc_id END"
NAMES = f"""m AS (SELECT {MANUAL} AS name FROM documents), o1 AS (SELECT {ORIGINAL} AS name FROM documents UNION ALL SELECT source || '_Ch.' || doc_id FROM documents WHERE doc_id % 11 = 0),
ms AS (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS stem, min(name) AS manual FROM m GROUP BY 1),
os AS (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS stem, min(name) AS original FROM o1 GROUP BY 1 HAVING count(*) = 1),
pairs AS (SELECT manual, original FROM ms JOIN os USING (stem))"""


def names(spark, sf):
    docs = table(spark, sf, "documents")
    manual = docs.select(F.expr(MANUAL).alias("name"))
    original = docs.select(F.expr(ORIGINAL).alias("name")).unionByName(
        docs.where("doc_id % 11 = 0").select(F.expr("source || '_Ch.' || doc_id").alias("name")))
    return manual, original


query("pair_documents", f"WITH {NAMES} SELECT manual, original, 'exact_stem' AS pair_method FROM pairs")(
    lambda spark, sf: gd.pair_exact(*names(spark, sf)))


@query("unpaired_documents", f"""WITH {NAMES} SELECT 'manual' AS side, name FROM m WHERE name NOT IN (SELECT manual FROM pairs)
UNION ALL SELECT 'original', name FROM o1 WHERE name NOT IN (SELECT original FROM pairs)""")
def _(spark, sf):
    manual, original = names(spark, sf)
    left, right = gd.unpaired(manual, original, gd.pair_exact(manual, original))
    return left.select(F.lit("manual").alias("side"), "name").unionByName(right.select(F.lit("original").alias("side"), "name"))


def taken(rows: str, first: str, second: str, by: str) -> str:
    """(group, first, second, score) of going through ``rows`` in order: one use of each side."""
    return f"""SELECT grp, unnest(list_reduce(list({{'a': {first}, 'b': {second}, 's': score}} ORDER BY {by}),
  lambda st, c: CASE WHEN st.last IS NOT DISTINCT FROM c.a OR list_contains(st.used, c.b) THEN st ELSE {{'last': c.a, 'used': list_append(st.used, c.b), 'out': list_append(st.out, c)}} END,
  {{'last': NULL, 'used': [], 'out': []}}).out) AS o FROM {rows} GROUP BY grp"""


STEM = "regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')"
SIM = "1.0::DOUBLE - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE"


@query("pair_documents_fuzzy", f"""WITH {NAMES}, lm AS (SELECT name AS manual, {STEM} AS a FROM m WHERE name NOT IN (SELECT manual FROM pairs)), lo AS (SELECT name AS original, {STEM} AS b FROM o1 WHERE name NOT IN (SELECT original FROM pairs)),
sc0 AS (SELECT manual, original, {SIM.format(a='a', b='b')} AS ratio, list_max(list_transform(range(1, length(a) + 1), lambda i: list_max(list_transform(range(0, length(a) - i + 2), lambda n: CASE WHEN n > 0 AND contains(b, substr(a, i, n)) THEN n ELSE 0 END)))) AS lcs FROM lm, lo WHERE a <> '' AND b <> ''),
sc AS (SELECT 0 AS grp, manual, original, lcs, ratio, lcs + ratio / 10 AS score FROM sc0 WHERE lcs > 0),
tk AS ({taken('sc', 'manual', 'original', 'manual, lcs DESC, ratio DESC, original')})
SELECT sc.manual, sc.original, format('longest_common_stem:{{:d}}:{{:.3f}}', lcs, ratio) AS pair_method FROM tk JOIN sc ON sc.manual = o.a AND sc.original = o.b""")
def _(spark, sf):
    manual, original = names(spark, sf)
    left, right = gd.unpaired(manual, original, gd.pair_exact(manual, original))
    return gd.pair_fuzzy(left, right)


BASE = "CASE doc_id % 5 WHEN 3 THEN 'ch' || doc_id || 'x' WHEN 4 THEN 'none' || doc_id ELSE source || '-ch' || doc_id END"
GOLDID = "CASE doc_id % 5 WHEN 0 THEN source || '-ch' || doc_id WHEN 1 THEN source || '-ch' || doc_id || '_tag' WHEN 2 THEN 'v2.' || source || '-ch' || doc_id || '.final' WHEN 3 THEN 'ch' || doc_id ELSE 'other' || doc_id END"
query("doc_id_match", f"""WITH b AS (SELECT DISTINCT {BASE} AS base FROM documents), i AS (SELECT DISTINCT {GOLDID} AS doc_id FROM documents)
SELECT base, coalesce((SELECT min(doc_id) FROM i WHERE doc_id = base), (SELECT min(doc_id) FROM i WHERE doc_id = base || '_tag'),
  (SELECT min(doc_id) FROM i WHERE contains(doc_id, base) OR contains(base, doc_id))) AS doc_id FROM b""")(
    lambda spark, sf: gd.match_ids(
        table(spark, sf, "documents").select(F.expr(BASE).alias("base")).distinct(),
        table(spark, sf, "documents").select(F.expr(GOLDID).alias("doc_id"))))

DEV, HELD = ["src1", "src2", "src3"], ["src7", "src11"]
query("split_membership", f"""SELECT source AS base, min(doc_id) AS position, CASE WHEN source IN {sb.in_list(DEV)} THEN 'dev' ELSE 'held_out' END AS split FROM documents WHERE source IN {sb.in_list(DEV + HELD)} GROUP BY source""")(
    lambda spark, sf: gd.split_membership(
        table(spark, sf, "documents").select(F.col("source").alias("base"), F.col("doc_id").alias("position")), DEV, HELD))

# --- paired corpus ----------------------------------------------------------------------
# Every ninth paragraph is edited and some stand elsewhere.  The edit distance
# of the checking SQL counts bytes, so there each other letter stands for
# itself as one control character that no text has.
LETTERS = "ßäçèéêíñóöü•–—…§’“”→"
ONE_BYTE = "translate({t}, '" + LETTERS + "', " + " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 26)]) + ")"
BYTES = SIM.format(a=ONE_BYTE.format(t="{a}"), b=ONE_BYTE.format(t="{b}"))
COPY = "CASE WHEN (doc_id + para_id) % 9 = 0 THEN 'edited ' || text ELSE text END"
KEPT = "(doc_id + para_id) % 7 <> 0"
MOVED = "CASE WHEN (doc_id * 3 + para_id) % 10 = 4 THEN para_id + 1000000 ELSE para_id END"
PAIR_SQL = ov.OVERLAY_SQL + f""", lo AS (SELECT doc_id, para_id, text FROM o),
mc AS (SELECT doc_id, {MOVED} AS para_id, {COPY} AS text FROM lo WHERE {KEPT})"""
CHAIN_SQL = f"""a AS (SELECT doc_id, para_id, h, row_number() OVER (PARTITION BY doc_id, h ORDER BY para_id) AS k FROM (SELECT doc_id, para_id, {sb.matching('text')} AS h FROM lo)),
b AS (SELECT doc_id, para_id AS manual_para, h, row_number() OVER (PARTITION BY doc_id, h ORDER BY para_id) AS k FROM (SELECT doc_id, para_id, {sb.matching('text')} AS h FROM mc)),
j AS (SELECT doc_id, list(manual_para ORDER BY para_id) AS ms, list(para_id ORDER BY para_id) AS ps FROM a JOIN b USING (doc_id, h, k) GROUP BY 1),
len AS (SELECT doc_id, ms, ps, list_reduce(range(1, len(ms) + 1), lambda f, i: list_append(f, 1 + coalesce(list_max(list_filter(f, lambda x, jj: ms[jj] < ms[i])), 0)), []::BIGINT[]) AS f FROM j),
back AS (SELECT doc_id, ms, ps, list_reduce(range(0, list_max(f)), lambda c, s: list_append(c, list_max(list_filter(range(1, len(f) + 1), lambda i: f[i] = list_max(f) - s AND (len(c) = 0 OR i < c[-1])))), []::BIGINT[]) AS chain FROM len),
an AS (SELECT doc_id, ps[i] AS para_id, ms[i] AS manual_para FROM (SELECT *, unnest(chain) AS i FROM back))"""
ORDER_SQL = f"""{CHAIN_SQL},
gl AS (SELECT lo.doc_id, lo.para_id, {sb.matching('text')} AS t, an.manual_para AS am, count(an.manual_para) OVER (PARTITION BY lo.doc_id ORDER BY lo.para_id) AS gap FROM lo LEFT JOIN an ON an.doc_id = lo.doc_id AND an.para_id = lo.para_id),
gr AS (SELECT mc.doc_id, mc.para_id AS mp, {sb.matching('text')} AS u, an.para_id AS ap, count(an.para_id) OVER (PARTITION BY mc.doc_id ORDER BY mc.para_id) AS gap FROM mc LEFT JOIN an ON an.doc_id = mc.doc_id AND an.manual_para = mc.para_id),
pr0 AS (SELECT gl.doc_id, gl.para_id, mp, CASE WHEN t = '' AND u = '' THEN 1.0 ELSE {BYTES.format(a='t', b='u')} END AS s FROM gl JOIN gr ON gl.doc_id = gr.doc_id AND gl.gap = gr.gap WHERE am IS NULL AND ap IS NULL),
bs AS (SELECT doc_id, para_id, max_by(mp, (s, -mp)) AS mp, max(s) AS s FROM pr0 WHERE s > 0 GROUP BY ALL),
al AS (SELECT gl.doc_id, gl.para_id, coalesce(am, bs.mp) AS manual_para, CASE WHEN am IS NOT NULL THEN 1.0 ELSE coalesce(round(s, 4), 0.0) END AS score FROM gl LEFT JOIN bs ON bs.doc_id = gl.doc_id AND bs.para_id = gl.para_id)"""


def paired(spark, sf):
    left = ov.overlay(spark, sf)
    return left, left.where(KEPT).withColumns({"text": F.expr(COPY), "para_id": F.expr(MOVED)})


query("align_anchors", f"WITH {PAIR_SQL}, {CHAIN_SQL} SELECT * FROM an")(
    lambda spark, sf: gd.anchors(*paired(spark, sf)))
query("align_paragraphs", f"WITH {PAIR_SQL}, {ORDER_SQL} SELECT * FROM al")(
    lambda spark, sf: gd.align_in_order(*paired(spark, sf)))
ONCE = "lower(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')))"
query("align_greedy", f"""WITH {PAIR_SQL}, x AS (SELECT doc_id, para_id, {ONCE} AS t FROM lo), y AS (SELECT doc_id, para_id AS mp, {ONCE} AS u FROM mc),
cd AS (SELECT x.doc_id AS grp, para_id, mp, {BYTES.format(a='t', b='u')} AS score FROM x JOIN y USING (doc_id) WHERE t <> '' AND u <> '' AND abs(length(t) - length(u)) <= 0.15 * greatest(length(t), length(u))),
cq AS (SELECT * FROM cd WHERE score >= 0.85), tk AS ({taken('cq', 'para_id', 'mp', 'para_id, score DESC, mp')})
SELECT x.doc_id, x.para_id, o.b AS manual_para, coalesce(round(o.s, 4), 0) AS score FROM x LEFT JOIN tk ON grp = x.doc_id AND o.a = x.para_id""")(
    lambda spark, sf: gd.align_once(*paired(spark, sf)))


@query("gold_dataset", ss.with_references(f""", lo AS (SELECT doc_id, para_id, text FROM rz), mc AS (SELECT doc_id, {MOVED} AS para_id, {COPY} AS text, tag FROM g WHERE {KEPT}), {ORDER_SQL},
r AS (SELECT rz.doc_id, rz.para_id, rz.text, in_ref, al.manual_para, coalesce(al.score, 0.0) AS score, coalesce(m.tag, '') AS gold_tag, {sb.collapse("coalesce(m.tag, '')")} AS c
  FROM rz LEFT JOIN al ON al.doc_id = rz.doc_id AND al.para_id = rz.para_id LEFT JOIN mc m ON m.doc_id = rz.doc_id AND m.para_id = al.manual_para), {LOOKUPS}
SELECT doc_id, para_id AS para_index, text, gold_tag, CASE WHEN manual_para IS NULL THEN 'UNMAPPED' ELSE {CANONICAL} END AS canonical_gold_tag, score AS alignment_score,
  concat_ws('; ', CASE WHEN manual_para IS NULL THEN 'alignment:no_manual_match' ELSE {TAG_NOTE} END, 'manual_para_index:' || manual_para) AS notes, CASE WHEN in_ref THEN 'reference' ELSE 'body' END AS zone FROM lk"""))
def _(spark, sf):
    """Whole gold build: pair copy, align, canonicalise, label zones."""
    original = referenced(spark, sf).select(*KEY, "text", "in_ref")
    manual = ov.given(spark, sf).where(KEPT).select(
        "doc_id", F.expr(MOVED).alias("para_id"), F.expr(COPY).alias("text"), F.col("tag").alias("style_name"))
    alignment = gd.align_in_order(original, manual)
    return gd.gold_rows(original, manual, alignment, STYLES, ALIASES)


# --- evaluation ---------------------------------------------------------------------------
ZONE = "CASE doc_id % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'back_matter' ELSE 'body' END"
SPLIT = "CASE WHEN doc_id % 5 < 3 THEN 'dev' ELSE 'held_out' END"
ZV = "CASE z " + " ".join(f"WHEN {sb.lit(z)} THEN predicted_tag NOT IN {sb.in_list(t)}" for z, t in fixed.EVALUATION_ZONE_TAGS.items()) + " ELSE false END"
EVAL_SQL = ov.GOLD_SQL + f""",
g AS (SELECT *, {ov._duck(ov.GIVEN_CASE)} AS tag FROM o), pr AS (SELECT doc_id, para_id, tag FROM g WHERE (doc_id + para_id) % 12 <> 0),{sb.normalize_steps('pr', 'tag', 'predicted_tag')},
e0 AS (SELECT gold.doc_id, gold.para_id, gold_tag, {ZONE.replace('doc_id', 'gold.doc_id')} AS zone, {SPLIT.replace('doc_id', 'gold.doc_id')} AS split, predicted_tag, upper({ZONE.replace('doc_id', 'gold.doc_id')}) AS z FROM gold LEFT JOIN nz9 ON nz9.doc_id = gold.doc_id AND nz9.para_id = gold.para_id),
e AS (SELECT * EXCLUDE (z), CASE WHEN gold_tag = 'UNMAPPED' THEN 'unmapped' WHEN predicted_tag IS NULL THEN 'gap' WHEN gold_tag = predicted_tag THEN 'match' ELSE 'mismatch' END AS outcome,
  gold_tag <> 'UNMAPPED' AND predicted_tag IS NOT NULL AND {ZV} AS zone_violation FROM e0)"""


def evaluated(spark, sf):
    gold = ov.gold(spark, sf).drop("text", "alignment_score").withColumns({"zone": F.expr(ZONE), "split": F.expr(SPLIT)})
    predicted = ov.given(spark, sf).where("(doc_id + para_id) % 12 <> 0")
    return ev.evaluate_rows(gold, predicted)


query("evaluate_rows", f"WITH {EVAL_SQL} SELECT doc_id, para_id, gold_tag, predicted_tag, outcome, zone_violation FROM e")(
    lambda spark, sf: evaluated(spark, sf).select(*KEY, "gold_tag", "predicted_tag", "outcome", "zone_violation"))
query("evaluate_summary", f"""WITH {EVAL_SQL} SELECT split, doc_id, count_if(outcome <> 'unmapped') AS total, count_if(outcome = 'match') AS matches, count_if(outcome = 'gap') AS coverage_gaps, count_if(zone_violation) AS zone_violations,
  count_if(outcome = 'unmapped') AS unmapped, round(coalesce(100.0::DOUBLE * count_if(outcome = 'match') / nullif(count_if(outcome <> 'unmapped'), 0), 0), 6) AS accuracy FROM e GROUP BY ROLLUP (split, doc_id)""")(
    lambda spark, sf: ev.evaluate_summary(evaluated(spark, sf)))
TOP = "(SELECT {e} AS expected, predicted_tag AS actual, count(*) AS n, '{k}' AS kind FROM e WHERE {w} GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20)"
query("confusion_topn", f"WITH {EVAL_SQL} " + " UNION ALL ".join([TOP.format(e="gold_tag", k="confusion", w="outcome = 'mismatch'"), TOP.format(e="gold_tag", k="gap", w="outcome = 'gap'"), TOP.format(e="zone", k="violation", w="zone_violation")]))(
    lambda spark, sf: ev.top_pairs(evaluated(spark, sf), "confusion").unionByName(ev.top_pairs(evaluated(spark, sf), "gap")).unionByName(ev.top_pairs(evaluated(spark, sf), "violation")))
query("sequence_diff", ov.with_given("""
, ex AS (SELECT doc_id, para_id, tag FROM g), ac AS (SELECT doc_id, para_id, CASE WHEN doc_id % 3 > 0 AND (doc_id + para_id) % 8 = 0 THEN 'TXT' ELSE tag END AS tag FROM g WHERE para_id <= n - CASE WHEN doc_id % 6 = 1 THEN 1 ELSE 0 END),
b AS (SELECT coalesce(ex.doc_id, ac.doc_id) AS doc_id, coalesce(ex.para_id, ac.para_id) AS para_id, ex.tag AS expected, ac.tag AS actual FROM ex FULL JOIN ac ON ex.doc_id = ac.doc_id AND ex.para_id = ac.para_id),
f AS (SELECT *, min(CASE WHEN expected IS DISTINCT FROM actual THEN para_id END) OVER (PARTITION BY doc_id) AS fm FROM b)
SELECT doc_id, count(expected) AS n_expected, count(actual) AS n_actual, min(fm) AS first_mismatch, min(fm) IS NULL AS is_equal,
  coalesce(string_agg(coalesce(expected, '-') || '/' || coalesce(actual, '-'), ' ' ORDER BY para_id) FILTER (WHERE abs(para_id - fm) <= 2), '') AS context, coalesce(count_if(actual = 'TXT' AND expected IS DISTINCT FROM 'TXT'), 0) AS txt_gaps FROM f GROUP BY doc_id"""))(
    lambda spark, sf: ev.sequence_diff(
        ov.given(spark, sf),
        ov.given(spark, sf).where("para_id <= n - CASE WHEN doc_id % 6 = 1 THEN 1 ELSE 0 END").withColumn(
            "tag", F.expr("CASE WHEN doc_id % 3 > 0 AND (doc_id + para_id) % 8 = 0 THEN 'TXT' ELSE tag END"))))
query("content_integrity", ov.with_overlay("""
, a AS (SELECT doc_id, count_if(para_id % 5 > 0) AS body_before, count_if(para_id % 5 = 0) AS table_before FROM o GROUP BY 1),
b AS (SELECT doc_id, count_if(para_id % 5 > 0) AS body_after, count_if(para_id % 5 = 0) AS table_after FROM o WHERE (doc_id * 3 + para_id) % 41 > 0 GROUP BY 1)
SELECT doc_id, body_before, table_before, coalesce(body_after, 0) AS body_after, coalesce(table_after, 0) AS table_after, body_before = coalesce(body_after, 0) AND table_before = coalesce(table_after, 0) AS intact FROM a LEFT JOIN b USING (doc_id)"""))(
    lambda spark, sf: ev.content_integrity(
        ov.overlay(spark, sf).withColumn("is_table", F.expr("para_id % 5 = 0")),
        ov.overlay(spark, sf).where("(doc_id * 3 + para_id) % 41 > 0").withColumn("is_table", F.expr("para_id % 5 = 0"))))
query("invalid_tags", ov.with_given(f"SELECT tag, count(*) AS n FROM g WHERE tag <> '' AND tag NOT IN {sb.VOCAB_SQL} GROUP BY 1"))(
    lambda spark, sf: ev.invalid_tags(ov.given(spark, sf), sb.VOCAB))
query("dataset_gates", ov.with_gold("""SELECT count(*) AS rows, round(avg((alignment_score >= 0.85)::INT), 6) AS aligned_ratio, round(avg((gold_tag = 'UNMAPPED')::INT), 6) AS unmapped_ratio,
  avg((alignment_score >= 0.85)::INT) >= 0.8 AND avg((gold_tag = 'UNMAPPED')::INT) <= 0.1 AS passed FROM gold"""))(
    lambda spark, sf: ev.dataset_gates(ov.gold(spark, sf)))

# Gold tags that need the tag functions: noise spellings of the given tags.
ETAG = "CASE WHEN (doc_id + 2 * para_id) % 17 = 0 THEN 'UNMAPPED' WHEN text LIKE '%Journal of Tests%' THEN 'REF-N' WHEN text LIKE 'Table %' THEN 'TH' || (para_id % 8) ELSE tag END"


def egold(spark, sf):
    return ov.given(spark, sf).withColumn("gold_tag", F.expr(ETAG))


EG = ov.GIVEN_SQL + f", eg AS (SELECT *, {ETAG} AS gold_tag FROM g), tcnt AS (SELECT gold_tag, count(*) AS n FROM eg WHERE gold_tag <> 'UNMAPPED' GROUP BY 1),{sb.normalize_steps('tcnt', 'gold_tag', 'norm')}"
NEAR = f"un AS (SELECT * FROM nz9 WHERE norm NOT IN {sb.VOCAB_SQL}), nearf AS {sb.nearest_table('un', 'norm', 'style', True)}, nearc AS {sb.nearest_table('un', 'norm', 'close', False)}"
query("eval_normalization", f"""WITH {EG}, {NEAR} SELECT sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE gold_tag IN {sb.VOCAB_SQL}), 0)::BIGINT AS direct, coalesce(sum(n) FILTER (WHERE norm IN {sb.VOCAB_SQL}), 0)::BIGINT AS normalized, sum(n)::BIGINT AS enforced FROM nz9""")(
    lambda spark, sf: ev.normalization_coverage(egold(spark, sf), sb.VOCAB))
query("eval_remap", f"""WITH {EG}, {NEAR}, rm AS (SELECT un.*, coalesce({sb.chain_case('norm')}, {sb.family_pick('norm')}, nearc.close) IS NOT NULL AS kept FROM un LEFT JOIN nearc ON nearc.tag = un.norm)
SELECT coalesce(sum(n), 0)::BIGINT AS not_in_allowed, coalesce(sum(n), 0)::BIGINT AS before_txt, coalesce(sum(n) FILTER (WHERE NOT kept), 0)::BIGINT AS after_txt, coalesce(sum(n) FILTER (WHERE kept), 0)::BIGINT AS semantic_recoveries FROM rm""")(
    lambda spark, sf: ev.remap_recovery(egold(spark, sf), sb.VOCAB))
query("eval_detection_prf", ss.with_references(f""", h AS (SELECT doc_id, bool_or(starts_with({ETAG}, 'REF-')) AS has, bool_or(in_ref) AS found FROM rz GROUP BY 1),
c AS (SELECT count_if(has AND found) AS tp, count_if(NOT has AND found) AS fp, count_if(has AND NOT found) AS fn FROM h), p AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c)
SELECT tp AS correct, fp AS false_positives, fn AS false_negatives, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM p"""))(
    lambda spark, sf: ev.detection_scores(egold(spark, sf), referenced(spark, sf)))
query("label_detection_prf", ss.with_references("""
, d AS (SELECT doc_id, bool_or(in_ref) AS found FROM rz GROUP BY 1), c AS (SELECT count_if(quality = 1 AND found) AS tp, count_if(quality = 0 AND found) AS fp, count_if(quality = 1 AND NOT found) AS fn FROM d JOIN labels USING (doc_id)),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
SELECT tp AS correct, fp AS false_positives, fn AS false_negatives, round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0 END AS f1 FROM p"""))(
    lambda spark, sf: ev.binary_scores(
        referenced(spark, sf).groupBy("doc_id").agg(F.max("in_ref").alias("found")).join(table(spark, sf, "labels"), "doc_id").agg(
            F.count_if((F.col("quality") == 1) & F.col("found")).alias("tp"), F.count_if((F.col("quality") == 0) & F.col("found")).alias("fp"),
            F.count_if((F.col("quality") == 1) & ~F.col("found")).alias("fn"))))
query("eval_heading_map", f"""WITH {EG} SELECT coalesce(sum(n), 0)::BIGINT AS th_entries, coalesce(sum(n) FILTER (WHERE regexp_matches(gold_tag, '^TH[1-6]$')), 0)::BIGINT AS sk_h_entries,
  coalesce(sum(n) FILTER (WHERE regexp_matches(gold_tag, '^TH[1-6]$')), 0)::BIGINT AS tbl_h_entries, 2 * coalesce(sum(n) FILTER (WHERE regexp_matches(gold_tag, '^TH[1-6]$')), 0)::BIGINT AS correct_mappings FROM tcnt WHERE regexp_matches(gold_tag, '^TH[0-9]+$')""")(
    lambda spark, sf: ev.heading_mapping(egold(spark, sf)))
query("eval_rule_coverage", ss.with_structure(f""", w AS (SELECT *, {ETAG} AS gold_tag, {sb.strip('text')} AS t, list_filter(string_split_regex({sb.strip('text')}, '[\\s\\x{{00A0}}]+'), lambda x: x <> '') AS ws FROM s),
f AS (SELECT *, {sb.has('text', fixed.FEATURE_NUMBERED_PATTERN)} AS num, {sb.has('text', fixed.REF_BULLET_PATTERN)} AS bul,
  t <> '' AND length(t) < 100 AND regexp_matches(t, '^\\p{{Lu}}') AND right(t, 1) <> '.' AND len(ws) <= 10 AND len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= greatest(1, floor(0.7::DOUBLE * len(ws))) AS hd,
  ({sb.has('text', fixed.YEAR_PATTERN)} OR contains(lower(text), 'doi') OR contains(lower(text), 'et al')) AND starts_with(gold_tag, 'REF-') AS rf FROM w WHERE gold_tag <> 'UNMAPPED')
SELECT count(*) AS total, count_if(num) AS has_numbering, count_if(bul) AS has_bullet, count_if(hd) AS heading_pattern, count_if(rf) AS reference_pattern, count_if(zone = 'TABLE') AS table_zone, count_if(starts_with(zone, 'BOX')) AS box_zone,
  round(least(100.0::DOUBLE * (count_if(num) + count_if(bul) + count_if(zone = 'TABLE') + count_if(starts_with(zone, 'BOX'))) / count(*), 100), 6) AS potential_coverage FROM f"""))(
    lambda spark, sf: ev.rule_potential(referenced(spark, sf).withColumn("gold_tag", F.expr(ETAG))))
