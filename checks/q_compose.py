"""Joins between predictions, caches and replies; composed plans; sinks."""

from pyspark.sql import functions as F

from checks import overlay as ov
from checks import sqlbits as sb
from checks import structure_sql as ss
from checks.q_repair import V, full_ladder, refs_with
from checks.q_retrieval import examples as gold_examples
from checks.q_structure import quality_sql, referenced
from checks.registry import query
from folioscope import fixed
from folioscope.functions import styles as st
from folioscope.operators import cache, quality, repair, review, usage
from folioscope.operators.heal import self_heal
from folioscope.operators.retrieval import ExampleIndex
from folioscope.plans.structure import retry_cascade, structure_corpus, tag_with
from folioscope.session import fresh_path, through_table
from folioscope.sources import sinks

KEY = ["doc_id", "para_id"]
NOW = "2024-03-01 00:00:00"

# --- merging ------------------------------------------------------------------------------
PART = "(doc_id + para_id) % 6 <> 0"
query("attach_tags", ov.with_given(f"SELECT doc_id, para_id, text, CASE WHEN {PART} THEN tag ELSE 'TXT' END AS tag, CASE WHEN {PART} THEN confidence ELSE 0 END AS confidence FROM g"))(
    lambda spark, sf: review.attach_tags(ov.overlay(spark, sf).drop("n"), ov.given(spark, sf).where(PART)))
query("fill_missing", ov.with_given(f"SELECT doc_id, para_id, CASE WHEN {PART} THEN tag ELSE 'TXT' END AS tag, CASE WHEN {PART} THEN confidence ELSE 0 END AS confidence, NOT ({PART}) AS missing FROM g"))(
    lambda spark, sf: review.fill_missing(ov.overlay(spark, sf), ov.given(spark, sf).where(PART).select(*KEY, "tag", "confidence")))
MERGED = """SELECT doc_id, para_id, CASE WHEN para_id % 4 = 0 THEN 'H1' WHEN para_id % 3 <> 0 THEN tag ELSE 'BL-MID' END AS tag, CASE WHEN para_id % 4 = 0 THEN 0.9 WHEN para_id % 3 <> 0 THEN confidence ELSE 0.8 END AS confidence,
  CASE WHEN para_id % 4 = 0 THEN 'rule' WHEN para_id % 3 <> 0 THEN 'model' ELSE 'cache' END AS source FROM g WHERE para_id % 4 = 0 OR para_id % 3 <> 0 OR para_id % 2 = 1"""


def merged(spark, sf):
    g = ov.given(spark, sf)
    by_rule = g.where("para_id % 4 = 0").withColumns({"tag": F.lit("H1"), "confidence": F.lit(0.9)})
    by_model = g.where("para_id % 3 <> 0")
    by_cache = g.where("para_id % 2 = 1").withColumns({"tag": F.lit("BL-MID"), "confidence": F.lit(0.8)})
    return review.merge_results(("rule", by_rule), ("model", by_model), ("cache", by_cache))


query("merge_results", ov.with_given(MERGED))(merged)
query("usage_counters", ov.with_given(f""", m AS ({MERGED}) SELECT count_if(source = 'rule') AS rule_predictions, count_if(source = 'model') AS model_predictions, count_if(source IN ('rule', 'model')) AS total_predictions,
  round(count_if(source = 'rule') / count_if(source IN ('rule', 'model')), 6) AS rule_coverage, count_if(source = 'cache') AS cache_hits, round(100.0::DOUBLE * count_if(source = 'cache') / count(*), 1) AS hit_rate, count_if(para_id % 5 = 0 AND source = 'model') AS items_improved FROM m"""))(
    lambda spark, sf: usage.usage_counters(merged(spark, sf).withColumn("improved", (F.col("para_id") % 5 == 0) & (F.col("source") == "model"))))
SECOND = "CASE WHEN para_id % 2 = 0 THEN tag ELSE 'H3' END"
query("fallback_merge", ov.with_given(f""", f AS (SELECT *, {SECOND} AS t2, round(confidence + 0.1 - (para_id % 3) * 0.1, 2) AS c2, para_id % 5 <> 0 AS has2 FROM g),
u AS (SELECT *, confidence < 0.75 AND has2 AND (c2 > confidence OR t2 <> tag) AS used FROM f)
SELECT doc_id, para_id, CASE WHEN used THEN t2 ELSE tag END AS tag, CASE WHEN used THEN c2 ELSE confidence END AS confidence, CASE WHEN used THEN tag END AS original_tag, CASE WHEN used THEN confidence END AS original_confidence, used AS fallback_used FROM u"""))(
    lambda spark, sf: review.merge_reevaluation(
        ov.given(spark, sf).select(*KEY, "tag", "confidence"),
        ov.given(spark, sf).where("para_id % 5 <> 0").select(*KEY, F.expr(SECOND).alias("tag"), F.expr("round(confidence + 0.1D - (para_id % 3) * 0.1D, 2)").alias("confidence")),
        below=0.75))

# --- cache ------------------------------------------------------------------------------------
CKEY = f"left(sha256(doc_id || ':' || para_id || ':' || {sb.matching('text')} || ':BODY'), 16)"
CACHED_AT = f"TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 60 AS INT))"


def cache_table(spark, sf):
    g = ov.given(spark, sf)
    return g.where("para_id % 4 = 0").select(
        cache.cache_key(F.col("doc_id"), F.col("para_id"), F.col("text"), F.lit("BODY")).alias("cache_key"), "tag", "confidence",
        F.expr(f"TIMESTAMP '{NOW}' - make_dt_interval(CAST(doc_id % 60 AS INT))").alias("cached_at"))


query("cache_lookup", ov.with_given(f"""SELECT doc_id, para_id, {CKEY} AS cache_key, CASE WHEN para_id % 4 = 0 AND doc_id % 60 < 30 THEN tag END AS cached_tag,
  CASE WHEN para_id % 4 = 0 AND doc_id % 60 < 30 THEN confidence END AS cached_confidence, para_id % 4 = 0 AND doc_id % 60 < 30 AS cached FROM g"""))(
    lambda spark, sf: cache.lookup(
        ov.overlay(spark, sf).select(*KEY, cache.cache_key(F.col("doc_id"), F.col("para_id"), F.col("text"), F.lit("BODY")).alias("cache_key")),
        cache_table(spark, sf), F.lit(NOW).cast("timestamp")))
query("cache_upsert", ov.with_given(f"""SELECT {CKEY} AS cache_key, CASE WHEN para_id % 2 = 0 AND NOT (para_id % 4 = 0 AND doc_id % 60 < 10) THEN 'H1' ELSE tag END AS tag,
  CAST(CASE WHEN para_id % 2 = 0 AND NOT (para_id % 4 = 0 AND doc_id % 60 < 10) THEN TIMESTAMP '{NOW}' - INTERVAL 10 DAY ELSE {CACHED_AT} END AS VARCHAR) AS cached_at FROM g WHERE para_id % 2 = 0 AND NOT (para_id % 4 = 0 AND doc_id % 60 = 10)
  UNION ALL SELECT {CKEY}, greatest(tag, 'H1'), CAST(TIMESTAMP '{NOW}' - INTERVAL 10 DAY AS VARCHAR) FROM g WHERE para_id % 4 = 0 AND doc_id % 60 = 10"""))(
    lambda spark, sf: cache.upsert(
        cache_table(spark, sf),
        ov.given(spark, sf).where("para_id % 2 = 0").select(
            cache.cache_key(F.col("doc_id"), F.col("para_id"), F.col("text"), F.lit("BODY")).alias("cache_key"), F.lit("H1").alias("tag"), "confidence",
            F.expr(f"TIMESTAMP '{NOW}' - INTERVAL 10 DAYS").alias("cached_at"))).select(
        "cache_key", "tag", F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss").alias("cached_at")))

# --- alias ladder --------------------------------------------------------------------------------
WILD = """CASE (doc_id * 3 + para_id) % 23 WHEN 0 THEN 'BIBITEM' WHEN 1 THEN 'COUT' WHEN 2 THEN 'HH' WHEN 3 THEN 'REF' WHEN 4 THEN 'TYPE' WHEN 5 THEN 'TTL' WHEN 6 THEN 'TBL-BL-FIRST' WHEN 7 THEN 'TBL-NL-LAST'
  WHEN 8 THEN 'TBL-TXT' WHEN 9 THEN 'BL-TXT' WHEN 10 THEN 'EFP-H1' WHEN 11 THEN 'EYU-BX' WHEN 12 THEN '1-TTL' WHEN 13 THEN '2-TXT-FLUSH' WHEN 14 THEN '3' WHEN 15 THEN 'NBX-BL-FIRST' WHEN 16 THEN 'Answer: h2.' WHEN 17 THEN 'FIG-LEG' ELSE tag END"""
WZONE = "CASE (doc_id + para_id) % 5 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'BACK_MATTER' ELSE zone END"


def has(x):
    return f"{x} IN {sb.VOCAB_SQL}"


def alias_ctes(source: str, raw: str, out: str = "mapped_tag", prefix: str = "al") -> str:
    """Sanitise, normalise, then the ladder; ends in CTE `{prefix}m`."""
    p = prefix
    fe = "regexp_extract_all(up, '[A-Z0-9]+(?:[_-][A-Z0-9]+)*')"
    bul = sb.has(sb.strip("text"), fixed.REF_BULLET_PATTERN)
    ref_tag = f"CASE WHEN {bul} THEN 'REF-U' ELSE 'REF-N' END"
    zp = "substr(zone, 5)"
    inbox = "starts_with(zone, 'BOX_')"
    rungs = [
        (f"in_ref AND regexp_matches(m, '^(UL|BL|NL)-') AND {has(ref_tag)}", ref_tag),
        (f"m = 'BIBITEM' AND in_ref AND {has(ref_tag)}", ref_tag),
        ("m = 'BIBITEM'", "'REF-U'"), ("m = 'COUT'", "'COUT-1'"), ("m = 'HH'", "'H1'"), ("m = 'REF'", ref_tag),
        (f"m = 'TYPE' AND {inbox} AND {has(zp + chr(124) * 2 + chr(39) + '-TYPE' + chr(39))}", f"{zp} || '-TYPE'"), ("m = 'TYPE' AND zone = 'TABLE'", "'T'"),
        (f"m = 'TTL' AND {inbox} AND {has(zp + chr(124) * 2 + chr(39) + '-TTL' + chr(39))}", f"{zp} || '-TTL'"), ("m = 'TTL' AND zone = 'TABLE'", "'T1'"),
        ("regexp_matches(m, '^TBL-BL-(FIRST|MID|LAST)$')", "'TBL' || substr(m, 7)"), ("regexp_matches(m, '^TBL-NL-(FIRST|MID|LAST)$')", "'TNL' || substr(m, 7)"),
        ("regexp_matches(m, '^TBL-UL-(FIRST|MID|LAST)$')", "'TUL' || substr(m, 7)"), ("m = 'TBL-TXT'", "'T'"), ("m = 'BL-TXT'", "'BL-MID'"),
        (f"regexp_matches(m, '^(EFP|EYU)-BX-') AND {has(chr(39) + 'BX4-' + chr(39) + ' || substr(m, 8)')}", "'BX4-' || substr(m, 8)"),
        (f"regexp_matches(m, '^(EFP|EYU)-') AND {has('substr(m, 5)')}", "substr(m, 5)"), ("m IN ('EFP-BX', 'EYU-BX')", "'TXT'"),
        (f"{inbox} AND {has(zp + ' || ' + chr(39) + '-' + chr(39) + ' || w')}", f"{zp} || '-' || w"),
        (f"w <> m AND {has(chr(39) + 'BX' + chr(39) + ' || m')}", "'BX' || m"),
        (f"{inbox} AND regexp_matches(w, '^[0-9]+$') AND {has(zp + ' || ' + chr(39) + '-TTL' + chr(39))}", f"{zp} || '-TTL'"),
        ("zone = 'TABLE' AND regexp_matches(w, '^(BX|NBX|KT-|KP-|OBJ-)') AND ends_with(w, '-FIRST')", "'TBL-FIRST'"),
        ("zone = 'TABLE' AND regexp_matches(w, '^(BX|NBX|KT-|KP-|OBJ-)') AND ends_with(w, '-LAST')", "'TBL-LAST'"),
        ("zone = 'TABLE' AND regexp_matches(w, '^(BX|NBX|KT-|KP-|OBJ-)') AND ends_with(w, '-MID')", "'TBL-MID'"),
        ("zone = 'TABLE' AND regexp_matches(w, '^(BX|NBX|KT-|KP-|OBJ-)')", "'T'"), ("zone = 'TABLE' AND regexp_matches(w, '^H[0-9]+$')", "'TH1'"),
        ("zone = 'BACK_MATTER' AND w NOT IN ('SR', 'SRH1') AND regexp_matches(w, '^(FIG-|T|REF|H)')", ref_tag),
    ]
    whens = "\n  ".join(f"WHEN {c} THEN {v}" for c, v in rungs)
    return f"""
{p}0 AS (SELECT *, upper(trim(coalesce({raw}, ''))) AS up FROM {source}),
{p}c AS (SELECT doc_id, para_id, unnest({fe}) AS cand, generate_subscripts({fe}, 1) AS pos FROM {p}0),{sb.normalize_steps(f'{p}c', 'cand', 'cnorm', f'{p}n')},
{p}b AS (SELECT doc_id, para_id, min_by(cand, pos) FILTER (WHERE {has('cnorm')}) AS known, min_by(cand, pos) AS any_tok FROM {p}n9 GROUP BY ALL),
{p}1 AS (SELECT x.*, CASE WHEN up = '' THEN 'TXT' WHEN regexp_matches(up, '^[A-Z0-9]+(?:[_-][A-Z0-9]+)*$') THEN up ELSE coalesce(known, any_tok, 'TXT') END AS san FROM {p}0 x LEFT JOIN {p}b USING (doc_id, para_id)),{sb.normalize_steps(f'{p}1', 'san', 'm', f'{p}k')},
{p}2 AS (SELECT *, CASE WHEN regexp_matches(m, '^[0-9]+-[A-Z0-9-]+$') THEN regexp_extract(m, '^[0-9]+-([A-Z0-9-]+)$', 1) ELSE m END AS w FROM {p}k9),
{p}m AS (SELECT * EXCLUDE (up, san, m, w), CASE {whens} ELSE w END AS {out} FROM {p}2)"""


WILD_ROWS = f"wr AS (SELECT * REPLACE ({WILD} AS tag, {WZONE} AS zone) FROM rz)"


def wild(spark, sf):
    return referenced(spark, sf).withColumns({"tag": F.expr(WILD), "zone": F.expr(WZONE)})


query("map_tag_alias", ss.with_references(f", {WILD_ROWS},{alias_ctes('wr', 'tag')} SELECT doc_id, para_id, zone, tag, mapped_tag FROM alm"))(
    lambda spark, sf: st.map_tag_alias(wild(spark, sf), "tag", V).select(*KEY, "zone", "tag", "mapped_tag"))

SAFE = f"""CASE WHEN zone = 'TABLE' THEN CASE WHEN regexp_matches(lower({sb.strip('text')}), '^(note|source)') THEN 'TFN' WHEN {sb.has(sb.strip('text'), fixed.REF_BULLET_PATTERN)} THEN 'TBL-MID'
   WHEN {sb.has(sb.strip('text'), fixed.REPLY_NUMBER_PATTERN)} THEN 'TNL-MID' ELSE 'T' END WHEN zone = 'BACK_MATTER' THEN CASE WHEN {sb.has(sb.strip('text'), fixed.REF_BULLET_PATTERN)} THEN 'REF-U' ELSE 'REF-N' END
   WHEN zone = 'METADATA' THEN 'PMI' ELSE 'TXT' END"""
HINT = "CASE zone " + " ".join(f"WHEN {sb.lit(z)} THEN {sb.lit(', '.join(e[:5]))}" for z, e in fixed.ZONE_WILDCARDS.items()) + " END"
query("zone_postcheck", ss.with_references(f""", {WILD_ROWS},{alias_ctes('wr', 'tag', 'al_tag')},
zc AS (SELECT *, {SAFE} AS safe, zone <> 'BODY' AND NOT {sb.wildcard_zone_ok('tag', 'zone')} AS refused, {sb.wildcard_zone_ok('al_tag', 'zone')} AND al_tag <> '' AS al_ok FROM alm),
zd AS (SELECT *, {sb.wildcard_zone_ok('safe', 'zone')} AS safe_ok FROM zc)
SELECT doc_id, para_id, CASE WHEN refused AND al_ok THEN al_tag WHEN refused AND safe_ok THEN safe ELSE tag END AS tag,
  CASE WHEN refused AND NOT al_ok THEN least(round(confidence * 100), CASE WHEN safe_ok THEN 70 ELSE 60 END) ELSE round(confidence * 100) END AS confidence,
  refused AND NOT al_ok AND NOT safe_ok AS zone_violation, CASE WHEN refused AND NOT al_ok AND NOT safe_ok THEN {HINT} END AS hints FROM zd"""))(
    lambda spark, sf: repair.check_zones(wild(spark, sf).withColumn("confidence", F.round(F.col("confidence") * 100)), V).select(
        *KEY, "tag", "confidence", "zone_violation", F.array_join("zone_suggestions", ", ").alias("hints")))

# --- replies ------------------------------------------------------------------------------------------


@query("parse_replies", ov.with_given("""SELECT doc_id, para_id AS id, tag, CAST(round(confidence * 100) AS BIGINT) AS confidence FROM g
  WHERE doc_id % 4 <> 2 OR para_id < n"""))
def _(spark, sf):
    """Replies rendered from the whole given table in four states of repair."""
    item = F.format_string('{"id": %d, "tag": "%s", "confidence": %d}', F.col("para_id"), F.col("tag"), F.round(F.col("confidence") * 100).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_id", item.alias("j")))), lambda s: s["j"]), ", ")
    docs = ov.given(spark, sf).groupBy("doc_id").agg(joined.alias("body"))
    whole = F.concat(F.lit("["), F.col("body"), F.lit("]"))
    # Cut inside the last object; a lone object then has nothing to keep.
    cut = F.concat(F.lit("```json\n["), F.expr("substring(body, 1, length(body) - 15)"))
    state = F.col("doc_id") % 4
    reply = (F.when(state == 0, whole).when(state == 1, F.concat(F.lit("Here you are:\n"), whole, F.lit("\nDone.")))
             .when(state == 2, cut).otherwise(F.concat(F.lit("["), F.regexp_replace("body", r"\}, \{", "} then {"))))
    return review.parse_replies(docs.select("doc_id", reply.alias("reply")))


CORR = "CASE WHEN para_id % 3 = 0 THEN 'H1' ELSE tag END"
query("self_heal", ss.with_references(f""", {WILD_ROWS},{alias_ctes('wr', 'tag', 'm1', 'ha')},
hd AS (SELECT *, bool_or(m1 NOT IN {sb.VOCAB_SQL}) OVER (PARTITION BY doc_id) AND para_id % 2 = 0 AS corrected FROM ham),
he AS (SELECT * EXCLUDE (m1), CASE WHEN corrected THEN {CORR} ELSE tag END AS raw2, CASE WHEN corrected THEN 77 ELSE round(confidence * 100) END AS conf2 FROM hd),{alias_ctes('he', 'raw2', 'm2', 'hb')},{sb.normalize_steps('hbm', 'm2', 'norm', 'hn')},
un AS (SELECT * FROM hn9 WHERE norm NOT IN {sb.VOCAB_SQL}), near AS {sb.nearest_table('un', 'norm', 'style', True)},
hf AS (SELECT x.*, m2 NOT IN {sb.VOCAB_SQL} AS healed, CASE WHEN norm IN {sb.VOCAB_SQL} THEN norm ELSE coalesce(near.style, 'TXT') END AS ntag FROM hn9 x LEFT JOIN near ON near.tag = x.norm)
SELECT doc_id, para_id, CASE WHEN healed THEN ntag ELSE m2 END AS tag, CASE WHEN healed THEN least(conf2, 60) ELSE conf2 END AS confidence, corrected, healed FROM hf"""))(
    lambda spark, sf: self_heal(
        wild(spark, sf).withColumn("confidence", F.round(F.col("confidence") * 100)),
        wild(spark, sf).where("para_id % 2 = 0").select(*KEY, F.expr(CORR).alias("tag"), F.lit(77.0).alias("confidence")), V))


@query("self_heal_knn")
def _(spark, sf):
    """The same with the gold index as the third step."""
    rows = wild(spark, sf).withColumn("confidence", F.round(F.col("confidence") * 100))
    none = rows.limit(0).select(*KEY, "tag", "confidence")
    return self_heal(rows, none, V, ExampleIndex(gold_examples(spark, sf), carry=("zone",), parts=ov.parts(spark, sf), each_row=True))


# --- composed plans ---------------------------------------------------------------------------------------
query("tagger_override", ov.with_given("SELECT doc_id, para_id, text, CASE WHEN text LIKE '<H1>%' THEN 'H1' ELSE 'TXT' END AS tag, 0.95 AS confidence FROM g"))(
    lambda spark, sf: tag_with(
        ov.overlay(spark, sf).drop("n"),
        lambda p: p.select(*KEY, F.expr("CASE WHEN text LIKE '<H1>%' THEN 'H1' ELSE 'TXT' END").alias("tag"), F.lit(0.95).alias("confidence"))))

_lad = full_ladder()
_Q = quality_sql(f"(SELECT * FROM {_lad.last})").strip()
query("review_bundle", refs_with(_lad, f""", {_Q}
SELECT x.doc_id, para_id, CASE WHEN length({sb.strip('text')}) > 160 THEN left({sb.strip('text')}, 160) || '...' ELSE {sb.strip('text')} END AS text_preview, tag, confidence, repaired, repair_reason, score, action
FROM @ x JOIN q USING (doc_id) WHERE action = 'REVIEW'"""))(
    lambda spark, sf: (lambda rows: review.review_bundle(rows, quality.score_documents(rows, V, "flag")))(
        through_table(structure_corpus(ov.given(spark, sf), V, sb.ZONES), "structured")))


@query("route_partitions", refs_with(_lad, f", {_Q} SELECT doc_id, action, score FROM q"))
def _(spark, sf):
    rows = structure_corpus(ov.given(spark, sf), V, sb.ZONES)
    path = fresh_path(spark, "by-action")
    sinks.write_by_action(quality.score_documents(rows, V, "flag"), path)
    return spark.read.parquet(path).select("doc_id", "action", "score")


@query("result_documents", ov.with_given("""SELECT doc_id, count(*) AS n, count_if(confidence * 100 >= 85) AS auto_applied, string_agg(tag, ' ' ORDER BY para_id) AS tags, coalesce(string_agg(tag, ' ' ORDER BY para_id) FILTER (WHERE NOT confidence * 100 >= 85), '') AS flagged FROM g GROUP BY doc_id"""))
def _(spark, sf):
    path = fresh_path(spark, "results")
    sinks.write_results(sinks.result_documents(ov.given(spark, sf).withColumn("confidence", F.col("confidence") * 100)), path)
    schema = "doc_id long, summary struct<total_paragraphs:long,auto_applied:long>, classifications array<struct<tag:string>>, flagged_items array<struct<tag:string>>"
    return spark.read.schema(schema).json(path).select(
        "doc_id", F.col("summary.total_paragraphs").alias("n"), F.col("summary.auto_applied").alias("auto_applied"),
        F.array_join("classifications.tag", " ").alias("tags"), F.array_join("flagged_items.tag", " ").alias("flagged"))


# Second source: surer tags, so documents in the middle band move.
UP = "CASE WHEN tag IN ('TXT', 'XYZ') AND para_id % 2 = 0 THEN 'BL-MID' ELSE tag END"


@query("retry_cascade")
def _(spark, sf):
    given = ov.given(spark, sf)
    second = given.withColumns({"tag": F.expr(UP), "confidence": F.greatest("confidence", F.lit(0.7))})

    def pick(rows):
        return lambda p: rows.select(*KEY, "tag", "confidence")

    # Each round is written once; the next one reads it back.
    return retry_cascade(
        ov.overlay(spark, sf), [pick(given), pick(second), pick(second)], V, zone_styles=sb.ZONES,
        keep=lambda df, attempt: through_table(df, f"attempt-{attempt}"),
    ).select("doc_id", "para_id", "tag", "score", "action", "attempts")
