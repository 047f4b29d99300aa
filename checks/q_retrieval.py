"""TF-IDF retrieval over the gold overlay, asked by the benchmark passages."""

from pyspark.sql import functions as F

from checks import overlay as ov
from checks import sqlbits as sb
from checks.registry import query, table
from folioscope import fixed
from folioscope.operators import retrieval
from folioscope.sources.gold import usable_gold

EXAMPLES = ov.GOLD_SQL + f""",
ex AS (SELECT *, 'src' || (doc_id % 20) || '_' || doc_id AS name, CASE WHEN doc_id % 2 = 0 THEN 'body' ELSE 'table' END AS zone FROM gold WHERE gold_tag <> 'UNMAPPED' AND alignment_score >= 0.75),
tk AS (SELECT doc_id, para_id, unnest(regexp_extract_all({sb.matching('text')}, {sb.lit(fixed.TOKEN_PATTERN)})) AS token FROM ex),
tc0 AS (SELECT doc_id, para_id, token, count(*) AS c FROM tk GROUP BY ALL),
tc AS (SELECT doc_id, para_id, token, c / sum(c) OVER (PARTITION BY doc_id, para_id) AS tf FROM tc0),
idf AS (SELECT token, count(*) AS df, (SELECT count(*) FROM ex) / count(*) AS idf FROM tc GROUP BY 1),
vec AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id, para_id)) AS norm FROM (SELECT doc_id, para_id, token, tf * idf AS w FROM tc JOIN idf USING (token)))"""


def asked(source: str, key: str) -> str:
    return f"""qk AS (SELECT {key}, unnest(regexp_extract_all({sb.matching('text')}, {sb.lit(fixed.TOKEN_PATTERN)})) AS token FROM {source}),
qc0 AS (SELECT {key}, token, count(*) AS c FROM qk GROUP BY ALL),
qc AS (SELECT {key}, token, c / sum(c) OVER (PARTITION BY {key}) AS tf FROM qc0),
qv AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY {key})) AS norm FROM (SELECT {key}, token, tf * idf AS w FROM qc JOIN idf USING (token)))"""


def examples(spark, sf):
    rows = ov.gold(spark, sf).withColumn("canonical_gold_tag", F.col("gold_tag"))
    return usable_gold(rows).withColumns({
        "name": F.expr("'src' || (doc_id % 20) || '_' || doc_id"),
        "zone": F.expr("CASE WHEN doc_id % 2 = 0 THEN 'body' ELSE 'table' END")})


def index(spark, sf):
    return retrieval.ExampleIndex(examples(spark, sf), carry=("name", "zone"), parts=ov.parts(spark, sf))


query("tfidf_idf", f"WITH {EXAMPLES} SELECT token, df, round(idf, 6) AS idf FROM idf")(
    lambda spark, sf: index(spark, sf).idf.select("token", "df", F.round("idf", 6).alias("idf")))
query("tfidf_vectors", f"WITH {EXAMPLES} SELECT doc_id, para_id, token, round(w, 6) AS w, round(norm, 6) AS norm FROM vec")(
    lambda spark, sf: index(spark, sf).postings.select("doc_id", "para_id", "token", F.round("w", 6).alias("w"), F.round("norm", 6).alias("norm")))
query("retriever_stats", f"WITH {EXAMPLES} SELECT (SELECT count(*) FROM ex) AS total_examples, (SELECT count(DISTINCT doc_id) FROM ex) AS num_documents, (SELECT count(*) FROM idf) AS vocab_size, (SELECT round(avg(alignment_score), 6) FROM ex) AS avg_alignment_score")(
    lambda spark, sf: retrieval.stats(index(spark, sf)))
query("diverse_examples", f"""WITH {EXAMPLES}, f AS (SELECT gold_tag, min((doc_id, para_id)) AS e FROM ex GROUP BY 1 ORDER BY 1 LIMIT 8),
r AS (SELECT doc_id, para_id, 1 AS part, '' AS t, alignment_score FROM ex WHERE (doc_id, para_id) NOT IN (SELECT e FROM f)),
u AS (SELECT e[1] AS doc_id, e[2] AS para_id, 0 AS part, gold_tag AS t, 0.0::DOUBLE AS alignment_score FROM f UNION ALL SELECT * FROM r)
SELECT doc_id, para_id, rank FROM (SELECT *, row_number() OVER (ORDER BY part, t, alignment_score DESC, doc_id, para_id) AS rank FROM u) WHERE rank <= 8""")(
    lambda spark, sf: retrieval.diverse(examples(spark, sf), 8))

query("retriever_top_tags", f"WITH {EXAMPLES} SELECT gold_tag, count(*) AS n FROM ex GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")(
    lambda spark, sf: retrieval.top_tags(index(spark, sf)))

DIVERSE = """f AS (SELECT gold_tag, min((doc_id, para_id)) AS e FROM ex GROUP BY 1 ORDER BY 1 LIMIT 8),
r AS (SELECT doc_id, para_id, 1 AS part, '' AS t, alignment_score FROM ex WHERE (doc_id, para_id) NOT IN (SELECT e FROM f)),
u AS (SELECT e[1] AS doc_id, e[2] AS para_id, 0 AS part, gold_tag AS t, 0.0::DOUBLE AS alignment_score FROM f UNION ALL SELECT * FROM r),
dv AS (SELECT doc_id, para_id, rank FROM (SELECT *, row_number() OVER (ORDER BY part, t, alignment_score DESC, doc_id, para_id) AS rank FROM u) WHERE rank <= 8)"""


def topk_sql(source: str, boost: str = "1", same: str = "true") -> str:
    """Every query of ``source``: its best examples, or the diverse ones if no token is known."""
    return f"""WITH {EXAMPLES}, {DIVERSE}, bq AS ({source}), {asked('bq', 'item_id')},
pos AS (SELECT item_id, doc_id, para_id, sum(qv.w * vec.w) / (max(qv.norm) * max(vec.norm)) AS s FROM qv JOIN vec USING (token) GROUP BY ALL),
every AS (SELECT q.item_id, ex.doc_id, ex.para_id, round(coalesce(s, 0) * {boost}, 9) AS score
  FROM (SELECT * FROM bq WHERE item_id IN (SELECT item_id FROM qv)) q JOIN ex ON {same} LEFT JOIN pos ON pos.item_id = q.item_id AND pos.doc_id = ex.doc_id AND pos.para_id = ex.para_id)
SELECT item_id, doc_id AS example_doc, para_id AS example_para, rank, round(score, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC, para_id DESC) AS rank FROM every) WHERE rank <= 8
UNION ALL SELECT item_id, doc_id, para_id, rank, 0.0 FROM bq, dv WHERE item_id NOT IN (SELECT item_id FROM qv)"""


NAMED = "SELECT item_id, 'src' || (item_id % 20) || '_q' AS qname, text FROM benchmark"
BOOST = "CASE WHEN s IS NOT NULL AND starts_with(ex.name, split_part(q.qname, '_', 1)) THEN 1.2 ELSE 1 END"
query("retrieve_topk", topk_sql(NAMED, BOOST))(
    lambda spark, sf: retrieval.retrieve(
        index(spark, sf), table(spark, sf, "benchmark").select("item_id", F.expr("'src' || (item_id % 20) || '_q'").alias("qname"), "text"),
        ["item_id"], k=8, book=("qname", "name")))
# Some queries without any known token: they get the diverse examples.
STRANGE = "CASE WHEN item_id % 7 = 0 THEN 'qqzzq' || item_id ELSE text END"
query("retrieve_topk_fallback", topk_sql(f"SELECT item_id, {STRANGE} AS text FROM benchmark"))(
    lambda spark, sf: retrieval.retrieve(
        index(spark, sf), table(spark, sf, "benchmark").select("item_id", F.expr(STRANGE).alias("text")), ["item_id"], k=8))
ASKED_ZONE = "CASE WHEN item_id % 3 = 0 THEN 'TABLE' ELSE 'Body' END"
query("retrieve_topk_by_zone", topk_sql(f"SELECT item_id, {STRANGE} AS text, {ASKED_ZONE} AS qzone FROM benchmark", same="upper(ex.zone) = upper(q.qzone)"))(
    lambda spark, sf: retrieval.retrieve(
        index(spark, sf), table(spark, sf, "benchmark").select("item_id", F.expr(STRANGE).alias("text"), F.expr(ASKED_ZONE).alias("qzone")),
        ["item_id"], k=8, same=("qzone", "zone")))

KQ = "CASE WHEN tag = 'XYZ' THEN 'XYZ' WHEN (doc_id + para_id) % 19 = 0 THEN 'QQQQQQQQ' ELSE tag END"
query("knn_fallback", f"""WITH {EXAMPLES}, 
g AS (SELECT *, {ov._duck(ov.GIVEN_CASE)} AS tag FROM o), kr AS (SELECT doc_id, para_id, text, {KQ} AS mapped_tag, CASE WHEN doc_id % 3 = 0 THEN 'TABLE' ELSE 'BODY' END AS zone FROM g),
{sb.normalize_steps('kr', 'mapped_tag', 'norm').strip()},
un AS (SELECT * FROM nz9 WHERE norm NOT IN {sb.VOCAB_SQL}), near AS {sb.nearest_table('un', 'norm', 'style', True)},
kn AS (SELECT x.*, CASE WHEN norm IN {sb.VOCAB_SQL} THEN norm ELSE coalesce(near.style, CASE WHEN starts_with(norm, 'H') AND regexp_matches(norm, '[0-9]') THEN 'H3' ELSE 'TXT' END) END AS ntag FROM nz9 x LEFT JOIN near ON near.tag = x.norm),
aq AS (SELECT doc_id AS qd, para_id AS qp, text, zone FROM kn WHERE mapped_tag NOT IN {sb.VOCAB_SQL} AND ntag IN ('TXT', 'TXT-FLUSH')), {asked('aq', 'qd, qp')},
sc AS (SELECT qv.qd, qv.qp, vec.doc_id, vec.para_id, round(sum(qv.w * vec.w) / (max(qv.norm) * max(vec.norm)), 9) AS score FROM qv JOIN vec USING (token) JOIN ex USING (doc_id, para_id) JOIN aq ON aq.qd = qv.qd AND aq.qp = qv.qp AND upper(ex.zone) = aq.zone GROUP BY ALL),
bs AS (SELECT qd, qp, doc_id, para_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qd, qp ORDER BY score DESC, doc_id DESC, para_id DESC) AS rn FROM sc) WHERE rn = 1 AND round(score, 4) > 0.7),
fd AS (SELECT qd, qp, round(score, 4) AS similarity, gold_tag FROM bs JOIN ex USING (doc_id, para_id))
SELECT kn.doc_id, kn.para_id, mapped_tag, similarity, coalesce(gold_tag, ntag) AS final_tag FROM kn LEFT JOIN fd ON fd.qd = kn.doc_id AND fd.qp = kn.para_id""")(
    lambda spark, sf: retrieval.knn_tags(
        index(spark, sf),
        ov.given(spark, sf).select("doc_id", "para_id", "text", F.expr(KQ).alias("mapped_tag"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'TABLE' ELSE 'BODY' END").alias("zone")),
        sb.VOCAB).select("doc_id", "para_id", "mapped_tag", "similarity", "final_tag"))
