"""Rule learning, reporting and application over the gold overlay."""

from pyspark.sql import functions as F

from checks import overlay as ov
from checks import sqlbits as sb
from checks.q_scalars import W_SQL
from checks.registry import query
from folioscope import fixed
from folioscope.operators import rules
from folioscope.session import fresh_path

ZONE = "CASE WHEN doc_id % 4 = 3 THEN 'TABLE' WHEN doc_id % 4 = 2 THEN 'BACK_MATTER' ELSE 'BODY' END"
T = "t"
FLAGS = {
    "is_empty": "t = ''", "is_short": "length(t) < 50", "is_long": "length(t) > 500",
    "has_number_prefix": sb.has(T, fixed.FEATURE_NUMBERED_PATTERN), "has_letter_prefix": sb.has(T, fixed.FEATURE_LETTERED_PATTERN),
    "has_roman_prefix": sb.has(T, fixed.FEATURE_ROMAN_PATTERN), "has_bullet": sb.has(T, fixed.REF_BULLET_PATTERN),
    "is_all_caps": sb.has(T, fixed.FEATURE_ALL_CAPS_PATTERN), "starts_with_digit": sb.has(T, "^[0-9]"),
    "ends_with_period": "right(t, 1) = '.'", "ends_with_colon": "right(t, 1) = ':'", "has_citation_year": sb.has("text", fixed.YEAR_PATTERN),
    "looks_like_heading": f"(length(t) <= 200 AND NOT {sb.has(T, '[.!?][[:space:]]*$')} AND len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= greatest(1, floor(0.6::DOUBLE * len(ws))))",
    "looks_like_caption": sb.has("lower(t)", "^(figure|table|fig[.]|tab[.])"),
    "looks_like_reference": f"({sb.has(T, fixed.FEATURE_NUMBERED_PATTERN)} OR {sb.has(T, fixed.REF_BULLET_PATTERN)} OR (({sb.has(T, fixed.YEAR_PATTERN)} OR contains(lower(t), 'doi') OR contains(lower(t), 'et al')) AND {sb.count_chars('text', '.;:,')} >= 2))",
    "looks_like_footnote": f"(left(t, 1) IN ('*', '†', '‡') OR {sb.has(T, '^[a-z][)]')})",
    "is_in_table": "zone = 'TABLE'", "is_in_back_matter": "zone = 'BACK_MATTER'",
}
EXAMPLES = ov.GOLD_SQL + f""",
x0 AS (SELECT *, {ZONE} AS zone, coalesce(lag(gold_tag) OVER w, 'START') AS prev_tag, coalesce(lead(gold_tag) OVER w, 'END') AS next_tag FROM gold WINDOW w AS (PARTITION BY doc_id ORDER BY para_id)),
x1 AS (SELECT *, {sb.strip('text')} AS t FROM x0 WHERE gold_tag <> 'UNMAPPED'), x2 AS (SELECT *, {W_SQL} AS ws FROM x1),
keys AS (SELECT doc_id, para_id, gold_tag AS tag, unnest(list_filter([{', '.join(f"CASE WHEN {c} THEN {sb.lit(n)} END" for n, c in FLAGS.items())}, 'zone=' || zone], lambda x: x IS NOT NULL)) AS feature_key FROM x2),
rc AS (SELECT tag, feature_key, count(*) AS support FROM keys GROUP BY ALL),
counts AS (SELECT *, sum(support) OVER (PARTITION BY feature_key)::BIGINT AS total FROM rc),
learned AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, support DESC, condition, predicted_tag) AS rank FROM (
  SELECT feature_key AS condition, tag AS predicted_tag, support, total, support / total AS confidence FROM counts WHERE support >= 10 AND support / total >= 0.8))"""


def examples(spark, sf):
    return rules.training_examples(ov.gold(spark, sf), zone=F.expr(ZONE))


def learned(spark, sf):
    return rules.learn_rules(rules.rule_counts(examples(spark, sf)))


query("training_examples", f"WITH {EXAMPLES} SELECT doc_id, para_id, gold_tag, prev_tag, next_tag, length(text) AS length, len(ws) AS word_count FROM x2")(
    lambda spark, sf: examples(spark, sf).select("doc_id", "para_id", "gold_tag", "prev_tag", "next_tag", "length", "word_count"))
query("rule_counts", f"WITH {EXAMPLES} SELECT * FROM counts")(lambda spark, sf: rules.rule_counts(examples(spark, sf)))
query("learn_rules", f"WITH {EXAMPLES} SELECT * REPLACE (round(confidence, 6) AS confidence) FROM learned")(
    lambda spark, sf: learned(spark, sf).withColumn("confidence", F.round("confidence", 6)))
query("rule_report", f"""WITH {EXAMPLES}, f AS (SELECT *, sum(support) OVER (PARTITION BY tag)::BIGINT AS tag_total FROM rc WHERE NOT contains(feature_key, '=')),
r AS (SELECT *, dense_rank() OVER (ORDER BY tag_total DESC, tag) AS tag_rank, row_number() OVER (PARTITION BY tag ORDER BY support DESC, feature_key) AS feature_rank FROM f)
SELECT tag, tag_rank, tag_total, feature_key, feature_rank, support, round(support / tag_total, 6) AS share FROM r WHERE tag_rank <= 20 AND feature_rank <= 3""")(
    lambda spark, sf: rules.rule_report(rules.rule_counts(examples(spark, sf))))


@query("rules_roundtrip", f"WITH {EXAMPLES} SELECT * REPLACE (round(confidence, 6) AS confidence) FROM learned")
def _(spark, sf):
    path = fresh_path(spark, "rules")
    counts = rules.rule_counts(examples(spark, sf))
    rules.save_rules(rules.learn_rules(counts), counts, path)
    stored, _ = rules.load_rules(spark, path)
    return stored.withColumn("confidence", F.round("confidence", 6))


ALL_KEYS = EXAMPLES + f""",
a1 AS (SELECT *, {sb.strip('text')} AS t FROM x0), a2 AS (SELECT *, {W_SQL} AS ws FROM a1),
ak AS (SELECT doc_id, para_id, unnest(list_filter([{', '.join(f"CASE WHEN {c} THEN {sb.lit(n)} END" for n, c in FLAGS.items())}, 'zone=' || zone], lambda x: x IS NOT NULL)) AS feature_key FROM a2),
best AS (SELECT doc_id, para_id, min(rank) AS rank FROM ak JOIN learned ON condition = feature_key GROUP BY ALL),
ruled AS (SELECT a2.doc_id, a2.para_id, l.predicted_tag AS rule_tag, l.condition AS rule_condition, CAST(floor(l.confidence * 100) AS INT) AS rule_confidence
  FROM a2 LEFT JOIN best USING (doc_id, para_id) LEFT JOIN learned l USING (rank))"""


def ruled(spark, sf):
    rows = rules.with_features(ov.gold(spark, sf), zone=F.expr(ZONE))
    return rules.apply_rules(rows, learned(spark, sf))


query("apply_rules", f"WITH {ALL_KEYS} SELECT * FROM ruled")(
    lambda spark, sf: ruled(spark, sf).select("doc_id", "para_id", "rule_tag", "rule_condition", "rule_confidence"))


@query("rules_first_split", f"WITH {ALL_KEYS} SELECT doc_id, para_id, CASE WHEN rule_tag IS NULL THEN 'model' ELSE 'rule' END AS answered_by, rule_tag AS tag FROM ruled")
def _(spark, sf):
    answered, remaining = rules.split_by_rules(ruled(spark, sf))
    one = answered.select("doc_id", "para_id", F.lit("rule").alias("answered_by"), F.col("rule_tag").alias("tag"))
    two = remaining.select("doc_id", "para_id", F.lit("model").alias("answered_by"), F.lit(None).cast("string").alias("tag"))
    return one.unionByName(two)
