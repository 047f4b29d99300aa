"""Jobs, batches, tokens and cost over the whole ``events`` table."""

from pyspark.sql import functions as F

from checks.registry import query, table
from checks import sqlbits as sb
from folioscope import fixed
from folioscope.operators import usage

STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' ELSE 'cancelled' END"
MODELS = list(fixed.MODEL_RATES)
MODEL = f"CASE event_id % 9 {' '.join(f'WHEN {i} THEN {sb.lit(m)}' for i, m in enumerate(MODELS))} ELSE 'other' END"
JOBS = f"""jobs AS (SELECT event_id AS job_id, user_id AS batch_id, {STATUS} AS status, ts AS completed_at, value AS processing_time_seconds,
  CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 20) AS BIGINT) AS output_tokens,
  CAST(floor(value * 100) AS BIGINT) + CAST(floor(value * 20) AS BIGINT) AS total_tokens, 'Batch ' || user_id || ' ' || event_type AS name, {MODEL} AS model FROM events)"""
RIN, ROUT = fixed.MODEL_RATES[fixed.DEFAULT_MODEL]


def money(i: str = "input_tokens", o: str = "output_tokens", ri: str = str(RIN), ro: str = str(ROUT)) -> str:
    a, b = f"{i}::DECIMAL(20,0) * {ri}::DECIMAL(9,4)", f"{o}::DECIMAL(20,0) * {ro}::DECIMAL(9,4)"

    def r(x):
        return f"round({x}, 0)::DOUBLE / 1000000"

    return f"{r(a)} AS input_cost, {r(b)} AS output_cost, {r(f'{a} + {b}')} AS total_cost"


def share(amount: str, parts: str) -> str:
    return f"(2 * CAST(round({amount} * 1000000) AS BIGINT) + {parts}) // (2 * {parts}) / 1000000"


def jobs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("batch_id"), F.expr(STATUS).alias("status"),
        F.col("ts").alias("completed_at"), F.col("value").alias("processing_time_seconds"),
        F.floor(F.col("value") * 100).alias("input_tokens"), F.floor(F.col("value") * 20).alias("output_tokens"),
        (F.floor(F.col("value") * 100) + F.floor(F.col("value") * 20)).alias("total_tokens"),
        F.expr("'Batch ' || user_id || ' ' || event_type").alias("name"), F.expr(MODEL).alias("model"))


query("search_filter", f"WITH {JOBS} SELECT job_id, name, status FROM jobs WHERE contains(lower(name), 'batch 1') AND status = 'completed'")(
    lambda spark, sf: usage.search(jobs(spark, sf), "BATCH 1", "completed").select("job_id", "name", "status"))

RATES = sb.values([(m, *r) for m, r in fixed.MODEL_RATES.items()], "m, ri, ro")
query("token_cost", f"""WITH {JOBS}, p AS (SELECT m, ri::DOUBLE AS ri, ro::DOUBLE AS ro FROM {RATES}),
j AS (SELECT jobs.*, coalesce(ri, {RIN}::DOUBLE) AS ri, coalesce(ro, {ROUT}::DOUBLE) AS ro FROM jobs LEFT JOIN p ON p.m = jobs.model)
SELECT job_id, model, {money(ri='ri', ro='ro')} FROM j""")(
    lambda spark, sf: usage.with_cost(jobs(spark, sf), "model").select("job_id", "model", "input_cost", "output_cost", "total_cost"))

query("queue_status", f"WITH {JOBS} SELECT count_if(status = 'pending') AS pending, count_if(status = 'processing') AS processing, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed, count_if(status <> 'cancelled') AS total FROM jobs")(
    lambda spark, sf: usage.queue_status(jobs(spark, sf)))

TODAY = "2024-01-20"
query("token_stats", f"""WITH {JOBS}, t AS (SELECT sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS total_jobs,
  coalesce(sum(input_tokens) FILTER (WHERE d), 0)::BIGINT AS today_input_tokens, coalesce(sum(output_tokens) FILTER (WHERE d), 0)::BIGINT AS today_output_tokens, coalesce(sum(total_tokens) FILTER (WHERE d), 0)::BIGINT AS today_total_tokens
  FROM (SELECT *, CAST(completed_at + INTERVAL 330 MINUTE AS DATE) = DATE '{TODAY}' AS d FROM jobs WHERE status = 'completed')),
c AS (SELECT *, round(input_tokens::DECIMAL(20,0) * {RIN}::DECIMAL(9,4) + output_tokens::DECIMAL(20,0) * {ROUT}::DECIMAL(9,4), 0)::DOUBLE / 1000000 AS total_cost,
  round(today_input_tokens::DECIMAL(20,0) * {RIN}::DECIMAL(9,4) + today_output_tokens::DECIMAL(20,0) * {ROUT}::DECIMAL(9,4), 0)::DOUBLE / 1000000 AS today_cost FROM t)
SELECT *, round_even(total_tokens / total_jobs, 0) AS tokens_per_job, {share('total_cost', 'total_jobs')} AS cost_per_job FROM c""")(
    lambda spark, sf: usage.token_stats(jobs(spark, sf), TODAY))

DAILY = f"""{JOBS}, cal AS (SELECT CAST(DATE '2024-01-25' - CAST(i AS INT) AS DATE) AS day FROM range(30) r(i)),
u AS (SELECT CAST(completed_at AS DATE) AS day, sum(input_tokens)::BIGINT AS i, sum(output_tokens)::BIGINT AS o, sum(total_tokens)::BIGINT AS t, count(*) AS n FROM jobs WHERE status = 'completed' GROUP BY 1),
daily AS (SELECT day, coalesce(i, 0) AS input_tokens, coalesce(o, 0) AS output_tokens, coalesce(t, 0) AS total_tokens, coalesce(n, 0) AS jobs_completed, {money('coalesce(i, 0)', 'coalesce(o, 0)')} FROM cal LEFT JOIN u USING (day))"""
query("daily_usage", f"WITH {DAILY} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM daily")(
    lambda spark, sf: usage.daily_usage(jobs(spark, sf), "2024-01-25", 30).withColumn("day", F.col("day").cast("string")))


def change(c: str) -> str:
    return f"CASE WHEN coalesce(sum({c}) OVER p, 0) > 0 THEN round((sum({c}) OVER w - sum({c}) OVER p) / (sum({c}) OVER p) * 100, 6) ELSE 0.0 END"


query("usage_trend", f"""WITH {DAILY} SELECT CAST(day AS VARCHAR) AS day, sum(total_tokens) OVER w AS tokens_7d, {change('total_tokens')} AS token_trend, {change('total_cost')} AS cost_trend, {change('jobs_completed')} AS jobs_trend
FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), p AS (ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING)""")(
    lambda spark, sf: usage.usage_trend(usage.daily_usage(jobs(spark, sf), "2024-01-25", 30)).withColumn("day", F.col("day").cast("string")))

# Batches of one user and day, so that all derived states occur.
BATCH_ID = "CAST(user_id * 100 + extract(day FROM ts) AS BIGINT)"
BATCHES = f"""{JOBS.replace('user_id AS batch_id', f'{BATCH_ID} AS batch_id')},
b0 AS (SELECT batch_id, count(*) AS total_jobs, count_if(status = 'completed') AS completed_jobs, count_if(status = 'failed') AS failed_jobs, count_if(status = 'processing') AS np, count_if(status = 'pending') AS nq,
  sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::BIGINT AS total_tokens, round(sum(processing_time_seconds), 2) AS total_processing_time, max(completed_at) AS completed_at FROM jobs GROUP BY 1),
b AS (SELECT * EXCLUDE (np, nq), {money()}, CASE WHEN completed_jobs + failed_jobs = total_jobs THEN CASE WHEN failed_jobs = 0 THEN 'completed' ELSE 'completed_with_errors' END
  WHEN np > 0 THEN 'processing' WHEN nq > 0 THEN 'pending' ELSE 'completed' END AS status, CAST(floor((completed_jobs + failed_jobs) / total_jobs * 100) AS INT) AS progress_percent FROM b0)"""


def batches(spark, sf):
    return usage.batch_rollup(
        jobs(spark, sf).withColumn("batch_id", F.col("batch_id") * 100 + F.dayofmonth("completed_at")))


query("batch_rollup", f"WITH {BATCHES} SELECT * REPLACE (CAST(completed_at AS VARCHAR)[1:19] AS completed_at) FROM b")(
    lambda spark, sf: batches(spark, sf).withColumn("completed_at", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss")))
query("unit_economics", f"""WITH {BATCHES} SELECT batch_id, CASE WHEN completed_jobs > 0 THEN round(total_processing_time / completed_jobs, 6) ELSE 0 END AS time_per_doc,
  CASE WHEN completed_jobs > 0 THEN {share('total_cost', 'completed_jobs')} ELSE 0 END AS cost_per_doc, CASE WHEN completed_jobs > 0 THEN round(total_tokens / completed_jobs, 6) ELSE 0 END AS tokens_per_doc,
  round(100.0::DOUBLE * completed_jobs / total_jobs, 6) AS success_rate FROM b WHERE status = 'completed' OR completed_jobs > 0""")(
    lambda spark, sf: usage.unit_economics(batches(spark, sf)))
query("status_distribution", f"WITH {BATCHES} SELECT status, count(*) AS n FROM b GROUP BY 1")(
    lambda spark, sf: usage.status_distribution(batches(spark, sf)))
query("latest_batches", f"WITH {BATCHES} SELECT batch_id, status, total_jobs FROM b ORDER BY completed_at DESC, batch_id LIMIT 50")(
    lambda spark, sf: usage.latest_batches(batches(spark, sf), 50).select("batch_id", "status", "total_jobs"))
NOW = "2024-02-15"
query("retention", f"WITH {BATCHES} SELECT batch_id, completed_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS is_expired FROM b")(
    lambda spark, sf: usage.expired(batches(spark, sf), F.lit(NOW).cast("timestamp")).select("batch_id", F.lit(True).alias("is_expired"))
    .unionByName(usage.kept(batches(spark, sf), F.lit(NOW).cast("timestamp")).select("batch_id", F.lit(False).alias("is_expired"))))
