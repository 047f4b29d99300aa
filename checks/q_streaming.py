"""Structured Streaming jobs over the given files, run to completion."""

from pyspark.sql import functions as F

from checks import overlay as ov
from checks import sqlbits as sb
from checks.q_repair import V, PICK, full_ladder, refs_with
from checks.q_usage import JOBS, STATUS
from checks.registry import query, table
from folioscope.plans.structure import structure_corpus
from folioscope.session import fresh_path
from folioscope.streaming import jobs as sj


def stream(spark, sf, name):
    """The table as a stream: one file, or a folder of part files.

    A stream takes a single file only by a pattern, so the first letter is one.
    """
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


@query("stream_structure", refs_with(full_ladder(), PICK))
def _(spark, sf):
    target, checkpoint = fresh_path(spark, "structured"), fresh_path(spark, "checkpoint")
    sj.run_batches(
        stream(spark, sf, "documents"),
        lambda batch: structure_corpus(ov.given_of(batch), V, sb.ZONES).select(
            "doc_id", "para_id", "tag", "confidence", "repaired", "repair_reason"),
        target, checkpoint,
    ).awaitTermination()
    return spark.read.parquet(target).drop("batch_id")


@query("stream_dedup", "WITH h AS (SELECT sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda t: trim(t) <> ''), '')) AS content_hash FROM documents) SELECT DISTINCT content_hash FROM h")
def _(spark, sf):
    target, checkpoint = fresh_path(spark, "admitted"), fresh_path(spark, "checkpoint")
    sj.admit_to_table(stream(spark, sf, "documents").select("doc_id", "text"), target, checkpoint).awaitTermination()
    return spark.read.parquet(target).select("content_hash")


def status_events(spark, sf):
    return status_rows(stream(spark, sf, "events"))


def status_rows(events):
    return events.select(
        (F.col("event_id") % 1000).alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(STATUS).alias("status"),
        F.floor(F.col("value") * 100).alias("input_tokens"), F.floor(F.col("value") * 20).alias("output_tokens"))


@query("stream_status", f"WITH {JOBS} SELECT job_id % 1000 AS job_id, max_by(status, (completed_at, job_id)) AS status, count(*) AS n_events FROM jobs GROUP BY 1")
def _(spark, sf):
    target, checkpoint = fresh_path(spark, "status"), fresh_path(spark, "checkpoint")
    sj.run_to_table(sj.latest_status(status_events(spark, sf)), target, checkpoint, mode="complete").awaitTermination()
    return sj.newest_rows(spark, target)


@query("stream_daily_usage", f"""WITH {JOBS} SELECT CAST(CAST(completed_at AS DATE) AS VARCHAR) AS day, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) AS jobs_completed
FROM jobs WHERE status = 'completed' GROUP BY 1""")
def _(spark, sf):
    target, checkpoint = fresh_path(spark, "daily"), fresh_path(spark, "checkpoint")
    sj.run_to_table(sj.daily_usage(status_events(spark, sf)), target, checkpoint).awaitTermination()  # a day comes out when the watermark has passed it
    closed = spark.read.parquet(target)
    return closed.unionByName(sj.open_days(status_rows(table(spark, sf, "events")), closed)).withColumn("day", F.col("day").cast("string"))


NOW = "2024-01-31 00:00:00"


@query("stream_cache", f"""WITH {JOBS}, k AS (SELECT CAST(batch_id AS VARCHAR) || '-' || (job_id % 5) AS cache_key, status AS tag, job_id, completed_at FROM jobs)
SELECT cache_key, max_by(tag, (completed_at, tag)) AS tag FROM k GROUP BY 1 HAVING max(completed_at) > TIMESTAMP '{NOW}' - INTERVAL 10 DAY""")
def _(spark, sf):
    folder, checkpoint = fresh_path(spark, "cache"), fresh_path(spark, "checkpoint")
    fresh = stream(spark, sf, "events").select(
        F.expr("CAST(user_id AS STRING) || '-' || (event_id % 5)").alias("cache_key"), F.expr(STATUS).alias("tag"), F.col("ts").alias("cached_at"))
    sj.refresh_cache(fresh, folder, checkpoint, ttl_days=30).awaitTermination()
    return sj.read_cache(spark, folder, "cache_key string, tag string, cached_at timestamp", NOW, ttl_days=10).select("cache_key", "tag")
