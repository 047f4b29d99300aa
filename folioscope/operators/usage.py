"""Jobs, batches, tokens and cost as aggregates over a ``jobs`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import fixed


def cost(input_tokens: Column, output_tokens: Column, model: Column | None = None,
         rates: dict[str, tuple[float, float]] | None = None) -> dict[str, Column]:
    """input_cost, output_cost, total_cost in dollars, six places.

    Unknown models are charged at the default model's rates.
    """
    rates = rates or fixed.MODEL_RATES

    def rate(value: float) -> Column:
        return F.lit(str(value)).cast("decimal(9,4)")

    default_in, default_out = rates[fixed.DEFAULT_MODEL]
    per_in, per_out = rate(default_in), rate(default_out)
    if model is not None:
        for name, (rate_in, rate_out) in rates.items():
            per_in = F.when(model == name, rate(rate_in)).otherwise(per_in)
            per_out = F.when(model == name, rate(rate_out)).otherwise(per_out)
    # Tokens times dollars per million is millionths of a dollar; decimals make
    # the rounding exact and the same everywhere.
    micro_in = input_tokens.cast("decimal(20,0)") * per_in
    micro_out = output_tokens.cast("decimal(20,0)") * per_out

    def dollars(micro: Column) -> Column:
        return F.round(micro, 0).cast("double") / F.lit(1_000_000)

    return {
        "input_cost": dollars(micro_in),
        "output_cost": dollars(micro_out),
        "total_cost": dollars(micro_in + micro_out),
    }


def with_cost(df: DataFrame, model: str | None = None) -> DataFrame:
    return df.withColumns(
        cost(F.col("input_tokens"), F.col("output_tokens"), F.col(model) if model else None)
    )


STATUSES = ["pending", "processing", "completed", "failed"]


def queue_status(jobs: DataFrame) -> DataFrame:
    """Counts per status; the total leaves cancelled jobs out."""
    counts = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    total = F.count_if(F.col("status").isin(STATUSES))
    return jobs.agg(*[c.alias(s) for s, c in counts.items()], total.alias("total"))


def token_stats(jobs: DataFrame, today: str, timezone: str = "Asia/Kolkata") -> DataFrame:
    """All-time and today's tokens of completed jobs, with costs and averages."""
    local_day = F.to_date(F.from_utc_timestamp("completed_at", timezone))
    is_today = local_day == F.lit(today).cast("date")

    def total(column: str, when: Column | None = None) -> Column:
        value = F.col(column) if when is None else F.when(when, F.col(column))
        return F.coalesce(F.sum(value), F.lit(0))

    sums = jobs.where(F.col("status") == "completed").agg(
        *[total(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")],
        F.count("*").alias("total_jobs"),
        *[
            total(c, is_today).alias(f"today_{c}")
            for c in ("input_tokens", "output_tokens", "total_tokens")
        ],
    )
    all_cost = cost(F.col("input_tokens"), F.col("output_tokens"))["total_cost"]
    day_cost = cost(F.col("today_input_tokens"), F.col("today_output_tokens"))["total_cost"]
    some = F.col("total_jobs") > 0
    return sums.withColumns(
        {
            "total_cost": all_cost,
            "today_cost": day_cost,
            "tokens_per_job": F.when(some, F.bround(F.col("total_tokens") / F.col("total_jobs")))
            .otherwise(0.0),
            "cost_per_job": _share(all_cost, F.col("total_jobs")),
        }
    )


def daily_usage(
    jobs: DataFrame, today: str, days: int = 30, timezone: str | None = None
) -> DataFrame:
    """One row per day, zero-filled, for the last ``days`` days.

    One pass over the jobs of that range; the calendar side has ``days`` rows.
    """
    stamp = F.col("completed_at")
    day = F.to_date(F.from_utc_timestamp(stamp, timezone) if timezone else stamp)
    last = F.to_date(F.lit(today))
    used = (
        jobs.where(F.col("status") == "completed")
        .withColumn("day", day)
        .where((F.col("day") <= last) & (F.col("day") > F.date_sub(last, days)))
        .groupBy("day")
        .agg(
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum("total_tokens").alias("total_tokens"),
            F.count("*").alias("jobs_completed"),
        )
    )
    calendar = jobs.sparkSession.range(days).select(
        F.date_sub(last, F.col("id").cast("int")).alias("day")
    )
    filled = calendar.join(used, "day", "left").na.fill(0)
    return with_cost(filled)


def usage_trend(daily: DataFrame) -> DataFrame:
    """Week over week: last seven days against the seven before, per day.

    ``daily`` has one row per day, so the unpartitioned order is a short list.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("day")
    week, prior = order.rowsBetween(-6, 0), order.rowsBetween(-13, -7)

    def change(column: str) -> Column:
        now, then = F.sum(column).over(week), F.coalesce(F.sum(column).over(prior), F.lit(0))
        return F.when(then > 0, F.round((now - then) / then * 100, 6)).otherwise(0.0)

    return daily.select(
        "day",
        F.sum("total_tokens").over(week).alias("tokens_7d"),
        change("total_tokens").alias("token_trend"),
        change("total_cost").alias("cost_trend"),
        change("jobs_completed").alias("jobs_trend"),
    )


def batch_rollup(jobs: DataFrame) -> DataFrame:
    """Counts, sums, cost, derived status and progress per batch."""
    sums = jobs.groupBy("batch_id").agg(
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("status") == "completed").alias("completed_jobs"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"),
        F.count_if(F.col("status") == "processing").alias("_processing"),
        F.count_if(F.col("status") == "pending").alias("_pending"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("input_tokens", "output_tokens", "total_tokens")
        ],
        F.round(F.coalesce(F.sum("processing_time_seconds"), F.lit(0.0)), 2).alias(
            "total_processing_time"
        ),
        F.max("completed_at").alias("completed_at"),
    )
    settled = F.col("completed_jobs") + F.col("failed_jobs")
    status = (
        F.when(F.col("total_jobs") == 0, "empty")
        .when(
            settled == F.col("total_jobs"),
            F.when(F.col("failed_jobs") == 0, "completed").otherwise("completed_with_errors"),
        )
        .when(F.col("_processing") > 0, "processing")
        .when(F.col("_pending") > 0, "pending")
        .otherwise("completed")
    )
    progress = F.floor(settled / F.col("total_jobs") * 100).cast("int")
    return with_cost(sums).withColumns({"status": status, "progress_percent": progress}).drop(
        "_processing", "_pending"
    )


def _share(amount: Column, parts: Column) -> Column:
    """Dollars per part, rounded half up in whole millionths."""
    micro = F.round(amount * 1_000_000).cast("bigint")
    return F.when(
        parts > 0, F.floor((2 * micro + parts) / (2 * parts)) / F.lit(1_000_000)
    ).otherwise(0.0)


def unit_economics(batches: DataFrame) -> DataFrame:
    """Time, cost and tokens per finished document; success rate."""
    done = F.col("completed_jobs")

    def per_doc(column: str) -> Column:
        return F.when(done > 0, F.round(F.col(column) / done, 6)).otherwise(0.0)

    return batches.where((F.col("status") == "completed") | (done > 0)).select(
        "batch_id",
        per_doc("total_processing_time").alias("time_per_doc"),
        _share(F.col("total_cost"), done).alias("cost_per_doc"),
        per_doc("total_tokens").alias("tokens_per_doc"),
        F.round(100.0 * done / F.col("total_jobs"), 6).alias("success_rate"),
    )


def status_distribution(batches: DataFrame) -> DataFrame:
    return batches.groupBy("status").agg(F.count("*").alias("n"))


def latest_batches(batches: DataFrame, limit: int = 50) -> DataFrame:
    return batches.orderBy(F.desc("completed_at"), "batch_id").limit(limit)


def search(rows: DataFrame, name: str, status: str = "all") -> DataFrame:
    """Name contains (any case) and status equals; 'all' skips the status."""
    found = rows.where(F.lower("name").contains(name.lower())) if name else rows
    return found if status == "all" else found.where(F.col("status") == status)


def expired(batches: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Batches completed before the cutoff; the rest is the kept snapshot."""
    return batches.where(F.col("completed_at") < now - F.expr(f"INTERVAL {days} DAYS"))


def kept(batches: DataFrame, now: Column, days: int = 30) -> DataFrame:
    cutoff = now - F.expr(f"INTERVAL {days} DAYS")
    return batches.where(F.col("completed_at").isNull() | (F.col("completed_at") >= cutoff))


def usage_counters(classified: DataFrame) -> DataFrame:
    """Share of rules, tagger and cache among predictions; fallback gains."""
    source = F.col("source")
    rules, model = F.count_if(source == "rule"), F.count_if(source == "model")
    return classified.agg(
        rules.alias("rule_predictions"),
        model.alias("model_predictions"),
        (rules + model).alias("total_predictions"),
        F.round(F.coalesce(rules / F.nullif(rules + model, F.lit(0)), F.lit(0.0)), 6).alias(
            "rule_coverage"
        ),
        F.count_if(source == "cache").alias("cache_hits"),
        F.round(100.0 * F.count_if(source == "cache") / F.count("*"), 1).alias("hit_rate"),
        F.count_if("improved").alias("items_improved"),
    )
