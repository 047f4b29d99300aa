"""Structured Streaming jobs: structuring, admission, status, usage, cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folioscope.operators import cache as prediction_cache
from folioscope.operators.cache import text_hash

Transform = Callable[[DataFrame], DataFrame]


def run_batches(
    stream: DataFrame,
    transform: Transform,
    target: str,
    checkpoint: str,
) -> StreamingQuery:
    """Each micro-batch through a batch plan, into its own folder.

    A document is one row, so it is whole within its batch; a replayed batch
    overwrites the folder it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return _each_batch(stream, write, checkpoint)


def admit_once(stream: DataFrame, text: str = "text", watermark: tuple[str, str] | None = None) -> DataFrame:
    """First document of every content hash; state keyed by the hash.

    With ``watermark=(column, delay)`` copies within the delay are dropped and
    old hashes leave the state.  Without one the state holds every hash ever
    seen, so for copies at any distance use ``admit_to_table``.
    """
    hashed = stream.withColumn("content_hash", text_hash(F.col(text)))
    if watermark is None:
        return hashed.dropDuplicates(["content_hash"])
    return hashed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["content_hash"])


def admit_to_table(
    stream: DataFrame, target: str, checkpoint: str, text: str = "text", watermark: tuple[str, str] | None = None
) -> StreamingQuery:
    """First document of every content hash, into one folder for each batch.

    The hashes seen are keyed state in the state store on disk, so a batch
    costs what it brings, whatever was admitted before; with ``watermark`` old
    hashes leave it.  A replayed batch starts from the state before it and
    rewrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    with _state_on_disk(stream.sparkSession):
        return _each_batch(admit_once(stream, text, watermark), write, checkpoint)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A query that starts in here keeps its state in RocksDB, not on the heap."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def _each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_status(events: DataFrame) -> DataFrame:
    """Newest status per job and its event count (update or complete mode)."""
    newest = F.max_by("status", F.struct("ts", "event_id"))
    return events.groupBy("job_id").agg(newest.alias("status"), F.count("*").alias("n_events"))


def daily_usage(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tokens of completed jobs per day; rows later than ``delay`` are dropped.

    In append mode a day comes out when the watermark has passed it; the days
    after the last closed one come from ``open_days``.
    """
    return _by_day(_completed(events).withWatermark("ts", delay))


def _completed(events: DataFrame) -> DataFrame:
    return events.where(F.col("status") == "completed")


def _by_day(events: DataFrame) -> DataFrame:
    return (
        events.groupBy(F.window("ts", "1 day"))
        .agg(
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.count("*").alias("jobs_completed"),
        )
        .select(F.to_date("window.start").alias("day"), "input_tokens", "output_tokens", "jobs_completed")
    )


def open_days(events: DataFrame, closed: DataFrame) -> DataFrame:
    """The days that are still open: a batch aggregate of the rows after the last closed day.

    ``closed`` is what ``daily_usage`` has written.  Only the rows of the open
    days are read, where the events are stored by time.
    """
    last = closed.agg(F.max("day").alias("last"))
    rows = _completed(events).join(F.broadcast(last), F.col("last").isNull() | (F.to_date("ts") > F.col("last")))
    return _by_day(rows)


#: Parts of the cache, each with its own newest version.
BUCKETS = 16


def _bucket() -> Column:
    return F.pmod(F.xxhash64("cache_key"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _write_version(entries: DataFrame, folder: str, batch_id: int) -> None:
    placed = entries.select("*", _bucket()).repartition(BUCKETS, "bucket")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch_id={batch_id}")


def _versions(spark: SparkSession, folder: str, below: int | None = None) -> dict[int, list[int]]:
    """The batches that wrote each bucket of the cache, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch_id=*/bucket=*")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for status in files.globStatus(path) or []:
        at = status.getPath()
        batch, bucket = int(at.getParent().getName().split("=")[1]), int(at.getName().split("=")[1])
        if below is None or batch < below:
            found.setdefault(bucket, []).append(batch)
    return {bucket: sorted(batches) for bucket, batches in found.items()}


def _newest(spark: SparkSession, folder: str, schema: StructType | str, versions: dict[int, list[int]]) -> DataFrame:
    paths = [f"{folder}/batch_id={batches[-1]}/bucket={bucket}" for bucket, batches in versions.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def refresh_cache(stream: DataFrame, folder: str, checkpoint: str, ttl_days: int = 30) -> StreamingQuery:
    """Merge each micro-batch into the cache, bucket by bucket of its keys.

    A batch reads the newest version of the buckets that it touches, keeps the
    newest entry of every key, leaves out what has expired at its own newest
    time, and writes the next version.  The version before stays for a replay,
    older ones go.  So a bucket holds valid entries only, and each key once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.persist()
        try:
            touched = {r[0] for r in fresh.select(_bucket()).distinct().collect()}
            now = fresh.agg(F.max("cached_at")).first()[0]
            before = {b: v for b, v in _versions(spark, folder, batch_id).items() if b in touched}
            merged = prediction_cache.upsert(_newest(spark, folder, batch.schema, before), fresh)
            valid = merged.where(F.col("cached_at") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {ttl_days} DAYS"))
            _write_version(valid, folder, batch_id)
            _forget(spark, folder, {b: v[:-1] for b, v in before.items()})
        finally:
            fresh.unpersist()

    return _each_batch(stream, write, checkpoint)


def _forget(spark: SparkSession, folder: str, versions: dict[int, list[int]]) -> None:
    for bucket, batches in versions.items():
        for batch in batches:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch_id={batch}/bucket={bucket}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_cache(spark: SparkSession, folder: str, schema: str, now: str, ttl_days: int = 30) -> DataFrame:
    """The entries that have not expired: a scan of the newest version of each bucket."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {ttl_days} DAYS")
    return _newest(spark, folder, schema, _versions(spark, folder)).where(F.col("cached_at") > cutoff)


def compact_cache(spark: SparkSession, folder: str, target: str, schema: str, now: str, ttl_days: int = 30) -> None:
    """Write the valid entries as the first version of a new cache."""
    _write_version(read_cache(spark, folder, schema, now, ttl_days), target, 0)


def run_to_table(
    stream: DataFrame, target: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Append rows to a parquet folder, or keep each batch's result by number.

    In ``complete`` mode the newest batch is the whole result, in ``update``
    mode it holds the changed rows: read either with ``newest_rows``.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").outputMode("append").start(target)

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return writer.outputMode(mode).foreachBatch(replace).start()


def newest_rows(spark: SparkSession, target: str, keys: Sequence[str] | None = None) -> DataFrame:
    """The result that ``run_to_table`` keeps.

    Without keys the newest batch (``complete`` mode); with keys the newest
    row of every key over all batches (``update`` mode).
    """
    rows = spark.read.parquet(target)
    if keys is None:
        newest = rows.agg(F.max("batch_id")).first()[0]
        return rows.where(F.col("batch_id") == F.lit(newest)).drop("batch_id")
    others = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("_v")).select(*keys, "_v.*")
