"""Session helpers: configuration, the shared work folder, checked lookups."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "folioscope", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_FOLDERS: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """This application's folder for checkpoints and hand-over tables.

    It stands in the folder that ``spark.checkpoint.dir`` names, which all
    executors must share (a ``file:`` folder only if it is a common mount).
    Only a local session without the setting gets a temporary folder.  The
    application's folder goes when the driver's Python ends.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app in _FOLDERS:
        return _FOLDERS[app]
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="folioscope-")
    folder = f"{named.rstrip('/')}/folioscope-{app}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())

    def remove() -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            files.delete(path, True)

    atexit.register(remove)
    _FOLDERS[app] = folder
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives executor loss)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: reuse without recompute."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.handover_path = path
    return out


def through_buckets(df: DataFrame, name: str, buckets: int, key: str, order: list[str]) -> DataFrame:
    """``through_table`` in buckets of ``key``: what reads it gets the rows placed by ``key``.

    A window, aggregate or join on ``key`` needs no exchange then.  ``df`` is
    to be placed by ``key`` in as many partitions, so each task writes one
    file.  The catalog lists the table until it is released or Python ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    atexit.register(_forget, spark, table)
    return _in_buckets(df, table, path, buckets, key, order)


def into_buckets(held: DataFrame, more: DataFrame, buckets: int, key: str, order: list[str]) -> DataFrame:
    """A table of ``through_buckets`` with further rows."""
    return _in_buckets(more.select(*held.columns), held.handover_table, held.handover_path, buckets, key, order)


def _in_buckets(df: DataFrame, table: str, path: str, buckets: int, key: str, order: list[str]) -> DataFrame:
    df.write.mode("append").bucketBy(buckets, key).sortBy(*order).option("path", path).saveAsTable(table)
    out = df.sparkSession.table(table)
    out.handover_path, out.handover_table = path, table
    return out


def _forget(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def release(*tables: DataFrame | None) -> None:
    """Delete hand-over tables that no later plan reads; other DataFrames are passed over."""
    for df in tables:
        path = getattr(df, "handover_path", None) if df is not None else None
        if isinstance(path, str):
            if isinstance(table := getattr(df, "handover_table", None), str):
                _forget(df.sparkSession, table)
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


BROADCAST_ROWS = 2_000_000


def checked_lookup(
    left: DataFrame,
    dimension: DataFrame,
    key: str,
    how: str = "left",
    spread: Column | None = None,
    max_rows: int = BROADCAST_ROWS,
    salts: int = 32,
) -> DataFrame:
    """Join a derived lookup on one key that may be very hot on the left.

    The lookup is counted up to ``max_rows``; within that bound it is
    broadcast, so the hot side never moves.  Beyond it both sides get a salt
    (the lookup is repeated once per salt) and a hot key spreads over
    ``salts`` partitions.
    """
    if dimension.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(dimension), key, how)
    salt = F.pmod(F.xxhash64(spread if spread is not None else F.struct("*")), F.lit(salts))
    wide = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        left.withColumn("_salt", salt.cast("int"))
        .join(wide.withColumn("_salt", F.col("_salt").cast("int")), [key, "_salt"], how)
        .drop("_salt")
    )
