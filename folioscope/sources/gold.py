"""Gold rows: JSON-lines source and sink, and the usable subset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD_SCHEMA = (
    "doc_id string, para_index int, text string, gold_tag string, "
    "canonical_gold_tag string, alignment_score double, notes string, zone string"
)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a fixed schema; unreadable lines are skipped."""
    return spark.read.schema(GOLD_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def write_gold(gold: DataFrame, path: str) -> None:
    gold.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def usable_gold(gold: DataFrame, min_score: float = 0.75) -> DataFrame:
    """Mapped rows whose alignment is good enough to learn from."""
    return gold.where(
        (F.coalesce(F.col("canonical_gold_tag"), F.lit("")) != "UNMAPPED")
        & (F.coalesce(F.col("alignment_score"), F.lit(0.0)) >= min_score)
    )
