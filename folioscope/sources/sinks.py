"""Result sinks: nested document records and action-partitioned queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_documents(classified: DataFrame, review_below: float = 85) -> DataFrame:
    """One nested record per document: summary, classifications, flagged items.

    The group is one document's rows, i.e. the size of its source row.
    """
    item = F.struct("para_id", "tag", "confidence")
    flagged = F.col("confidence") < review_below

    def in_order(items: Column) -> Column:
        return F.array_sort(items)

    return classified.groupBy("doc_id").agg(
        F.struct(
            F.count("*").alias("total_paragraphs"),
            F.count_if(~flagged).alias("auto_applied"),
            F.count_if(flagged).alias("needs_review"),
            F.round(100.0 * F.avg((~flagged).cast("int")), 1).alias("auto_apply_percentage"),
            F.round(F.avg("confidence"), 6).alias("average_confidence"),
        ).alias("summary"),
        in_order(F.collect_list(item)).alias("classifications"),
        in_order(F.collect_list(F.when(flagged, item))).alias("flagged_items"),
    )


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_by_action(rows: DataFrame, path: str) -> None:
    """Review queue: one folder per action, read back with partition pruning."""
    rows.write.mode("overwrite").partitionBy("action").parquet(path)
