"""Prediction cache: keys, read-through, latest-wins snapshots, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import matching_text


def cache_key(doc_id: Column, para_id: Column, text: Column, zone: Column) -> Column:
    joined = F.concat_ws(
        ":", doc_id.cast("string"), para_id.cast("string"), matching_text(text), zone
    )
    return F.substring(F.sha2(joined, 256), 1, 16)


def content_hash(paragraphs: DataFrame) -> DataFrame:
    """SHA-256 of a document's paragraph text in order, without separators."""
    ordered = F.array_sort(F.collect_list(F.struct("para_id", "text")))
    whole = F.array_join(F.transform(ordered, lambda p: p["text"]), "")
    return paragraphs.groupBy("doc_id").agg(F.sha2(whole, 256).alias("content_hash"))


def text_hash(text: Column) -> Column:
    """The same hash taken inside the document row: no shuffle."""
    lines = F.filter(F.split(text, "\n"), lambda t: F.trim(t) != "")
    return F.sha2(F.array_join(lines, ""), 256)


def lookup(
    rows: DataFrame, cache: DataFrame, now: Column, ttl_days: int = 30
) -> DataFrame:
    """Rows with the cached prediction where a valid entry exists.

    ``cached`` splits hits from misses.  Keys are hashes, so neither side has
    a hot key; the expired entries are dropped before the join.
    """
    valid = cache.where(F.col("cached_at") > now - F.expr(f"INTERVAL {ttl_days} DAYS"))
    found = valid.select(
        "cache_key",
        F.col("tag").alias("cached_tag"),
        F.col("confidence").alias("cached_confidence"),
    )
    return rows.join(found, "cache_key", "left").withColumn(
        "cached", F.col("cached_tag").isNotNull()
    )


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Newest entry per key over both tables (one partial aggregate)."""
    columns = [c for c in cache.columns if c != "cache_key"]
    newest = F.max_by(F.struct(*columns), F.struct("cached_at", "tag"))
    return (
        cache.unionByName(fresh.select(cache.columns))
        .groupBy("cache_key")
        .agg(newest.alias("_v"))
        .select("cache_key", *[F.col(f"_v.{c}").alias(c) for c in columns])
    )
