"""Mixing sources to target weights: whole copies plus one seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import free_names, words
from folioscope.session import through_table


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """Target size of every source, from one row (source, size) per source.

    Sources take the weights in turn, by code point, null last.  They share
    ``share`` times the sum of all sizes by weight; a target stops at ``most``
    times its source's size and the excess is shared again by weight.  This
    water level has a closed form: in order of ``most * size / weight`` the
    first sources are full, and the level is what is left over the weights
    that are left.  Of the sources that are not full the first gives the
    highest level, so ties in the order do no harm.

    The windows run over one row per source, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    every = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    onward = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(float(most))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = F.when(left / F.sum("_weight").over(onward) <= F.col("_full_at"), left / F.sum("_weight").over(onward))
    return (
        sizes.withColumn("_weight", turn)
        .withColumn("_full_at", cap / F.col("_weight"))
        .withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(every))
        .withColumn("target", F.least(cap, F.coalesce(F.col("_weight") * F.col("_level"), cap)))
        .select("source", "source_size", "target")
    )


def draw(identity: Column, seed: int) -> Column:
    """A uniform number in [0, 1) fixed by the identity and the seed.

    The first 52 bits of an MD5 digest, which any SQL engine can draw again.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), identity))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def measured(docs: DataFrame) -> DataFrame:
    """Narrow rows (doc_id, source, size, identity), written once and reused."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return through_table(
        docs.select(
            "doc_id",
            "source",
            F.size(words(F.col("text"))).cast("long").alias("size"),
            F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2(text, 256))).alias("identity"),
        ),
        "mix-sizes",
    )


def _targets(rows: DataFrame, weights, share, most) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return source_targets(sizes, weights, share, most)


def _copies(size: Column, source_size: Column, target: Column, identity: Column, seed: int) -> Column:
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    extra = F.when(draw(identity, seed) < rate - F.floor(rate), F.lit(1)).otherwise(F.lit(0))
    return (F.floor(rate) + extra).cast("int")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """One row per document with the copies the mix takes of it.

    Size is the number of words (null text: 0).  A source's repetition rate is
    its target over its size; each document is emitted floor(rate) times, plus
    one more when a uniform number drawn from (seed, doc_id) is below the
    fraction.  A document without id draws from its text.  Rows that repeat a
    doc_id draw alike.  A source without words has rate 0, an empty table
    gives no rows, and null is a source of its own, last in order.

    The draw needs no order and no shuffle; only (source, size) sums move.
    The sources table is one row per source: it is joined by Spark, which
    broadcasts it while it is small and splits hot sources otherwise.
    """
    rows = measured(docs)
    targets = _targets(rows, weights, share, most)
    joined = rows.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.withColumn("copies", _copies(F.col("size"), F.col("source_size"), F.col("target"), F.col("identity"), seed)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The documents as the mix emits them, each repeated, columns unchanged."""
    rows = measured(docs)
    mine, size, total, target, copies = free_names(docs, "mix_source", "mix_size", "mix_source_size", "mix_target", "mix_copies")
    targets = _targets(rows, weights, share, most).toDF(mine, total, target)
    identity = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    made = docs.join(targets, docs["source"].eqNullSafe(F.col(mine)), "left").withColumn(
        copies, _copies(F.lit(0), F.col(total), F.col(target), identity, seed)
    )
    each = F.explode(F.array_repeat(F.lit(1), F.col(copies))).alias(size)
    return made.where(F.col(copies) > 0).select(*docs.columns, each).select(*docs.columns)
