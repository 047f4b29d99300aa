"""Reference zones: trigger, start and end as window passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope import fixed
from folioscope.functions import patterns as pt
from folioscope.functions.text import strip_blank
from folioscope.operators.ordered import document, ordered, upto


def with_reference_start(
    df: DataFrame, text: str = "text", use_density: bool = False
) -> DataFrame:
    """Add ref_start (0-based row position or null) and ref_trigger.

    First a heading anywhere; else a secondary heading in the last quarter
    with three strict citations among the next five rows; else, if asked for,
    a dense window of strict citations near the end.
    """
    t = F.col(text)
    near = ordered().rowsBetween(1, 5)
    placed = df.withColumns(
        {
            "_at": F.row_number().over(ordered()) - 1,
            "_rows": F.count("*").over(document()),
            "_strict": pt.is_citation(t).cast("int"),
            "_head": pt.is_reference_heading(t),
            "_second": pt.is_secondary_reference_heading(t),
        }
    )
    checks = placed.withColumn(
        "_valid",
        F.col("_second")
        & (F.col("_at") >= F.floor(F.col("_rows") * 0.75))
        & (F.coalesce(F.sum("_strict").over(near), F.lit(0)) >= 3),
    )
    candidates = {
        "_s1": F.min(F.when(F.col("_head"), F.col("_at"))).over(document()),
        "_s2": F.min(F.when(F.col("_valid"), F.col("_at"))).over(document()),
    }
    drop = ["_strict", "_head", "_second", "_valid", "_s1", "_s2"]
    third = F.lit(None).cast("int")
    if use_density:
        # Window [centre-10, centre-10+20), both ends clamped to the document.
        checks = checks.withColumn("_plain", pt.is_numbered_not_reference(t).cast("int"))
        full = ordered().rowsBetween(-10, 9)
        early = F.col("_at") < 10  # the clamped window is then rows 0..19

        def around(flag: str):
            first20 = F.sum(F.when(F.col("_at") < 20, F.col(flag))).over(document())
            return F.when(early, first20).otherwise(F.sum(flag).over(full))

        checks = checks.withColumns({"_cites": around("_strict"), "_false": around("_plain")})
        dense = (
            (F.col("_at") >= F.floor(F.col("_rows") * 0.80))
            & (F.col("_cites") >= 16)
            & (F.col("_false") == 0)
        )
        candidates["_dense"] = F.min(F.when(dense, F.col("_at"))).over(document())
        third = F.when(
            F.col("_dense").isNotNull(), F.greatest(F.col("_dense") - 10, F.lit(0))
        )
        drop += ["_plain", "_cites", "_false", "_dense"]
    found = checks.withColumns(candidates)
    return found.withColumns(
        {
            "ref_start": F.coalesce("_s1", "_s2", third),
            "ref_trigger": F.when(F.col("_s1").isNotNull(), "heading_match")
            .when(F.col("_s2").isNotNull(), "secondary_heading_validated")
            .when(third.isNotNull(), "strict_patterns")
            .otherwise("none"),
        }
    ).drop(*drop)


def with_reference_zone(
    df: DataFrame, text: str = "text", use_density: bool = False
) -> DataFrame:
    """Add ref_trigger, ref_start, ref_end (exclusive) and in_ref.

    The zone ends at the first structural tag after the start, or, once three
    reference-like rows were seen, where a long enough streak of other
    substantive rows began; else with the document.
    """
    started = with_reference_start(df, text, use_density)
    t = strip_blank(F.col(text))
    strong = F.col("ref_trigger") == "heading_match"
    after = F.col("_at") > F.col("ref_start")
    flagged = started.withColumns(
        {
            "_exit": after & pt.is_zone_exit(t),
            "_like": F.when(strong, pt.has_reference_feature(t)).otherwise(
                pt.is_citation(t, strict=False)
            ),
        }
    ).withColumn("_solid", after & (F.length(t) >= 10) & ~F.col("_exit"))
    islands = flagged.withColumn(
        "_seen", F.sum((F.col("_solid") & F.col("_like")).cast("int")).over(upto())
    )
    streaks = islands.withColumn(
        "_streak", F.sum((F.col("_solid") & ~F.col("_like")).cast("int")).over(upto("_seen"))
    )
    needed = F.when(strong, fixed.STRONG_STREAK).otherwise(fixed.WEAK_STREAK)
    broken = F.col("_solid") & (F.col("_seen") >= 3) & (F.col("_streak") >= needed)
    ends = streaks.withColumns(
        {
            "_exit_at": F.min(F.when(F.col("_exit"), F.col("_at"))).over(document()),
            "_hit": F.min(
                F.when(broken, F.struct(F.col("_at").alias("at"), F.col("_streak").alias("streak")))
            ).over(document()),
        }
    )
    by_streak = F.col("_hit.at") - F.col("_hit.streak") + 1
    end = (
        F.when(
            F.col("_exit_at") < F.coalesce(F.col("_hit.at"), F.col("_rows")), F.col("_exit_at")
        )
        .otherwise(F.coalesce(by_streak, F.col("_rows")))
    )
    return (
        ends.withColumn("ref_end", F.when(F.col("ref_start").isNotNull(), end).cast("int"))
        .withColumn(
            "in_ref",
            F.coalesce(
                (F.col("_at") >= F.col("ref_start")) & (F.col("_at") < F.col("ref_end")),
                F.lit(False),
            ),
        )
        .drop("_at", "_rows", "_exit", "_like", "_solid", "_seen", "_streak", "_exit_at", "_hit")
    )


def reference_examples(df: DataFrame, limit: int = 5, width: int = 60) -> DataFrame:
    """First rows of each document's reference zone, as snippets."""
    ranked = df.where("in_ref").withColumn("rank", F.row_number().over(ordered()))
    return ranked.where(F.col("rank") <= limit).select(
        "doc_id", "rank", "para_id", F.substring("text", 1, width).alias("snippet")
    )
