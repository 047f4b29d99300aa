"""Deterministic tag rules: features, learning, reporting, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import fixed
from folioscope.functions.text import any_of, strip_blank
from folioscope.session import BROADCAST_ROWS, through_table

RULE = "struct<rank: int, predicted_tag: string, confidence: double, condition: string>"

FLAG_NAMES = [
    "is_empty", "is_short", "is_long", "has_number_prefix", "has_letter_prefix",
    "has_roman_prefix", "has_bullet", "is_all_caps", "starts_with_digit",
    "ends_with_period", "ends_with_colon", "has_citation_year",
    "looks_like_heading", "looks_like_caption", "looks_like_reference",
    "looks_like_footnote", "is_in_table", "is_in_box", "is_in_back_matter",
]


def words(text: Column) -> Column:
    return F.filter(F.split(strip_blank(text), r"[\s\x{00A0}]+"), lambda w: w != "")


def looks_like_heading(t: Column) -> Column:
    w = words(t)
    titled = F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}")))
    needed = F.greatest(F.lit(1), F.floor(F.size(w) * 0.6).cast("int"))
    return (t != "") & (F.length(t) <= 200) & ~t.rlike(r"[.!?]\s*$") & (titled >= needed)


def looks_like_reference(text: Column) -> Column:
    t = strip_blank(text)
    listed = t.rlike(any_of([fixed.FEATURE_NUMBERED_PATTERN, fixed.REF_BULLET_PATTERN]))
    dated = t.rlike(fixed.YEAR_PATTERN) | t.rlike("(?i)doi|et al")
    return (t != "") & (listed | (text.rlike(fixed.TWO_MARKS_PATTERN) & dated))


def feature_columns(
    text: Column, zone: Column, list_kind: Column, list_position: Column
) -> dict[str, Column]:
    """Two lengths, nineteen flags and three context strings."""
    t = strip_blank(text)
    place = F.coalesce(zone, F.lit("BODY"))
    return {
        "length": F.length(text),
        "word_count": F.size(words(text)),
        "is_empty": t == "",
        "is_short": F.length(t) < 50,
        "is_long": F.length(t) > 500,
        "has_number_prefix": t.rlike(fixed.FEATURE_NUMBERED_PATTERN),
        "has_letter_prefix": t.rlike(fixed.FEATURE_LETTERED_PATTERN),
        "has_roman_prefix": t.rlike(fixed.FEATURE_ROMAN_PATTERN),
        "has_bullet": t.rlike(fixed.REF_BULLET_PATTERN),
        "is_all_caps": t.rlike(fixed.FEATURE_ALL_CAPS_PATTERN),
        "starts_with_digit": t.rlike(r"^\p{Nd}"),
        "ends_with_period": t.endswith("."),
        "ends_with_colon": t.endswith(":"),
        "has_citation_year": text.rlike(fixed.YEAR_PATTERN),
        "looks_like_heading": looks_like_heading(t),
        "looks_like_caption": t.rlike(r"(?i)^(figure|table|fig\.|tab\.)"),
        "looks_like_reference": looks_like_reference(text),
        "looks_like_footnote": t.rlike(r"^(\*|†|‡)")
        | t.rlike(fixed.FEATURE_FOOTNOTE_PATTERN),
        "is_in_table": place == "TABLE",
        "is_in_box": place.startswith("BOX_"),
        "is_in_back_matter": place == "BACK_MATTER",
        "zone": place,
        "list_kind": list_kind,
        "list_position": list_position,
    }


def with_features(
    df: DataFrame,
    text: str = "text",
    zone: Column | None = None,
    list_kind: Column | None = None,
    list_position: Column | None = None,
) -> DataFrame:
    null = F.lit(None).cast("string")
    return df.withColumns(
        feature_columns(
            F.col(text),
            zone if zone is not None else F.lit("BODY"),
            list_kind if list_kind is not None else null,
            list_position if list_position is not None else null,
        )
    )


def training_examples(gold: DataFrame, zone: Column | None = None) -> DataFrame:
    """Gold rows as examples with the neighbouring gold tags.

    Neighbours are taken before unmapped rows are dropped, so an unmapped row
    is no example but is still seen by the rows next to it.
    """
    order = Window.partitionBy("doc_id").orderBy("para_id")
    beside = gold.withColumns(
        {
            "prev_tag": F.coalesce(F.lag("gold_tag").over(order), F.lit("START")),
            "next_tag": F.coalesce(F.lead("gold_tag").over(order), F.lit("END")),
        }
    )
    kept = beside.where(
        (F.col("gold_tag") != "UNMAPPED") & (F.col("gold_tag") != "") & (F.col("text") != "")
    )
    return with_features(kept, zone=zone)


def key_slots(use_neighbors: bool = False) -> list[Column]:
    """One key or null for each flag (`name`) and each string (`name=value`)."""
    names = ["zone", "list_kind", "list_position"]
    if use_neighbors:
        names += ["prev_tag", "next_tag"]
    flags = [F.when(F.col(f), F.lit(f)) for f in FLAG_NAMES]
    strings = [
        F.when(F.coalesce(F.col(s), F.lit("")) != "", F.concat(F.lit(f"{s}="), F.col(s)))
        for s in names
    ]
    return [*flags, *strings]


def feature_keys(use_neighbors: bool = False) -> Column:
    """Keys present on a row: true flags and `name=value` for set strings."""
    return F.array_compact(F.array(*key_slots(use_neighbors)))


def rule_counts(examples: DataFrame, use_neighbors: bool = False) -> DataFrame:
    """(tag, feature_key, support, total): one pass, partial aggregation.

    The number of distinct keys is small, so both totals come from the same
    tiny (tag, key) aggregate.
    """
    by_tag = (
        examples.select(
            F.col("gold_tag").alias("tag"),
            F.explode(feature_keys(use_neighbors)).alias("feature_key"),
        )
        .groupBy("tag", "feature_key")
        .agg(F.count("*").alias("support"))
    )
    return by_tag.withColumn(
        "total", F.sum("support").over(Window.partitionBy("feature_key"))
    )


def learn_rules(
    counts: DataFrame, min_support: int = 10, min_confidence: float = 0.8
) -> DataFrame:
    """Single-feature rules ranked by (confidence, support); ties by name.

    A tag below ``min_support`` examples cannot reach it on any feature, so
    the support filter covers it.
    """
    rules = counts.where(
        (F.col("support") >= min_support)
        & (F.col("support") / F.col("total") >= min_confidence)
    ).select(
        F.col("feature_key").alias("condition"),
        F.col("tag").alias("predicted_tag"),
        "support",
        "total",
        (F.col("support") / F.col("total")).alias("confidence"),
    )
    # The rule table is an aggregate over (tag, key): a global rank is small.
    order = Window.partitionBy(F.lit(0)).orderBy(
        F.desc("confidence"), F.desc("support"), "condition", "predicted_tag"
    )
    return rules.withColumn("rank", F.row_number().over(order))


def apply_rules(
    features: DataFrame, rules: DataFrame, use_neighbors: bool = False,
    min_confidence: float = 0.80,
) -> DataFrame:
    """Add rule_tag, rule_condition, rule_confidence (0-100) of the first match.

    Of the rules with one condition only the best ranked can fire, so the
    table is reduced to those.  Each of the row's keys is one lookup in the
    hashed relation of the rules by condition, built once for all lookups; the
    best rank among the hits decides within the row, so no row is exploded or
    shuffled.  Flags that no rule names are not looked up.  A table beyond the
    broadcast bound is met by exploded keys, whose hits are reduced to the
    best of each row.
    """
    best = through_table(
        rules.groupBy("condition").agg(F.min_by(F.struct("rank", "predicted_tag", "confidence"), "rank").alias("rule")), "rules-by-condition"
    )
    if best.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        flags = {r[0] for r in best.where(F.col("condition").isin(FLAG_NAMES)).select("condition").collect()}
        slots = dict(zip([*FLAG_NAMES, *range(9)], key_slots(use_neighbors)))
        asked = {f"_k{i}": key for i, (name, key) in enumerate(slots.items()) if name not in FLAG_NAMES or name in flags}
        ruled, hits = features.withColumns(asked), []
        for k in asked:
            held = F.broadcast(best.alias(f"_of{k}"))
            ruled = ruled.join(held, F.col(k) == F.col(f"_of{k}.condition"), "left")
            hits.append(F.when(F.col(f"_of{k}.condition").isNotNull(), F.struct(f"_of{k}.rule.*", F.col(k).alias("condition"))))
        first = F.array_min(F.array_compact(F.array(*hits))) if hits else F.lit(None)
        ruled = ruled.select(*features.columns, first.alias("_rule")) if hits else features.withColumn("_rule", F.lit(None).cast(RULE))
    else:
        numbered = through_table(features.withColumn("_row", F.monotonically_increasing_id()), "ruled-rows")
        asked = numbered.select("_row", F.explode(feature_keys(use_neighbors)).alias("condition")).join(best, "condition")
        first = asked.groupBy("_row").agg(F.min(F.struct("rule.*", "condition")).alias("_rule"))
        ruled = numbered.join(first, "_row", "left").drop("_row")
    sure = F.col("_rule.confidence").cast("double")
    return (
        ruled.withColumn("_rule", F.when(sure >= min_confidence, F.col("_rule")))
        .withColumns(
            {
                "rule_tag": F.col("_rule.predicted_tag"),
                "rule_condition": F.col("_rule.condition"),
                "rule_confidence": F.floor(sure * 100).cast("int"),
            }
        )
        .drop("_rule")
    )


def split_by_rules(ruled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows answered by a rule, rows that still need a tagger)."""
    answered = ruled.where(F.col("rule_tag").isNotNull())
    open_rows = ruled.where(F.col("rule_tag").isNull())
    return answered, open_rows


def rule_report(counts: DataFrame, tags: int = 20, features: int = 3) -> DataFrame:
    """Top features of the most frequent tags with their share (flags only)."""
    flags = counts.where(~F.col("feature_key").contains("="))
    per_tag = Window.partitionBy("tag")
    shared = flags.withColumn("tag_total", F.sum("support").over(per_tag))
    # One row per tag survives to the global rank.
    ranked_tags = shared.select("tag", "tag_total").distinct().withColumn(
        "tag_rank",
        F.row_number().over(
            Window.partitionBy(F.lit(0)).orderBy(F.desc("tag_total"), "tag")
        ),
    )
    order = per_tag.orderBy(F.desc("support"), "feature_key")
    return (
        shared.withColumn("feature_rank", F.row_number().over(order))
        .where(F.col("feature_rank") <= features)
        .join(ranked_tags.where(F.col("tag_rank") <= tags).select("tag", "tag_rank"), "tag")
        .select(
            "tag", "tag_rank", "tag_total", "feature_key", "feature_rank", "support",
            F.round(F.col("support") / F.col("tag_total"), 6).alias("share"),
        )
    )


def top_rules(rules: DataFrame, limit: int = 50) -> DataFrame:
    return rules.where(F.col("rank") <= limit)


def save_rules(rules: DataFrame, counts: DataFrame, path: str) -> None:
    rules.write.mode("overwrite").parquet(f"{path}/rules")
    counts.write.mode("overwrite").parquet(f"{path}/rule_counts")


def load_rules(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/rules"), spark.read.parquet(f"{path}/rule_counts")
