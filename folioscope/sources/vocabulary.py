"""Style vocabularies and aliases as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope import fixed
from folioscope.functions.styles import normalize_style
from folioscope.functions.text import strip_blank, style_text


def build_vocabulary(
    observed: DataFrame, listed: DataFrame, fallback: DataFrame, enough: int = 50
) -> DataFrame:
    """Styles seen in documents, listed styles, and the fallback list when the
    listed ones are too few.  One column ``style``; order on write if needed.
    """
    distinct = listed.select("style").distinct()
    if distinct.limit(enough).count() < enough:  # bounded check of a dimension
        listed = listed.select("style").unionByName(fallback.select("style"))
    return (
        observed.select("style")
        .unionByName(listed.select("style"))
        .select(strip_blank(F.col("style")).alias("style"))
        .where(F.col("style") != "")
        .distinct()
    )


def load_vocabulary(styles: DataFrame, required: str = "PMI") -> DataFrame:
    """Normalised styles without invalid entries; fails if one is missing."""
    loaded = (
        styles.select(normalize_style(F.col("style")).alias("style"))
        .where((F.col("style") != "") & ~F.col("style").isin(fixed.INVALID_VOCABULARY_ENTRIES))
        .distinct()
    )
    if loaded.where(F.col("style") == required).isEmpty():
        raise ValueError(f"{required} is required in the vocabulary")
    return loaded


def load_raw_vocabulary(styles: DataFrame) -> DataFrame:
    """Variant for gold building: blanks cleaned, names otherwise untouched."""
    return (
        styles.select(style_text(F.col("style")).alias("style"))
        .where(F.col("style") != "")
        .distinct()
    )


def load_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.select(
        style_text(F.col("raw")).alias("raw"), style_text(F.col("canonical")).alias("canonical")
    ).where((F.col("raw") != "") & (F.col("canonical") != ""))


MOST_ZONE_RULES = 50_000


def load_zone_rules(rules: DataFrame) -> dict[str, list[str]]:
    """Zone -> allowed styles from a table (zone, style), normalised.

    A zone without rows is unrestricted.  The table is a dimension: distinct
    rows are counted, and too many raise an error instead of being cut.
    """
    rows = (
        rules.select(F.upper(strip_blank(F.col("zone"))).alias("zone"), normalize_style(F.col("style")).alias("style"))
        .where((F.col("zone") != "") & (F.col("style") != ""))
        .distinct()
        .limit(MOST_ZONE_RULES + 1)
        .collect()
    )
    if len(rows) > MOST_ZONE_RULES:
        raise ValueError(f"more than {MOST_ZONE_RULES} zone rules")
    found: dict[str, list[str]] = {}
    for r in sorted(rows):
        found.setdefault(r["zone"], []).append(r["style"])
    return found


def casefold_lookup(values: DataFrame, column: str = "style") -> DataFrame:
    """(folded, original) for folded names that only one original maps to."""
    return (
        values.select(F.lower(column).alias("folded"), F.col(column).alias("original"))
        .distinct()
        .groupBy("folded")
        .agg(F.count("*").alias("_n"), F.min("original").alias("original"))
        .where(F.col("_n") == 1)
        .drop("_n")
    )
