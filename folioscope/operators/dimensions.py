"""Zone dimension reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import looked_up


def zone_styles(zone: str, table: dict[str, list[str]] | None = None) -> list[str]:
    """Styles listed for a zone; empty means unrestricted."""
    return list((table or {}).get(zone) or [])


def summary_text(styles: list[str], shown: int = 15) -> str:
    families = sorted({s.split("-")[0] + "-*" if "-" in s else s for s in styles})
    more = f" (+{len(families) - shown} more)" if len(families) > shown else ""
    return ", ".join(families[:shown]) + more


def zone_summary(zones: DataFrame, table: dict[str, list[str]] | None = None) -> DataFrame:
    """Add the style families valid in each row's zone."""
    texts = {z: summary_text(s) for z, s in (table or {}).items()}
    return zones.withColumn(
        "summary",
        F.coalesce(
            looked_up(texts, F.col("zone")) if texts else F.lit(None).cast("string"),
            F.lit("Full style range (no restrictions)"),
        ),
    )
