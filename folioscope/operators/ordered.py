"""Window specifications shared by every pass over a document.

All of them partition by ``doc_id`` first, so one exchange on ``doc_id``
serves the whole chain; a document is one source row, which bounds the group.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def document(*also: str) -> WindowSpec:
    return Window.partitionBy("doc_id", *also)


def ordered(*also: str) -> WindowSpec:
    return document(*also).orderBy("para_id")


def before(*also: str) -> WindowSpec:
    return ordered(*also).rowsBetween(Window.unboundedPreceding, -1)


def upto(*also: str) -> WindowSpec:
    return ordered(*also).rowsBetween(Window.unboundedPreceding, 0)


def seen(flag: Column, window: WindowSpec) -> Column:
    """True if the flag held on some row of the frame (false on empty frames)."""
    return F.coalesce(F.max(flag).over(window), F.lit(False))
