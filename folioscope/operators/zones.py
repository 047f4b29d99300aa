"""Context zones, boxes and list runs as window passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import patterns as pt
from folioscope.operators.ordered import before, ordered, seen, upto


def with_boxes(df: DataFrame, text: str = "text") -> DataFrame:
    """Add box_marker, in_box, box_type, box_zone, box_seg.

    The machine forgets everything but the last marker: nested starts are
    ignored, any end closes, and the end row still belongs to the box.
    ``box_seg`` counts boxes opened so far.
    """
    marked = df.withColumns(
        {
            "box_marker": pt.box_marker(F.col(text)),
            "_kind": pt.box_type(F.col(text)),
        }
    ).withColumn("_prev", F.last("box_marker", ignorenulls=True).over(before()))
    starts = F.col("box_marker").eqNullSafe("start")
    open_before = F.col("_prev").eqNullSafe("start")
    opened = marked.withColumns(
        {"in_box": starts | open_before, "_opens": starts & ~open_before}
    )
    typed = opened.withColumns(
        {
            "_type": F.last(F.when(F.col("_opens"), F.col("_kind")), ignorenulls=True).over(upto()),
            "box_seg": F.sum(F.col("_opens").cast("int")).over(upto()),
        }
    )
    return typed.withColumns(
        {
            "box_type": F.when(F.col("in_box"), F.col("_type")),
            "box_zone": F.when(F.col("in_box"), pt.box_zone(F.col("_type"))),
            "_last_zone": pt.box_zone(F.col("_type")),
        }
    ).drop("_kind", "_prev", "_opens", "_type")


def segment_zones(df: DataFrame, text: str = "text", after_box: str = "sticky") -> DataFrame:
    """Add zone and the box columns.

    METADATA -> FRONT_MATTER -> BODY -> BACK_MATTER, with boxes in between.
    ``after_box='sticky'``: the rows after a box keep its zone until a
    body-start or opener line; ``'restore'`` returns to the zone before it.
    """
    if after_box not in ("sticky", "restore"):
        raise ValueError(after_box)
    t = F.col(text)
    flagged = with_boxes(df, text).withColumns(
        {
            "_body": pt.is_body_start(t) & ~F.col("in_box"),
            "_open": pt.is_chapter_opener(t) & ~F.col("in_box"),
            "_back": pt.is_back_matter(t) & ~F.col("in_box"),
            "_seg": F.when(F.col("in_box"), -1 - F.col("box_seg")).otherwise(
                F.col("box_seg") if after_box == "sticky" else F.lit(0)
            ),
            "_z0": F.first(
                F.when(pt.has_metadata(t), "METADATA")
                .when(pt.is_chapter_opener(t), "FRONT_MATTER")
                .when(pt.is_body_start(t), "BODY")
                .otherwise("FRONT_MATTER")
            ).over(upto()),
        }
    )
    # Outside boxes each stretch starts from the document start state or from
    # the zone of the box before it.
    entry = F.col("_z0")
    if after_box == "sticky":
        entry = F.when(F.col("box_seg") == 0, F.col("_z0")).otherwise(F.col("_last_zone"))
    entered = flagged.withColumn("_z0", entry)
    in_body = F.col("_z0") == "BODY"
    hit = entered.withColumns(
        {
            "_back": F.col("_back") & (in_body | seen(F.col("_body"), before("_seg"))),
            "_body": in_body | seen(F.col("_body"), upto("_seg")),
            "_open": seen(F.col("_open"), upto("_seg")),
        }
    )
    zone = (
        F.when(F.col("in_box"), F.col("box_zone"))
        .when(seen(F.col("_back"), upto("_seg")), "BACK_MATTER")
        .when(F.col("_body"), "BODY")
        .when(F.col("_open"), "FRONT_MATTER")
        .otherwise(F.col("_z0"))
    )
    return hit.withColumn("zone", zone).drop(
        "_body", "_open", "_back", "_seg", "_z0", "_last_zone", "box_zone", "box_seg"
    )


def cell_zones(cells: DataFrame, text: str = "text") -> DataFrame:
    """Table rows: zone TABLE, cell zone = box zone or TABLE (own box machine)."""
    boxed = with_boxes(cells, text)
    return boxed.withColumns(
        {
            "zone": F.lit("TABLE"),
            "table_cell_zone": F.coalesce("box_zone", F.lit("TABLE")),
        }
    ).drop("box_zone", "box_seg", "_last_zone")


def document_section(df: DataFrame) -> DataFrame:
    """Older two projections of the zone."""
    boxed = F.col("zone").startswith("BOX_")
    return df.withColumns(
        {
            "legacy_section": F.when(boxed, "BODY")
            .when(F.col("zone") == "METADATA", "FRONT_MATTER")
            .otherwise(F.col("zone")),
            "document_section": F.when(boxed, "BODY").otherwise(F.col("zone")),
        }
    )


LIST_KEY = ["list_kind", "indent_level", "zone", "is_table", "table_idx", "box_type"]


def with_list_positions(df: DataFrame) -> DataFrame:
    """FIRST / MID / LAST of runs of list items with an equal key.

    Needs the ``LIST_KEY`` columns; rows without a list kind break runs.
    """
    key = F.struct(*LIST_KEY)
    listed = F.col("list_kind").isNotNull()
    changed = df.withColumn("_key", F.when(listed, key)).withColumn(
        "_new", ~F.col("_key").eqNullSafe(F.lag("_key").over(ordered()))
    )
    runs = changed.withColumn("_run", F.sum(F.col("_new").cast("int")).over(upto()))
    last = ~F.lead("_run").over(ordered()).eqNullSafe(F.col("_run"))
    position = (
        F.when(~listed, F.lit(None).cast("string"))
        .when(F.col("_new"), "FIRST")
        .when(last, "LAST")
        .otherwise("MID")
    )
    return runs.withColumns(
        {
            "list_position": position,
            "list_level": F.when(listed, F.col("indent_level")),
        }
    ).drop("_key", "_new", "_run")


def with_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """Row features of a block: captions, sources, labels, lists."""
    t = F.col(text)
    have = set(df.columns)
    defaults = {
        "is_table": F.lit(False),
        "table_idx": F.lit(None).cast("int"),
        "has_xml_list": F.lit(False),
        "indent_level": F.lit(0),
        "has_bullet": pt.has_bullet(t),
        "has_numbering": pt.has_numbering(t),
    }
    base = df.withColumns({k: v for k, v in defaults.items() if k not in have})
    return base.withColumns(
        {
            "caption_type": pt.caption_type(t),
            "source_line": pt.is_source_line(t),
            "box_label": pt.box_label(t),
            "box_title": pt.is_box_title(t),
            "list_kind": pt.list_kind(
                F.col("has_bullet"), F.col("has_numbering"), F.col("has_xml_list"), t
            ),
        }
    )


def structure(df: DataFrame, text: str = "text", after_box: str = "sticky") -> DataFrame:
    """Zones, boxes, block features and list positions in one chain."""
    return with_list_positions(with_blocks(segment_zones(df, text, after_box), text))
