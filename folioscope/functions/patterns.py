"""Paragraph predicates as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope import fixed
from folioscope.functions.text import (
    any_of,
    folded,
    strip_blank,
    strip_xml_tags,
)


def _matches(text: Column, patterns: list[str] | str) -> Column:
    """Any pattern on the stripped text, ignoring case."""
    pattern = patterns if isinstance(patterns, str) else any_of(patterns)
    return strip_blank(text).rlike("(?i)" + pattern)


def has_metadata(text: Column) -> Column:
    return _matches(text, fixed.METADATA_PATTERNS)


def has_front_matter(text: Column) -> Column:
    return _matches(text, fixed.FRONT_MATTER_PATTERNS)


def is_chapter_opener(text: Column) -> Column:
    return _matches(text, fixed.CHAPTER_OPENER_PATTERNS)


def is_body_start(text: Column) -> Column:
    return _matches(text, fixed.BODY_START_PATTERNS)


def is_back_matter(text: Column) -> Column:
    return _matches(text, fixed.BACK_MATTER_PATTERNS)


BOX_START = "^<" + any_of(fixed.BOX_TAGS) + ">"
BOX_END = "^</" + any_of(fixed.BOX_TAGS) + ">"


def box_marker(text: Column) -> Column:
    """'start', 'end' or null."""
    return F.when(_matches(text, BOX_START), "start").when(_matches(text, BOX_END), "end")


def box_type(text: Column) -> Column:
    """Type of the box a start marker opens, null elsewhere.

    A type matches when its spelled-out pattern occurs in the marker's tag
    pattern or when its name occurs in the text; types are tried in fixed
    order, so `<example> ... note` is a note.
    """

    def ladder(line: Column) -> Column:
        found = F.lit("box")
        for name in reversed(list(fixed.BOX_PREFIXES)):
            spelled = name.replace(" ", r"\s*")
            holders = [tag for tag in fixed.BOX_TAGS if spelled in tag]
            hit = line.contains(name)
            if holders:
                hit = hit | line.rlike("^<" + any_of(holders) + ">")
            found = F.when(hit, name).otherwise(found)
        return found

    # Bound once in a one-element array: the ladder is long, and only the few
    # marker rows reach it.
    return F.when(
        _matches(text, BOX_START), F.get(F.transform(F.array(folded(text)), ladder), 0)
    )


def box_zone(kind: Column) -> Column:
    mapped = F.lit(None).cast("string")
    for name, prefix in reversed(list(fixed.BOX_PREFIXES.items())):
        mapped = F.when(kind == name, f"BOX_{prefix}").otherwise(mapped)
    return mapped


def caption_type(text: Column) -> Column:
    return F.when(_matches(text, fixed.FIGURE_CAPTION_PATTERNS), "figure").when(
        _matches(text, fixed.TABLE_CAPTION_PATTERNS), "table"
    )


def is_source_line(text: Column) -> Column:
    return _matches(text, fixed.SOURCE_LINE_PATTERNS)


def box_label(text: Column) -> Column:
    t = strip_blank(text)
    longest = max(map(len, fixed.BOX_PREFIXES))
    short = (F.length(t) <= longest) & F.lower(t).isin(list(fixed.BOX_PREFIXES))
    return F.when(short, F.lower(t))


def is_box_title(text: Column) -> Column:
    return _matches(text, fixed.BOX_TITLE_PATTERNS)


def has_bullet(text: Column) -> Column:
    return strip_blank(text).rlike(fixed.BULLET_PATTERN)


def has_numbering(text: Column) -> Column:
    return strip_blank(text).rlike(fixed.NUMBERING_PATTERN)


def indent_level(inches: Column) -> Column:
    return F.coalesce(F.floor(inches / 0.25), F.lit(0)).cast("int")


def list_kind(bullet: Column, numbered: Column, xml_list: Column, text: Column) -> Column:
    return (
        F.when(bullet, "bullet")
        .when(numbered, "numbered")
        .when(xml_list, "unordered")
        .when(strip_blank(text).rlike(fixed.LETTERED_ITEM_PATTERN), "unordered")
    )


def infer_cell_style(
    declared: Column, text: Column, header: Column, first_col: Column
) -> Column:
    """Table style from the declared cell style, else from the position."""
    up = F.upper(F.coalesce(declared, F.lit("")))
    by_place = (
        F.when(header, "T2")
        .when(first_col, "T4")
        .when(text.rlike(r"^(\x{2022}|-|\x{25CF}|\x{25CB}|\t)"), "TBL-MID")
        .otherwise("T")
    )
    return (
        F.when(up.isin("T", "TABLEBODY", "GT"), F.when(first_col, "T4").otherwise("T"))
        .when(up.isin("T2", "TABLECOLUMNHEAD1", "TABLEHEADER"), "T2")
        .when(up.contains("TBL") | up.contains("BULLET"), "TBL-MID")
        .when(up.isin("TFN", "TABLEFOOTNOTE"), "TFN")
        .when(
            up.startswith("UNT"),
            F.when(header, "T2").when(first_col, "T4").otherwise("T"),
        )
        .otherwise(by_place)
    )


# --- references ----------------------------------------------------------------


def is_reference_entry(text: Column) -> Column:
    """Entry test used by the repair passes."""
    t = strip_blank(text)
    dated = t.rlike(fixed.YEAR_PATTERN) | t.rlike("(?i)doi|et al")
    listed = t.rlike(any_of([fixed.REF_NUMBER_PATTERN, fixed.REF_BULLET_PATTERN]))
    cited = t.rlike(fixed.TWO_MARKS_PATTERN) & (t.rlike(fixed.AUTHOR_TITLE_PATTERN) | dated)
    return (
        (t != "")
        & (listed | cited)
        & ~t.rlike("(?i)" + fixed.SUGGESTED_READING_PATTERN)
    )


def starts_with_ref_bullet(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(fixed.REF_BULLET_PATTERN)


def reference_feature_count(t: Column) -> Column:
    return reduce(
        lambda a, b: a + b,
        [t.rlike(p).cast("int") for p in fixed.REFERENCE_FEATURE_PATTERNS],
    )


def is_citation(text: Column, strict: bool = True) -> Column:
    t = strip_blank(text)
    start = t.rlike(any_of(fixed.CITATION_START_PATTERNS))
    count = reference_feature_count(t)
    hit = (start & (count >= 2)) if strict else (start | (count >= 3))
    return (F.length(t) >= 20) & hit


def has_reference_feature(text: Column) -> Column:
    t = strip_blank(text)
    hit = reduce(
        lambda a, b: a | b, [t.rlike(p) for p in fixed.REFERENCE_FEATURE_PATTERNS]
    )
    return (F.length(t) >= 15) & hit


def is_numbered_not_reference(text: Column) -> Column:
    t = strip_blank(text)
    referenced = (
        t.rlike(fixed.YEAR_PATTERN)
        | t.rlike(r"\bet\s+al\.?\b")
        | t.rlike("(?i)doi")
        | t.rlike(r"(?i)\b(journal|vol\.|volume|press)\b")
    )
    return (F.length(t) < 50) & t.rlike(r"^\d+\.\s+") & ~referenced


def _untagged(text: Column, limit: int) -> Column:
    """Lower-cased text without tags where it can be ``limit`` long, else null."""
    bare = F.lower(strip_xml_tags(text))
    return F.when((F.length(strip_blank(text)) <= limit) | text.contains("<"), bare)


def is_reference_heading(text: Column) -> Column:
    c = _untagged(text, 80)
    short = (F.length(c) <= 80) & ~c.rlike(r"[.!?;:]\s*$")
    hit = c.isin(fixed.REFERENCE_HEADINGS) | (short & c.rlike(any_of(fixed.REFERENCE_HEADINGS)))
    return F.coalesce(hit, F.lit(False))


def is_secondary_reference_heading(text: Column) -> Column:
    longest = max(map(len, fixed.SECONDARY_REFERENCE_HEADINGS))
    hit = _untagged(text, longest).isin(fixed.SECONDARY_REFERENCE_HEADINGS)
    return F.coalesce(hit, F.lit(False))


def is_zone_exit(text: Column) -> Column:
    return text.rlike(fixed.ZONE_EXIT_PATTERN) & ~text.rlike(
        fixed.REFERENCE_TAG_PATTERN
    )


def is_t4_heading(text: Column) -> Column:
    t = strip_blank(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    titled = F.size(
        F.filter(
            words,
            lambda w: F.regexp_replace(w, "[^A-Za-z0-9]", "").rlike("^[A-Z]"),
        )
    )
    needed = F.greatest(F.lit(1), F.floor(F.size(words) * 0.7).cast("int"))
    return (
        (t != "")
        & (F.length(t) <= 60)
        & ~t.rlike(r"[.!?;:]\s*$")
        & ~t.rlike(fixed.T4_NUMERIC_PATTERN)
        & (t.rlike(fixed.T4_CAPS_PATTERN) | ((F.size(words) >= 2) & (titled >= needed)))
    )


def inline_heading(text: Column) -> Column:
    level = F.regexp_extract(
        F.coalesce(text, F.lit("")), fixed.INLINE_HEADING_PATTERN, 1
    )
    return F.when(level != "", F.concat(F.lit("H"), level))


def is_table_footnote(text: Column) -> Column:
    t = strip_blank(text)
    return t.rlike(r"(?i)^(?:note|source|\*|†|[a-z]\))")
