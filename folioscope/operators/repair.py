"""Deterministic repair of tagged paragraphs.

The row ladder is a chain of projections; the passes after it are windows on
the document.  Nothing here joins or shuffles beyond the one exchange on
``doc_id`` that the structure passes already need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import fixed
from folioscope.functions import patterns as pt
from folioscope.functions import styles as st
from folioscope.functions.styles import Vocabulary
from folioscope.functions.text import looked_up, strip_blank
from folioscope.operators.ordered import before, document, ordered, upto

C = F.col

TABLE_HEADINGS = {
    f"{family}{level}": f"TH{level}" for family in ("SK_H", "TBL-H") for level in range(1, 7)
}
BACK_MATTER_FALLBACKS = ["REF-U", "REF-N", "BM-TTL", "TSN", "TXT-FLUSH", "TXT"]


def _step(df: DataFrame, when: Column, value: Column | str, reason: str) -> DataFrame:
    """One rung: where ``when`` holds, set the tag and append the reason."""
    new = F.lit(value) if isinstance(value, str) else value
    return df.withColumns(
        {
            "tag": F.when(when, new).otherwise(C("tag")),
            "_why": F.when(when, F.concat("_why", F.lit("," + reason))).otherwise(C("_why")),
        }
    )


def _prepared(df: DataFrame, vocabulary: Vocabulary, keep_marker_pmi: bool) -> DataFrame:
    """Facts the rungs share, computed once per row."""
    optional = {
        "is_header_row": F.lit(False),
        "is_stub_col": F.lit(False),
        "ref_heading": F.lit(False),
        "has_xml_list": F.lit(False),
    }
    base = df.withColumns({k: v for k, v in optional.items() if k not in df.columns})
    base = base.withColumns(
        {
            "input_tag": C("tag"),
            "_why": F.lit(""),
            "_prefix": st.box_prefix(C("zone"), C("box_type")),
            "_t": strip_blank(C("text")),
        }
    )
    base = base.withColumns(
        {
            "_norm": st.normalized("tag", vocabulary, C("_prefix")),
            "_entry": pt.is_reference_entry(C("_t")),
            "_ref_tag": F.when(pt.starts_with_ref_bullet(C("_t")), "REF-U").otherwise("REF-N"),
            "_ref": C("in_ref") | (C("zone") == "REFERENCE"),
            "_bulletish": C("has_bullet") | C("has_xml_list"),
        }
    )
    base = base.withColumn(
        "_lock",
        st.trust_lock(C("_norm"), C("tag"), C("confidence"), C("text"), vocabulary, keep_marker_pmi),
    )
    if keep_marker_pmi:
        base = base.withColumn(
            "tag", F.when(F.upper("_t") == "<BL>", "PMI").otherwise(C("tag"))
        )
    return base


def _structural_list_tag() -> Column:
    return st.list_tag(
        C("list_kind"), C("list_position"), C("zone"), C("box_type"), C("_bulletish"), C("tag")
    )


def _table_rungs(df: DataFrame, v: Vocabulary) -> DataFrame:
    """Zone TABLE: heading names, footnotes, cell text, lists, T / T2 / T4."""
    here = ~C("_lock") & (C("zone") == "TABLE")
    mapped = looked_up(TABLE_HEADINGS, C("input_tag"))
    df = df.withColumns({"_head": F.when(here, mapped), "_note": here & pt.is_table_footnote(C("_t"))})
    df = _step(df, v.has("_head"), C("_head"), "zone-table-heading-map")
    df = _step(
        df, C("_head").isNotNull() & ~v.has("_head"), "T", "zone-table-heading-fallback"
    )
    df = _step(df, C("_note"), "TFN", "zone-table-footnote")
    if "TD" in v:
        df = _step(df, here & (C("tag") == "TBL-TXT"), "TD", "zone-table-txt-to-td")
    listed = here & C("tag").rlike("^(BL|UL|NL)-")
    plain = here & C("tag").isin("TXT", "TXT-FLUSH", "T") & ~C("_note")
    cell, why = F.lit("T"), F.lit("zone-table-text")
    if "T4" in v:
        guess = (C("confidence") < 0.90) & pt.is_t4_heading(C("_t"))
        cell = F.when(C("is_stub_col") | guess, "T4").otherwise(cell)
        why = (
            F.when(C("is_stub_col"), "zone-table-stub-col")
            .when(guess, "zone-table-t4-heuristic")
            .otherwise(why)
        )
    if "T2" in v:
        cell = F.when(C("is_header_row"), "T2").otherwise(cell)
        why = F.when(C("is_header_row"), "zone-table-header-row").otherwise(why)
    return df.withColumns(
        {
            "tag": F.when(listed, "T").when(plain, cell).otherwise(C("tag")),
            "_why": F.when(listed, F.concat("_why", F.lit(",zone-table-list")))
            .when(plain, F.concat("_why", F.lit(","), why))
            .otherwise(C("_why")),
        }
    ).drop("_head", "_note")


def _back_matter_rung(df: DataFrame, v: Vocabulary) -> DataFrame:
    targets = {t: v.first(*chain) for t, chain in fixed.BACK_MATTER_CHAINS.items()}
    targets = {t: c for t, c in targets.items() if c and c != t}
    if not targets:
        return df
    new = looked_up(targets, C("tag"))
    here = ~C("_lock") & (C("zone") == "BACK_MATTER") & new.isNotNull()
    return _step(df, here, new, "zone-backmatter-normalize")


def _list_rung(df: DataFrame, v: Vocabulary, keep_lists: bool) -> DataFrame:
    df = df.withColumns({"_list": _structural_list_tag(), "_n": st.normalized("tag", v)})
    open_row = ~C("_ref") & ~C("_lock") & C("_list").isNotNull()
    positioned = C("tag").rlike("-(FIRST|MID|LAST)$")
    ref_like = C("_n").startswith("REF") | C("_n").isin("BIB", "SR", "SRH1") | C("_entry")
    fresh = ~positioned & ~ref_like
    drift = C("tag").startswith("BL-") & C("_list").startswith("UL-")
    if keep_lists:
        drift = drift | C("tag").startswith("BL-")
    align = C("tag").rlike("^(BL|NL|UL|TBL|TNL|TUL)") & (C("tag") != C("_list")) & ~drift
    return _step(df, open_row & (fresh | align), C("_list"), "list-position").drop("_list", "_n")


def _zone_rungs(df: DataFrame, v: Vocabulary, zone_styles) -> DataFrame:
    refused = ~C("_lock") & ~st.zone_accepts_exact("tag", "zone", zone_styles)
    safe = F.when(C("tag").startswith("BX4-"), "BX4-TXT").otherwise("T")
    df = _step(
        df, refused & (C("zone") == "TABLE") & (C("tag") != safe), safe, "table-inferred"
    )
    df = df.withColumn("_list", _structural_list_tag())
    fallback = (
        F.when(C("zone") == "TABLE", "T")
        .when(
            C("zone") == "BACK_MATTER",
            F.coalesce("_list", F.lit(v.first(*BACK_MATTER_FALLBACKS)).cast("string"), "tag"),
        )
        .otherwise(F.coalesce("_list", F.lit("TXT")))
    )
    here = refused & (C("zone") != "BODY") & (C("tag") != fallback)
    return _step(df, here, fallback, "zone-fallback").drop("_list")


def _reference_rungs(df: DataFrame) -> DataFrame:
    head = C("_t").rlike("(?i)^<ref-h2>") | C("ref_heading")
    listed = C("tag").rlike("^(UL|BL)-")
    entry = ~C("tag").startswith("APX-REF") & ~C("tag").isin("SR", "SRH1") & C("_entry")
    new = (
        F.when(head, F.lit("REFH2")).when(listed | entry, C("_ref_tag")).otherwise(C("tag"))
    )
    why = (
        F.when(head, "ref-zone-heading")
        .when(listed, "ref-zone-list-override")
        .otherwise("ref-zone-pre-allowed")
    )
    changed = C("_ref") & (new != C("tag"))
    return df.withColumns(
        {
            "tag": F.when(changed, new).otherwise(C("tag")),
            "_why": F.when(changed, F.concat("_why", F.lit(","), why)).otherwise(C("_why")),
        }
    )


def repair_rows(
    df: DataFrame,
    vocabulary: Vocabulary,
    zone_styles: dict[str, list[str]] | None = None,
    keep_lists: bool = False,
    keep_marker_pmi: bool = False,
) -> DataFrame:
    """The ordered repair ladder; adds repaired, repair_reason, input_tag, from_h4h5.

    Needs the structure and reference-zone columns.  Rows whose tag is allowed
    and sure (>= 0.90) are left alone, except in a reference zone.
    """
    v = vocabulary
    df = _prepared(df, v, keep_marker_pmi)
    open_row = ~C("_lock")
    df = _step(
        df,
        open_row & (C("_norm") != "") & (C("_norm") != C("tag")),
        C("_norm"),
        "style-canonicalize",
    )
    df = _step(
        df, open_row & C("box_marker").isNotNull() & (C("tag") != "PMI"), "PMI", "box-marker"
    )
    df = _step(
        df, open_row & (C("zone") == "METADATA") & (C("tag") != "PMI"), "PMI", "metadata-zone"
    )
    inline = pt.inline_heading(C("text"))
    df = _step(
        df,
        open_row & (C("zone") != "TABLE") & (inline != C("tag")),
        inline,
        "inline-heading-marker",
    )
    df = _step(
        df, open_row & (C("caption_type") == "table") & (C("tag") != "T1"), "T1", "table-caption"
    )
    df = _step(
        df,
        open_row & (C("caption_type") == "figure") & (C("tag") != "FIG-LEG"),
        "FIG-LEG",
        "figure-caption",
    )
    df = _step(df, open_row & C("source_line") & (C("tag") != "TSN"), "TSN", "source-line")
    boxed = open_row & C("zone").startswith("BOX_")
    family = F.coalesce("_prefix", F.lit("NBX"))
    label = F.concat(family, F.lit("-TYPE"))
    title = F.concat(family, F.lit("-TTL"))
    labelled = C("box_label").isNotNull()
    df = _step(df, boxed & labelled & (C("tag") != label), label, "box-type-label")
    df = _step(
        df, boxed & ~labelled & C("box_title") & (C("tag") != title), title, "box-title"
    )
    df = df.withColumn(
        "_lock", C("_lock") & ~(C("in_ref") & ~C("_norm").startswith("REF-"))
    )
    df = _table_rungs(df, v)
    df = _back_matter_rung(df, v)
    df = _list_rung(df, v, keep_lists)
    df = _zone_rungs(df, v, zone_styles)
    lowered = ~C("_lock") & C("tag").isin("H4", "H5")
    df = df.withColumn("from_h4h5", lowered)
    df = _step(df, lowered, "H3", "heading-canonicalize")
    df = _reference_rungs(df)
    df = df.withColumn("_n", st.normalized("tag", v))
    df = df.withColumn("_n", st.ensure_allowed(C("_n"), v))
    df = _step(df, C("_n") != C("tag"), C("_n"), "not-allowed")
    changed = C("_why") != ""
    return df.withColumns(
        {
            "repaired": changed,
            "repair_reason": F.when(changed, C("_why").substr(F.lit(2), F.length("_why"))),
            "confidence": F.when(changed, F.least("confidence", F.lit(80.0))).otherwise(
                C("confidence")
            ),
        }
    ).drop("_why", "_prefix", "_t", "_norm", "_entry", "_ref_tag", "_ref", "_bulletish", "_lock", "_n")


def repair_table_zone(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The table rungs alone."""
    base = _prepared(df, vocabulary, False)
    return _table_rungs(base, vocabulary).withColumn(
        "repair_reason", F.when(C("_why") != "", C("_why").substr(F.lit(2), F.length("_why")))
    )


def repair_back_matter(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The back-matter map alone."""
    base = _prepared(df, vocabulary, False)
    return _back_matter_rung(base, vocabulary).withColumn(
        "repair_reason", F.when(C("_why") != "", C("_why").substr(F.lit(2), F.length("_why")))
    )


# --- passes over the repaired rows ------------------------------------------------


def _amend(df: DataFrame, when: Column, tag: Column, reason: str) -> DataFrame:
    why = F.concat_ws(",", "repair_reason", F.lit(reason))
    return df.withColumns(
        {
            "tag": F.when(when, tag).otherwise(C("tag")),
            "repaired": C("repaired") | when,
            "repair_reason": F.when(when, why).otherwise(C("repair_reason")),
        }
    )


KEPT_REFERENCE_TAGS = ["SR", "REF-N", "REF-N0", "BIB", "APX-REF-N", "APX-REF-U", "APX-REFH1"]


def preserve_reference_section(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Between a reference heading and the next section, restore the tagger's
    own reference tags."""
    df = df.withColumns(
        {"_now": st.normalized("tag", vocabulary), "_own": st.normalized("input_tag", vocabulary)}
    )
    keep = C("_own").isin(KEPT_REFERENCE_TAGS) & vocabulary.has("_own")
    opens = C("_now").isin("SRH1", "REFH1") | strip_blank(C("text")).rlike("(?i)^<ref>")
    ends = C("_now").isin("H1", "H2", "CN", "CT") & ~keep
    df = df.withColumns({"_open": opens, "_ev": F.when(ends, "E").when(opens, "T"), "_keep": keep})
    inside = C("_open") | F.last("_ev", ignorenulls=True).over(before()).eqNullSafe("T")
    df = df.withColumn("_restore", inside & C("_keep") & (C("tag") != C("input_tag")))
    return _amend(df, C("_restore"), C("input_tag"), "ref-section-preserve").drop(
        "_now", "_own", "_open", "_ev", "_keep", "_restore"
    )


ANCHORS = ["T1", "T2", "T4", "TFN", "TSN"]
TABLE_LIST_TAGS = ["TBL-FIRST", "TBL-MID", "TBL-LAST"]


#: Rows in which an anchor protects a float, and rows of a run (see _replayed).
REACH = 10
RUN = 64


def _step_on(distance: Column, kind: Column) -> Column:
    """Distance to the last anchor left, from the row before to this row.

    ``distance`` counts up to REACH + 1, which means out of reach.
    """
    here = F.least(distance + 1, F.lit(REACH + 1))
    return (
        F.when(kind == 1, 0)
        .when((kind == 2) & (here <= REACH), 0)
        .when((kind == 3) & (here > REACH), 0)
        .otherwise(here)
        .cast("int")
    )


def _replayed(df: DataFrame) -> DataFrame:
    """Decide the candidates of documents with contested rows in order.

    The state between rows is one small number, the distance to the last
    anchor left.  A row leaves an anchor always (1), if one is in reach (2), if
    none is (3), or never (0).  The last row of each run of RUN rows holds
    what the run makes of each state; these maps are followed from run to run,
    and within its run each contested row follows the rows before it.  No row
    carries more than one run, or as many maps as there are runs.
    """
    flag = C("_anchor").cast("int")
    ahead = F.coalesce(F.sum(flag).over(ordered().rowsBetween(1, REACH)), F.lit(0)) > 0
    df = df.withColumns({"_at": F.row_number().over(ordered()) - 1, "_ahead": ahead})
    open_ = C("_cand") & ~C("_ahead")
    stays = C("_new").isin(ANCHORS) | C("_new").startswith("FIG-")
    kind = (
        F.when(C("_anchor") & (~open_ | stays), 1).when(C("_anchor"), 2).when(open_ & stays, 3).otherwise(0).cast("tinyint")
    )
    replay = F.max(open_ & ~C("_anchor")).over(document())
    df = df.withColumns({"_replay": replay, "_kind": kind})
    df = df.withColumn("_run", F.collect_list(F.when(C("_replay"), C("_kind"))).over(ordered().rowsBetween(1 - RUN, 0)))
    df = df.withColumn("_ends", C("_at") % RUN == RUN - 1)
    states = F.array(*[F.lit(s).cast("int") for s in range(REACH + 2)])
    whole = F.aggregate("_run", states, lambda held, k: F.transform(held, lambda s: _step_on(s, k)))
    df = df.withColumn("_map", F.when(C("_replay") & C("_ends"), whole))
    maps = F.collect_list("_map").over(Window.partitionBy("doc_id", "_ends").orderBy("para_id").rowsBetween(Window.unboundedPreceding, 0))
    followed = F.aggregate(C("_maps"), F.lit(REACH + 1), lambda s, m: F.element_at(m, s + 1))
    df = df.withColumn("_maps", maps).withColumn("_after", F.when(C("_map").isNotNull(), followed))
    df = df.withColumn("_start", F.coalesce(F.last("_after", ignorenulls=True).over(before()), F.lit(REACH + 1)))
    inside = F.slice("_run", -(C("_at") % RUN + 1), C("_at") % RUN)
    distance = F.aggregate(inside, C("_start"), _step_on) + 1
    down = F.when(C("_replay") & C("_cand"), ~C("_ahead") & (distance > REACH)).otherwise(C("_down"))
    return df.withColumn("_down", down).drop(
        "_at", "_ahead", "_replay", "_kind", "_run", "_ends", "_map", "_maps", "_after", "_start"
    )


def check_anchors(df: DataFrame, vocabulary: Vocabulary, exact: bool = True) -> DataFrame:
    """Downgrade back-matter floats with no figure or table tag within ten rows.

    Two anchors in reach protect each other, so a window on the incoming tags
    decides every row but the table-list ones, which see downgrades made
    before them.  ``exact`` decides these in documents that have any by the
    distance to the last anchor that is left, in time linear in the rows.
    """
    anchor = C("tag").startswith("FIG-") | C("tag").isin(ANCHORS)
    candidate = (C("zone") == "BACK_MATTER") & (anchor | C("tag").isin(TABLE_LIST_TAGS))
    in_refs = vocabulary.first("REF-U", "REF-N", "REF-TXT", "TXT-FLUSH", "TXT") or "TXT-FLUSH"
    elsewhere = vocabulary.first("TSN", "BM-TTL", "TXT-FLUSH", "TXT") or "TXT-FLUSH"
    new = F.when(C("in_ref") | (C("zone") == "REFERENCE"), in_refs).otherwise(elsewhere)
    df = df.withColumns({"_anchor": anchor, "_cand": candidate, "_new": new})
    flag = C("_anchor").cast("int")
    near = F.sum(flag).over(ordered().rowsBetween(-REACH, REACH)) - flag
    df = df.withColumn("_down", C("_cand") & (near == 0))
    if exact:
        df = _replayed(df)
    return _amend(df, C("_down"), C("_new"), "zone-backmatter-downgrade").drop(
        "_anchor", "_cand", "_new", "_down"
    )


def flush_after_heading(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Plain text right after a heading becomes flush text."""
    target = "TXT-FLUSH" if "TXT-FLUSH" in vocabulary else "TXT"
    bulletish = C("has_bullet") | C("has_xml_list") if "has_xml_list" in df.columns else C("has_bullet")
    df = df.withColumn("_now", st.normalized("tag", vocabulary))
    listed = st.list_tag(
        C("list_kind"), C("list_position"), C("zone"), C("box_type"), bulletish, C("tag")
    ).isNotNull()
    previous = F.lag("_now").over(ordered())
    df = df.withColumn(
        "_flush",
        F.coalesce(
            previous.isin("H1", "H2", "H3", "APX-H1", "APX-H2", "APX-H3"), F.lit(False)
        )
        & (C("_now") == "TXT")
        & C("zone").isin("BODY", "BACK_MATTER", "REFERENCE")
        & (strip_blank(C("text")) != "")
        & ~listed
        & C("caption_type").isNull()
        & ~C("source_line"),
    )
    return _amend(df, C("_flush"), F.lit(target), "heading-following-flush").drop("_now", "_flush")


def fix_heading_hierarchy(
    df: DataFrame, vocabulary: Vocabulary, lowered: str = "row"
) -> DataFrame:
    """Headings may not skip levels; sure tags only steer the others.

    A heading's outcome depends on earlier outcomes, yet within a stretch that
    starts at an accepted H1 the state only moves forward: just after the H1
    ('A', or 'Z' before any H1), after a lone H3 ('B'), after an H2 ('C').
    Three windows find those points, so no fold and no self-join is needed.

    ``lowered='row'`` exempts a row that itself came from H4/H5 from the
    missing-H2 rule; ``'last_row'`` uses the document's last row for all.
    """
    came = F.coalesce(C("from_h4h5"), F.lit(False)) if "from_h4h5" in df.columns else F.lit(False)
    if lowered == "last_row":
        came = F.last(came).over(
            ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
    df = df.withColumn("_now", st.normalized("tag", vocabulary))
    sure = vocabulary.has("_now") & (C("confidence") >= 0.90)
    level = F.when(
        C("tag").rlike("^H[1-6]$"), F.substring("tag", 2, 1).cast("int")
    )
    df = df.withColumns({"_sure": sure, "_l": level, "_came": came, "_c7": C("confidence") >= 0.7})
    fixed_level = F.when(C("_sure"), C("_l"))
    df = df.withColumns(
        {
            "_s": F.coalesce(fixed_level, F.lit(0)),
            "_n": F.coalesce(F.when(~C("_sure"), C("_l")), F.lit(0)),
        }
    )
    h1ish = (C("_s") == 1) | (C("_n") == 1) | ((C("_n") == 2) & C("_c7"))
    df = df.withColumn("_h1", F.coalesce(F.max(h1ish).over(before()), F.lit(False)))
    top = (C("_s") == 1) | (C("_n") == 1) | ((C("_n") == 2) & ~C("_h1") & C("_c7"))
    dead = (C("_n") == 2) & ~C("_h1") & ~C("_c7")
    df = df.withColumns({"_top": top, "_dead": dead})
    df = df.withColumn("_seg", F.sum(C("_top").cast("int")).over(upto()))

    s2, s3 = C("_s") == 2, C("_s") == 3
    n2 = (C("_n") == 2) & ~C("_dead") & ~C("_top")
    n3, n4, n5 = C("_n") == 3, C("_n") == 4, C("_n") >= 5
    after_h1 = C("_seg") > 0
    first_c = s2 | n2 | F.when(after_h1, (C("_n") >= 3) & C("_c7")).otherwise(n3 & ~C("_came"))
    first_b = s3 | F.when(after_h1, F.lit(False)).otherwise((n3 & C("_came")) | n4 | n5)
    df = df.withColumn(
        "_turn", F.when(C("_top"), None).when(first_c, "C").when(first_b, "B")
    )
    df = df.withColumn("_p1", F.first("_turn", ignorenulls=True).over(before("_seg")))
    leave_b = s2 | n2 | (n3 & ~C("_came")) | (n5 & C("_c7"))
    df = df.withColumn("_leave", C("_p1").eqNullSafe("B") & leave_b)
    df = df.withColumn(
        "_phase",
        F.when(C("_p1").isNull(), F.when(after_h1, "A").otherwise("Z"))
        .when(
            (C("_p1") == "C") | F.coalesce(F.max("_leave").over(before("_seg")), F.lit(False)),
            "C",
        )
        .otherwise("B"),
    )
    in_c = C("_phase") == "C"
    enters = (C("_phase").isin("A", "Z") & (C("_turn") == "C")) | (
        (C("_phase") == "B") & C("_leave")
    )
    setter = (
        F.when(C("_top"), None)
        .when(enters | (in_c & (s2 | n2 | (n5 & C("_c7")))), 2)
        .when(in_c & (s3 | n3), 3)
    )
    df = df.withColumn("_setter", setter)
    df = df.withColumn("_last", F.last("_setter", ignorenulls=True).over(before("_seg")))
    sure_h2 = F.when(C("_c7"), "H2").otherwise("TXT")
    below_h2 = F.when(C("_came"), "H3").otherwise("H2")
    out = (
        F.when(C("_n") == 0, C("tag"))
        .when(C("_top"), "H1")
        .when(C("_dead"), "TXT")
        .when(C("_n") == 2, "H2")
        .when(C("_phase") == "A", sure_h2)
        .when((C("_phase") == "Z") & ~n3, "H3")
        .when(C("_phase").isin("Z", "B") & n3, below_h2)
        .when(C("_phase") == "B", F.when(n4, "H3").otherwise(sure_h2))
        .when(n3, "H3")
        .when(n4 & (C("_last") == 3), "H3")
        .otherwise(sure_h2)
    )
    df = df.withColumn("_out", out)
    changed = C("_out") != C("tag")
    df = df.withColumn(
        "confidence", F.when(changed, F.least("confidence", F.lit(80.0))).otherwise(C("confidence"))
    )
    return _amend(df, changed, C("_out"), "heading-hierarchy").drop(
        "_now", "_sure", "_l", "_came", "_c7", "_s", "_n", "_h1", "_top", "_dead", "_seg", "_turn",
        "_p1", "_leave", "_phase", "_setter", "_last", "_out",
    )


def guard_reference_zone(df: DataFrame) -> DataFrame:
    """Last word inside a reference zone: REFH2, REF-U or REF-N at >= 0.99."""
    t = strip_blank(C("text"))
    given_head = C("ref_heading") if "ref_heading" in df.columns else F.lit(False)
    head = C("in_ref") & (t.rlike("(?i)^<ref-h2>") | given_head)
    wanted = F.when(pt.starts_with_ref_bullet(t), "REF-U").otherwise("REF-N")
    entry = (
        C("in_ref")
        & ~head
        & ~C("tag").isin("SR", "SRH1")
        & ~C("tag").startswith("APX-REF")
        & pt.is_reference_entry(t)
        & (C("tag") != wanted)
    )
    df = df.withColumns({"_head": head, "_entry": entry, "_wanted": wanted})
    df = df.withColumn(
        "confidence",
        F.when(C("_head") | C("_entry"), F.greatest("confidence", F.lit(0.99))).otherwise(
            C("confidence")
        ),
    )
    df = _amend(df, C("_head"), F.lit("REFH2"), "ref-zone-heading")
    return _amend(df, C("_entry"), C("_wanted"), "ref-zone-final").drop(
        "_head", "_entry", "_wanted"
    )


def repair(
    df: DataFrame,
    vocabulary: Vocabulary,
    zone_styles: dict[str, list[str]] | None = None,
    keep_lists: bool = False,
    keep_marker_pmi: bool = False,
    exact_anchors: bool = True,
    lowered: str = "row",
) -> DataFrame:
    """Row ladder and all passes, in order."""
    df = repair_rows(df, vocabulary, zone_styles, keep_lists, keep_marker_pmi)
    df = preserve_reference_section(df, vocabulary)
    df = check_anchors(df, vocabulary, exact_anchors)
    df = flush_after_heading(df, vocabulary)
    df = fix_heading_hierarchy(df, vocabulary, lowered)
    return guard_reference_zone(df)


def check_zones(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Predictions against the wildcard zone table.

    Remap by the alias ladder, else a safe tag of the zone (confidence <= 70),
    else flag the row with suggestions (confidence <= 60).
    """
    df = st.map_tag_alias(df, "tag", vocabulary, out="_alias")
    t = strip_blank(C("text"))
    refused = (C("zone") != "BODY") & ~st.zone_accepts_wildcard("tag", "zone")
    remap = refused & (C("_alias") != "") & st.zone_accepts_wildcard("_alias", "zone")
    bullet = t.rlike(fixed.REF_BULLET_PATTERN)
    safe = (
        F.when(
            C("zone") == "TABLE",
            F.when(F.lower(t).rlike("^(note|source)"), "TFN")
            .when(bullet, "TBL-MID")
            .when(t.rlike(fixed.REPLY_NUMBER_PATTERN), "TNL-MID")
            .otherwise("T"),
        )
        .when(C("zone") == "BACK_MATTER", F.when(bullet, "REF-U").otherwise("REF-N"))
        .when(C("zone") == "METADATA", "PMI")
        .otherwise("TXT")
    )
    df = df.withColumns({"_refused": refused, "_remap": remap, "_safe": safe})
    fall = C("_refused") & ~C("_remap") & st.zone_accepts_wildcard("_safe", "zone")
    df = df.withColumn("_fall", fall)
    bad = C("_refused") & ~C("_remap") & ~C("_fall")
    hints = F.lit(None).cast("string")
    for zone, entries in fixed.ZONE_WILDCARDS.items():
        hints = F.when(C("zone") == zone, ", ".join(entries[:5])).otherwise(hints)
    return df.withColumns(
        {
            "zone_violation": bad,
            "zone_suggestions": F.when(bad, F.split(hints, ", ")),
            "confidence": F.when(C("_fall"), F.least("confidence", F.lit(70.0)))
            .when(bad, F.least("confidence", F.lit(60.0)))
            .otherwise(C("confidence")),
            "tag": F.when(C("_remap"), C("_alias")).when(C("_fall"), C("_safe")).otherwise(C("tag")),
        }
    ).drop("_alias", "_refused", "_remap", "_safe", "_fall")
