"""Predictions against gold: rows, summaries, confusions, gates, offline checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import fixed
from folioscope.functions import styles as st
from folioscope.functions.styles import Vocabulary, normalize_style
from folioscope.functions.text import quoted, strip_blank
from folioscope.operators.ordered import document
from folioscope.operators.rules import words

KEYS = ["doc_id", "para_id"]


def _evaluation_zone_ok(tag: str) -> Column:
    cases = " ".join(
        f"WHEN {quoted(z)} THEN `{tag}` IN ({', '.join(quoted(t) for t in tags)})"
        for z, tags in fixed.EVALUATION_ZONE_TAGS.items()
    )
    return F.expr(f"CASE `_zone` {cases} ELSE TRUE END")


def evaluate_rows(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold rows with the prediction at the same index and its outcome.

    outcome: unmapped, gap, match or mismatch; zone_violation is independent.
    """
    tags = predicted.select(*KEYS, normalize_style(F.col("tag")).alias("predicted_tag"))
    joined = gold.join(tags, KEYS, "left").withColumn("_zone", F.upper(F.coalesce("zone", F.lit("body"))))
    unmapped, absent = F.col("gold_tag") == "UNMAPPED", F.col("predicted_tag").isNull()
    return joined.withColumns(
        {
            "outcome": F.when(unmapped, "unmapped")
            .when(absent, "gap")
            .when(F.col("gold_tag") == F.col("predicted_tag"), "match")
            .otherwise("mismatch"),
            "zone_violation": ~unmapped & ~absent & ~_evaluation_zone_ok("predicted_tag"),
        }
    ).drop("_zone")


def _measures() -> list[Column]:
    outcome = F.col("outcome")
    total = F.count_if(outcome != "unmapped")
    matches = F.count_if(outcome == "match")
    return [
        total.alias("total"),
        matches.alias("matches"),
        F.count_if(outcome == "gap").alias("coverage_gaps"),
        F.count_if("zone_violation").alias("zone_violations"),
        F.count_if(outcome == "unmapped").alias("unmapped"),
        F.round(F.coalesce(100.0 * matches / F.nullif(total, F.lit(0)), F.lit(0.0)), 6).alias("accuracy"),
    ]


def evaluate_summary(rows: DataFrame) -> DataFrame:
    """Per document, per split and overall in one pass (rollup)."""
    return rows.rollup("split", "doc_id").agg(*_measures())


def top_pairs(rows: DataFrame, kind: str, limit: int = 20) -> DataFrame:
    """Most frequent confusions, gaps or zone violations.

    Counts shrink to tag pairs before anything is ranked.
    """
    if kind == "confusion":
        chosen, pair = rows.where(F.col("outcome") == "mismatch"), ["gold_tag", "predicted_tag"]
    elif kind == "gap":
        chosen, pair = rows.where(F.col("outcome") == "gap"), ["gold_tag", "predicted_tag"]
    else:
        chosen, pair = rows.where("zone_violation"), ["zone", "predicted_tag"]
    counts = chosen.groupBy(*pair).agg(F.count("*").alias("n")).toDF("expected", "actual", "n")
    return counts.orderBy(F.desc("n"), "expected", "actual").limit(limit).withColumn("kind", F.lit(kind))


def sequence_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per document: equal or not, first difference, rows around it, text gaps.

    Full outer join on (document, index); the context is a window over the
    joined rows, not a second join.
    """
    both = expected.select(*KEYS, F.col("tag").alias("expected")).join(
        actual.select(*KEYS, F.col("tag").alias("actual")), KEYS, "full"
    )
    differs = ~F.col("expected").eqNullSafe(F.col("actual"))
    first = both.withColumn(
        "_first", F.min(F.when(differs, F.col("para_id"))).over(document())
    )
    near = F.abs(F.col("para_id") - F.col("_first")) <= 2
    shown = F.struct(
        "para_id",
        F.concat_ws("/", F.coalesce("expected", F.lit("-")), F.coalesce("actual", F.lit("-"))).alias("pair"),
    )
    around = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(near, shown))), lambda s: s["pair"]), " "
    )
    return first.groupBy("doc_id").agg(
        F.count("expected").alias("n_expected"),
        F.count("actual").alias("n_actual"),
        F.min("_first").alias("first_mismatch"),
        F.min("_first").isNull().alias("is_equal"),
        around.alias("context"),
        F.count_if((F.col("actual") == "TXT") & ~F.col("expected").eqNullSafe("TXT")).alias("txt_gaps"),
    )


def content_integrity(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paragraph counts per document, body and table, before and after."""

    def counts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("doc_id").agg(
            F.count_if(~F.col("is_table")).alias(f"body_{name}"),
            F.count_if("is_table").alias(f"table_{name}"),
        )

    joined = counts(before, "before").join(counts(after, "after"), "doc_id", "full").na.fill(0)
    return joined.withColumn(
        "intact",
        (F.col("body_before") == F.col("body_after")) & (F.col("table_before") == F.col("table_after")),
    )


def invalid_tags(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Distinct tags outside the vocabulary with their counts."""
    return (
        rows.where((F.col("tag") != "") & ~vocabulary.has("tag"))
        .groupBy("tag").agg(F.count("*").alias("n"))
    )


def dataset_gates(
    gold: DataFrame, align_at: float = 0.85, min_aligned: float = 0.80, max_unmapped: float = 0.10
) -> DataFrame:
    """Shares of aligned and unmapped rows and whether the dataset passes."""
    shares = gold.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.avg((F.col("alignment_score") >= align_at).cast("int")), F.lit(0.0)).alias("_a"),
        F.coalesce(F.avg((F.col("gold_tag") == "UNMAPPED").cast("int")), F.lit(1.0)).alias("_u"),
    )
    return shares.select(
        "rows",
        F.round("_a", 6).alias("aligned_ratio"),
        F.round("_u", 6).alias("unmapped_ratio"),
        ((F.col("_a") >= min_aligned) & (F.col("_u") <= max_unmapped)).alias("passed"),
    )


def gold_overview(gold: DataFrame) -> DataFrame:
    """Rows, mapped, unmapped and documents of a gold table."""
    mapped = F.col("gold_tag") != "UNMAPPED"
    return gold.agg(
        F.count("*").alias("total_entries"),
        F.count_if(mapped).alias("mapped_entries"),
        F.count_if(~mapped).alias("unmapped_entries"),
        F.count_distinct("doc_id").alias("documents"),
    )


# --- offline checks ----------------------------------------------------------------
# Tags are counted first; the tag functions then run once per distinct tag.


def _tag_counts(gold: DataFrame) -> DataFrame:
    return (
        gold.where((F.col("gold_tag") != "UNMAPPED") & (F.col("gold_tag") != ""))
        .groupBy("gold_tag").agg(F.count("*").alias("n"))
        .withColumn("_norm", normalize_style(F.col("gold_tag")))
    )


def _sum_if(flag: Column) -> Column:
    return F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0))


def normalization_coverage(gold: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """How many gold tags are allowed as given, normalised, and enforced."""
    tags = _tag_counts(gold).withColumn(
        "_enforced", st.enforce_membership(F.col("_norm"), vocabulary)
    )
    return tags.agg(
        F.sum("n").alias("total"),
        _sum_if(vocabulary.has("gold_tag")).alias("direct"),
        _sum_if(vocabulary.has("_norm")).alias("normalized"),
        _sum_if(vocabulary.has("_enforced")).alias("enforced"),
    )


def remap_recovery(gold: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Unknown tags that a remap saves from becoming plain text."""
    tags = _tag_counts(gold).where(~vocabulary.has("_norm")).withColumn(
        "_kept", st.semantic_match(F.col("_norm"), vocabulary).isNotNull()
    )
    txt = "TXT" in vocabulary
    return tags.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("not_in_allowed"),
        (F.coalesce(F.sum("n"), F.lit(0)) if txt else F.lit(0)).alias("before_txt"),
        _sum_if(~F.col("_kept") & F.lit(txt)).alias("after_txt"),
        _sum_if(F.col("_kept")).alias("semantic_recoveries"),
    )


def is_reference_tag(tag: Column) -> Column:
    return (
        F.upper(tag).rlike("^REF[-_]")
        | F.upper(tag).isin("EOC-REF", "EOC_REF", "EOC-REFH", "EOC_REFH", "SR", "SRH1")
        | F.lower(tag).rlike("reference|bibliography")
    )


def detection_scores(gold: DataFrame, detected: DataFrame) -> DataFrame:
    """Document-level precision, recall and F1 of reference detection.

    ``detected`` has (doc_id, in_ref) per paragraph.
    """
    have = gold.groupBy("doc_id").agg(F.max(is_reference_tag(F.col("gold_tag"))).alias("has"))
    found = detected.groupBy("doc_id").agg(F.max("in_ref").alias("found"))
    both = have.join(found, "doc_id")
    tp = F.count_if(F.col("has") & F.col("found"))
    fp = F.count_if(~F.col("has") & F.col("found"))
    fn = F.count_if(F.col("has") & ~F.col("found"))
    return binary_scores(both.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")))


def binary_scores(counts: DataFrame) -> DataFrame:
    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp = F.col("tp")
    scored = counts.withColumns(
        {"_p": ratio(tp, tp + F.col("fp")), "_r": ratio(tp, tp + F.col("fn"))}
    )
    return scored.select(
        F.col("tp").alias("correct"),
        F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"),
        F.round("_p", 6).alias("precision"),
        F.round("_r", 6).alias("recall"),
        F.round(ratio(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), 6).alias("f1"),
    )


def heading_mapping(gold: DataFrame) -> DataFrame:
    """Table headings in gold, and whether both raw spellings map to them."""
    tags = _tag_counts(gold).where(F.col("gold_tag").rlike("^TH[0-9]+$"))
    level = F.col("gold_tag").substr(F.lit(3), F.length("gold_tag"))
    known = F.col("gold_tag").rlike("^TH[1-6]$")

    def maps(prefix: str) -> Column:
        return known & (normalize_style(F.concat(F.lit(prefix), level)) == F.col("gold_tag"))

    return tags.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("th_entries"),
        _sum_if(maps("SK_H")).alias("sk_h_entries"),
        _sum_if(maps("TBL-H")).alias("tbl_h_entries"),
        (_sum_if(maps("SK_H")) + _sum_if(maps("TBL-H"))).alias("correct_mappings"),
    )


def rule_potential(gold: DataFrame, zone: str = "zone") -> DataFrame:
    """Share of gold rows a deterministic feature could decide."""
    t = strip_blank(F.col("text"))
    w = words(t)
    titled = F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}")))
    heading = (
        (t != "")
        & (F.length(t) < 100)
        & t.rlike(r"^\p{Lu}")
        & ~t.endswith(".")
        & (F.size(w) <= 10)
        & (titled >= F.greatest(F.lit(1), F.floor(F.size(w) * 0.7).cast("int")))
    )
    dated = F.col("text").rlike(fixed.YEAR_PATTERN) | F.col("text").rlike("(?i)doi|et al")
    rows = gold.where((F.col("gold_tag") != "UNMAPPED") & (F.col("gold_tag") != ""))
    numbering = F.count_if(F.col("text").rlike(fixed.FEATURE_NUMBERED_PATTERN))
    bullet = F.count_if(F.col("text").rlike(fixed.REF_BULLET_PATTERN))
    table = F.count_if(F.col(zone) == "TABLE")
    box = F.count_if(F.col(zone).startswith("BOX"))
    return rows.agg(
        F.count("*").alias("total"),
        numbering.alias("has_numbering"),
        bullet.alias("has_bullet"),
        F.count_if(heading).alias("heading_pattern"),
        F.count_if(dated & F.col("gold_tag").startswith("REF-")).alias("reference_pattern"),
        table.alias("table_zone"),
        box.alias("box_zone"),
        F.round(
            F.least(100.0 * (numbering + bullet + table + box) / F.count("*"), F.lit(100.0)), 6
        ).alias("potential_coverage"),
    )
