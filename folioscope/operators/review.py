"""Review rows, reply merging, chunking and prompt lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import fixed
from folioscope.functions.text import preview, strip_blank
from folioscope.operators.ordered import document, ordered


def marked_text(text: Column, tag: Column) -> Column:
    """`<TAG> text`, unless the text already starts with a marker."""
    return F.when(
        ~F.regexp_replace(text, r"^\s+", "").startswith("<"),
        F.concat(F.lit("<"), tag, F.lit("> "), text),
    ).otherwise(text)


def suspicious(df: DataFrame, limit: int = 50) -> DataFrame:
    """Lowest confidence first (TXT first among equals), top rows per document."""
    order = document().orderBy(
        F.coalesce("confidence", F.lit(1.0)),
        F.when(F.col("tag") == "TXT", 0).otherwise(1),
        "para_id",
    )
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def review_order(df: DataFrame, threshold: float = 85) -> DataFrame:
    """Queue and rank: automatic rows by position, review rows by confidence."""
    sure = F.col("confidence") >= threshold
    queued = df.withColumn("queue", F.when(sure, "auto").otherwise("review"))
    order = document("queue").orderBy(
        F.when(F.col("queue") == "review", F.col("confidence")), "para_id"
    )
    return queued.withColumn("rank", F.row_number().over(order))


def review_bundle(classified: DataFrame, quality: DataFrame) -> DataFrame:
    """Decision rows of the documents that need a reviewer.

    Both sides are keyed and partitioned by document.
    """
    held = quality.where(F.col("action") == "REVIEW").select(
        "doc_id", "score", "action", *(["retry_count"] if "retry_count" in quality.columns else [])
    )
    return classified.join(held, "doc_id").select(
        "doc_id",
        "para_id",
        preview(strip_blank(F.col("text")), 160).alias("text_preview"),
        "tag",
        "confidence",
        F.coalesce("repaired", F.lit(False)).alias("repaired"),
        "repair_reason",
        *[c for c in held.columns if c != "doc_id"],
    )


def neighbor_context(df: DataFrame, below: float = 75) -> DataFrame:
    """Uncertain rows with the tags of the rows around them."""
    around = df.withColumns(
        {"before_tag": F.lag("tag").over(ordered()), "after_tag": F.lead("tag").over(ordered())}
    )
    return around.where(F.col("confidence") < below)


def chunks(df: DataFrame, size: int = 75) -> DataFrame:
    """Chunk number, chunk count and the chunk's first and last row id."""
    at = df.withColumns(
        {
            "chunk": (F.floor((F.row_number().over(ordered()) - 1) / size) + 1),
            "chunk_count": F.ceil(F.count("*").over(document()) / size),
        }
    )
    return at.withColumns(
        {
            "first_id": F.min("para_id").over(document("chunk")),
            "last_id": F.max("para_id").over(document("chunk")),
        }
    )


# --- replies -----------------------------------------------------------------------

REPLY_SCHEMA = "array<struct<id:bigint,tag:string,confidence:double>>"
REPLY_OBJECT = (
    r'\{\s*"id"\s*:\s*(\d+)\s*,\s*"tag"\s*:\s*"([^"]+)"\s*,\s*"confidence"\s*:\s*(\d+)'
)


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Reply text -> (id, tag, confidence) rows.

    Four readings in order: the whole text, the bracketed part, the text cut
    after its last complete object, and object by object.
    """
    r = F.col(reply)
    bare = strip_blank(F.regexp_replace(r, r"```(?:json)?\s*", ""))
    tail = F.when(F.instr(bare, "[") > 0, F.regexp_extract(bare, r"(\[[\s\S]*)", 1))
    cut = F.concat(F.regexp_extract(tail, r"^([\s\S]*\})", 1), F.lit("]"))
    embedded = F.regexp_extract(r, r"(\[[\s\S]*\])", 1)

    def group(i: int) -> Column:
        return F.regexp_extract_all(r, F.lit(REPLY_OBJECT), F.lit(i))

    single = F.transform(
        F.arrays_zip(group(1).alias("i"), group(2).alias("t"), group(3).alias("c")),
        lambda z: F.struct(
            z["i"].cast("bigint").alias("id"),
            z["t"].alias("tag"),
            z["c"].cast("double").alias("confidence"),
        ),
    )

    def whole(text: Column) -> Column:
        strict = F.from_json(text, REPLY_SCHEMA, {"mode": "PERMISSIVE"})
        complete = strip_blank(text).rlike(r"^\[[\s\S]*\]$")
        clean = ~F.exists(strict, lambda x: x.isNull() | x["id"].isNull())
        return F.when(complete & clean, strict)

    parsed = F.coalesce(whole(r), whole(embedded), whole(cut), single)
    others = [c for c in replies.columns if c != reply]
    return replies.select(*others, F.explode(parsed).alias("_p")).select(*others, "_p.*")


def attach_tags(paragraphs: DataFrame, classified: DataFrame) -> DataFrame:
    """Paragraphs with their tag; rows without one become TXT at confidence 0."""
    return paragraphs.join(
        classified.select("doc_id", "para_id", "tag", "confidence"), ["doc_id", "para_id"], "left"
    ).withColumns(
        {
            "tag": F.coalesce("tag", F.lit("TXT")),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
        }
    )


def fill_missing(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Found rows plus TXT at confidence 0 for every expected row not returned."""
    keys = ["doc_id", "para_id"]
    absent = expected.select(*keys).join(found.select(*keys), keys, "left_anti")
    return found.withColumn("missing", F.lit(False)).unionByName(
        absent.withColumns(
            {"tag": F.lit("TXT"), "confidence": F.lit(0.0), "missing": F.lit(True)}
        )
    )


def merge_results(*sources: tuple[str, DataFrame]) -> DataFrame:
    """One row per paragraph; the earlier source wins.

    Sources are (name, rows) in priority order; one aggregate replaces a
    chain of outer joins.
    """
    stacked = None
    for rank, (name, rows) in enumerate(sources):
        part = rows.select(
            "doc_id", "para_id", "tag", "confidence",
            F.lit(name).alias("source"), F.lit(rank).alias("_rank"),
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    best = F.min_by(F.struct("tag", "confidence", "source"), "_rank")
    return stacked.groupBy("doc_id", "para_id").agg(best.alias("_b")).select(
        "doc_id", "para_id", "_b.*"
    )


def merge_reevaluation(
    first: DataFrame, second: DataFrame, below: float = 75
) -> DataFrame:
    """Take the second opinion on uncertain rows if surer or different."""
    again = second.select(
        "doc_id", "para_id", F.col("tag").alias("_t"), F.col("confidence").alias("_c")
    )
    joined = first.join(again, ["doc_id", "para_id"], "left")
    use = F.coalesce(
        (F.col("confidence") < below)
        & ((F.col("_c") > F.col("confidence")) | (F.col("_t") != F.col("tag"))),
        F.lit(False),
    )
    return joined.select(
        *[c for c in first.columns if c not in ("tag", "confidence")],
        F.when(use, F.col("_t")).otherwise(F.col("tag")).alias("tag"),
        F.when(use, F.col("_c")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(use, F.col("tag")).alias("original_tag"),
        F.when(use, F.col("confidence")).alias("original_confidence"),
        use.alias("fallback_used"),
    )


# --- prompt rows ----------------------------------------------------------------------


def prompt_line() -> Column:
    """`[id] [hints] text` with a visible cue for automatic list items."""
    t = F.col("text")
    cued = (
        F.when(
            F.col("has_bullet") & ~t.rlike(r"^\s*[\x{2022}\-*\x{25CF}\x{25CB}\x{25AA}]"),
            F.concat(F.lit("• "), t),
        )
        .when(
            F.col("has_numbering")
            & ~F.col("has_bullet")
            & ~t.rlike(r"^\s*[\p{L}\p{N}_]+\."),
            F.concat(F.lit("1. "), t),
        )
        .otherwise(t)
    )
    hints = F.array_compact(
        F.array(
            F.when(F.col("zone") != "BODY", F.col("zone")),
            F.when(F.col("box_type").isNotNull(), F.concat(F.lit("box:"), F.col("box_type"))),
            F.when(F.col("has_xml_list"), F.lit("LIST_ITEM")),
            F.when(
                F.col("list_kind").isNotNull(),
                F.concat(F.lit("LIST:"), F.concat_ws(",", "list_kind", "list_position")),
            ),
            F.when(
                F.col("caption_type").isNotNull(),
                F.concat(F.lit("CAPTION:"), F.col("caption_type")),
            ),
            F.when(F.col("source_line"), F.lit("SOURCE_LINE")),
            F.when(
                F.col("box_marker").isNotNull(),
                F.concat(F.lit("BOX_MARKER:"), F.col("box_marker")),
            ),
        )
    )
    hint = F.when(
        F.size(hints) > 0, F.concat(F.lit(" ["), F.array_join(hints, " | "), F.lit("]"))
    ).otherwise("")
    return F.concat(F.lit("["), F.col("para_id").cast("string"), F.lit("]"), hint, F.lit(" "), cued)


def zone_note(zone: Column, count: Column) -> Column:
    """`zone (n items): valid styles` as shown above a batch."""
    listed = F.lit("Full range")
    for name, entries in fixed.ZONE_WILDCARDS.items():
        listed = F.when(zone == name, ", ".join(entries)).otherwise(listed)
    return F.concat(F.lit("- "), zone, F.lit(" ("), count.cast("string"), F.lit(" items): "), listed)


def prompt_batches(df: DataFrame, size: int = 75) -> DataFrame:
    """One row per chunk: header, zone notes with counts, and the lines.

    A chunk holds at most ``size`` rows, so the collected arrays are bounded.
    """
    parts = chunks(df, size).withColumn("_line", prompt_line())
    zones = F.transform(
        F.array_sort(F.array_distinct(F.collect_list("zone"))),
        lambda z: z,
    )
    gathered = parts.groupBy("doc_id", "chunk", "chunk_count", "first_id", "last_id").agg(
        F.count("*").alias("n_rows"),
        zones.alias("_zones"),
        F.collect_list("zone").alias("_all"),
        F.array_sort(F.collect_list(F.struct("para_id", "_line"))).alias("_lines"),
    )
    notes = F.array_join(
        F.transform(
            "_zones",
            lambda z: zone_note(z, F.size(F.filter("_all", lambda x: x == z))),
        ),
        "\n",
    )
    head = F.concat(
        F.lit("Chunk "), F.col("chunk").cast("string"), F.lit(" of "),
        F.col("chunk_count").cast("string"), F.lit(" (paragraphs "),
        F.col("first_id").cast("string"), F.lit(" to "), F.col("last_id").cast("string"), F.lit(")"),
    )
    body = F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n")
    return gathered.select(
        "doc_id", "chunk", "chunk_count", "first_id", "last_id", "n_rows",
        F.concat_ws("\n\n", head, notes, body).alias("prompt"),
    )
