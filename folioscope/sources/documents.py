"""Paragraph sources: plain text, mark-up pages, table grids, file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.patterns import has_bullet, has_numbering
from folioscope.functions.text import collapse_blank, strip_blank


def paragraphs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, para_id, n, text): ordered, stripped, non-empty paragraphs from 1.

    Numbering happens inside the document row, so the source needs no shuffle
    and no window; an existing partitioning on ``key`` is kept.
    """
    lines = F.filter(
        F.transform(F.split(F.col(text), "\n"), strip_blank), lambda line: line != ""
    )
    return (
        documents.select(key, lines.alias("_lines"))
        .select(key, F.size("_lines").alias("n"), F.posexplode("_lines").alias("_at", "text"))
        .select(key, (F.col("_at") + 1).alias("para_id"), "n", "text")
    )


def by_document(documents: DataFrame, key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Place whole documents before they are exploded.

    One exchange of document rows (not of exploded paragraphs) then serves
    every window, aggregate and join on ``key`` downstream.  A table bucketed
    on ``key`` needs not even this.
    """
    return documents.repartition(parts, key) if parts else documents.repartition(key)


#: Bytes of text in a partition of whole documents, and rows in one of paragraphs.
PART_BYTES = 4 << 20
PART_ROWS = 25_000
#: Small corpora are still divided among the cores, down to this many bytes.
LEAST_BYTES = 1 << 20


def parts_for(documents: DataFrame, text: str = "text") -> int | None:
    """Partitions that hold a bounded amount of text each; None for a stream.

    Adaptive execution joins partitions by their compressed bytes, which say
    little about the work: text packs well and is then split, matched and
    multiplied.  A number that is given is kept.
    """
    if documents.isStreaming:
        return None
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    cores = documents.sparkSession.sparkContext.defaultParallelism
    return max(2, -(-size // PART_BYTES), min(cores, -(-size // LEAST_BYTES)))


def placed(rows: DataFrame, key: str, count: int, per: int = PART_ROWS) -> DataFrame:
    """``rows``, ``count`` of them, placed by ``key`` in partitions of a bounded number of rows."""
    return rows.repartition(max(1, -(-count // per)), key)


BLOCK_TAGS = "h[1-6]|p|li|td|th"


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, para_id, tag, text, flags) for heading/paragraph/list/cell blocks."""
    clean = F.regexp_replace(
        F.col(html), r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", ""
    )
    opened = F.regexp_replace(clean, rf"(?i)<({BLOCK_TAGS})(?:\s[^>]*)?>", "\x01$1\x02")
    closed = F.regexp_replace(opened, rf"(?i)</(?:{BLOCK_TAGS})>", "\x01")
    pieces = F.filter(F.split(closed, "\x01"), lambda p: p.contains("\x02"))

    def block(piece: Column) -> Column:
        body = F.substring_index(piece, "\x02", -1)
        plain = F.regexp_replace(body, "<[^>]*>", " ")
        for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"),
                             ("&quot;", '"'), ("&amp;", "&")):
            plain = F.replace(plain, F.lit(entity), F.lit(char))
        return F.struct(
            F.lower(F.substring_index(piece, "\x02", 1)).alias("tag"),
            collapse_blank(plain).alias("text"),
            body.rlike("(?i)<(b|strong)>").alias("is_bold"),
            body.rlike(r"(?i)<a\s").alias("has_link"),
        )

    blocks = F.filter(F.transform(pieces, block), lambda b: b["text"] != "")
    tag = F.col("b.tag")
    return pages.select(key, F.posexplode(blocks).alias("_at", "b")).select(
        key,
        (F.col("_at") + 1).alias("para_id"),
        tag.alias("tag"),
        F.col("b.text").alias("text"),
        F.col("b.is_bold").alias("is_bold"),
        F.col("b.has_link").alias("has_link"),
        tag.rlike("^h[1-6]$").alias("is_heading"),
        tag.isin("td", "th").alias("is_table"),
        has_bullet(F.col("b.text")).alias("has_bullet"),
        has_numbering(F.col("b.text")).alias("has_numbering"),
        (tag == "li").alias("has_xml_list"),
    )


def table_cells(tables: DataFrame, keys: list[str], rows: str = "rows") -> DataFrame:
    """Explode `rows` (array of rows of cells of paragraphs) into cell rows.

    The grid arrives with its table row, so coordinates, last row and size
    come from the array itself.
    """
    sized = tables.select(
        *keys,
        F.size(rows).alias("n_rows"),
        F.coalesce(F.size(F.get(F.col(rows), 0)), F.lit(0)).alias("n_cols"),
        F.posexplode(rows).alias("row_idx", "_cells"),
    )
    cells = sized.select(
        *keys, "n_rows", "n_cols", "row_idx",
        F.posexplode("_cells").alias("col_idx", "_paras"),
    )
    return (
        cells.select(
            *keys, "n_rows", "n_cols", "row_idx", "col_idx",
            F.posexplode("_paras").alias("para_in_cell", "text"),
        )
        .withColumn("text", strip_blank(F.col("text")))
        .where(F.col("text") != "")
        .withColumns(
            {
                "is_header_row": F.col("row_idx") == 0,
                "is_stub_col": F.col("col_idx") == 0,
                "is_last_row": F.col("row_idx") == F.col("n_rows") - 1,
                "table_size": F.concat_ws("x", "n_rows", "n_cols"),
            }
        )
    )


def document_files(files: DataFrame, name: str = "name", extension: str = "docx") -> DataFrame:
    """Rows whose file name carries the extension, any case."""
    return files.where(
        F.lower(F.regexp_extract(F.col(name), r"\.([^.]+)$", 1)) == extension.lower()
    )


def read_document_files(spark, folder: str, extension: str = "txt") -> DataFrame:
    """Whole text files under a folder, recursively: (path, text)."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*.{extension}")
        .option("wholetext", "true")
        .text(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def write_bucketed(documents: DataFrame, name: str, buckets: int, key: str = "doc_id") -> None:
    """Store documents bucketed on the key; structuring them needs no exchange."""
    documents.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
