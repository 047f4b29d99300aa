"""Invalid predictions healed in set steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import styles as st
from folioscope.functions.styles import Vocabulary, normalize_style
from folioscope.operators.ordered import document
from folioscope.operators.retrieval import ExampleIndex, knn_tags

KEYS = ["doc_id", "para_id"]


def self_heal(
    first: DataFrame,
    corrections: DataFrame,
    vocabulary: Vocabulary,
    index: ExampleIndex | None = None,
    text: str = "text",
) -> DataFrame:
    """First replies -> tags that are all in the vocabulary.

    A document with an unknown tag takes its correction set where one exists;
    what is still unknown takes the tag of a close gold example or the nearest
    style (confidence <= 60); anything left becomes TXT (confidence <= 50).
    ``first`` has zone, text, in_ref, tag, confidence on 0-100.
    """
    v = vocabulary
    mapped = st.map_tag_alias(first, "tag", v, out="_m1", text=text)
    mapped = mapped.withColumn("_bad", ~v.has("_m1"))
    mapped = mapped.withColumn("_retry", F.max("_bad").over(document()))
    again = corrections.select(
        *KEYS, F.col("tag").alias("_tag2"), F.col("confidence").alias("_conf2")
    )
    joined = mapped.join(again, KEYS, "left")
    use = F.col("_retry") & F.col("_tag2").isNotNull()
    chosen = joined.withColumns(
        {
            "_raw": F.when(use, F.col("_tag2")).otherwise(F.col("tag")),
            "_conf": F.when(use, F.col("_conf2")).otherwise(F.col("confidence")),
            "corrected": use,
        }
    )
    second = st.map_tag_alias(chosen, "_raw", v, out="mapped_tag", text=text)
    if index is not None:
        asked = second.select(*KEYS, "zone", F.col(text).alias("text"), "mapped_tag", "_conf", "corrected")
        healed = knn_tags(index, asked, v)
    else:
        healed = second.withColumn(
            "final_tag", st.enforce_membership(normalize_style(F.col("mapped_tag")), v)
        )
    bad = ~v.has("mapped_tag")
    settled = healed.withColumns(
        {
            "_tag": F.when(bad, F.col("final_tag")).otherwise(F.col("mapped_tag")),
            "_conf": F.when(bad, F.least("_conf", F.lit(60.0))).otherwise(F.col("_conf")),
        }
    )
    lost = ~v.has("_tag")
    return settled.select(
        *KEYS,
        F.when(lost, "TXT").otherwise(F.col("_tag")).alias("tag"),
        F.when(lost, F.least("_conf", F.lit(50.0))).otherwise(F.col("_conf")).alias("confidence"),
        "corrected",
        bad.alias("healed"),
    )
