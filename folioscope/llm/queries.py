"""The queries of this subpackage and the SQL that they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import exact, html, lm, mixing, packing, phrases, quality, records, search, simhash, toxicity, urls, vectors
from folioscope.llm.common import table


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return urls.judge_urls(pages, urls.labelled_urls(pages, labels)).select("page_id", "host", "path", "rule", "verdict")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op3_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = toxicity.labelled(table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), labels, toxicity.CHAIN)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.stored_documents(table(spark, sf_dir, "documents"))


def op11_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked_vectors(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_rules, op2_exact_dedup, op3_quality_vote, op4_interpolated_lm, op5_main_text, op6_toxicity_chain,
        op7_source_mix, op8_best_fit_packing, op9_simhash_ring, op10_binary_records, op11_phrase_collocation, op12_embedding_dedup, op13_lexical_search,
    )
}

ORACLES = {
    "op2_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)
    """,
    "op7_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   coalesce(CAST(doc_id AS VARCHAR), 'text:' || sha256(coalesce(text, ''))) AS identity
            FROM documents
        ), sized AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
        ), weighed AS (
            SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
                   source_size * CAST(2 AS DOUBLE) AS cap
            FROM sized
        ), levels AS (
            SELECT *, cap / weight AS full_at,
                   (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (
                        ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (
                        ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighed
        ), targets AS (
            SELECT source, source_size,
                   least(cap, coalesce(weight * max(CASE WHEN level <= full_at THEN level END) OVER (), cap)) AS target
            FROM levels
        ), rated AS (
            SELECT d.doc_id, d.size, d.identity, t.source_size, t.target,
                   CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                   CAST('0x' || substr(md5('7:' || d.identity), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS drawn
            FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               size * CAST(floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
        FROM rated
    """,
    "op11_phrase_collocation": r"""
        WITH texts AS (
            SELECT coalesce(lang, 'und') AS lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), pieces AS (
            SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws
            FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)
        ), grams AS (
            SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS g
            FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k)
        ), counts AS (
            SELECT lang, k, g, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY lang, k, g
        ), totals AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
        ), often AS (
            SELECT *, string_split(g, ' ') AS ws FROM counts WHERE f >= 30
        ), cut AS (
            SELECT c.lang, c.g, c.f AS a, c.k AS words, j.k AS k, l.f AS l, r.f AS r,
                   CAST(CAST(2000000 AS HUGEINT) * c.f // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
            FROM often c JOIN (SELECT unnest([1, 2, 3]) AS k) j ON j.k < c.k
            JOIN often l ON l.lang = c.lang AND l.g = array_to_string(c.ws[1:j.k], ' ')
            JOIN often r ON r.lang = c.lang AND r.g = array_to_string(c.ws[j.k + 1:], ' ')
        ), best AS (
            SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
        ), inside AS (
            SELECT lang, f, array_to_string(ws[i:i + m - 1], ' ') AS g
            FROM often, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m)
            WHERE m < k AND i + m - 1 <= k
        ), covering AS (
            SELECT lang, g, max(f) AS f FROM inside GROUP BY lang, g
        ), kept AS (
            SELECT b.* FROM best b LEFT JOIN covering c ON c.lang = b.lang AND c.g = b.g
            WHERE c.f IS NULL OR CAST(100 AS HUGEINT) * c.f < CAST(80 AS HUGEINT) * b.a
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g COLLATE C) AS rank,
               g AS phrase, a, l, r, n, score
        FROM kept JOIN totals USING (lang)
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g COLLATE C) <= 2000
    """,
    "op12_embedding_dedup": r"""
        WITH RECURSIVE every AS (
            SELECT row_number() OVER () AS i, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), v AS (
            SELECT * FROM every
            WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), link AS (
            SELECT a.i AS a, b.i AS b FROM v a JOIN v b ON a.i <> b.i AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= CAST(0.95 AS DOUBLE)
        ), reach AS (
            SELECT i AS a, i AS b FROM every UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
        ), least AS (
            SELECT reach.a, min(every.vec_id) AS component_id FROM reach JOIN every ON every.i = reach.b GROUP BY reach.a
        ), degree AS (
            SELECT a, count(*) AS n_links FROM link GROUP BY a
        )
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM every JOIN least ON least.a = every.i LEFT JOIN degree ON degree.a = every.i
    """,
    "op13_lexical_search": r"""
        WITH words AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
            FROM documents
        ), size AS (
            SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(len(ts)) AS BIGINT) AS length FROM words WHERE len(ts) > 0
        ), tf AS (
            SELECT row, doc_id, len(ts) AS n, t, count(*) AS tf FROM (SELECT row, doc_id, ts, unnest(ts) AS t FROM words) GROUP BY ALL
        ), asked AS (
            SELECT item, item_id, t, count(*) AS times
            FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
            GROUP BY ALL
        ), weight AS (
            SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(total) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tf, size GROUP BY t
        ), scored AS (
            SELECT item, item_id, row, doc_id,
                   CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // length)))) AS BIGINT) AS score
            FROM asked JOIN tf USING (t) JOIN weight USING (t), size
            GROUP BY ALL
        )
        SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0
        WINDOW best AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)
        QUALIFY row_number() OVER best <= 10
    """,
}
