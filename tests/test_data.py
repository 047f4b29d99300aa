import random

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import overlay as ov
from checks import sqlbits as sb
from checks.compare import check, duck
from folioscope.operators import gold, review
from folioscope.plans.structure import structure_corpus
from folioscope.sources.documents import paragraphs, write_bucketed

SF = "/root/testdata/sf0.001"
QUICK = [
    "paragraphs", "html_blocks", "table_cells", "gold_load", "vocab_build", "casefold_unique",
    "zone_segmentation", "box_type", "list_positions", "reference_zone", "ref_zone_density",
    "normalize_style", "normalize_tag", "sanitize_tag", "style_map", "rule_features", "citation_flags",
    "quality_score", "heading_hierarchy", "anchor_check", "repair_corpus", "learn_rules", "apply_rules",
    "retrieve_topk", "diverse_examples", "canonicalize_gold", "pair_documents", "doc_id_match",
    "align_anchors", "evaluate_summary", "sequence_diff", "cache_upsert", "merge_results", "batch_rollup",
    "daily_usage", "token_stats", "parse_replies", "stream_dedup", "stream_status",
]


@pytest.fixture(scope="module")
def engine():
    return duck(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, engine, name):
    from __spark_entry__ import oracle_sql, queries

    verdict, _ = check(spark, engine, SF, name, queries()[name], oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_every_query_has_a_name_and_most_have_sql():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) - len(oracle_sql()) <= 15


def test_one_exchange_for_the_whole_chain(spark):
    plan = structure_corpus(ov.given(spark, SF), sb.VOCAB, sb.ZONES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_bucketed_documents_need_no_exchange(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    write_bucketed(docs, "bucketed_documents", 4)
    try:
        rows = paragraphs(spark.table("bucketed_documents")).withColumns(
            {"tag": F.lit("TXT"), "confidence": F.lit(0.8)})
        plan = structure_corpus(rows, sb.VOCAB, sb.ZONES)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.sql("DROP TABLE bucketed_documents")


def edit_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return 1 - row[-1] / max(len(a), len(b))


def test_fuzzy_pairs_match_going_one_by_one(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "nine", "ten"]
    manual = sorted({"-".join(rng.sample(words, 2)) for _ in range(7)})
    original = sorted({"_".join(rng.sample(words, 2)) + "x" for _ in range(7)})
    free, want = [*original], {}
    for m in manual:
        key = m.replace("-", "")
        best, top = None, (-1, -1.0)
        for o in free:
            other = o.replace("_", "")
            common = max((n for n in range(len(key) + 1) for i in range(len(key) - n + 1) if key[i : i + n] in other), default=0)
            score = (common, edit_similarity(key, other))
            if score > top:
                best, top = o, score
        if best and top[0] > 0:
            want[m] = best
            free.remove(best)
    frames = [spark.createDataFrame([(n,) for n in names], "name string") for names in (manual, original)]
    got = {r.manual: r.original for r in gold.pair_fuzzy(*frames).collect()}
    assert got == want


def _documents(spark, *sides):
    return [
        spark.createDataFrame([(1, i, t) for i, t in enumerate(side, 1)], "doc_id long, para_id long, text string")
        for side in sides
    ]


def test_alignment_by_anchors_and_gaps(spark):
    frames = _documents(spark, ["A b c", "same line", "gone", "old words here"], ["A b c", "same line", "old words there"])
    got = {r.para_id: r.manual_para for r in gold.align_in_order(*frames).collect()}
    assert got[1] == 1 and got[2] == 2 and got[4] == 3
    once = {r.para_id: r.manual_para for r in gold.align_once(*frames).collect()}
    assert once == {1: 1, 2: 2, 3: None, 4: 3}


def test_anchors_keep_the_longest_chain(spark):
    frames = _documents(spark, "A B C D E".split(), "B C D E A".split())
    assert sorted((r.para_id, r.manual_para) for r in gold.anchors(*frames).collect()) == [(2, 1), (3, 2), (4, 3), (5, 4)]


def test_vocabulary_tables_are_never_cut(spark):
    from folioscope.functions.styles import Vocabulary

    rows = spark.range(60_000).selectExpr("'TXT' AS style").unionByName(spark.sql("SELECT 'MY-STYLE' AS style"))
    assert set(Vocabulary(rows).names) == {"TXT", "MY-STYLE"}
    for wrong in (rows.limit(0), spark.range(50_001).selectExpr("'S' || id AS style"), []):
        with pytest.raises(ValueError):
            Vocabulary(wrong)


def test_many_rules_all_count(spark):
    from folioscope.operators import rules

    table = spark.range(25_000).selectExpr(
        "CASE WHEN id = 24999 THEN 'zone=LAST' ELSE 'zone=Z' || id END AS condition", "'T' || id AS predicted_tag", "0.9D AS confidence", "id + 1 AS rank")
    flags = {f: F.lit(False) for f in rules.FLAG_NAMES}
    rows = spark.createDataFrame([(1, "LAST"), (2, "Z7"), (3, "none")], "doc_id long, zone string").withColumns(
        {**flags, "list_kind": F.lit(None).cast("string"), "list_position": F.lit("")})
    got = {r.doc_id: r.rule_tag for r in rules.apply_rules(rows, table).collect()}
    assert got == {1: "T24999", 2: "T7", 3: None}


def test_retrieval_answers_every_query_within_its_zone(spark):
    from folioscope.operators.retrieval import ExampleIndex, retrieve

    examples = spark.createDataFrame(
        [(1, 1, "red apple", "A", "x", 0.9), (1, 2, "green apple", "A", "y", 0.8), (2, 1, "blue sky", "B", "x", 1.0)],
        "doc_id long, para_id long, text string, zone string, gold_tag string, alignment_score double")
    asked = spark.createDataFrame([(1, "apple red", "a"), (2, "zzz", "A"), (3, "apple", "B")], "q long, text string, zone string")
    index = ExampleIndex(examples, carry=("zone",))
    got = retrieve(index, asked, ["q"], k=2, same=("zone", "zone")).collect()
    found = {q: [(r.example_doc, r.example_para) for r in sorted(got, key=lambda r: r["rank"]) if r.q == q] for q in (1, 2, 3)}
    assert found == {1: [(1, 1), (1, 2)], 2: [(1, 1), (1, 2)], 3: [(2, 1)]}


def _stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(1.1)  # files are taken in order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streams_over_several_files(spark, tmp_path):
    import datetime as dt

    from folioscope.streaming import jobs

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "job_id long, event_id long, ts timestamp, status string, input_tokens long, output_tokens long"
    batches = [
        [(1, 1, day(1), "completed", 10, 1), (2, 2, day(1, 3), "failed", 5, 1)],
        [(1, 3, day(4), "failed", 7, 1), (3, 4, day(4, 1), "completed", 7, 2)],
        [(4, 7, day(4, 2), "completed", 0, 0)],  # rows are late by the watermark of the batch before
        [(2, 5, day(1, 5), "completed", 100, 9), (3, 6, day(8), "completed", 1, 1)],
    ]
    source = _stream(spark, tmp_path, batches, schema)
    jobs.run_to_table(jobs.latest_status(source), str(tmp_path / "s"), str(tmp_path / "c1"), mode="complete").awaitTermination()
    newest = {r.job_id: (r.status, r.n_events) for r in jobs.newest_rows(spark, str(tmp_path / "s")).collect()}
    assert newest == {1: ("failed", 2), 2: ("completed", 2), 3: ("completed", 2), 4: ("completed", 1)}
    jobs.run_to_table(jobs.latest_status(source), str(tmp_path / "u"), str(tmp_path / "c2"), mode="update").awaitTermination()
    changed = {r.job_id: (r.status, r.n_events) for r in jobs.newest_rows(spark, str(tmp_path / "u"), ["job_id"]).collect()}
    assert changed == newest
    jobs.run_to_table(jobs.daily_usage(source), str(tmp_path / "d"), str(tmp_path / "c3")).awaitTermination()
    days = {str(r.day): (r.input_tokens, r.jobs_completed) for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    assert days == {"2024-01-01": (10, 1), "2024-01-04": (7, 2)}  # the late row of day 1 is dropped, day 8 is open


def test_admission_and_cache_over_several_files(spark, tmp_path):
    from folioscope.streaming import jobs

    batches = [[(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")], [(6, "a"), (7, "d"), (8, "c")]]
    source = _stream(spark, tmp_path, batches, "doc_id long, text string")
    jobs.admit_to_table(source, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    admitted = [r.text for r in spark.read.parquet(str(tmp_path / "t")).collect()]
    assert sorted(admitted) == ["a", "b", "c", "d"]
    entries = source.selectExpr("text AS cache_key", "'t' || doc_id AS tag", "timestamp_seconds(doc_id * 86400) AS cached_at")
    schema = "cache_key string, tag string, cached_at timestamp"
    jobs.refresh_cache(entries, str(tmp_path / "k"), str(tmp_path / "c4")).awaitTermination()
    got = {r.cache_key: r.tag for r in jobs.read_cache(spark, str(tmp_path / "k"), schema, "1970-01-10", 4).collect()}
    assert got == {"a": "t6", "c": "t8", "d": "t7"}
    jobs.compact_cache(spark, str(tmp_path / "k"), str(tmp_path / "k2"), schema, "1970-01-10", 4)
    again = {r.cache_key: r.tag for r in jobs.read_cache(spark, str(tmp_path / "k2"), schema, "1970-01-10", 4).collect()}
    assert again == got


def test_reply_repairs(spark):
    replies = [
        (1, '[{"id": 1, "tag": "H1", "confidence": 90}]'),
        (2, 'Sure: [{"id": 2, "tag": "TXT", "confidence": 80}] bye'),
        (3, '```json\n[{"id": 3, "tag": "T1", "confidence": 70}, {"id": 4, "ta'),
        (4, '{"id": 5, "tag": "T", "confidence": 60} and {"id": 6, "tag": "T2", "confidence": 50}'),
    ]
    got = review.parse_replies(spark.createDataFrame(replies, "doc_id long, reply string"))
    assert sorted((r.doc_id, r.id, r.tag) for r in got.collect()) == [
        (1, 1, "H1"), (2, 2, "TXT"), (3, 3, "T1"), (4, 5, "T"), (4, 6, "T2")]


@pytest.mark.parametrize("name", ["stream_dedup", "stream_structure", "stream_status"])
def test_streams_read_a_folder_of_part_files(spark, tmp_path, name):
    from __spark_entry__ import oracle_sql, queries

    for t in ("documents", "events"):
        rows = spark.read.parquet(f"{SF}/{t}.parquet").limit(60)
        rows.repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    verdict, _ = check(spark, con, str(tmp_path), name, queries()[name], oracle_sql()[name])
    assert verdict.startswith("ok"), verdict
