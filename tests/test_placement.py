"""Partitions go by the work in them, not by their packed bytes."""

from checks import load_all
from checks import overlay as ov
from folioscope.functions.styles import Vocabulary
from folioscope.operators import retrieval
from folioscope.plans import structure
from folioscope.sources import documents as src
from tests.conftest import paragraphs

SCHEMA = "doc_id long, text string"


def long_documents(spark):
    """13 MB of text that packs to nearly nothing."""
    return spark.createDataFrame([(i, "\n".join(f"line {i} {k} of a text" for k in range(1000))) for i in range(600)], SCHEMA)


def test_documents_are_divided_by_their_text(spark, monkeypatch):
    docs = long_documents(spark)
    monkeypatch.setattr(src, "PART_BYTES", 1 << 20)
    assert src.parts_for(docs) > 10
    assert ov.given_of(docs).rdd.getNumPartitions() == src.parts_for(docs)
    assert src.parts_for(docs.limit(0)) == 2
    assert src.parts_for(spark.createDataFrame([(1, None)], SCHEMA)) == 2


def test_distinct_tags_are_dealt_out(spark, monkeypatch, tmp_path):
    long_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(src, "PART_BYTES", 1 << 20)
    assert load_all()[0]["normalize_tag"](spark, str(tmp_path)).rdd.getNumPartitions() > 10


def test_postings_are_placed_by_their_number(spark, monkeypatch):
    rows = [(i, 1, " ".join(f"w{i * k % 89}" for k in range(20)), "TXT", 1.0) for i in range(200)]
    monkeypatch.setattr(retrieval, "POSTINGS", 200)
    index = retrieval.ExampleIndex(spark.createDataFrame(rows, "doc_id long, para_id long, text string, gold_tag string, alignment_score double"))
    assert index.postings.rdd.getNumPartitions() >= 10


def test_every_attempt_is_placed_by_its_rows(spark, monkeypatch):
    found = []

    def recorded(tagged, *args, **options):
        found.append(tagged.rdd.getNumPartitions())
        return structured(tagged, *args, **options)

    structured, place = structure.structure_corpus, structure.placed
    monkeypatch.setattr(structure, "structure_corpus", recorded)
    monkeypatch.setattr(structure, "placed", lambda rows, key, count: place(rows, key, count, 10))
    rows = paragraphs(spark, [{"doc_id": d} for d in range(20) for _ in range(5)]).select("doc_id", "para_id", "text")
    tagger = lambda p: p.selectExpr("doc_id", "para_id", "'XYZ' AS tag", "0.1D AS confidence")
    structure.retry_cascade(rows, [tagger, tagger], Vocabulary(["TXT", "H1"])).count()
    assert found[0] == 10 and len(found) == 2
