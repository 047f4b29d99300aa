"""Retrieval by rare tokens: the index in buckets, and the nearest example above a floor."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.operators import retrieval

SCHEMA = "doc_id long, para_id long, text string, gold_tag string, alignment_score double, zone string"


def made_texts(rng, n):
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(250)]
    text = lambda k: " ".join(rng.choice(rare) if rng.random() < 0.4 else rng.choice(common) for _ in range(k))
    own = [text(rng.choice([2, 6, 12])) for _ in range(n)]
    return own + [" ".join(w if rng.random() < 0.8 else rng.choice(common) for w in rng.choice(own).split()) for _ in range(n)]


def vectors(texts, total, df):
    out = {}
    for k, t in texts.items():
        w = {x: c / len(t.split()) * total / df[x] for x, c in Counter(t.split()).items() if x in df}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out[k] = {x: v / norm for x, v in w.items()}
    return out


@pytest.mark.parametrize("frequent, bound", [(10**6, 10**6), (20, 10**6), (5, 3)])
def test_nearest_equals_all_pairs_and_few_meet(spark, monkeypatch, frequent, bound):
    """Also where the tokens, the questions and the examples in reach are too many to be broadcast."""
    rng = random.Random(8)
    texts = made_texts(rng, 150)
    gold = [(i, 1 + i % 3, t, f"T{i}", 1.0, rng.choice(["a", "B"])) for i, t in enumerate(rng.choices(texts, k=400))]
    asked = [(i, 7, t, rng.choice(["A", "b", None])) for i, t in enumerate(rng.choices(texts, k=120) + ["unheard of", "", "r1 r1 c2"])]
    monkeypatch.setattr(retrieval, "FREQUENT", frequent)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", bound)
    written = []
    write = retrieval.through_table
    monkeypatch.setattr(retrieval, "through_table", lambda df, name: written.append((name, write(df, name))) or written[-1][1])
    index = retrieval.ExampleIndex(spark.createDataFrame(gold, SCHEMA), carry=("zone",))
    queries = spark.createDataFrame(asked, "doc_id long, para_id long, text string, zone string")
    got = {r.doc_id: (r.example_doc, r.example_para, r.similarity) for r in retrieval.nearest(index, queries, ["doc_id", "para_id"], ("zone", "zone"), 0.7).collect()}
    df = Counter(w for _, _, t, *_ in gold for w in set(t.split()))
    left = vectors({i: t for i, _, t, _ in asked}, len(gold), df)
    right = vectors({i: t for i, _, t, *_ in gold}, len(gold), df)
    expected, pairs = {}, 0
    for i, _, _, zone in asked:
        found = [(round(sum(v * right[e[0]].get(x, 0) for x, v in left[i].items()), 9), e[0], e[1]) for e in gold if zone and e[5].upper() == zone.upper()]
        pairs += sum(s > 0 for s, *_ in found)
        if (best := max(found, default=(0, 0, 0))) and round(best[0], 4) > 0.7:
            expected[i] = (best[1], best[2], round(best[0], 4))
    assert got == expected and len(got) > 50
    assert dict(written)["near"].count() < pairs / 10


@pytest.mark.parametrize("rarest", [1, 2, 5])
def test_index_keeps_rows_placed_whatever_the_vocabulary(spark, monkeypatch, rarest):
    """All tokens broadcast; all but those of a single row; the frequent ones alone."""
    rng = random.Random(9)
    gold = [(i // 3, i % 3, t, "T", 1.0, "a") for i, t in enumerate(made_texts(rng, 40) + ["", "<b>", "only once"])]
    index = retrieval.ExampleIndex(spark.createDataFrame(gold, SCHEMA))
    df = Counter(w for _, _, t, *_ in gold for w in set(t.split()) if w != "<b>")
    monkeypatch.setattr(retrieval, "FREQUENT", sum(n >= rarest for n in df.values()))
    assert {r.token: (r.df, r.idf) for r in index.idf.collect()} == {w: (n, len(gold) / n) for w, n in df.items()}
    got = {(r.doc_id, r.para_id, r.token): (round(r.w, 9), round(r.norm, 9)) for r in index.postings.collect()}
    expected = {}
    for d, p, t, *_ in gold:
        w = {x: c / len(t.split()) * len(gold) / df[x] for x, c in Counter(t.split()).items() if x in df}
        expected |= {(d, p, x): (round(v, 9), round(math.sqrt(sum(y * y for y in w.values())), 9)) for x, v in w.items()}
    assert got == expected
    assert "Exchange hashpartitioning(doc_id" not in index.postings._jdf.queryExecution().executedPlan().toString()


def test_only_postings_of_asked_tokens_are_written(spark, monkeypatch):
    rng = random.Random(3)
    gold = [(i, 1, t, "T", 1.0, "a") for i, t in enumerate(made_texts(rng, 100))]
    written = []
    write = retrieval.through_table
    monkeypatch.setattr(retrieval, "through_table", lambda df, name: written.append((name, write(df, name))) or written[-1][1])
    index = retrieval.ExampleIndex(spark.createDataFrame(gold, SCHEMA))
    retrieval.retrieve(index, spark.createDataFrame([(1, "r5 r9 c1")], "q long, text string"), ["q"], k=3).collect()
    asked = index.counts.where(F.col("token").isin("r5", "r9", "c1")).count()
    assert dict(written)["postings"].count() == asked < index.counts.count() / 4


def test_a_retrieval_takes_the_texts_of_the_examples_for_the_index_and_the_labels_alone(spark):
    rng = random.Random(4)
    read = spark.sparkContext.accumulator(0)
    gold = [(i, 1, t, f"T{i % 9}", 1.0, "a") for i, t in enumerate(made_texts(rng, 30))]

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    examples = spark.createDataFrame(gold, SCHEMA).mapInArrow(counted, SCHEMA)
    index = retrieval.ExampleIndex(examples, carry=("zone",), parts=2)
    asked = spark.createDataFrame([(1, "r5 r9 c1", "a"), (2, "unheard", "A")], "q long, text string, zone string")
    rows = retrieval.retrieve(index, asked, ["q"], k=3, same=("zone", "zone"), book=("zone", "zone")).collect()
    assert len(rows) == 6 and read.value == 2 * len(gold)


def test_examples_that_repeat_are_joined_to_their_rows_if_asked(spark):
    from folioscope.functions.styles import Vocabulary

    rng = random.Random(5)
    texts = made_texts(rng, 20)
    gold = [(i // 2, 1, texts[i // 2], "H1", 1.0, "a") for i in range(24)] + [(50 + i, 1, t, "T", 1.0, "a") for i, t in enumerate(texts)]
    asked = [(i, 2, t, "QQQQQQQQ", "A") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(gold, SCHEMA)
    rows = spark.createDataFrame(asked, "doc_id long, para_id long, text string, mapped_tag string, zone string")
    take = lambda index: sorted(map(tuple, retrieval.knn_tags(index, rows, Vocabulary(["TXT", "H1", "T"])).select("doc_id", "similarity", "final_tag").collect()), key=repr)
    assert take(retrieval.ExampleIndex(frame, carry=("zone",), each_row=True)) == take(retrieval.ExampleIndex(frame))
    once = frame.dropDuplicates(["doc_id"])
    assert retrieval.ExampleIndex(once, carry=("zone",), each_row=True).joined_to_rows() is None
