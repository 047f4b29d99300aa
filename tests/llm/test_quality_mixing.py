import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.llm import mixing, quality

from .conftest import odd_rows


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), len(covered), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(set(w)),
    )


def test_counts_equal_brute_force(odd, spark):
    extra = [(900, "a b c x a b c a b c\n#l\n \n#l\na b", "en", "s", 0, "", 0, "", 0, ""), (901, "é é é é", "en", "s", 0, "", 0, "", 0, "")]
    docs = odd.unionByName(spark.createDataFrame(extra, odd.schema))
    rows = quality.text_features(docs).collect()
    want = Counter((d, *counts(t)) for d, t, *_ in odd_rows() + extra)
    got = Counter((r.doc_id, r.n_words, r.n_repeat_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_distinct_words) for r in rows)
    assert got == want


def test_judgement(odd, nothing):
    for r in quality.judge_quality(odd).collect():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept) and 0 <= r["quality"] <= 1
    assert quality.judge_quality(nothing).count() == 0


def test_votes_find_a_fault_that_few_documents_have(spark):
    names = ["a", "b", "c", "d"]
    good = [(1, 1, 1, 1)] * 900 + [(1, -1, 1, 1)] * 50
    bad = [(0, 1, 1, 1)] * 60 + [(1, 1, 0, 0)] * 40
    votes = spark.createDataFrame(good + bad, ", ".join(f"{n} tinyint" for n in names))
    share, model = quality.fit_votes(votes, names)
    scored = votes.distinct().withColumn("p", quality.posterior(share, model)).collect()
    for r in scored:
        assert (r.p >= 0.5) == (0 not in tuple(r)[:4])
    assert 0.8 < share < 0.98


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, "d": 0}, {"a": 1, None: 50, "Z": 7, "é": 300}, {"only": 8}, {"x": 0, "y": 0}, {"a": 1000, "b": 10, "c": 10, "d": 1000}])
def test_targets_fill_like_water(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = water(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-12, abs=1e-9)


def test_mix(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows()) and rows == mixing.mix(odd).collect()
    for r in rows:
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken == r["size"] * r.copies and int(rate) <= r.copies <= int(rate) + (rate % 1 > 0) <= 2
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_draw_has_the_asked_probability(spark):
    rows = spark.range(20_000).select(mixing.draw(F.col("id").cast("string"), 7).alias("u"))
    low, mean, high = rows.agg(F.min("u"), F.avg((F.col("u") < 0.3).cast("int")), F.max("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.3) < 0.02


def test_no_python_in_the_native_operators(odd):
    for df in (mixing.mix(odd), quality.text_features(odd), mixing.mixed_documents(odd)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
