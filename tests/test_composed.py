"""Composed plans against plain versions of them, where no SQL checks them."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from checks import overlay as ov
from checks import sqlbits as sb
from folioscope import fixed
from folioscope.operators import heal, quality, retrieval, review
from folioscope.plans.structure import structure_corpus, tag_with
from tests.conftest import paragraphs

SF = "/root/testdata/sf0.001"
KEY = ["doc_id", "para_id"]


def test_prompt_batches_equal_a_plain_rendering(spark):
    zones = ["BODY", "TABLE", "BODY", "BACK_MATTER", "TABLE", "BODY", "BODY"]
    rows = [{"doc_id": d, "para_id": i + 1, "text": f"text {d} {i}", "zone": z} for d in (1, 2) for i, z in enumerate(zones[: 7 - 3 * (d - 1)])]
    df = paragraphs(spark, rows).withColumn("has_numbering", F.lit(False))
    got = {(r.doc_id, r.chunk): (r.chunk_count, r.first_id, r.last_id, r.n_rows, r.prompt) for r in review.prompt_batches(df, 3).collect()}
    expected = {}
    for d in (1, 2):
        own = [r for r in rows if r["doc_id"] == d]
        parts = [own[i : i + 3] for i in range(0, len(own), 3)]
        for c, part in enumerate(parts, 1):
            first, last = part[0]["para_id"], part[-1]["para_id"]
            count = Counter(r["zone"] for r in part)
            notes = [f"- {z} ({n} items): " + ", ".join(fixed.ZONE_WILDCARDS.get(z, ["Full range"])) for z, n in sorted(count.items())]
            lines = [f"[{r['para_id']}]" + ("" if r["zone"] == "BODY" else f" [{r['zone']}]") + f" {r['text']}" for r in part]
            head = f"Chunk {c} of {len(parts)} (paragraphs {first} to {last})"
            expected[d, c] = (len(parts), first, last, len(part), "\n\n".join([head, "\n".join(notes), "\n".join(lines)]))
    assert got == expected


def test_retry_cascade_stops_each_document_at_its_first_good_round(spark):
    from checks.q_compose import UP
    from checks.q_repair import V
    from checks.registry import QUERIES

    given = ov.given(spark, SF)
    better = given.withColumns({"tag": F.expr(UP), "confidence": F.greatest("confidence", F.lit(0.7))})
    tags, verdicts = [], []
    for rows in (given, better):
        whole = structure_corpus(tag_with(ov.overlay(spark, SF), lambda p, rows=rows: rows.select(*KEY, "tag", "confidence")), V, sb.ZONES).cache()
        tags.append({(r.doc_id, r.para_id): r.tag for r in whole.collect()})
        verdicts.append({r.doc_id: (r.score, r.action) for r in quality.score_documents(whole, V, "flag").collect()})
        whole.unpersist()
    expected = set()
    for doc, para in tags[0]:
        first = verdicts[0][doc][1] != "RETRY"
        score, action = verdicts[0 if first else 1][doc]
        attempts = 1 if first else 2 if action != "RETRY" else 3
        expected.add((doc, para, tags[0 if first else 1][doc, para], score, action, attempts))
    got = {(r.doc_id, r.para_id, r.tag, r.score, r.action, r.attempts) for r in QUERIES["retry_cascade"](spark, SF).collect()}
    assert got == expected and len({a for *_, a in got}) > 1


def test_self_heal_takes_the_tag_of_a_close_gold_example(spark):
    from folioscope.functions.styles import Vocabulary

    v = Vocabulary(["TXT", "TXT-FLUSH", "H1", "H2", "BL-MID", "REF-N"])
    gold = [(9, 1, "alpha beta gamma delta", "H1", 1.0, "BODY"), (9, 2, "one two three four", "BL-MID", 1.0, "BODY"), (9, 3, "alpha beta gamma delta", "REF-N", 1.0, "TABLE"), (8, 1, "zeta eta theta", "Unheard", 1.0, "BODY")]
    index = retrieval.ExampleIndex(spark.createDataFrame(gold, "doc_id long, para_id long, text string, gold_tag string, alignment_score double, zone string"), carry=("zone",))
    rows = [("alpha beta gamma delta", "QQQQQQQQ", "BODY", 90.0), ("alpha beta gamma delta", "QQQQQQQQ", "TABLE", 40.0), ("one two three five", "QQQQQQQQ", "BODY", 90.0),
            ("zeta eta theta", "QQQQQQQQ", "BODY", 90.0), ("nothing known", "QQQQQQQQ", "BODY", 55.0), ("plain", "H1", "BODY", 80.0)]
    first = spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], "doc_id long, para_id long, text string, tag string, zone string, confidence double").withColumn("in_ref", F.lit(False))
    none = first.select(*KEY, "tag", "confidence").limit(0)
    got = {r.para_id: (r.tag, r.confidence, r.healed) for r in heal.self_heal(first, none, v, index).collect()}

    words = lambda t: re.findall(r"\w+", t.lower())
    df = Counter(w for _, _, t, *_ in gold for w in set(words(t)))

    def vector(text):
        tf = Counter(w for w in words(text))
        return {w: c / len(words(text)) * len(gold) / df[w] for w, c in tf.items() if w in df}

    def cosine(a, b):
        length = lambda x: math.sqrt(sum(y * y for y in x.values()))
        return sum(a[w] * b.get(w, 0) for w in a) / (length(a) * length(b)) if a and b else 0.0

    expected = {}
    for i, (text, tag, zone, sure) in enumerate(rows, 1):
        if tag in v:
            expected[i] = (tag, sure, False)
            continue
        best = max(((cosine(vector(text), vector(t)), d, p, g) for d, p, t, g, _, z in gold if z == zone), default=(0, 0, 0, ""))
        found = best[3] if best[0] > 0.7 and best[3] in v else "TXT"
        expected[i] = (found, min(sure, 60.0), True)
    assert got == expected
