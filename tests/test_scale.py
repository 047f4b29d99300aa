"""Operators whose work must not grow with the square of a group."""

import difflib
import json
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.functions.styles import Vocabulary
from folioscope.operators import gold as gd
from folioscope.operators import repair, retrieval, rules
from tests.conftest import paragraphs

VOCAB = Vocabulary(["TXT", "TXT-FLUSH", "TSN", "T1", "T2", "REF-U", "REF-N", "FIG-LEG", "TBL-MID", "UL-MID"])


def plain_anchors(tags, refs):
    """The rule in order, one row after the other."""
    is_anchor = lambda t: t.startswith("FIG-") or t in repair.ANCHORS
    now = list(tags)
    for i, tag in enumerate(tags):
        if not (is_anchor(tag) or tag in repair.TABLE_LIST_TAGS):
            continue
        around = now[max(0, i - 10) : i] + tags[i + 1 : i + 11]
        if not any(is_anchor(t) for t in around):
            now[i] = "REF-U" if refs[i] else "TSN"
    return now


def test_anchors_follow_the_rule_in_order(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for doc in range(60):
        n = rng.choice([5, 40, 64, 65, 200, 500])
        rare = rng.random() * 0.15
        draw = lambda: rng.choice(["T1", "FIG-LEG", "TSN"]) if rng.random() < rare else rng.choice(["TBL-MID", "TBL-FIRST", "TXT", "TXT"])
        tags, refs = [draw() for _ in range(n)], [rng.random() < 0.4 for _ in range(n)]
        expected |= {(doc, i + 1): t for i, t in enumerate(plain_anchors(tags, refs))}
        rows += [{"doc_id": doc, "para_id": i + 1, "tag": t, "in_ref": r, "zone": "BACK_MATTER"} for i, (t, r) in enumerate(zip(tags, refs))]
    df = paragraphs(spark, rows).withColumn("repaired", F.lit(False)).withColumn("repair_reason", F.lit("")).withColumn("_why", F.lit(""))
    df = df.withColumn("input_tag", F.col("tag"))
    got = {(r.doc_id, r.para_id): r.tag for r in repair.check_anchors(df, VOCAB).collect()}
    assert {k for k in expected if expected[k] != got[k]} == set()


def test_anchors_of_one_very_long_document(spark):
    n = 100_000
    df = paragraphs(spark, []).drop("doc_id", "para_id", "tag", "zone", "in_ref")
    rows = spark.range(1, n + 1).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("para_id"),
        F.when(F.col("id") % 997 == 0, "T1").when(F.col("id") % 3 == 0, "TXT").otherwise("TBL-MID").alias("tag"),
        F.lit("BACK_MATTER").alias("zone"), (F.col("id") % 5 == 0).alias("in_ref"), F.lit("").alias("_why"), F.lit("").alias("input_tag"), F.lit(False).alias("repaired"), F.lit("").alias("repair_reason"),
    )
    start = time.time()
    got = [r.tag for r in repair.check_anchors(rows.unionByName(df, allowMissingColumns=True), VOCAB).orderBy("para_id").select("tag").collect()]
    took = time.time() - start
    tags = ["T1" if i % 997 == 0 else "TXT" if i % 3 == 0 else "TBL-MID" for i in range(1, n + 1)]
    assert got == plain_anchors(tags, [i % 5 == 0 for i in range(1, n + 1)])
    assert took < 60


def test_retrieval_scores_few_of_the_pairs(spark):
    """Equal to all pairs, and most tokens are only looked up for candidates."""
    rng = random.Random(2)
    common, rare = [f"c{i}" for i in range(15)], [f"r{i}" for i in range(600)]
    text = lambda n: " ".join(rng.choice(rare) if rng.random() < 0.4 else rng.choice(common) for _ in range(n))
    made = [(i, 1, text(12), "TXT", 1.0) for i in range(1500)]
    index = retrieval.ExampleIndex(spark.createDataFrame(made, "doc_id long, para_id long, text string, gold_tag string, alignment_score double"))
    asked = spark.createDataFrame([(k, text(10)) for k in range(40)], "item_id long, text string")
    names = {"item_id": "_k0"}
    rows = retrieval._asked(asked, index, ["item_id"], [], "text", names)
    near, tokens = retrieval.candidates(index, index.impacts, rows, ["_k0"], ["token"], 5, 1.0, 0.0)
    every = index.impacts.join(rows, "token").select("_k0", "doc_id").distinct().count()
    first = tokens.where(~F.col("_late")).select("_k0", "token")
    scored = index.impacts.join(first, "token").select("_k0", "doc_id").distinct().count()
    assert near.count() < every / 20 and scored < every / 3
    got = sorted((r.item_id, r["rank"], r.example_doc, r.similarity) for r in retrieval.retrieve(index, asked, ["item_id"], k=5).collect())
    all_pairs = (
        index.impacts.join(rows.select("_k0", "token", "_a"), "token").groupBy("_k0", "doc_id")
        .agg(F.round(F.sum(F.col("_a") * F.col("share")), 9).alias("s")).collect()
    )
    best = {}
    for r in all_pairs:
        best.setdefault(r["_k0"], []).append((-r.s, -r.doc_id))
    expected = sorted((k, n, -d, round(-s, 4)) for k, v in best.items() for n, (s, d) in enumerate(sorted(v)[:5], 1))
    assert got == expected


def plain_pairs(manual, original):
    key = lambda name: "".join(c for c in name.lower() if c.isascii() and c.isalnum())

    def lcs(a, b):
        return difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b))

    free, out = sorted(original), {}
    for m in sorted(manual):
        best, taken = (0, -1.0), None
        for o in free:
            a, b = key(m), key(o)
            if a and b:
                n = lcs(a, b)
                if n >= max(best[0], 1):
                    score = (n, edit(a, b))
                    if score > best:
                        best, taken = score, o
        if taken:
            out[m] = taken
            free.remove(taken)
    return out


def test_fuzzy_pairs_equal_going_through_the_names(spark):
    rng = random.Random(10)
    stems = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    manual = [f"{s}-final manuscript" if rng.random() < 0.7 else f"{s}{k}" for k, s in enumerate(stems)] + ["", "--", "q"]
    original = [f"{rng.choice(stems)}_{k}_manuscript" if rng.random() < 0.7 else f"x{s}" for k, s in enumerate(stems[:50])] + ["zz", "!"]
    manual, original = sorted(set(manual)), sorted(set(original))
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.manual: r.original for r in gd.pair_fuzzy(frame(manual + manual[:5]), frame(original)).collect()}
    assert got == plain_pairs(manual, original)


def test_assignment_in_rounds_equals_going_in_order(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(f"m{rng.randrange(9)}", f"o{o}", rng.randint(1, 3), rng.choice([0.1, 0.5])) for o in range(6) for _ in range(4)]
    pairs = spark.createDataFrame(rows, "manual string, original string, lcs int, ratio double").dropDuplicates(["manual", "original"]).cache()
    take = lambda: {(r.manual, r.original) for r in gd._assigned(pairs).collect()}
    at_once = take()
    monkeypatch.setattr(gd, "IN_ORDER", 3)
    assert take() == at_once and len(at_once) > 3


def test_assignment_of_tied_names_needs_few_rounds(spark, monkeypatch):
    n, steps = 40, []
    rows = [(f"m{m:02d}", f"o{o:02d}", 4, 0.5) for m in range(n) for o in range(n)]
    pairs = spark.createDataFrame(rows, "manual string, original string, lcs int, ratio double").cache()
    monkeypatch.setattr(gd, "IN_ORDER", 400)
    step = gd.cut_lineage
    monkeypatch.setattr(gd, "cut_lineage", lambda df: steps.append(1) or step(df))
    got = {(r.manual, r.original) for r in gd._assigned(pairs).collect()}
    assert got == {(f"m{k:02d}", f"o{k:02d}") for k in range(n)} and len(steps) < n


def test_common_length_of_batches(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab1") for _ in range(rng.randint(1, 12)))
    rows = [(word(), word(), 0.5) for _ in range(300)]
    frame = spark.createDataFrame(rows, "_a string, _b string, ratio double").withColumns({"manual": F.col("_a"), "original": F.col("_b")})
    got = frame.mapInArrow(gd._with_common_length, "manual string, original string, lcs int, ratio double").collect()
    for r in got:
        match = difflib.SequenceMatcher(None, r.manual, r.original, autojunk=False).find_longest_match()
        assert r.lcs == match.size


def test_names_with_a_common_end_are_not_all_compared(spark):
    n = 3000
    rng = random.Random(1)
    own = ["".join(rng.choice("abcdefghijklmnop") for _ in range(14)) for _ in range(n)]
    left = spark.createDataFrame([(f"{s}-commonending", f"{s}commonending") for s in own], "name string, key string")
    right = spark.createDataFrame([(f"x{s}_commonending", f"x{s}commonending") for s in own], "name string, key string")
    pairs, bounds = gd._near_in_order(left, right, *gd.LOOKS[0])
    near = pairs.join(bounds, "manual").where("lcs > bound")
    assert pairs.count() < 50 * n and near.where("original = concat('x', replace(manual, '-', '_'))").count() == n


def test_containment_looks_under_the_rarest_piece(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    inner, outer = {word(rng.randint(1, 7)) for _ in range(150)} | {"zzzz", "abcabcx"}, {word(rng.randint(1, 30)) for _ in range(150)}
    frame = lambda names, c: spark.createDataFrame([(n,) for n in names], f"{c} string")
    got = {(r.inner, r.outer) for r in gd._containing(frame(inner, "inner"), frame(outer, "outer")).collect()}
    assert got == {(a, b) for a in inner for b in outer if a in b}


def test_many_rules_are_looked_up_by_condition(spark, monkeypatch):
    n = 100_000
    made = spark.range(n).select(
        F.concat(F.lit("zone="), F.col("id")).alias("condition"), F.concat(F.lit("T"), F.col("id") % 7).alias("predicted_tag"),
        (F.lit(0.8) + (F.col("id") % 10) / 100).alias("confidence"), F.col("id").cast("int").alias("rank"),
    ).unionByName(spark.createDataFrame([("is_short", "SHORT", 0.99, n + 5), ("zone=7", "LATE", 1.0, n + 9)], "condition string, predicted_tag string, confidence double, rank int"))
    rows = paragraphs(spark, [{"text": "x", "zone": "7"}, {"text": "y" * 60, "zone": "99999"}, {"text": "z" * 60, "zone": "none"}, {"text": "s", "zone": "none"}])
    featured = rules.with_features(rows, zone=F.col("zone"))
    expected = [(1, "T0", "zone=7", 87), (2, "T4", "zone=99999", 89), (3, None, None, None), (4, "SHORT", "is_short", 99)]
    take = lambda df: sorted((r.para_id, r.rule_tag, r.rule_condition, r.rule_confidence) for r in df.collect())
    assert take(rules.apply_rules(featured, made)) == expected
    monkeypatch.setattr(rules, "BROADCAST_ROWS", 10)
    assert take(rules.apply_rules(featured, made)) == expected


def test_ratio_equals_brute_force_on_ten_thousand_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abAB-é1") for _ in range(rng.randint(0, 14)))
    made = [(word(), word()) for _ in range(9_900)] + [(None, "a"), (None, None), ("", "")]
    made += [("".join(rng.choice("abcd ") for _ in range(60)), "".join(rng.choice("abcd ") for _ in range(70))) for _ in range(100)]
    got = spark.createDataFrame(made, "a string, b string").repartition(4).withColumn("s", tx.sequence_ratio(F.col("a"), F.col("b"))).collect()
    for r in got:
        assert abs(r.s - difflib.SequenceMatcher(None, r.a or "", r.b or "", autojunk=False).ratio()) < 1e-9, r


def test_admission_keeps_keyed_state_and_survives_a_replay(spark, tmp_path):
    from folioscope.streaming import jobs

    source = tmp_path / "in"
    source.mkdir()
    write = lambda name, rows: (source / name).write_text("\n".join(json.dumps({"doc_id": i, "text": t}) for i, t in rows))
    stream = spark.readStream.schema("doc_id long, text string").json(str(source))
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    before = spark.conf.get(jobs.STATE_STORE, None)
    write("a.json", [(1, "a"), (2, "b"), (3, "a")])
    jobs.admit_to_table(stream, target, checkpoint).awaitTermination()
    write("b.json", [(4, "b"), (5, "c")])
    jobs.admit_to_table(stream, target, checkpoint).awaitTermination()
    # The second batch as if it had not been committed: it runs again.
    for commit in (tmp_path / "c" / "commits").glob("*1*"):
        commit.rename(tmp_path / f"held-{commit.name}")
    jobs.admit_to_table(stream, target, checkpoint).awaitTermination()
    assert sorted((r.text, r.batch_id) for r in spark.read.parquet(target).collect()) == [("a", 0), ("b", 0), ("c", 1)]
    assert spark.conf.get(jobs.STATE_STORE, None) == before


def test_cache_keeps_valid_entries_only(spark, tmp_path):
    from folioscope.streaming import jobs

    source, folder = tmp_path / "in", str(tmp_path / "k")
    source.mkdir()
    schema = "cache_key string, tag string, cached_at timestamp"
    for n in range(4):
        rows = [{"cache_key": f"k{i}", "tag": f"t{n}", "cached_at": f"2024-01-{1 + 10 * (n // 2):02d}T00:00:0{n}Z"} for i in range(n, 40, n + 1)]
        (source / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    jobs.refresh_cache(stream, folder, str(tmp_path / "c"), ttl_days=5).awaitTermination()
    newest = jobs._newest(spark, folder, schema, jobs._versions(spark, folder))
    held = {r.cache_key: r.tag for r in newest.collect()}
    latest = {f"k{i}": max(n for n in range(4) if i >= n and (i - n) % (n + 1) == 0) for i in range(40)}
    valid = {k: f"t{n}" for k, n in latest.items() if n >= 2}
    assert {k: t for k, t in held.items() if t in ("t2", "t3")} == valid
    got = {r.cache_key: r.tag for r in jobs.read_cache(spark, folder, schema, "2024-01-12", 5).collect()}
    assert got == valid
    assert all(len(v) <= 2 for v in jobs._versions(spark, folder).values())


def test_open_days_complete_the_closed_ones(spark):
    import datetime as dt

    from folioscope.streaming import jobs

    day = lambda d: dt.datetime(2024, 1, d, 5)
    events = spark.createDataFrame(
        [(day(1), "completed", 1, 1), (day(2), "completed", 2, 1), (day(2), "failed", 9, 9), (day(3), "completed", 4, 2)],
        "ts timestamp, status string, input_tokens long, output_tokens long",
    )
    closed = spark.createDataFrame([(dt.date(2024, 1, 1), 1, 1, 1)], "day date, input_tokens long, output_tokens long, jobs_completed long")
    rest = sorted((str(r.day), r.input_tokens, r.jobs_completed) for r in jobs.open_days(events, closed).collect())
    assert rest == [("2024-01-02", 2, 1), ("2024-01-03", 4, 1)]
    assert jobs.open_days(events, closed.limit(0)).count() == 3


def test_greedy_alignment_equals_all_pairs_and_compares_few(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(300)]
    line = lambda n: " ".join(rng.choices(words, k=n))

    def edited(text):
        letters = list(text)
        for _ in range(rng.randint(0, max(1, len(text) // 6))):
            letters[rng.randrange(len(letters))] = rng.choice("xyz")
        return "".join(letters)

    a = [line(rng.choice([1, 2, 8, 16])) for _ in range(40)]
    a += rng.choices(a, k=20)
    b = [edited(t) for t in rng.choices(a, k=60)] + ["", line(300)]
    frames = [
        spark.createDataFrame([(7, i, t) for i, t in enumerate(side, 1)], "doc_id long, para_id long, text string") for side in (a, b)
    ]
    got = {r.para_id: (r.manual_para, r.score) for r in gd.align_once(*frames).collect()}

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            last, row = row, [i]
            for j, q in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != q)))
        return row[-1]

    used, want = set(), {}
    for i, x in enumerate(a, 1):
        near = []
        for j, y in enumerate(b, 1):
            longest = max(len(x), len(y))
            if y and j not in used and abs(len(x) - len(y)) <= 0.15 * longest:
                score = 1.0 - distance(x, y) / longest
                near += [(-score, j)] if score >= 0.85 else []
        want[i] = (min(near)[1], round(-min(near)[0], 4)) if near else (None, 0.0)
        used.add(want[i][0])
    assert got == want and len([m for m, _ in got.values() if m]) > 25

    texts = sorted({line(30) for _ in range(200)})
    rows = pa.table({"doc_id": [1] * 400, "hash": [t.encode() for t in texts] * 2, "text": texts * 2, "side": [0] * 200 + [1] * 200})
    assert gd._close_texts(0.85)(rows).num_rows < 300  # of 40,000 pairs
