import random

import numpy as np
import pyarrow as pa

from folioscope.llm import resemblance, simhash


def near_texts():
    """Families of copies with changed words, chains of them, and strangers."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for length, copies, changes in [(300, 12, 6), (120, 40, 2), (60, 3, 1), (30, 4, 1), (6, 2, 1), (2000, 3, 30)] * 3:
        base = [word() for _ in range(length)]
        texts.append(base)
        for _ in range(copies):
            base = list(base if rng.random() < 0.5 else texts[-1])
            for _ in range(changes):
                base[rng.randrange(len(base))] = word()
            texts.append(base)
    return [" ".join(t) for t in texts] + ["one two", "ONE  two", "", None, "three"]


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(texts):
    """The smallest place of each component, all pairs by 5-word Jaccard."""
    sets, root = [five(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in range(len(texts))}


def test_near_stage_links_every_pair_of_high_jaccard(spark):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.drop_near(docs).collect()}
    assert kept == brute(texts) and len(kept) < len(texts) - 100


def test_buckets_go_on_until_all_members_are_compared(spark, monkeypatch):
    """All texts in one bucket, few hubs, no small buckets, no splits: no pair may be lost."""
    texts = near_texts()[:30]
    monkeypatch.setattr(resemblance, "HUBS", 4)
    monkeypatch.setattr(resemblance, "FIRST_HUBS", 4)
    monkeypatch.setattr(resemblance, "SMALL", 0)
    monkeypatch.setattr(resemblance, "ROUNDS", 100)
    hashes = [resemblance.shingles((t or "").encode(), 5) for t in texts]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = {signed(resemblance._node(h)): (len(h), i) for i, h in enumerate(hashes)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(text) k").collect()}
    rows = [(x, n, [7], (False, i, keyed[i])) for x, (n, i) in nodes.items()]
    table = spark.createDataFrame(rows, "node long, n long, keys array<long>, least struct<unnamed: boolean, doc_id: long, text_key: long>")
    found = {r.node: r.root for r in resemblance.resembling(docs, table, 5).collect()}
    least = {}
    for x, (_, i) in nodes.items():
        r = found.get(x, x)
        least[r] = min(least.get(r, i), i)
    assert set(least.values()) == brute(texts)


def template_texts(families, members, rng):
    """Texts that share two thirds of their words in one run, Jaccard near 0.5: none are near."""
    word = lambda: f"w{rng.randrange(10**6)}"
    out = []
    for _ in range(families):
        shared = [word() for _ in range(160)]
        for _ in range(members):
            own = [word() for _ in range(80)]
            at = rng.randrange(len(own))
            out.append(" ".join(own[:at] + shared + own[at:]))
    return out


def test_template_texts_are_not_compared_in_all_pairs(spark, monkeypatch):
    counted = []
    plain = resemblance._alike
    monkeypatch.setattr(resemblance, "_alike", lambda pairs, sets: counted.append(pairs.count()) or plain(pairs, sets))
    rows = []
    for members in (150, 300):
        docs = spark.createDataFrame(list(enumerate(template_texts(1, members, random.Random(5)))), "doc_id long, text string")
        counted.clear()
        assert simhash.drop_near(docs).count() == members
        rows.append(sum(counted))
    assert rows[1] <= 3 * max(rows[0], 300) and rows[1] < 30 * 300


def test_recall_just_above_the_threshold(spark):
    """Pairs of Jaccard 0.8 to 0.85 in templates and apart; very long, null and empty texts among them."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts, near = [], 0
    template = [word() for _ in range(100)]
    for k in range(250):
        base = [word() for _ in range(rng.choice([60, 150, 400]))] + (template if k % 2 else [])
        changed = list(base)
        while True:  # change words until the similarity is about to fall below 0.8
            changed[rng.randrange(len(changed))] = word()
            a, b = five(" ".join(base)), five(" ".join(changed))
            if 5 * len(a & b) < 4 * len(a | b):
                break
            last = list(changed)
        texts += [" ".join(base), " ".join(last)]
        near += 1
    long = [word() for _ in range(30_000)]
    texts += [" ".join(long), " ".join(long[:-50] + ["end"] * 50), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.drop_near(docs).collect()}
    assert kept.issuperset(range(0, 2 * near, 2)) and 2 * near in kept and 2 * near + 1 not in kept
    assert len([i for i in range(1, 2 * near, 2) if i in kept]) <= 0.01 * near
    assert len(kept & {2 * near + 2, 2 * near + 3}) == 1


def test_near_stage_links_by_fingerprints_too(spark):
    """Equal fingerprints where repeats outweigh the rest, Jaccard under 0.8: op9's method links them."""
    lines = "one two three four five six seven eight nine ten eleven " * 200
    texts = [lines + "alpha beta gamma delta", lines + "kappa lambda sigma omega"]
    a, b = (simhash.fingerprint(t.encode(), simhash.NEAR_WIDTH) for t in texts)
    assert (a ^ b).bit_count() <= simhash.LIMIT and 5 * len(five(texts[0]) & five(texts[1])) < 4 * len(five(texts[0]) | five(texts[1]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "something else"])], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near(docs).collect()} == {0, 2}


def test_minima_make_no_python_number_of_each_hash():
    import tracemalloc

    rng = np.random.default_rng(3)
    made = [rng.integers(-(1 << 63), 1 << 63, 500, dtype=np.int64) for _ in range(2001)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2001), pa.int64()), pa.array(made, pa.list_(pa.int64()))], names=["node", "hashes"])
    tracemalloc.start()
    low = [x for part in resemblance._minima(iter([batch.slice(1)])) for x in part.column(1).slice(0, 20).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert low == [resemblance.minima(h.view(np.uint64)).view(np.int32).tolist() for h in made[1:21]]
    assert peak < 10 << 20
