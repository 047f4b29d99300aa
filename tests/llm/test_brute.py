"""Operators and pipeline stages against plain Python, row by row."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from folioscope.llm import quality, toxicity, urls
from folioscope.llm.tokens import default_tokenizer

from .test_quality_mixing import water
from .test_resemblance import five


def test_mined_url_rules_equal_all_token_sets(spark):
    rng = random.Random(3)
    word = lambda *w: rng.choice(w)
    rows = []
    for i in range(400):
        site, kind = word("casino", "shop", "news", "blog"), word("win", "read", "buy")
        bad = int(rng.random() < (0.9 if (site, kind) == ("casino", "win") else 0.7 if kind == "buy" and site != "news" else 0.1))
        rows.append((f"http://{site}.{word('com', 'org')}/{kind}/{word('a', 'b')}/{i}", bad))
    known = spark.createDataFrame(rows, "url string, bad int")
    own = {r.url: frozenset(r.t) for r in known.select("url", urls.url_tokens(known.url).alias("t")).collect()}
    baskets = [(own[u], bad) for u, bad in rows]
    n, bads = len(baskets), sum(bad for _, bad in baskets)
    least = max(urls.MIN_SUPPORT, urls.MIN_PAGES / n)
    strong = {}
    tokens = sorted(set().union(*own.values()))
    for size in range(1, max(map(len, own.values())) + 1):
        for part in itertools.combinations(tokens, size):
            held = [bad for t, bad in baskets if t.issuperset(part)]
            hits = sum(held)
            if hits and hits / n >= least:
                confidence = hits / len(held)
                if confidence >= urls.MIN_CONFIDENCE and confidence / (bads / n) >= urls.MIN_LIFT:
                    strong[frozenset(part)] = (confidence, hits / n)
    want = {t: v for t, v in strong.items() if not any(o < t and w[0] >= v[0] for o, w in strong.items())}
    got = {frozenset(r.tokens): (r.confidence, r.support) for r in urls.mine_rules(known).collect()}
    assert got.keys() == want.keys() and len(want) > 2
    for t, v in want.items():
        assert got[t] == pytest.approx(v)
    matched = {r.url: r.confidence for r in urls.match_rules(known, urls.mine_rules(known)).collect()}
    for u, t in own.items():
        best = max((v[0] for r, v in want.items() if r <= t), default=None)
        assert matched.get(u) == (pytest.approx(best) if best else None)


def plain_em(votes, names, rounds=30, prior=0.8, strength=10.0):
    """The same model fitted over single documents and not over counts of patterns."""
    share, model = prior, {r: dict(quality.START) for r in names}
    for _ in range(rounds):
        good = []
        for v in votes:
            a, b = share, 1 - share
            for r, x in zip(names, v):
                a, b = a * model[r][x][0], b * model[r][x][1]
            good.append(a / (a + b))
        was, total, sure = share, len(votes), sum(good)
        share = (sure + strength * prior) / (total + strength)
        for k, r in enumerate(names):
            raw = {}
            for x, (p, q) in quality.START.items():
                of_good = sum(g for g, v in zip(good, votes) if v[k] == x)
                of_all = sum(v[k] == x for v in votes)
                raw[x] = ((of_good + strength * p) / (sure + strength), (of_all - of_good + strength * q) / (total - sure + strength))
            model[r] = quality._bounded(raw)
        if abs(was - share) < 1e-9:
            break
    return share, model


def test_quality_posteriors_equal_plain_expectation_maximisation(spark, odd):
    rows = quality.judge_quality(odd).collect()
    names = [c for c in rows[0].asDict() if c.startswith("vote_")]
    votes = [tuple(r[n] for n in names) for r in rows]
    share, model = plain_em(votes, names)
    for r, v in zip(rows, votes):
        logit = math.log(share / (1 - share)) + sum(math.log(model[n][x][0] / model[n][x][1]) for n, x in zip(names, v))
        p = 1 / (1 + math.exp(-logit))
        assert r["quality"] == pytest.approx(p, rel=1e-6, abs=1e-9)
        assert r.kept == (not r.base_failed and p >= 0.5)


def spaced(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def id_order(row):
    return (row["doc_id"] is None, row["doc_id"] or 0)


def plain_toxicity(rows, model):
    features, weights, limit = model
    column = {f: i for i, f in enumerate(features)}
    out = []
    for row in rows:
        at = sorted({column[f] for w in (row["text"] or "").lower().split() for f in toxicity.word_features(w) if f in column})
        before = []
        for w in map(np.array, weights):
            z = w[at].sum() + sum(p * w[len(features) + c] for c, p in enumerate(before)) + w[-1]
            before.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        if before[-1] < limit:
            out.append(row)
    return out


def plain_near(rows):
    sets = [five(r["text"]) for r in rows]
    part = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            old, new = part[i], part[j]
            part = [new if p == old else p for p in part]
    groups = defaultdict(list)
    for p, r in zip(part, rows):
        groups[p].append(r)
    return groups.values()


def copies(rows):
    size = Counter()
    for r in rows:
        size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    target = water({s: size[s] for s in {r["source"] for r in rows}})
    out = Counter()
    for r in rows:
        rate = target[r["source"]] / size[r["source"]] if size[r["source"]] else 0.0
        name = str(r["doc_id"]) if r["doc_id"] is not None else "text:" + hashlib.sha256((r["text"] or "").encode()).hexdigest()
        drawn = int(hashlib.md5(f"7:{name}".encode()).hexdigest()[:13], 16) / 2**52
        out[r["doc_id"], r["text"]] += math.floor(rate) + (drawn < rate - math.floor(rate))
    return +out


def test_every_pipeline_stage_on_the_odd_table(spark, odd, tmp_path):
    folder = str(tmp_path)
    odd.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 2)) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    now, rows = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows[name, "in"] = [r.asDict() for r in now.collect()]
        stage(spark, now, folder).write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
        rows[name, "out"] = [r.asDict() for r in now.collect()]
    bag = lambda rs: Counter((r["doc_id"], r["text"]) for r in rs)

    model = toxicity.fit_chain(odd, toxicity.labelled(labels), toxicity.CHAIN)
    assert bag(rows["toxicity", "out"]) == bag(plain_toxicity(rows["toxicity", "in"], model))

    groups = defaultdict(list)
    for r in rows["exact_dedup", "in"]:
        groups[spaced(r["text"])].append(r)
    kept = {spaced(r["text"]): r for r in rows["exact_dedup", "out"]}
    assert len(kept) == len(rows["exact_dedup", "out"]) == len(groups)
    assert all(id_order(kept[t]) == min(map(id_order, g)) for t, g in groups.items())

    found = bag(rows["near_dedup", "out"])
    parts = list(plain_near(rows["near_dedup", "in"]))
    assert sum(found.values()) == len(parts)
    for part in parts:
        stays = [r for r in part if found[r["doc_id"], r["text"]]]
        assert len(stays) == 1 and id_order(stays[0]) == min(map(id_order, part))

    assert bag(rows["mix_sources", "out"]) == copies(rows["mix_sources", "in"])

    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(default_tokenizer()).encode
    want, places = Counter(), defaultdict(list)
    for r in rows["best_fit_packing", "in"]:
        ids = np.array([*encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[r["doc_id"], piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    got = rows["best_fit_packing", "out"]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= 2048


def test_rows_between_chunks_and_owners_grow_with_the_corpus():
    from folioscope.llm import lm

    def rows(tokens):
        chunk, owner = lm.sizes(tokens)
        return (tokens / chunk) * (tokens / owner)

    for tokens in (10**11, 10**13):
        assert rows(2 * tokens) / rows(tokens) == pytest.approx(2, rel=0.01)


def test_files_are_ordered_by_their_number(spark):
    from folioscope.llm import records

    names = [f"part-{n:05d}-ab12.txt" for n in (99_999, 100_000, 7, 100_001)]
    rows = spark.createDataFrame([(n,) for n in names], "file string").orderBy(records.file_number("file")).collect()
    assert [r.file for r in rows] == [names[2], names[0], names[1], names[3]]


def test_bins_are_tried_once_on_each_level(spark):
    """The sequences of a tree of groups are few more than one best fit over all."""
    from folioscope.llm import packing

    rng = random.Random(12)
    lengths = [rng.choice([2048, 1500, 900, 700, 300, 60]) for _ in range(4000)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "row long, length long").repartition(4)
    got = packing.pack_items(items, group=100).collect()
    assert Counter(r["length"] for r in got) == Counter(lengths)
    assert len({r.sequence_id for r in got}) <= 1.02 * max(packing.best_fit(sorted(lengths, reverse=True), 2048)[2], sum(lengths) / 2048)


def test_entries_are_found_through_the_directory(spark, odd):
    """Without the right buckets no document finds its entry."""
    from folioscope.llm import exact

    directory, entries = exact.build_index(odd, bucket_bytes=4000)
    assert directory.count() > 4
    by_slot = {r.slot: r.bucket for r in directory.collect()}
    depth = len(by_slot).bit_length() - 1
    for r in entries.collect():
        assert by_slot[(r.key % (1 << 64)) >> (64 - depth)] == r.bucket
    wrong = directory.withColumn("bucket", directory.bucket + 1)
    keyed = odd.select("doc_id", exact._key(exact.normalised(odd.text), 64).alias("key"))
    led = exact.in_buckets(keyed, wrong).join(entries, ["bucket", "key"], "left_semi").count()
    assert exact.in_buckets(keyed, directory).join(entries, ["bucket", "key"], "left_semi").count() == odd.count() > led
