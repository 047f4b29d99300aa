import hashlib
import re

import numpy as np
import pytest

from folioscope.llm import components, exact, simhash

from .conftest import odd_rows


def groups():
    out = {}
    for d, t, *_ in odd_rows():
        out.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    return out


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups_even_with_colliding_keys(odd, bits):
    rows = exact.exact_groups(odd, bucket_bytes=4000, key_bits=bits).collect()
    assert len(rows) == len(odd_rows())
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups().items()}
    for r in rows:
        ids = by_sha[r.text_sha256]
        keep = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)


def test_index_splits_and_chains(odd):
    directory, entries = exact.build_index(odd, bucket_bytes=4000)
    slots = directory.collect()
    assert len(slots) == 2 ** max(r.local_depth for r in slots) > 1
    assert entries.count() == len(groups())
    _, chained = exact.build_index(odd, key_bits=3)
    assert chained.agg({"chain": "max"}).first()[0] > 0


def test_directory_doubles_only_where_overfull():
    rows = exact.directory_rows({0: 100, 1: 100, 2: 1, 7: 1}, depth=3, capacity=150)
    assert [(s, b) for s, b, _ in rows] == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 4), (5, 4), (6, 4), (7, 4)]
    assert exact.directory_rows({}, 3, 10) == [(0, 0, 0)]


def test_drop_exact_leaves_one_of_each(odd):
    rows = exact.drop_exact(odd)
    assert rows.columns == odd.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in rows.collect()]
    assert sorted(texts) == sorted(groups())


def test_simhash_against_all_pairs(odd):
    rows = simhash.near_components(odd).collect()
    texts = odd_rows()
    assert len(rows) == len(texts)
    prints = [(d, simhash.fingerprint((t or "").encode())) for d, t, *_ in texts]
    assert sorted((str(d), f) for d, f in prints) == sorted((str(r.doc_id), r.fp % 2**64) for r in rows)
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    for r in rows:
        assert r.component_id == least.get(find(r.fp % 2**64))


def test_fingerprint_is_the_majority_of_hashes():
    import xxhash

    assert simhash.fingerprint(b"") == 0
    assert simhash.fingerprint(b" One\tTwo ") == xxhash.xxh64_intdigest(b"one two", 42)
    words = b"a b c d e f".split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)
    assert simhash.fingerprint(b" ".join(words)) == want


def test_pigeonring_finds_every_close_pair(spark):
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(60):
        at = int(rng.integers(0, 2**63))
        for _ in range(6):
            fps.add(at - 2**63)
            for b in rng.choice(64, 3, replace=False):
                at ^= 1 << int(b)
            at &= 2**64 - 1
            at = at if at < 2**63 else at ^ (1 << 63)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    found = {r.node: r.root for r in components.connected(links).collect()}
    ordered = sorted(fps)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if ((a ^ b) % 2**64).bit_count() <= 3:
                assert found[a] == found[b]


def test_large_runs_are_divided_without_loss(monkeypatch):
    rng = np.random.default_rng(1)
    low = rng.integers(0, 2**32, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([low, low ^ np.uint64(1 << 5), low ^ np.uint64(3 << 20)]))  # segments 2, 3 equal
    plain, divided = [], []
    simhash._spanning(fps, 2, plain)
    monkeypatch.setattr(simhash, "RUN", 10)
    simhash._link_run(fps, 2, divided)

    def parts(edges):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(int(a))] = find(int(b))
        least = {}
        for f in root:
            least[find(f)] = min(least.get(find(f), f), f)
        return {f: least[find(f)] for f in root}

    assert parts(plain) == parts(divided)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(5, 5)]
    found = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(31)} == {0} and {found[100 + i] for i in range(40)} == {100}


def test_drop_near_and_empty_tables(odd, nothing):
    kept = simhash.drop_near(odd)
    assert kept.columns == odd.columns
    components_ = {r.component_id for r in simhash.near_components(odd).collect()}
    assert kept.count() == len(components_)
    for made in (simhash.drop_near(nothing), exact.drop_exact(nothing), exact.exact_groups(nothing), simhash.near_components(nothing)):
        assert made.count() == 0


def test_drop_near_loses_no_text_with_a_null_or_repeated_id(spark):
    alone = [" ".join(f"{w}{k}" for k in range(12)) for w in ("red", "green", "blue", "grey")]
    rows = [(None, alone[0]), (None, alone[1]), (7, alone[2]), (7, alone[3]), (7, alone[3]), (None, alone[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.drop_near(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, alone[0]), (None, alone[1]), (7, alone[2]), (7, alone[3])], key=str)
