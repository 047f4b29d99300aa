import math
import random

import numpy as np

from folioscope.llm import vectors

KINDS = "vec_id long, embedding array<float>, label int, n int, ball long, root long"


def brute(rows):
    ok, unit = [], []
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(float)
            ok.append(i)
            unit.append(a / np.linalg.norm(a))
    links = [set() for _ in rows]
    for x, i in enumerate(ok):
        for y in range(x):
            if len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= 0.95:
                links[i].add(ok[y])
                links[ok[y]].add(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        part, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - part:
                part.add(j)
                todo.append(j)
        seen |= part
        least = min((rows[j][0] for j in part if rows[j][0] is not None), default=None)
        for j in part:
            out[j] = (rows[j][0], len(links[j]), least, rows[j][0] == least)
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], KINDS).repartition(3)


def families(rng, count, dim, size, noise):
    rows = []
    for _ in range(count):
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        for _ in range(size):
            rows.append((base + rng.normal(size=dim) * noise / math.sqrt(dim)).tolist())
    return rows


def test_links_equal_brute_force_on_odd_vectors(spark):
    rng = np.random.default_rng(4)
    made = families(rng, 6, 16, 12, 0.15) + families(rng, 3, 16, 30, 0.3) + families(rng, 4, 8, 5, 0.2) + families(rng, 60, 16, 1, 0)
    made += [made[0]] * 40 + [[2 * x for x in made[1]], [1e-30 * x for x in made[2]], [1e30 * x for x in made[3]]]
    rows = [(i, v) for i, v in enumerate(made)]
    random.Random(1).shuffle(rows)
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [0.0] * 15)]
    rows += [(905, [None] + [1.0] * 15), (None, made[0]), (None, None), (None, None), (7, made[20]), (906, [1.0, 2.0, 3.0]), (907, [2.0, 4.0, 6.0])]
    assert got(vectors.linked_vectors(frame(spark, rows))) == brute(rows)


def test_cells_blocks_and_balls_lose_no_link(spark, monkeypatch):
    """Small cells, blocks and balls: each way of meeting is taken."""
    monkeypatch.setattr(vectors, "PER_CELL", 40)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "MEMBERS", 8)
    monkeypatch.setattr(vectors, "CHUNK", 64)
    rng = np.random.default_rng(8)
    made = families(rng, 1, 32, 200, 0.1) + families(rng, 2, 32, 80, 0.22) + families(rng, 30, 32, 6, 0.2) + families(rng, 300, 32, 1, 0)
    rows = list(enumerate(made))
    random.Random(2).shuffle(rows)
    assert got(vectors.linked_vectors(frame(spark, rows))) == brute(rows)


def test_recall_at_the_threshold(spark):
    """Pairs just above the least cosine, in random directions, over many cells."""
    rng = np.random.default_rng(12)
    rows, pairs, dim = [], 1500, 48
    for k in range(pairs):
        base, step = rng.normal(size=(2, dim))
        base /= np.linalg.norm(base)
        step -= (step @ base) * base
        step /= np.linalg.norm(step)
        cosine = 0.951 + 0.004 * rng.random()
        rows += [(2 * k, base.tolist()), (2 * k + 1, (cosine * base + math.sqrt(1 - cosine**2) * step).tolist())]
    found = {r[0]: r for r in got(vectors.linked_vectors(frame(spark, rows)))}
    linked = sum(found[2 * k + 1][2] == 2 * k for k in range(pairs))
    assert linked >= 0.99 * pairs
    assert sum(not r[3] for r in found.values()) == linked


def test_no_vectors(spark):
    assert vectors.linked_vectors(frame(spark, [])).count() == 0
