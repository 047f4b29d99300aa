"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import attach_groups
from folioscope.llm.components import connected
from folioscope.session import through_table

#: Linked from this cosine on.
COSINE = 0.95
#: Vectors that a cell should hold, and the most cells of one dimension.
PER_CELL, MOST_CELLS = 512, 4096
#: The cells are fitted on about so many vectors for each of them, drawn by a
#: hash of their row, at most SAMPLE of all.
PER_CENTRE, SAMPLE = 32, 131_072
ROUNDS = 8
#: A vector is also compared in later cells whose border is within so many
#: standard deviations of a step at the least cosine in a random direction.
SPREAD = 2.5
#: Balls in a block of a cell; vectors in a ball; vectors grouped at a time.
BLOCK, MEMBERS, CHUNK = 4096, 256, 1024
STRIP = 512
#: Slack for rounding in bounds on angles.
SLACK = 1e-7

REACH = math.acos(COSINE)
BALLS = (
    "ball long, dim int, home int, visits array<int>, n int, radius double, center binary, "
    "vec_ids array<long>, vectors binary"
)
FOUND = "kind int, a long, b long, add long"
LINK, BALL_COUNT, ROW_COUNT, OPEN = range(4)


def _normal(rows: np.ndarray) -> np.ndarray:
    """Unit vectors, in double precision."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1)[:, None]  # very large and very small components
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _decoded(held: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors again from what moves: a ball's centre, or one vector as it is stored."""
    out = np.empty((len(held), dim))
    short = np.array([len(h) == 4 * dim for h in held])
    for part, kind in ((short, np.float32), (~short, np.float64)):
        at = np.flatnonzero(part)
        if len(at):
            out[at] = _normal(np.frombuffer(b"".join(held[i] for i in at), kind).reshape(-1, dim))
    return out


def _unit(batch_column: pa.Array) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """By dimension, the places and unit vectors that may link; and the other places."""
    flat = batch_column.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    sizes = batch_column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    out, bad = {}, np.ones(len(sizes), bool)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        rows = values[starts[at][:, None] + np.arange(dim)[None, :]]
        good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
        at, rows = at[good], rows[good]
        if len(at):
            out[dim] = at, _normal(rows)
            bad[at] = False
    return out, np.flatnonzero(bad)


def _fit(cells: int):
    """Centres of spherical k-means on one dimension's sample, seeded by its spread."""

    def run(table: pa.Table) -> pa.Table:
        units, _ = _unit(table["v"].combine_chunks())
        centres = np.empty((0, 0))
        for _, rows in units.values():
            rng = np.random.default_rng(len(rows))
            k = max(1, min(cells, len(rows) // 8))
            centres = rows[rng.choice(len(rows), k, replace=False)]
            for _ in range(ROUNDS):
                home = np.concatenate([(rows[i : i + 8192] @ centres.T).argmax(axis=1) for i in range(0, len(rows), 8192)])
                order = np.argsort(home, kind="stable")
                found, first = np.unique(home[order], return_index=True)
                sums = np.add.reduceat(rows[order], first, axis=0)
                length = np.sqrt((sums * sums).sum(axis=1))
                moved = length > 1e-9
                centres[found[moved]] = sums[moved] / length[moved][:, None]
        return pa.table({"dim": pa.array([centres.shape[1]] * len(centres), pa.int32()), "center": [c.tobytes() for c in centres]})

    return run


def fit_cells(vectors: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Centres of the cells by dimension: at most MOST_CELLS of each that is drawn.

    Fitted in one task for each dimension, on a sample of at most SAMPLE rows;
    dimensions that the sample lacks are one cell.
    """
    cells = max(1, min(MOST_CELLS, total // PER_CELL))
    wanted = min(SAMPLE, max(PER_CENTRE * cells, 1024))
    share = min(1 << 30, math.ceil((1 << 30) * wanted / max(total, 1)))
    drawn = vectors.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share).limit(2 * SAMPLE)
    made = drawn.groupBy(F.size("v").alias("dim")).applyInArrow(_fit(cells), "dim int, center binary").collect()
    out: dict[int, list] = {}
    for row in made:
        out.setdefault(row.dim, []).append(np.frombuffer(row.center))
    return {dim: np.array(rows) for dim, rows in out.items()}


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _balls(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Splits unit vectors into (places, centre, radius) balls.

    All members of a ball are within half of the linking angle of its centre,
    so each two of them link.  A vector that shares none is its own centre.
    """
    cosines = rows @ rows.T
    np.fill_diagonal(cosines, 1.0)
    wide, inner = math.cos(REACH / math.sqrt(2)), REACH / 2 - SLACK
    left = np.ones(len(rows), bool)
    for lead in range(len(rows)):
        if not left[lead]:
            continue
        near = np.flatnonzero(left & (cosines[lead] >= wide))[:MEMBERS]
        if len(near) > 1:
            centre = rows[near].sum(axis=0)
            centre /= math.sqrt(centre @ centre)
            angles = _angle(rows[near] @ centre)
            if angles[near == lead][0] > inner:
                centre, angles = rows[lead], _angle(cosines[lead][near])
            stay = angles <= inner
            near, angles = near[stay], angles[stay]
        if len(near) > 1:
            left[near] = False
            yield near, centre, float(angles.max()) + SLACK
        else:
            left[lead] = False
            yield np.array([lead]), rows[lead], 0.0


def _placed(centres: dict[int, np.ndarray]):
    """Balls with their home cell and the later cells in which they are met too."""

    def homes(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.concatenate([(rows[i : i + STRIP] @ own.T).argmax(axis=1) for i in range(0, len(rows), STRIP)])

    def visited(middle: np.ndarray, radii: np.ndarray, home: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        step = SPREAD * math.sqrt((2 - 2 * COSINE) / own.shape[1])
        out = []
        for i in range(0, len(middle), STRIP):
            part = slice(i, i + STRIP)
            to, base = middle[part] @ own.T, own[home[part]]
            behind = np.take_along_axis(to, home[part][:, None], 1) - to
            apart = np.sqrt(np.maximum(2 - 2 * (base @ own.T), 1e-18))
            close = behind <= (step + 2 * np.sin(radii[part] / 2))[:, None] * apart
            close &= np.arange(len(own))[None, :] > home[part][:, None]
            out += [np.flatnonzero(r).astype(np.int32) for r in close]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = batch.column(0).to_numpy(), batch.column(1)
            units, rest = _unit(batch.column(2))
            stored = batch.column(2).flatten().to_numpy(zero_copy_only=False) if batch.column(2).type.value_type == pa.float32() else None
            starts = batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
            out = [(int(ids[i]), 0, -1, [], 1, 0.0, b"", [names[i].as_py()], b"") for i in rest.tolist()]
            for dim, (at, rows) in units.items():
                own = centres.get(dim)
                own = rows[:1] if own is None else own
                cell = homes(rows, own)
                made = []
                order = np.argsort(cell, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                    for i in range(0, len(part), CHUNK):
                        some = part[i : i + CHUNK]
                        made += [(some[near], centre, radius) for near, centre, radius in _balls(rows[some])]
                middle = np.array([m[1] for m in made])
                radii = np.array([m[2] for m in made])
                home = homes(middle, own)
                known = dim in centres
                visits = visited(middle, radii, home, own) if known else [[]] * len(made)
                for (near, centre, radius), h, v in zip(made, home.tolist(), visits):
                    held = at[near]
                    middle_of = centre.tobytes() if stored is None or len(near) > 1 else stored[starts[held[0]] : starts[held[0] + 1]].tobytes()
                    out.append(
                        (int(ids[held[0]]), dim, h, v, len(near), radius, middle_of, [names[i].as_py() for i in held.tolist()],
                         rows[near].tobytes() if len(near) > 1 else b"")
                    )
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            names_ = ["ball", "dim", "home", "visits", "n", "radius", "center", "vec_ids", "vectors"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names_)

    return run


class _Joined:
    """Keeps of many links those that join what was apart."""

    def __init__(self, n: int):
        self.part, self.links = np.arange(n), []

    def add(self, one: int, others: np.ndarray) -> None:
        parts = self.part[others]
        if (parts == self.part[one]).all():
            return
        for other in others.tolist():
            old, new = self.part[other], self.part[one]
            if old != new:
                self.links.append((one, other))
                self.part[self.part == old] = new


def _compare(table: pa.Table) -> pa.Table:
    """Blocked products within one part of a cell: links, counts and open pairs of balls.

    Two balls link in all pairs or in none where the angle between their
    centres, more or less both radii, says so; else they stay open.
    """
    ids, radii, n = (table[c].to_numpy() for c in ("ball", "radius", "n"))
    visitor, block = table["visitor"].to_numpy(), table["block"].to_numpy()
    middle = _decoded(table["center"].to_pylist(), table["dim"][0].as_py())
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    counts, joined, still = np.zeros(len(ids), np.int64), _Joined(len(ids)), []
    mine = np.flatnonzero(~visitor & ((i == j) | (block == i) | (j < 0)))
    theirs = np.flatnonzero(visitor | (i == j) | ((block == j) & (j >= 0)))
    for k in range(0, len(mine), STRIP):
        some = mine[k : k + STRIP]
        cosines = middle[some] @ middle[theirs].T
        low = math.cos(min(math.pi, REACH + float(radii[some].max()) + float(radii[theirs].max() if len(theirs) else 0) + SLACK))
        x, y = np.nonzero(cosines >= min(low, COSINE))
        c = cosines[x, y]
        x, y = some[x], theirs[y]
        once = visitor[y] | (x < y) if i == j else np.ones(len(x), bool)
        x, y, c = x[once], y[once], c[once]
        wide = radii[x] + radii[y]
        plain = wide == 0
        angle = _angle(c)
        link = np.where(plain, c >= COSINE, angle + wide <= REACH - SLACK)
        unsure = ~plain & ~link & (angle - wide <= REACH + SLACK)
        still += zip(ids[x[unsure]].tolist(), ids[y[unsure]].tolist())
        x, y = x[link], y[link]
        np.add.at(counts, x, n[y])
        np.add.at(counts, y, n[x])
        cuts = np.flatnonzero(np.diff(x)) + 1
        for one, others in zip(np.split(x, cuts), np.split(y, cuts)):
            if len(one):
                joined.add(int(one[0]), others)
    met = np.flatnonzero(counts)
    rows = [(LINK, int(ids[a]), int(ids[b]), 0) for a, b in joined.links]
    rows += [(BALL_COUNT, int(ids[k]), None, int(counts[k])) for k in met.tolist()]
    rows += [(OPEN, a, b, 0) for a, b in still]
    return _found(rows)


def _found(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["kind", "a", "b", "add"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open pairs of balls, vector by vector; rows name a vector by ball and place."""
    for batch in batches:
        rows = []
        for a, b, dim, one, two in zip(*(c.to_pylist() for c in batch.columns)):
            left, right = (_decoded([v], dim) if len(v) <= 8 * dim else np.frombuffer(v).reshape(-1, dim) for v in (one, two))
            link = left @ right.T >= COSINE
            if link.any():
                rows.append((LINK, a, b, 0))
                for ball, sums in ((a, link.sum(axis=1)), (b, link.sum(axis=0))):
                    rows += [(ROW_COUNT, ball, int(k), int(sums[k])) for k in np.flatnonzero(sums)]
        yield from _found(rows).to_batches()


def _in_parts(balls: DataFrame) -> DataFrame:
    """Balls dealt to the parts (i, j) of their cells in which they are compared.

    A cell of up to BLOCK balls and visitors is one part.  A larger one is cut
    into blocks by hash: part (i, j) compares home blocks i and j, part
    (i, -1-v) home block i with visitor block v.  Visitors are not compared
    with each other, and visits only go to later cells, so a pair of vectors
    meets once.
    """
    lean = ["ball", "dim", "n", "radius", "center"]
    homes = balls.where("home >= 0").select(*lean, F.col("home").alias("cell"), F.lit(False).alias("visitor"))
    guests = balls.select(*lean, F.explode("visits").alias("cell"), F.lit(True).alias("visitor"))
    every = homes.unionByName(guests)
    sizes = every.groupBy("dim", "cell").agg(
        F.ceil(F.count(F.when(~F.col("visitor"), 1)) / BLOCK).cast("int").alias("gh"),
        F.ceil(F.count(F.when(F.col("visitor"), 1)) / BLOCK).cast("int").alias("gv"),
    )
    sized = every.join(F.broadcast(sizes), ["dim", "cell"])  # at most MOST_CELLS rows for each dimension
    block = F.pmod(F.xxhash64("ball"), F.when(F.col("visitor"), F.col("gv")).otherwise(F.greatest("gh", F.lit(1)))).cast("int")
    parts = F.expr(
        """CASE WHEN gh <= 1 AND gv <= 1 THEN array(named_struct('i', 0, 'j', 0))
                WHEN visitor THEN transform(filter(sequence(0, gh), x -> x < gh), x -> named_struct('i', x, 'j', -1 - block))
                ELSE concat(transform(sequence(0, gh - 1), x -> named_struct('i', least(x, block), 'j', greatest(x, block))),
                            transform(filter(sequence(0, gv), x -> x < gv), x -> named_struct('i', block, 'j', -1 - x))) END"""
    )
    dealt = sized.withColumn("block", block).withColumn("part", F.explode(parts))
    return dealt.select("dim", "cell", "part.i", "part.j", "ball", "n", "radius", "center", "visitor", "block")


def linked_vectors(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link at a cosine of at least 0.95, in double precision.  Null
    vectors, those with null or non-finite components, zero and empty ones
    link with nothing; vectors of different length never link.  component_id
    is the smallest vec_id reachable, nulls passed over, so it is null where
    all ids are; kept is true where vec_id is component_id, also if both are
    null.  Rows that repeat an id are vectors of their own.  Labels and other
    columns are not read; an empty table gives no rows.

    Vectors that lie close together in a task become balls, all members of
    which link, so a large group of copies moves as few balls and its pairs
    are counted, not made.  Balls are compared in their home cell, and as
    visitors in later cells whose border is near: a link is only lost where
    both ends lie on two sides of a border further away than SPREAD allows,
    and no link is found that is none.
    """
    named = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    total = vectors.count()
    centres = fit_cells(named.where(F.size("v") > 0), total)
    balls = through_table(named.mapInArrow(_placed(centres), BALLS), "balls")
    found = _in_parts(balls).groupBy("dim", "cell", "i", "j").applyInArrow(_compare, FOUND)
    found = through_table(found, "ball-pairs")
    unsettled = found.where(F.col("kind") == OPEN)
    row_counts = None
    if not unsettled.isEmpty():
        whole = balls.select("ball", "dim", F.when(F.col("n") > 1, F.col("vectors")).otherwise(F.col("center")).alias("v"))
        pairs = (
            unsettled.select("a", "b")
            .join(whole.withColumnsRenamed({"ball": "a", "v": "va"}), "a")
            .join(whole.drop("dim").withColumnsRenamed({"ball": "b", "v": "vb"}), "b")
        )
        settled = through_table(pairs.select("a", "b", "dim", "va", "vb").mapInArrow(_settle, FOUND), "settled-pairs")
        found = found.unionByName(settled)
        row_counts = settled.where(F.col("kind") == ROW_COUNT).groupBy(F.col("a").alias("ball"), F.col("b").alias("place")).agg(
            F.sum("add").alias("more")
        )
    roots = connected(found.where(F.col("kind") == LINK).select("a", "b"))
    counts = found.where(F.col("kind") == BALL_COUNT).groupBy(F.col("a").alias("ball")).agg(F.sum("add").alias("add"))
    info = (
        balls.select("ball", "n", "vec_ids")
        .join(counts, "ball", "left")
        .join(roots.withColumnRenamed("node", "ball"), "ball", "left")
        .withColumn("root", F.coalesce("root", "ball"))
    )
    info = through_table(info, "ball-roots")
    least = info.groupBy("root").agg(F.min(F.array_min("vec_ids")).alias("component_id"), F.count("*").alias("size"))
    placed = attach_groups(info, through_table(least, "ball-components"), "root", "size", total)
    rows = placed.select("ball", "component_id", (F.col("n") - 1 + F.coalesce("add", F.lit(0))).alias("base"), F.posexplode("vec_ids").alias("place", "vec_id"))
    links = F.col("base").cast("long")
    if row_counts is not None:
        rows = rows.join(row_counts, ["ball", "place"], "left")
        links = links + F.coalesce("more", F.lit(0))
    return rows.select("vec_id", links.alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
