"""Texts whose word shingles resemble each other: min-wise bands, then exact Jaccard."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import free_names
from folioscope.llm.components import connected
from folioscope.session import release, through_table

SEED = 42
#: Two texts meet when all minima of a band are equal.  Each band takes DEEP of
#: MINIMA minima, so one reading of the shingles serves all bands.  At a
#: similarity of 0.5 two texts share a band of eight with 0.4 per cent.
MINIMA = 128
BANDS = 48
DEEP = 8
#: Linked from this similarity on, as a fraction.
OVER, UNDER = 4, 5
#: Members of a bucket that all others of it are compared with: in the first
#: round, in which nothing is connected yet, and in each later one.
FIRST_HUBS, HUBS = 2, 8
#: Rounds of hubs before what is left of the large buckets is split by further
#: minima; buckets up to SMALL members are compared pair by pair.
ROUNDS = 3
SMALL = 12
#: Minima by which a large bucket is split, in so many ways side by side.
FURTHER, WAYS = 6, 3
#: Parts that the pairs of one hub are dealt to.
SALTS = 32
STEP = 2048
#: Texts whose sets of shingles are held at a time.
SETS_AT_ONCE = 1000

_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None]
_ODD = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None] | np.uint32(1)
_TAKEN = np.array([_rng.choice(MINIMA, DEEP, replace=False) for _ in range(BANDS)])


def shingles(text: bytes, width: int) -> np.ndarray:
    """Distinct hashes of a text's shingles; a text of fewer words is one shingle."""
    words = text.lower().split()  # bytes: only A-Z change, only white space 9-13 and 32 splits
    if len(words) < width:
        made = [b" ".join(words)]
    else:
        made = map(b" ".join, zip(*[words[k:] for k in range(width)]))
    count = max(len(words) - width + 1, 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in made), dtype="<u8", count=count))


def minima(hashes: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, (1 << 32) - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), STEP):
        low = np.minimum(low, ((short[None, k : k + STEP] ^ _XOR) * _ODD).min(axis=1))
    return low


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key for each band of minima."""
    return [xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(minima(hashes)[_TAKEN])]


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _text(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _signatures(width: int, fingerprint: Callable[[bytes, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, prints = [], [], [], []
            for value in batch.column(2):
                hashes = shingles(_text(value), width)
                prints.append(fingerprint(_text(value), width))
                nodes.append(_node(hashes))
                sizes.append(len(hashes))
                keys.append(np.array(band_keys(hashes), np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                    pa.array(np.array(prints, np.uint64).view(np.int64)),
                ],
                names=["doc_id", "text_key", "node", "n", "keys", "fp"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(k, SETS_AT_ONCE) for batch in batches for k in range(0, batch.num_rows, SETS_AT_ONCE)):
            made = [shingles(_text(t), width) for t in part.column(0)]
            nodes = np.array([_node(x) for x in made], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.array([x.view(np.int64) for x in made], pa.list_(pa.int64()))], names=["node", "hashes"]
            )

    return run


def matching_rows(docs: DataFrame, least: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``least`` (a struct of doc_id and text_key) names.

    Null ids match null ids.  ``docs`` keeps its columns, and gets the two that
    it was matched by as its last.
    """
    own, key = free_names(docs, "near_id", "near_key")
    named = F.coalesce(F.col("least.doc_id").cast("string"), F.lit(""))
    keep = least.select(named.alias(own), F.col("least.text_key").alias(key)).distinct()
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    rows = docs.withColumn(own, name).withColumn(key, F.xxhash64("text"))
    return rows.join(keep, [own, key], "left_semi").select(*docs.columns, own, key)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b): the pairs (hub, node) whose exact Jaccard is high enough.

    A hub's shingles go once to each of up to SALTS parts of its pairs, so a
    hub that a third of all texts are compared with is no hot key.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    of_hub = salted.select("hub", "salt").distinct().join(sets.select(F.col("node").alias("hub"), F.col("hashes").alias("hub_hashes")), "hub")
    both = salted.join(sets, "node").join(of_hub, ["hub", "salt"])
    common = F.size(F.array_intersect("hashes", "hub_hashes"))
    together = F.size("hashes") + F.size("hub_hashes")
    return both.where((OVER + UNDER) * common >= OVER * together).select(F.col("node").alias("a"), F.col("hub").alias("b"))


def _roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _unsettled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows (key, node, n, root, m) of the buckets whose m members are not all connected."""
    rooted = _roots(rows.select("key", "node", "n"), roots)
    if roots is not None:
        rooted = through_table(rooted, "near-rooted")
    found = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo < hi")
    out = through_table(rooted.join(found.select("key", "m"), "key"), "near-open")
    release(rooted)
    return out


def _hubs(rows: DataFrame, hubs: int) -> DataFrame:
    """(key, hub, hub_n, hub_root): the same few texts wherever they are members."""
    order = F.xxhash64("node")
    part = F.pmod(F.shiftright(order, 32), F.lit(hubs))
    chosen = rows.groupBy("key", part.alias("part")).agg(F.min(F.struct(order.alias("turn"), "node", "n", "root")).alias("h"))
    return chosen.select("key", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.root").alias("hub_root"))


def _round(rows: DataFrame, sets: DataFrame, roots: DataFrame | None, hubs: int, small: int) -> tuple[DataFrame, DataFrame]:
    """Compares large buckets with their hubs and small ones in pairs: (roots, unsettled rows).

    Pairs that are connected already or whose sizes are too far apart go
    first; each pair is compared once, however many buckets it shares.
    """
    far = (F.col("root") != F.col("hub_root")) & (UNDER * F.least("n", "hub_n") >= OVER * F.greatest("n", "hub_n"))
    large = rows.where(F.col("m") > small)
    chosen = through_table(_hubs(large, hubs), "near-hubs")
    pairs = large.join(chosen, "key").where(far).select("hub", "node")
    if small:
        few = rows.where(F.col("m") <= small)
        others = few.select("key", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("root").alias("hub_root"))
        pairs = pairs.unionByName(few.join(others, "key").where(far & (F.col("node") > F.col("hub"))).select("hub", "node"))
    pairs = through_table(pairs.distinct(), "near-pairs")
    links = _alike(pairs, sets)
    if roots is not None:
        links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = connected(links)
    rest = large.join(chosen.select("key", F.col("hub").alias("node")), ["key", "node"], "left_anti")
    left = _unsettled(rest, found)
    release(chosen, pairs, rows, *([roots] if roots is not None else []))
    return found, left


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = batch.column(1).offsets.to_numpy()
        hashes = batch.column(1).values.to_numpy(zero_copy_only=False).view(np.uint64)  # no Python number for each
        low = [minima(hashes[a:b]).view(np.int32) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.list_(pa.int32()))], names=["node", "low"])


def _split(rows: DataFrame, low: DataFrame, level: int) -> DataFrame:
    """Rows (key, node, n) of the parts of each bucket by FURTHER more minima.

    Every member goes to one part of each of WAYS divisions.  The minima are
    chosen by the bucket, so a pair that meets in several buckets has as many
    chances that are all different.
    """
    taken = lambda way, i: F.get("low", F.pmod(F.xxhash64("key", F.lit(level), way, F.lit(i)), F.lit(MINIMA)).cast("int"))
    part = lambda way: F.xxhash64("key", F.lit(level), way, *[taken(way, i) for i in range(FURTHER)])
    ways = F.array(*[part(F.lit(w)) for w in range(WAYS)])
    return rows.select("key", "node", "n").join(low, "node").select(F.explode(ways).alias("key"), "node", "n")


def _ring_roots(nodes: DataFrame, ring: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the nodes whose fingerprints ``ring`` links, or that share one."""
    prints = nodes.select("node", F.explode("fps").alias("fp"))
    linked = connected(ring(prints.select("fp").distinct())).withColumnRenamed("node", "fp")
    rooted = prints.join(linked, "fp", "left").select("node", F.coalesce("root", "fp").alias("fp"))
    least = rooted.groupBy("fp").agg(F.min("node").alias("b"))
    roots = connected(rooted.join(least, "fp").select(F.col("node").alias("a"), "b"))
    release(linked)
    return roots


def resembling(docs: DataFrame, nodes: DataFrame, width: int, roots: DataFrame | None = None) -> DataFrame | None:
    """(node, root) of connected nodes; ``roots``, or None, has those that are connected already.

    ``nodes`` has node, n, keys and least.  Members of a bucket are compared
    with its hubs, a few of its members, so texts with several near ones are
    soon connected; small buckets with members that are still apart are
    compared in pairs.  Large ones that are not settled after ROUNDS rounds are
    split by further minima until they are small or settled.  So the rows of
    each round are linear in the texts; no pair is left out for the size of a
    bucket, but in large ones a pair has to share further minima, for which it
    has WAYS chances in each band that it shares.
    """
    members = nodes.select(F.explode("keys").alias("key"), "node", "n")
    rows = _unsettled(members, None)
    if roots is not None:
        met, rows = rows, _unsettled(rows, roots)
        release(met)
    if rows.isEmpty():
        return roots
    wanted = nodes.join(rows.select("node").distinct(), "node", "left_semi")
    texts = matching_rows(docs.select("doc_id", "text"), wanted).select("text")
    sets = through_table(texts.mapInArrow(_sets(width), "node long, hashes array<long>").dropDuplicates(["node"]), "near-sets")
    for turn in range(ROUNDS):
        if rows.isEmpty():
            break
        roots, rows = _round(rows, sets, roots, HUBS if turn else FIRST_HUBS, SMALL if turn else 0)
    if not rows.isEmpty():
        crowd = rows.select("node").distinct().join(sets, "node").select("node", "hashes")
        low, level = through_table(crowd.mapInArrow(_minima, "node long, low array<int>"), "near-minima"), 0
        while not rows.isEmpty():
            parts = through_table(_split(rows, low, level), "near-parts")
            release(rows)
            rows = _unsettled(parts, roots)
            release(parts)
            if not rows.isEmpty():
                roots, rows = _round(rows, sets, roots, HUBS, SMALL)
            level += 1
        release(low)
    release(sets)
    return roots


def near_keepers(
    docs: DataFrame, width: int, fingerprint: Callable[[bytes, int], int], ring: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Column ``least``, the first row of each component of near texts.

    ``ring`` links the fingerprints first; then texts that resemble each other
    are linked where they are not connected yet.

    Ids come before nulls, smallest first, then by the hash of the text.  Null
    texts count as empty; texts without words are one node, texts of fewer
    words than ``width`` are one shingle each.  Texts are read whole: a very
    long one is as many shingles as it has words, in one row of one task.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    kinds = "doc_id long, text_key long, node long, n long, keys array<long>, fp long"
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    made = keyed.mapInArrow(_signatures(width, fingerprint), kinds)
    # Texts with the same shingles in other numbers have several fingerprints.
    nodes = made.groupBy("node").agg(
        F.min(first).alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.collect_set("fp").alias("fps")
    )
    nodes = through_table(nodes, "near-nodes")
    rooted = _roots(nodes.select("node", "least"), resembling(docs, nodes, width, _ring_roots(nodes, ring)))
    return rooted.groupBy("root").agg(F.min("least").alias("least"))
