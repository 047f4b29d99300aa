"""Near duplicates by SimHash with pigeonring filtering of fingerprint pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import attach_groups, free_names
from folioscope.llm.components import connected
from folioscope.llm.resemblance import matching_rows, near_keepers
from folioscope.session import through_table

SEED = 42
BITS = 64
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
#: Budget of differing bits.  The layout below is for 4 segments and 3 bits:
#: in proportion, a chain of 1, 2, 3, 4 segments may differ in 0, 1, 2, 3 bits.
LIMIT = 3
#: Words of a shingle in the near-duplicate stage; op9's fingerprints take 3.
NEAR_WIDTH = 5
#: Runs above this many fingerprints are divided by a third segment.
RUN = 8192
STEP = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a text: a bit is 1 if set in over half of the shingle hashes."""
    words = text.lower().split()  # bytes: only A-Z change, only white space 9-13 and 32 splits
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)] + [b""] * (width - 1)
        count, shingles = 1, iter(words[:1])
    else:
        count = len(words) - width + 1
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)]))
    ones = np.zeros(BITS, dtype=np.int64)
    left = count
    while left:
        n = min(left, STEP)
        hashes = np.fromiter((xxhash.xxh64_intdigest(next(shingles), SEED) for _ in range(n)), dtype="<u8", count=n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= n
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array(
                [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in batch.column(2)], dtype=np.uint64
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made.view(np.int64))], names=["doc_id", "text_key", "fp"]
            )

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint and chain start, the keys under which it is met.

    A chain of two segments may differ in one bit, and not in its first
    segment.  A fingerprint is stored under its own key, and asks under the
    keys with one zero of the second segment set; of two that differ in one
    bit, the one with the zero asks.
    """
    flips = np.uint64(1) << np.arange(WIDTH, dtype=np.uint64)
    mask = np.uint64((1 << WIDTH) - 1)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        keys, owners, stored = [], [], []
        for i in range(SEGMENTS):
            first = (fps >> np.uint64(WIDTH * i)) & mask
            second = (fps >> np.uint64(WIDTH * ((i + 1) % SEGMENTS))) & mask
            base = (np.uint64(i) << np.uint64(2 * WIDTH)) | (first << np.uint64(WIDTH))
            row, bit = np.nonzero((second[:, None] & flips[None, :]) == 0)
            keys += [base | second, base[row] | second[row] | flips[bit]]
            owners += [fps, fps[row]]
            stored += [np.ones(len(fps), bool), np.zeros(len(row), bool)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners).view(np.int64)), pa.array(np.concatenate(stored))],
            names=["key", "fp", "stored"],
        )


def _spanning(fps: np.ndarray, start: int, edges: list) -> None:
    """Links that connect what is within the budgets, fewer than fingerprints.

    Breadth first: each fingerprint is compared with all not yet reached, so a
    clique gives a tree and not all of its pairs.
    """
    chain = np.uint64(0)
    for k in range(3):
        chain |= np.uint64(((1 << WIDTH) - 1) << (WIDTH * ((start + k) % SEGMENTS)))
    left = fps
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            apart = left ^ at
            near = np.bitwise_count(apart & chain) <= LIMIT - 1  # three segments of the chain
            near[near] = np.bitwise_count(apart[near]) <= LIMIT
            if near.any():
                found = left[near]
                edges.extend((at, x) for x in found)
                front.extend(found)
                left = left[~near]


def _link_run(fps: np.ndarray, start: int, edges: list) -> None:
    """Links within a run of fingerprints that share a key of chain ``start``.

    In a very large run one of the two other segments differs in at most one
    bit too, so runs by that segment hold every link, and as they fix 48 of 64
    bits up to two, they are bounded.
    """
    fps = np.unique(fps)
    if len(fps) <= RUN:
        _spanning(fps, start, edges)
        return
    mask = np.uint64((1 << WIDTH) - 1)
    for j in (start + 2, start + 3):
        part = (fps >> np.uint64(WIDTH * (j % SEGMENTS))) & mask
        for bit in range(-1, WIDTH):
            if bit < 0:
                keys, own = part, fps
            else:
                asks = (part >> np.uint64(bit)) & np.uint64(1) == 0
                keys = np.concatenate([part[asks] | np.uint64(1 << bit), part])
                own = np.concatenate([fps[asks], fps])
            order = np.argsort(keys, kind="stable")
            keys, own = keys[order], own[order]
            for a, b in _runs(keys):
                if b - a > 1:
                    _spanning(np.unique(own[a:b]), start, edges)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate([[0], cuts]) if len(keys) else np.empty(0, int)
    ends = np.concatenate([cuts, [len(keys)]]) if len(keys) else np.empty(0, int)
    long = ends - starts > 1
    return zip(starts[long].tolist(), ends[long].tolist())


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal keys; rows come in order of key."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def found(key: np.ndarray, fp: np.ndarray, stored: np.ndarray) -> pa.RecordBatch | None:
        edges: list = []
        for a, b in _runs(key):
            if stored[a:b].any():
                _link_run(fp[a:b], int(key[a]) >> (2 * WIDTH), edges)
        if not edges:
            return None
        ends = np.array(edges, dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held.append((cols[0], cols[1].view(np.uint64), cols[2]))
        if held[0][0][0] == cols[0][-1]:
            continue  # one run so far
        key, fp, stored = (np.concatenate(x) for x in zip(*held))
        cut = np.searchsorted(key, key[-1])  # the last run may go on
        if (out := found(key[:cut], fp[:cut], stored[:cut])) is not None:
            yield out
        held = [(key[cut:], fp[cut:], stored[cut:])]
    if held and (out := found(*(np.concatenate(x) for x in zip(*held)))) is not None:
        yield out


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within 3 bits.

    ``fps`` has one long column fp without repeats.  Pigeonring: around the
    ring of 4 segments there is a start from which 1, 2, 3 and 4 segments
    differ in at most 0, 1, 2 and 3 bits.  The first two conditions make the
    key that is shuffled, at most 4 stored rows and 64 asking rows for each
    fingerprint; the third and the full distance are checked where rows meet.
    """
    return (
        fps.select("fp").mapInArrow(_postings, "key long, fp long, stored boolean")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_links, "a long, b long")
    )


def _components(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, fp), and each fingerprint with its component.

    ``least`` is a component's first row: ids before nulls, smallest first,
    then by the hash of the text.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    rows = through_table(keyed.mapInArrow(_fingerprints(width), "doc_id long, text_key long, fp long"), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    distinct = through_table(rows.groupBy("fp").agg(F.min(first).alias("least"), F.count("*").alias("n")), "distinct-fp")
    roots = connected(fingerprint_links(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "n", "least", F.coalesce("root", "fp").alias("root")
    )
    whole = rooted.groupBy("root").agg(F.min("least").alias("least"), F.sum("n").alias("component_size"))
    return rows, through_table(rooted.drop("least").join(whole, "root"), "fp-components")


def near_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id, component_size.

    Words of the lower-cased (A-Z) whole text, shingles of ``width`` words with
    repeats (fewer words: the whole sequence; none or null: fingerprint zero,
    linked like any other).  Documents with equal fingerprints, or with
    fingerprints that differ in at most 3 bits, are linked; component_id is
    the smallest doc_id reachable.  Null ids are passed over in the minimum;
    where all are null, so is component_id.  Copies meet once, as one
    fingerprint, so their pairs are never made.  An empty table gives no rows.
    """
    rows, found = _components(docs, width)
    named = found.select("fp", "n", F.col("least.doc_id").alias("component_id"), "component_size")
    total = found.agg(F.sum("n")).first()[0] or 0
    return attach_groups(rows.select("doc_id", "fp"), named, "fp", "n", total).select("doc_id", "fp", "component_id", "component_size")


def drop_near(docs: DataFrame, width: int = NEAR_WIDTH) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest doc_id.

    Near means fingerprints of shingles of ``width`` words that op9's method
    links, 3 bits of 64 apart at most; those hold only what is almost equal, so
    a Jaccard similarity of at least 0.8 of the sets of shingles links too (see
    resemblance).  A component without any id keeps one
    of its rows, and of rows that repeat the id the one whose text has the
    smallest hash, so an id that stands for several texts stays once for each
    component that it is first of.  All columns are unchanged.
    """
    rows = matching_rows(docs, near_keepers(docs, width, fingerprint, fingerprint_links))
    own, key = rows.columns[-2:]
    (turn,) = free_names(rows, "near_turn")
    first = F.row_number().over(Window.partitionBy(own, key).orderBy(own))
    return rows.withColumn(turn, first).where(F.col(turn) == 1).select(*docs.columns)
