"""Exact duplicates through an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import SPACE_RUN, attach_groups, free_names
from folioscope.session import through_table

#: Bytes of distinct text that a bucket holds before it splits; more where the
#: whole index would else need a deeper directory.
BUCKET_BYTES = 8 << 20
#: Splits stop at this depth, so the directory has at most 2**DEPTH slots; what
#: is still overfull then is a longer stream for its owner, not an error.
DEPTH = 16
#: Bytes of text that a combining task holds before it hands on what it has.
COMBINE_BYTES = 32 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _slot(key: Column, depth: int) -> Column:
    """The top ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def directory_rows(bytes_by_slot: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """(slot, bucket, local depth) of the doubled directory.

    One bucket at first; an overfull bucket splits on its next bit, and the
    directory doubles whenever the split bucket was as deep as the directory.
    Buckets are numbered by the first slot of their range at full depth.
    """
    sums = [0]
    for s in range(1 << depth):
        sums.append(sums[-1] + bytes_by_slot.get(s, 0))
    local, todo, deepest = [], [(0, 0)], 0
    while todo:
        first, own = todo.pop()
        span = 1 << (depth - own)
        if own < depth and sums[first + span] - sums[first] > capacity:
            todo += [(first, own + 1), (first + span // 2, own + 1)]
        else:
            local.append((first, own))
            deepest = max(deepest, own)
    out = []
    for first, own in sorted(local):
        start, many = first >> (depth - deepest), 1 << (deepest - own)
        out += [(start + k, first, own) for k in range(many)]
    return out


def _combine(limit: int):
    """Within a task, one row per distinct text with its count and smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in keys], pa.int64()),
                    pa.array([t for _, t in keys], pa.string()),
                    pa.array([held[k][0] for k in keys], pa.int64()),
                    pa.array([held[k][1] for k in keys], pa.int64()),
                ],
                names=["key", "norm", "keep_id", "group_size"],
            )

        for batch in batches:
            for doc, key, norm in zip(*[c.to_pylist() for c in batch.columns]):
                at = held.get((key, norm))
                if at is None:
                    held[key, norm] = [doc, 1]
                    size += len(norm) + 200
                else:
                    at[1] += 1
                    if doc is not None and (at[0] is None or doc < at[0]):
                        at[0] = doc
                if size > limit:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the keys a task holds: rows come in order of bucket and key.

    All texts of one key form a chain; a row joins the member whose bytes
    equal its own or becomes a new member.
    """
    names = ["bucket", "key", "chain", "text_sha256", "keep_id", "group_size"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    now, chain, done = None, [], []

    def close() -> None:
        for n, (norm, keep, size) in enumerate(chain):
            done.append((*now, n, hashlib.sha256(norm.encode()).hexdigest(), keep, size))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    for batch in batches:
        for bucket, key, norm, keep, size in zip(*[c.to_pylist() for c in batch.columns]):
            if now != (bucket, key):
                close()
                now, chain = (bucket, key), []
            for member in chain:
                if member[0] == norm:
                    member[2] += size
                    if keep is not None and (member[1] is None or keep < member[1]):
                        member[1] = keep
                    break
            else:
                chain.append([norm, keep, size])
        if done:
            yield out()
            done = []
    close()
    if done:
        yield out()


def build_index(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, key_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(directory, entries) of the index over all documents, both on shared files.

    entries: one row per distinct normalised text (bucket, key, chain,
    text_sha256, keep_id, group_size).  A pass over keys alone sizes the
    buckets.  Each task then combines its own copies, so a text that a third
    of all rows share reaches its owner once per task.  The directory leads
    each row from its slot to its bucket, and one task owns each bucket: it
    streams the bucket's rows in order of key and writes its entries.
    ``key_bits`` under 64 forces collisions, for tests.
    """
    spark = docs.sparkSession
    norm = normalised(F.col("text"))
    keyed = docs.select("doc_id", _key(norm, key_bits).alias("key"), norm.alias("norm"))
    sizes = (
        keyed.groupBy("key").agg(F.max(F.octet_length("norm")).alias("b"))
        .groupBy(_slot(F.col("key"), DEPTH).alias("slot")).agg(F.sum("b").alias("b"))
    )
    by_slot = {r["slot"]: r["b"] for r in sizes.collect()}  # at most 2**DEPTH rows
    rows = directory_rows(by_slot, DEPTH, max(bucket_bytes, sum(by_slot.values()) >> (DEPTH - 2)))
    directory = through_table(spark.createDataFrame(rows, "slot int, bucket int, local_depth int").coalesce(1), "hash-directory")
    combined = keyed.mapInArrow(_combine(COMBINE_BYTES), "key long, norm string, keep_id long, group_size long")
    placed = in_buckets(combined, directory).select("bucket", "key", "norm", "keep_id", "group_size")
    entries = (
        placed.repartition("bucket")
        .sortWithinPartitions("bucket", "key", "keep_id")
        .mapInArrow(_own, "bucket int, key long, chain int, text_sha256 string, keep_id long, group_size long")
    )
    return directory, through_table(entries, "hash-entries")


def _key(norm: Column, key_bits: int) -> Column:
    return F.xxhash64(norm).bitwiseAND(F.lit(-1 << (64 - key_bits)))


def in_buckets(rows: DataFrame, directory: DataFrame, key: str = "key") -> DataFrame:
    """Rows with the bucket to which the directory leads from the slot of their key."""
    depth = directory.count().bit_length() - 1
    led = directory.select(F.col("slot").alias("_slot"), "bucket")  # at most 2**DEPTH rows
    return rows.withColumn("_slot", _slot(F.col(key), depth)).join(F.broadcast(led), "_slot").drop("_slot")


def exact_groups(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one
    space; null counts as empty.  Of equal texts the smallest doc_id stays; a
    null id is larger than any other, and stays only if all ids of its group
    are null.  Rows that repeat both id and text are all marked like the first
    (``drop_exact`` leaves one of them).  An empty table gives no rows.
    """
    directory, entries = build_index(docs, bucket_bytes, key_bits)
    norm = normalised(F.col("text"))
    rows = in_buckets(docs.select("doc_id", F.sha2(norm, 256).alias("text_sha256"), _key(norm, key_bits).alias("key")), directory)
    place = F.struct("bucket", "key", "text_sha256").alias("place")  # bucket, key, and the member of its chain
    total = entries.agg(F.sum("group_size")).first()[0] or 0
    found = attach_groups(
        rows.select("doc_id", "text_sha256", place), entries.select(place, "keep_id", "group_size"), "place", "group_size", total
    )
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents that stay, one row per distinct text, columns unchanged.

    Rows that repeat an id and its text, and those of a text without any id,
    are reduced to one before they are shuffled.  Then each row asks the entry
    to which bucket, key and digest lead whether it is the keeper.
    """
    directory, entries = build_index(docs, bucket_bytes)
    own, sha, key, held = free_names(docs, "dedup_id", "dedup_sha", "dedup_key", "dedup_row")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    norm = normalised(F.col("text"))
    first = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns)))
    placed = docs.withColumns({own: name("doc_id"), sha: F.sha2(norm, 256), key: _key(norm, 64)})
    rows = in_buckets(placed.groupBy(own, sha, key).agg(first.alias(held)), directory, key)
    keepers = entries.select(name("keep_id").alias(own), F.col("text_sha256").alias(sha), F.col("key").alias(key), "bucket")
    return rows.join(keepers, [own, sha, key, "bucket"], "left_semi").select(f"{held}.*")
