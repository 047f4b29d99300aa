"""Best-fit packing of token sequences by hierarchical residual packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import free_names
from folioscope.llm.tokens import default_tokenizer, encoder, utf8
from folioscope.session import through_table

CAPACITY = 2048
#: Pieces that a group packs at first, and underfull bins on later levels.
GROUP = 8192
#: Groups that become one on the next level of the tree.
FANOUT = 8
#: A bin this full goes out at once; all others are tried again.
NEARLY_FULL = 0.98

ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(schema: str, columns: dict) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], _KINDS[k]) for n, k in fields], names=[n for n, _ in fields])


def _cut(path: str, capacity: int, end_id: int, with_ids: bool, schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        end = np.array([end_id], dtype=words.dtype).tobytes()
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, packed in zip(batch.column(0).to_pylist(), words.encode(utf8(batch.column(1)))):
                ids = np.frombuffer(packed + end, dtype=words.dtype)
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    raw = ids[start : start + capacity].astype("<u4").tobytes()
                    for name, value in zip(out, (doc, piece, start, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None)):
                        out[name].append(value)
            yield _batch(schema, out)

    return run


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens; only longer documents are cut.

    With ``with_ids`` the column ids holds them as little-endian 32-bit ids.
    """
    schema = ITEM + (", ids binary" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_cut(tokenizer, capacity, end_id, with_ids, schema), schema)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each item, in the order given, and the number of bins.

    An item goes to the bin with the least room that holds it.  Open bins are
    kept by room; a bit set of the rooms in use finds the least fitting one.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0
    where, offset = [], []
    for n in lengths:
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        where.append(b)
        offset.append(capacity - room)
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return where, offset, bins


def _pack_group(level: int, last: bool, capacity: int, schema: str):
    """Packs what a group holds: pieces at first, underfull bins later.

    A bin that is made of bins keeps the id of the first of them.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy().astype(np.int64)
        if level:
            ids, item = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)
            inner = table.column("offset").to_numpy()
        else:
            item, inner = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
        sizes = np.bincount(item, weights=lengths).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        where, place, bins = best_fit(sizes[order].tolist(), capacity)
        bin_of, offset_of = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        bin_of[order], offset_of[order] = where, place
        fill = np.bincount(bin_of, weights=sizes, minlength=bins)
        open_ = (fill < NEARLY_FULL * capacity) & (not last)
        own = bin_of[item]
        group = key[0].as_py()
        if level:
            first = np.empty(bins, np.int64)
            first[np.asarray(where[::-1], int)] = order[::-1]
            named = ids[first]
        else:
            named = (group << 27) | np.arange(bins)  # a leaf packs in one part
        columns = {n: table.column(n) for n in table.column_names}
        columns |= {
            "sequence_id": pa.array(named[own], pa.int64()),
            "offset": pa.array(offset_of[item] + inner, pa.int64()),
            "closed": pa.array(~open_[own], pa.bool_()),
        }
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.table([columns[n] for n in names], names=names)

    return run


def pack_items(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows with a column ``length``.

    Items are dealt to groups by row, not by key, so repeated documents spread
    out.  Each group packs its items by best fit in order of decreasing
    length.  Nearly full bins are final.  The groups are the leaves of a tree:
    on each level FANOUT neighbours become one node, and their underfull bins,
    as items, are packed anew, in parts of at most ``group`` bins where a node
    has more.  Every underfull bin is tried once on each level, so there are
    as many rounds as levels, the logarithm of the number of groups.  Every
    level is a table in the shared folder.
    """
    node, part = free_names(items, "pack_node", "pack_part")
    fields = ", ".join(f"{n} {k}" for n, k in ((f.name, f.dataType.simpleString()) for f in items.schema.fields))
    schema = fields.replace("bigint", "long") + f", {node} long, sequence_id long, offset long, closed boolean"
    groups = max(1, -(-items.count() // group))
    levels, width = 0, groups
    while width > 1:
        levels, width = levels + 1, -(-width // FANOUT)
    rows = items.withColumn(node, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    rows, final = rows.withColumn(part, F.lit(0)), []
    for level in range(levels + 1):
        pack = _pack_group(level, level == levels, capacity, schema)
        packed = through_table(rows.groupBy(node, part).applyInArrow(pack, schema), f"packed-{level}")
        final.append(packed.where("closed").drop("closed", node))
        if level < levels:
            left = packed.where("not closed").withColumn(node, F.floor(F.col(node) / FANOUT))
            sizes = left.where("offset = 0").groupBy(node).agg(F.ceil(F.count("*") / group).alias(part))  # each bin begins once
            own = F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.col(part))
            rows = left.join(F.broadcast(sizes), node).withColumn(part, own)
    out = final[0]
    for more in final[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone.  Rows that repeat a document are
    packed each for itself; an empty table gives no rows.
    """
    items = cut_documents(docs, tokenizer or default_tokenizer(), capacity, end_id, with_ids)
    return pack_items(through_table(items, "pack-items"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of its pieces in order, for ``with_ids`` rows."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
