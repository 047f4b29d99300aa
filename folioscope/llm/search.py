"""Ranked lexical search: term-at-a-time over short lists, document-at-a-time over long ones."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import through_table

TOP = 10
#: Bytes of query text that are answered in one pass over the documents.
QUERY_BYTES = 16 << 20
#: Documents and postings of a shard that are searched at a time.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 22
#: Documents of a block, the unit that is skipped.
BLOCK = 256
#: Lists of a shard are short up to one posting in so many documents.
SHORT = 16

#: Only letters, digits and what is not ASCII stays; A-Z is lowered.
_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
HIT = "item long, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _postings(number: dict[bytes, int]):
    """Each document's length and its counts of the terms that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, counts = [], [], []
            for value in batch.column(1):
                words = terms(value.as_buffer().to_pybytes()) if value.is_valid else []
                sizes.append(len(words))
                own = Counter(filter(None.__ne__, map(number.get, words)))
                found.append(list(own.keys()))
                counts.append(list(own.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


class Shard:
    """Inverted lists of some documents, with the largest impact in each block."""

    def __init__(self, ids, sizes, owners, found, tfs, weights, total, length):
        self.ids = ids
        self.blocks = -(-len(ids) // BLOCK)
        m = 25 + (75 * sizes * total) // max(length, 1)
        order = np.argsort(found, kind="stable")  # documents stay in order within a list
        self.docs, found, tfs = owners[order], found[order], tfs[order]
        self.impacts = weights[found] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[self.docs]))
        self.starts = np.searchsorted(found, np.arange(len(weights) + 1))
        self.tops: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def span(self, term: int) -> tuple[int, int]:
        return self.starts[term], self.starts[term + 1]

    def top(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each block starts in a long list, and its largest impact there."""
        if term not in self.tops:
            a, b = self.span(term)
            cuts = a + np.searchsorted(self.docs[a:b], np.arange(self.blocks + 1) * BLOCK)
            most = np.zeros(self.blocks, np.int64)
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            most[full] = np.maximum.reduceat(self.impacts[:b], cuts[full]) if len(full) else 0
            self.tops[term] = cuts, most
        return self.tops[term]

    def search(self, asked: dict[int, int], floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that can stand among the best, given that ``floor`` is reached already.

        Short lists are added up term by term.  Their sums form one more list,
        bounded in each block by its largest sum, beside the long lists; blocks
        are taken best bound first until none can reach the TOP-th best score.
        """
        length = {t: int(np.subtract(*self.span(t)[::-1])) for t in asked}
        short = [t for t in asked if 0 < length[t] <= len(self.ids) // SHORT]
        long = [t for t in asked if length[t] > len(self.ids) // SHORT]
        docs = np.concatenate([self.docs[slice(*self.span(t))] for t in short] or [np.empty(0, np.int64)])
        sums = np.concatenate([asked[t] * self.impacts[slice(*self.span(t))] for t in short] or [np.empty(0, np.int64)])
        docs, at = np.unique(docs, return_inverse=True)
        held = np.zeros(len(docs), np.int64)
        np.add.at(held, at, sums)
        cuts = np.searchsorted(docs, np.arange(self.blocks + 1) * BLOCK)
        bound = np.zeros(self.blocks, np.int64)
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        if len(full):
            bound[full] = np.maximum.reduceat(held, cuts[full])
        lists = [(asked[t], *self.top(t)) for t in long]
        for times, _, most in lists:
            bound += times * most
        best_docs, best = np.empty(0, np.int64), np.empty(0, np.int64)
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] < max(floor, 1):
                break
            dense = np.zeros(BLOCK, np.int64)
            base = block * BLOCK
            a, b = cuts[block], cuts[block + 1]
            dense[docs[a:b] - base] = held[a:b]
            for times, where, _ in lists:
                a, b = where[block], where[block + 1]
                dense[self.docs[a:b] - base] += times * self.impacts[a:b]
            own = np.flatnonzero(dense >= max(floor, 1))
            if len(own):
                best_docs, best = np.append(best_docs, own + base), np.append(best, dense[own])
                if len(best) >= TOP:
                    floor = max(floor, int(np.partition(best, -TOP)[-TOP]))
                    stay = best >= floor
                    best_docs, best = best_docs[stay], best[stay]
        return best_docs, best


def _first(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TOP best rows: by score, then by id, nulls (the largest number) last."""
    order = np.lexsort((ids, -scores))[:TOP]
    return ids[order], scores[order]


def _searcher(items: list[dict[int, int]], weights: np.ndarray, total: int, length: int):
    """The best documents of each item in a task; the score reached in one shard bounds the next."""
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        held, docs, postings = [], 0, 0

        def search() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table["doc_id"].fill_null(none).to_numpy()
            lists = table["terms"].combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            owners = np.repeat(np.arange(len(ids)), sizes)
            shard = Shard(
                ids, table["n"].to_numpy(), owners, lists.flatten().to_numpy().astype(np.int64),
                table["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64), weights, total, length,
            )
            for k, asked in enumerate(items):
                was = best[k]
                found, scores = shard.search(asked, int(was[1][-1]) if len(was[1]) == TOP else 0)
                if len(found):
                    best[k] = _first(np.append(was[0], ids[found]), np.append(was[1], scores))

        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                held.append(batch)
                docs, postings = docs + batch.num_rows, postings + len(batch.column(2).flatten())
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    search()
                    held, docs, postings = [], 0, 0
        if held:
            search()
        rows = [np.concatenate([b[i] for b in best] or [np.empty(0, np.int64)]) for i in (0, 1)]
        item = np.repeat(np.arange(len(items)), [len(b[0]) for b in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(rows[0], mask=rows[0] == none), pa.array(rows[1])], names=["item", "doc_id", "score"]
        )

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """The items with their terms, in blocks of bounded size."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        text = (row.text or "").encode()
        if block and size + len(text) > QUERY_BYTES:
            yield block
            block, size = [], 0
        block.append((row.item_id, Counter(terms(text))))
        size += len(text)
    if block:
        yield block


def _answers(docs: DataFrame, block: list[tuple[int | None, Counter]]) -> DataFrame:
    spark = docs.sparkSession
    number = {t: k for k, t in enumerate(sorted({t for _, asked in block for t in asked}))}
    index = through_table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_postings(number), POSTINGS), "postings")
    total, length = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    df = np.zeros(len(number), np.int64)
    for row in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most one for each term asked
        df[row.t] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    items = [{number[t]: c for t, c in asked.items()} for _, asked in block]
    found = index.mapInArrow(_searcher(items, weights, total, length or 0), HIT)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "item long, item_id long")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The 10 best documents of each item: item_id, rank, doc_id, score.

    Every row of ``items`` is a query and every row of ``docs`` a document,
    also where ids repeat or are null (null ids come last among equal
    scores).  Null and empty texts have no term; an item without any known
    term, or an empty table, gives no rows.  Texts are read whole.

    Documents stay where they are: each task holds inverted lists for shards
    of its documents and answers all items of a block there; only 10 rows for
    each item and task move.  The number of documents, their length and the
    document counts of the terms are of the whole table.
    """
    out = None
    for block in _blocks(items):
        part = _answers(docs, block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
