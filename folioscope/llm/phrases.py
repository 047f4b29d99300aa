"""Phrase collocations from count streams in prefix and in suffix order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import through_table

#: A candidate occurs at least so often, has at most so many words, and goes
#: where a longer one occurs at least so many per cent as often.
LEAST = 30
LONGEST = 4
COVERED = 80
#: Phrases of each language in the report.
REPORTED = 2000
#: Words that a task holds before it sends their counts on.
HELD = 2_500_000
#: Phrases in a batch that a task sends.
SENT = 50_000
#: Bytes of a text that are split at a time, cut only where a piece ends.
STRETCH = 8 << 20
#: Size of a map of frequent phrases in bits: 32 for each, within these bounds.
#: The map only keeps rare phrases out of the counts, so a full one costs time
#: and never changes a result.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28

_MARK = b"."
#: A-Z lowered, everything that ends a piece as one mark.
_PLAIN = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
GRAM = "lang string, gram string, c long"
EDGE = "lang string, gram string, c long, parts array<long>, ext long"


class _Ids(dict):
    """Numbers words in the order in which they come; the mark is 0."""

    def __init__(self) -> None:
        super().__init__({_MARK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _stretches(text: bytes) -> Iterator[bytes]:
    start = 0
    while len(text) - start > STRETCH:
        end = text.rfind(_MARK, start, start + STRETCH)
        if end <= start:
            end = text.find(_MARK, start + STRETCH)
            if end < 0:
                break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode()))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first * _MIX) ^ (second + (first >> np.uint64(29)))
    return mixed * _MIX


class Frequent:
    """A map of bits: no frequent phrase of a level is missing from it."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(64 * len(bits) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _grams(order: int, ids: np.ndarray, size: int, hashes: np.ndarray | None, known: list) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Phrases of ``order`` words (3: of 3 and of 4) in a run of ids, as the columns of their words, with counts."""
    if order == 1:
        counts = np.bincount(ids, minlength=size)
        counts[0] = 0
        found = np.flatnonzero(counts)
        yield [found], counts[found]
        return
    good = known[0].has(hashes)
    good[0] = False
    both = good[ids[:-1]] & good[ids[1:]]
    at = np.flatnonzero(both)
    if order == 2:
        keys, counts = np.unique(ids[at] * size + ids[at + 1], return_counts=True)
        yield [keys // size, keys % size], counts
        return
    keys, ranks = np.unique(ids[at] * size + ids[at + 1], return_inverse=True)
    one, two = keys // size, keys % size
    often = known[1].has(pair_hash(hashes[one], hashes[two]))
    pair = np.full(len(ids), -1, np.int64)  # the frequent pair that starts at each place
    pair[at] = np.where(often[ranks], ranks, -1)
    at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
    keys, counts = np.unique(pair[at] * size + ids[at + 2], return_counts=True)
    head = keys // size
    yield [one[head], two[head], keys % size], counts
    at = np.flatnonzero((pair[:-2] >= 0) & (pair[1:-1] >= 0) & (pair[2:] >= 0))
    keys, counts = np.unique(pair[at] * len(one) + pair[at + 2], return_counts=True)
    head, tail = keys // max(len(one), 1), keys % max(len(one), 1)
    yield [one[head], two[head], one[tail], two[tail]], counts


def _counter(order: int, known: list):
    """Counts of phrases within bounded runs of words; Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [Frequent(k.value) for k in known]
        ids, held, size = _Ids(), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(ids)
            for lang, parts in held.items():
                hashes = None
                if order > 1:
                    hashes = np.fromiter((word_hash(lang, w) for w in words), np.uint64, len(words))
                for columns, counts in _grams(order, np.concatenate(parts), len(words), hashes, maps):
                    for k in range(0, len(counts), SENT):
                        some = zip(*([words[i] for i in c[k : k + SENT].tolist()] for c in columns))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([lang]).take(pa.array(np.zeros(len(counts[k : k + SENT]), np.int32))),
                                pa.array([b" ".join(w) for w in some], pa.binary()).cast(pa.string()),
                                pa.array(counts[k : k + SENT].astype(np.int64)),
                            ],
                            names=["lang", "gram", "c"],
                        )

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not value.is_valid:
                    continue
                for part in _stretches(value.as_buffer().to_pybytes().translate(_PLAIN)):
                    tokens = part.replace(_MARK, b" . ").split()
                    made = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
                    held.setdefault(lang, []).append(np.append(made, 0))
                    size += len(tokens)
                    if size >= HELD:
                        yield from flush()
                        ids, held, size = _Ids(), {}, 0
        yield from flush()

    return run


def _bits_of(order: int, mask: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(lang, gram.encode().split(b" ")) for lang, gram in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            parts = [np.array([word_hash(lang, w[k]) for lang, w in split], np.uint64) for k in range(order)]
            at = (parts[0] if order == 1 else pair_hash(*parts)) & np.uint64(mask)
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))],
                names=["slot", "bits"],
            )

    return run


def _frequent(grams: DataFrame, order: int):
    """Broadcast map of the frequent phrases of one level, at most 32 MB."""
    size = LEAST_BITS
    while size < min(32 * grams.count(), MOST_BITS):
        size *= 2
    slots = grams.select("lang", "gram").mapInArrow(_bits_of(order, size - 1), "slot long, bits long")
    found = slots.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return grams.sparkSession.sparkContext.broadcast(bits)


def _counted(texts: DataFrame, order: int, known: list) -> DataFrame:
    return texts.mapInArrow(_counter(order, known), GRAM).groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, c) of all phrases of 1 to 4 words from ``least`` on, and (lang, n).

    Level by level: a phrase can only be frequent if its parts are, so each
    level is counted where the map of the level before allows it.  All texts
    are read whole in three passes, and all counts are exact.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    single = through_table(_counted(texts, 1, []), "phrase-words")
    totals = single.groupBy("lang").agg(F.sum("c").alias("n"))
    levels, known = [single.where(F.col("c") >= least)], []
    for order in (2, 3):
        known.append(_frequent(levels[-1], order - 1))
        levels.append(through_table(_counted(texts, order, known).where(F.col("c") >= least), "phrase-level"))
    return levels[0].unionByName(levels[1]).unionByName(levels[2]), totals


def _scan(backwards: bool):
    """One pass over a count stream in which every phrase follows its beginnings.

    The phrases that the present one starts with are the only ones held.  A
    phrase of two words or more leaves with the counts of its beginnings (from
    behind: of its ends) and the largest count among its extensions by a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # [lang, words, gram, count, best extension]
        out: list[tuple] = []

        def leave(depth: int) -> None:
            while len(stack) > depth:
                lang, words, gram, count, best = stack.pop()
                if len(words) > 1:
                    out.append((lang, gram, count, [s[3] for s in stack], best))

        for batch in batches:
            for lang, gram, count in zip(*(c.to_pylist() for c in batch.columns)):
                words = gram.split(" ")
                if backwards:
                    words.reverse()
                depth = len(stack)
                while depth and (stack[depth - 1][0] != lang or stack[depth - 1][1] != words[:depth] or depth >= len(words)):
                    depth -= 1
                leave(depth)
                if depth != len(words) - 1:
                    raise ValueError(f"the stream lacks a part of {gram!r}")
                if stack:
                    stack[-1][4] = max(stack[-1][4], count)
                stack.append([lang, words, gram, count, 0])
            if len(out) >= 10_000:
                yield _batch(out)
                out.clear()
        leave(0)
        if out:
            yield _batch(out)

    return run


def _batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["lang", "gram", "c", "parts", "ext"])


def _stream(grams: DataFrame, backwards: bool) -> DataFrame:
    """The counts in prefix (backwards: suffix) order, scanned.

    A task owns first (last) words; only frequent phrases stand in the stream,
    so a word of c occurrences brings at most c / 10 of them.
    """
    order = F.split("gram", " ")
    order = F.reverse(order) if backwards else order
    placed = grams.withColumn("w", order).repartition("lang", F.get("w", 0)).sortWithinPartitions("lang", "w")
    return placed.select("lang", "gram", "c").mapInArrow(_scan(backwards), EDGE)


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, reported: int = REPORTED) -> DataFrame:
    """The best scored phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts lose the case of A-Z and are cut at ``.,;:!?`` and line ends into
    pieces, those at spaces and tabs into words; null texts count as empty,
    null languages as ``und``.  A candidate of 2 to 4 words occurs ``least``
    times or more.  Cut after k words it has l and r, the counts of both
    parts, and floor(2000000 * a / (l + r)); the lowest cut counts, ties go to
    the smallest k.  A candidate goes where one longer by a word has
    ``covered`` per cent of its count: what holds of a still longer one holds
    of one of these.  Equal scores are ordered by a, then by the bytes of the
    phrase.  Repeated rows count each time; extra columns are not read.

    The counts of beginnings and right extensions come from the stream in
    prefix order, those of ends and left extensions from the stream in suffix
    order, and both are met by a merge join.
    """
    grams, totals = frequent_phrases(docs, least)
    ahead = _stream(grams, False).withColumnsRenamed({"parts": "ls", "ext": "right"})
    behind = _stream(grams, True).select("lang", "gram", F.col("parts").alias("rs"), F.col("ext").alias("left"))
    met = ahead.join(behind.hint("merge"), ["lang", "gram"]).where(
        F.greatest("left", "right").cast("decimal(20,0)") * 100 < F.col("c").cast("decimal(20,0)") * covered
    )
    cuts = F.expr(
        """array_min(transform(sequence(1, size(ls)), k -> named_struct(
            'score', cast(cast(c as decimal(20,0)) * 2000000
                          div (cast(ls[k - 1] as decimal(20,0)) + cast(rs[size(ls) - k] as decimal(20,0))) as bigint),
            'k', k, 'l', ls[k - 1], 'r', rs[size(ls) - k])))"""
    )
    scored = met.select("lang", F.col("gram").alias("phrase"), F.col("c").alias("a"), cuts.alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= reported)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
