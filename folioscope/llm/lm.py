"""Interpolated n-gram scoring: deleted interpolation by context frequency.

Words are 64-bit hashes and a pair of words is a hash of both.  Texts are kept
as chunks of about a million tokens, each a row of packed arrays.  A chunk asks
the owners of key ranges for the corpus counts of its distinct words and pairs
and gets them back in the order asked, so no row per token is ever shuffled
and no table that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tokens import utf8
from folioscope.session import through_table

#: Tokens of a chunk (a longer text is a chunk of its own), and of an owner.
CHUNK = 1_000_000
OWNER = 2_000_000
#: Beyond about 10^10 tokens both grow with the square root of the corpus, so
#: that the rows between chunks and owners grow as the corpus does.
CHUNK_ROOT, OWNER_ROOT = 10, 20
#: Bytes of text that count as a token in this estimate.
TOKEN_BYTES = 6
#: Context frequencies are grouped by their power of two, up to this one.
BUCKETS = 24
#: Part of the training documents whose counts fit the weights.
FIT, TRAIN, HELD = 1, 0, 2
_END, _START = b"\x00end", b"\x00start"

_CHUNK = "chunk long, fold int, docs binary, lengths binary, vocabulary binary, tokens binary, n_tokens long"
_ASK = "chunk long, level int, owner long, keys binary, train binary, fit binary"


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


END, START = _hash(_END), _hash(_START)


def squeeze(values: np.ndarray) -> bytes:
    """An array as compressed byte planes: high bytes that are all zero vanish."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def expand(raw: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One 64-bit key for each pair of hashes (multiply and xor-shift mixing)."""
    with np.errstate(over="ignore"):
        x = before * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ word
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _frame(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _cut_chunks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunks(batches, limit)

    return run


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Texts as chunks, a fold at a time: local vocabulary and token numbers."""
    task, made = TaskContext.get().partitionId(), 0
    open_: dict[int, tuple[dict, list, list, list]] = {}
    held: dict[int, int] = {}

    def close(fold: int) -> pa.RecordBatch:
        nonlocal made
        seen, docs, lengths, tokens = open_.pop(fold)
        held[fold] = 0
        vocabulary = np.fromiter((_hash(w) for w in seen), dtype=np.uint64, count=len(seen))
        made += 1
        return _frame(
            _CHUNK,
            [
                (
                    (task << 32) + made,
                    fold,
                    _ids(docs),
                    squeeze(np.array(lengths, "<i8")),
                    vocabulary.tobytes(),
                    squeeze(np.concatenate(tokens)),
                    sum(lengths),
                )
            ],
        )

    for batch in batches:
        for doc, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
            if fold not in open_:
                open_[fold] = ({_END: 0}, [], [], [])
            seen, docs, lengths, tokens = open_[fold]
            number = seen.setdefault
            words = text.lower().split()  # bytes: A-Z, and white space 9-13 and 32
            words.append(_END)
            tokens.append(np.fromiter((number(w, len(seen)) for w in words), dtype=np.uint32, count=len(words)))
            docs.append(doc)
            lengths.append(len(words))
            held[fold] = held.get(fold, 0) + len(words)
            if held[fold] >= limit:
                yield close(fold)
    for fold in list(open_):
        yield close(fold)


def _ids(docs: list) -> bytes:
    """Packed ids: a byte that says whether there is one, then the ids."""
    return bytes(d is not None for d in docs) + np.array([d or 0 for d in docs], "<i8").tobytes()


def _from_ids(raw: bytes) -> list:
    n = len(raw) // 9
    return [int(d) if has else None for has, d in zip(raw[:n], np.frombuffer(raw, "<i8", offset=n))]


def _open(lengths: bytes, vocabulary: bytes, tokens: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ends, word numbers, and hashes of each token and its context."""
    ends = np.cumsum(expand(lengths, "<i8"))
    numbers = expand(tokens, "<u4")
    word = np.frombuffer(vocabulary, np.uint64)[numbers]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[0] = START
    before[ends[:-1]] = START
    return ends, numbers, word, before


def _ask(owners: int):
    """The distinct keys of each chunk, dealt to owners, with their counts."""

    def rows(chunk: int, level: int, fold: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        owner = (keys >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for k, c, o in zip(np.split(keys, cuts), np.split(counts, cuts), owner[np.concatenate([[0], cuts])]):
            packed, none = squeeze(c.astype("<u4")), b""
            steps = squeeze(np.diff(k, prepend=np.uint64(0)))  # keys rise, so steps are short
            yield chunk, level, int(o), steps, packed if fold == TRAIN else none, packed if fold == FIT else none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, fold, _, lengths, vocabulary, tokens, _ in zip(*[c.to_pylist() for c in batch.columns]):
                ends, numbers, word, before = _open(lengths, vocabulary, tokens)
                hashes = np.frombuffer(vocabulary, np.uint64)
                order = np.argsort(hashes)
                counts = np.bincount(numbers, minlength=len(hashes))
                keys, times = hashes[order], counts[order]
                start = np.searchsorted(keys, np.uint64(START))  # contexts: a text's start is one too
                keys, times = np.insert(keys, start, np.uint64(START)), np.insert(times, start, len(ends))
                yield _frame(_ASK, list(rows(chunk, 1, fold, keys, times)))
                yield _frame(_ASK, list(rows(chunk, 2, fold, *np.unique(pair_keys(before, word), return_counts=True))))

    return run


_TOLD = "chunk long, level int, owner long, train binary, fit binary, n_train long, n_fit long, v_train long, v_all long"


def _tell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """An owner adds up what all chunks have of its keys and answers each.

    n_*: sums of counts; v_*: keys with a count, over the owner's whole range.
    They stand on the rows of the first chunk only.
    """
    level, owner = key[0].as_py(), key[1].as_py()
    asked = [np.cumsum(expand(k.as_buffer(), "<u8"), dtype=np.uint64) for k in table.column("keys")]
    sizes = [len(k) for k in asked]
    distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
    del asked
    totals = {}
    for name in ("train", "fit"):
        counts = [
            expand(c.as_buffer(), "<u4") if len(c.as_buffer()) else np.zeros(n, "<u4")
            for c, n in zip(table.column(name), sizes)
        ]
        totals[name] = np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    real = distinct != np.uint64(START) if level == 1 else np.ones(len(distinct), bool)
    sums = (
        int(totals["train"][real].sum()),
        int(totals["fit"][real].sum()),
        int((totals["train"][real] > 0).sum()),
        int((totals["train"][real] + totals["fit"][real] > 0).sum()),
    )
    cuts = np.cumsum(sizes)[:-1]
    rows = []
    for n, (chunk, at) in enumerate(zip(table.column("chunk").to_pylist(), np.split(place, cuts))):
        said = [squeeze(totals[name][at].astype("<u8")) for name in ("train", "fit")]
        rows.append((chunk, level, owner, *said, *(sums if n == 0 else (0, 0, 0, 0))))
    return pa.Table.from_batches([_frame(_TOLD, rows)])


def _counts(left: pa.Table, told: pa.Table):
    """Of each token: its count, its context's and the pair's, by fold."""
    row = {n: left.column(n)[0].as_py() for n in left.column_names}
    ends, numbers, word, before = _open(row["lengths"], row["vocabulary"], row["tokens"])
    said = {}
    answers = sorted(zip(*[told.column(n).to_pylist() for n in ("level", "owner", "train", "fit")]), key=lambda x: x[:2])
    for level in (1, 2):
        for fold, k in (("train", 2), ("fit", 3)):
            said[level, fold] = np.concatenate([expand(x[k], "<i8") for x in answers if x[0] == level])
    keys = np.sort(np.append(np.frombuffer(row["vocabulary"], np.uint64), np.uint64(START)))
    own, context = np.searchsorted(keys, word), np.searchsorted(keys, before)
    pair = np.unique(pair_keys(before, word), return_inverse=True)[1]
    out = {fold: (said[1, fold][own], said[1, fold][context], said[2, fold][pair]) for fold in ("train", "fit")}
    return row, ends, out


def _fit_counts(left: pa.Table, told: pa.Table) -> pa.Table:
    """Of the fitting part: how often each triple of training counts occurs."""
    _, _, by = _counts(left, told)
    triples, times = np.unique(np.stack(by["train"], axis=1), axis=0, return_counts=True)
    return pa.table(
        {"word": triples[:, 0], "context": triples[:, 1], "pair": triples[:, 2], "times": times.astype(np.int64)}
    )


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the power of two in its count."""
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0), BUCKETS)


def _mixed(word, context, pair, weights: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """Probability of each token under the mixture of its context's bucket."""
    w = weights[bucket_of(context)]
    return w[:, 0] / (distinct + 1) + w[:, 1] * word / max(total, 1) + w[:, 2] * pair / np.maximum(context, 1)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(weights: list, total: int, distinct: int):
    weights = np.array(weights)

    def run(left: pa.Table, told: pa.Table) -> pa.Table:
        row, ends, by = _counts(left, told)
        word, context, pair = (a + b for a, b in zip(by["train"], by["fit"]))
        base = np.log10((word + 0.1) / (total + 0.1 * (distinct + 1)))
        mixed = np.log10(_mixed(word, context, pair, weights, total, distinct))
        starts = np.concatenate([[0], ends[:-1]])
        docs = _from_ids(row["docs"])
        return pa.table(
            {
                "doc_id": pa.array(docs, pa.int64()),
                "held_out": pa.array([row["fold"] == HELD] * len(docs), pa.bool_()),
                "n_tokens": ends - starts,
                "n_known": np.add.reduceat((word > 0).astype(np.int64), starts),
                "train_tokens": pa.array([total] * len(docs), pa.int64()),
                "base_score": np.add.reduceat(base, starts),
                "score": np.add.reduceat(mixed, starts),
            }
        )

    return run


def fit_weights(triples: DataFrame, total: int, distinct: int, rounds: int = 12) -> list[list[float]]:
    """Weights (uniform, word, pair) of each context bucket.

    Expectation-maximisation on held-out counts: each round is one aggregation
    of the table of count triples by bucket, in which a token's share goes to
    the estimates in proportion to what each gave.  A bucket with no held-out
    token keeps the weights it started with.
    """
    bucket = F.when(F.col("context") > 0, F.least(F.floor(F.log2("context")).cast("int") + 1, F.lit(BUCKETS))).otherwise(0)
    rows = triples.select(
        bucket.alias("bucket"),
        "times",
        F.lit(1.0 / (distinct + 1)).alias("p0"),
        (F.col("word") / F.lit(float(max(total, 1)))).alias("p1"),
        F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0).alias("p2"),
    )
    spark = triples.sparkSession
    start = [[0.1, 0.9, 0.0] if b == 0 else [0.1, 0.5, 0.4] for b in range(BUCKETS + 1)]
    weights = start
    for _ in range(rounds):
        now = spark.createDataFrame([(b, *w) for b, w in enumerate(weights)], "bucket int, w0 double, w1 double, w2 double")
        mass = F.col("w0") * F.col("p0") + F.col("w1") * F.col("p1") + F.col("w2") * F.col("p2")
        share = lambda k: F.sum(F.col("times") * F.col(f"w{k}") * F.col(f"p{k}") / F.col("mass")).alias(f"s{k}")
        found = rows.join(F.broadcast(now), "bucket").withColumn("mass", mass).groupBy("bucket").agg(share(0), share(1), share(2)).collect()
        was, weights = weights, [list(w) for w in weights]
        for r in found:
            mass_of = r["s0"] + r["s1"] + r["s2"]
            if mass_of > 0:
                weights[r["bucket"]] = [max(r[f"s{k}"] / mass_of, 1e-9 if k == 0 else 0.0) for k in range(3)]
        if max(abs(a - b) for x, y in zip(was, weights) for a, b in zip(x, y)) < 1e-4:
            break
    return weights


def sizes(tokens: int) -> tuple[int, int]:
    """Tokens of a chunk and of an owner: rows between them are linear in ``tokens``."""
    root = math.isqrt(tokens)
    return max(CHUNK, CHUNK_ROOT * root), max(OWNER, OWNER_ROOT * root)


def score_documents(docs: DataFrame, chunk_tokens: int | None = None, rounds: int = 12) -> DataFrame:
    """One row per document with its log10 probability under the model.

    Documents whose crc32(doc_id as text) mod 10 is 0 are held out (a null id
    counts as the empty text, which is held out).  Of the others, remainder 1
    is the held-out part on which the mixture weights are learned while counts
    come from remainders 2 to 9; the final counts are of all nine.  Tokens are
    the words of the lower-cased (A-Z) text and one end; null is empty.

    Estimates: uniform over the vocabulary and one unknown word, word over all
    tokens, and pair over its context (the word before, or the start).  An
    empty table gives no rows.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10))
    part = F.when(fold == 0, HELD).when(fold == 1, FIT).otherwise(TRAIN)
    rows = docs.select(F.col("doc_id").cast("long"), part.alias("fold"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk, owner = sizes(size // TOKEN_BYTES)
    chunks = through_table(rows.mapInArrow(_cut_chunks(chunk_tokens or chunk), _CHUNK), "lm-chunks")
    tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    owners = max(1, math.ceil(tokens / owner))
    asked = chunks.mapInArrow(_ask(owners), _ASK)
    told = through_table(asked.groupBy("level", "owner").applyInArrow(_tell, _TOLD), "lm-counts")
    sums = told.where("level = 1").agg(*[F.sum(c).alias(c) for c in ("n_train", "n_fit", "v_train", "v_all")]).first()
    n_train, n_fit, v_train, v_all = [sums[c] or 0 for c in ("n_train", "n_fit", "v_train", "v_all")]
    answers = told.select("chunk", "level", "owner", "train", "fit")
    fitting = chunks.where(F.col("fold") == FIT)
    triples = (
        fitting.groupBy("chunk")
        .cogroup(answers.join(fitting.select("chunk"), "chunk", "left_semi").groupBy("chunk"))
        .applyInArrow(_fit_counts, "word long, context long, pair long, times long")
        .groupBy("word", "context", "pair")
        .agg(F.sum("times").alias("times"))
    )
    weights = fit_weights(through_table(triples, "lm-triples"), n_train, v_train, rounds)
    return (
        chunks.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(_score(weights, n_train + n_fit, v_all), _SCORED)
    )
