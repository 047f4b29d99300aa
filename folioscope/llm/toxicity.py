"""Toxicity by a classifier chain of linear models on word and prefix features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folioscope.llm.common import free_names

#: Labelled rows that the chain is fitted on, at most about this many, drawn
#: by hash of doc_id from all of them.
SAMPLE = 12_000
#: Features that the linear models weigh, chosen by association with a category.
FEATURES = 1500
LEAST_DOCS = 5
#: Features of documents that the fit counts or looks up at a time.
BLOCK = 1 << 20
FOLDS = 3
PREFIXES = (3, 4, 5, 6)
MASK = (1 << 31) - 1
#: Words whose features a worker remembers.
REMEMBERED = 400_000
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_…«»“”‘’"

Model = tuple[list[int], list[list[float]], float]


def word_features(word: str) -> list[int]:
    """A word and its prefixes, hashed; inflected forms share their prefixes."""
    word = word.strip(_EDGES) or word
    made = [f"={word}"] + [f"{word[:n]}~" for n in PREFIXES if len(word) >= n]
    return [xxhash.xxh32_intdigest(x) & MASK for x in made]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = []
        for text in batch.column(0).to_pylist():
            found = {f for w in set((text or "").lower().split()) for f in word_features(w)}
            ids.append(np.array(sorted(found), "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), *batch.columns[1:]], names=["ids", *batch.schema.names[1:]])


def _logistic(rows: np.ndarray, cols: np.ndarray, n: int, extra: np.ndarray, y: np.ndarray, width: int, steps: int = 150, l2: float = 1e-5) -> np.ndarray:
    """Weights of binary features, then of ``extra`` columns, then the intercept.

    Full-batch gradient with adaptive moments on the mean log loss.
    """
    k = extra.shape[1]
    w, m, v = (np.zeros(width + k + 1) for _ in range(3))
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w[-1] = np.log(rate / (1 - rate))
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n) + extra @ w[width:-1] + w[-1]
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.concatenate([np.bincount(cols, weights=miss[rows], minlength=width), extra.T @ miss, [miss.sum()]]) / n
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _predict(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int, extra: np.ndarray, width: int) -> np.ndarray:
    z = np.bincount(rows, weights=w[cols], minlength=n) + extra @ w[width:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _blocks(parts: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, id) of the documents' features, a block of whole documents at a time."""
    start, size = 0, 0
    for i, p in enumerate(parts):
        size += len(p)
        if size >= BLOCK or i + 1 == len(parts):
            held = parts[start : i + 1]
            yield np.repeat(np.arange(start, i + 1), [len(x) for x in held]), np.concatenate(held)
            start, size = i + 1, 0


def _choose(parts: Sequence[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The features with the largest chi-square against any category."""
    features, counts = np.zeros(0, "<i4"), np.zeros((0, 1 + y.shape[1]))
    for rows, ids in _blocks(parts):
        found, place = np.unique(ids, return_inverse=True)
        weights = [None, *(y[rows, c] for c in range(y.shape[1]))]
        more = np.stack([np.bincount(place, weights=w, minlength=len(found)) for w in weights], axis=1)
        merged, place = np.unique(np.concatenate([features, found]), return_inverse=True)
        both = np.zeros((len(merged), counts.shape[1]))
        both[place[: len(features)]] = counts
        both[place[len(features) :]] += more
        features, counts = merged, both
    n, docs, best = len(y), counts[:, 0], np.zeros(len(features))
    for c in range(y.shape[1]):
        with_label = counts[:, 1 + c]
        total = y[:, c].sum()
        if 0 < total < n:
            expected = docs * total / n
            score = (with_label - expected) ** 2 / expected + (with_label - expected) ** 2 / np.maximum(docs - expected, 1e-9)
            best = np.maximum(best, score)
    best[docs < LEAST_DOCS] = -1
    top = np.lexsort((features, -best))[:FEATURES]
    return np.sort(features[top[best[top] > 0]])


def _matrix(parts: Sequence[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the chosen features in the documents."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row, ids in _blocks(parts) if len(chosen) else ():
        at = np.searchsorted(chosen, ids)
        known = chosen[np.minimum(at, len(chosen) - 1)] == ids
        rows.append(row[known])
        cols.append(at[known])
    return np.concatenate(rows), np.concatenate(cols)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The best F1 on out-of-fold predictions; of equals the one next to a half."""
    grid = np.arange(5, 96) / 100
    found = np.array([2 * (y * (p >= t)).sum() / max((p >= t).sum() + y.sum(), 1) for t in grid])
    best = grid[found >= found.max() - 1e-12]
    return float(best[np.argmin(np.abs(best - 0.5))])


def _fit(categories: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        parts = [np.frombuffer(x.as_buffer(), "<i4") for x in table.column("ids")]
        y = np.stack([table.column(f"y{c}").to_numpy().astype(float) for c in range(categories)], axis=1)
        n = len(parts)
        chosen = _choose(parts, y)
        rows, cols = _matrix(parts, chosen)
        width = len(chosen)
        fold = np.array([xxhash.xxh32_intdigest(str(d)) % FOLDS for d in table.column("doc_id").to_pylist()])
        before = np.zeros((n, 0))
        weights = []
        for c in range(categories):
            weights.append(_logistic(rows, cols, n, before, y[:, c], width))
            out = np.zeros(n)
            for f in range(FOLDS):  # what later models see was not trained on
                learn = fold != f
                if not learn.any() or learn.all():
                    out = _predict(weights[c], rows, cols, n, before, width)
                    continue
                renumber = np.cumsum(learn) - 1
                inside = learn[rows]
                w = _logistic(renumber[rows[inside]], cols[inside], int(learn.sum()), before[learn], y[learn, c], width)
                out[~learn] = _predict(w, rows, cols, n, before, width)[~learn]
            before = np.column_stack([before, out])
        return pa.table(
            {
                "features": pa.array([chosen.tolist()], pa.list_(pa.int32())),
                "weights": pa.array([[w.tolist() for w in weights]], pa.list_(pa.list_(pa.float64()))),
                "threshold": pa.array([_threshold(before[:, -1], y[:, -1])], pa.float64()),
            }
        )

    return run


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> Model | None:
    """Fit the chain on labelled documents; None if there are none.

    ``labels`` has doc_id and one 0/1 column per category; rows with a null
    are left out, of repeated ids the largest value counts, and of several
    texts the one with the smallest hash.  The sample's features, one row for
    each id, go to one task, bounded by ``sample``; only the weights return.
    """
    clean = labels.select("doc_id", *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    clean = clean.groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    known = clean.count()
    share = 1 << 20 if known <= sample else int((1 << 20) * sample / known)
    drawn = clean.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    ys = [f"y{i}" for i in range(len(categories))]
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", *ys)
    rows = rows.agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "doc_id", *ys)
    made = rows.mapInArrow(_features, "ids binary, doc_id long, " + ", ".join(f"{y} int" for y in ys))
    found = (
        made.groupBy(F.lit(0).alias("all"))
        .applyInArrow(_fit(len(categories)), "features array<int>, weights array<array<double>>, threshold double")
        .first()
    )
    return (list(found["features"]), [list(w) for w in found["weights"]], found["threshold"]) if found else None


def _apply(model: Model | None, made_names: Sequence[str], keep: int):
    """Probabilities after the first ``keep`` columns; the text comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, _ = model or ([], [], 0.5)
        categories = len(made_names)
        column = {f: i for i, f in enumerate(features)}
        width = len(features)
        tables = [np.array(w) for w in weights]
        remembered: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            made: list[list[float]] = [[] for _ in range(categories)]
            for text in batch.column(keep):
                cols: set[int] = set()
                for w in set((text.as_py() or "").lower().split()):
                    got = remembered.get(w)
                    if got is None:
                        got = tuple(column[f] for f in word_features(w) if f in column)
                        if len(remembered) > REMEMBERED:
                            remembered.clear()
                        remembered[w] = got
                    if got:
                        cols.update(got)
                at, before = np.array(sorted(cols), int), np.zeros(0)
                for c in range(categories):
                    p = 0.0
                    if tables:
                        w = tables[c]
                        z = w[at].sum() + before @ w[width : width + c] + w[-1]
                        p = float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                    made[c].append(p)
                    before = np.append(before, p)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:keep], *[pa.array(m, pa.float64()) for m in made]],
                names=[*batch.schema.names[:keep], *made_names],
            )

    return run


def _limit(model: Model | None, threshold: float | None) -> float:
    return threshold if threshold is not None else model[2] if model else 0.5


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str], threshold: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, p_<category> in chain order, and ``toxic``.

    ``toxic`` is whether the last category's probability reaches ``threshold``,
    by default the one that was best on out-of-fold predictions.
    Null and empty texts have no features and get the chain's base rates.  Rows
    that repeat are scored alike; without labels every probability is 0.
    """
    model = fit_chain(docs, labels, categories, sample)
    made = [f"p_{name}" for name in categories]
    schema = "doc_id long, " + ", ".join(f"`{m}` double" for m in made)
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_apply(model, made, 1), schema)
    return scored.withColumn("toxic", F.col(made[-1]) >= F.lit(_limit(model, threshold)))


def drop_toxic(docs: DataFrame, labels: DataFrame, categories: Sequence[str], threshold: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """The documents whose last category stays below ``threshold``, unchanged.

    The rows pass the model as they are; nothing is shuffled or joined back.
    """
    model = fit_chain(docs, labels, categories, sample)
    k = len(categories)
    read, *made = free_names(docs, "tox_text", *[f"tox_p{c}" for c in range(k)])
    kinds = StructType([*docs.schema.fields, *[StructField(m, DoubleType()) for m in made]])
    scored = docs.withColumn(read, F.col("text")).mapInArrow(_apply(model, made, len(docs.columns)), kinds)
    return scored.where(F.col(made[-1]) < F.lit(_limit(model, threshold))).select(*docs.columns)


def labelled(labels: DataFrame) -> DataFrame:
    """The labels table as chain categories: low quality first, then toxic."""
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))


CHAIN = ("low_quality", "toxic")
