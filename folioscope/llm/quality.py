"""Weak supervision of document quality: voting rules, EM accuracies, posteriors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import SPACE_RUN, let, words
from folioscope.session import through_table

NOT_SYMBOLS = r"[^#*$%&|<>]+"


def _repeated_words(tokens: Column, width: int) -> Column:
    """Words inside ``width``-word windows that occur at least twice in the text.

    Windows are compared by 64-bit hash.  Sorted by hash, a window whose
    neighbour has the same hash is repeated; the union of the repeated windows
    is then measured along the text, in n log n.
    """

    def by_hash(w: Column) -> Column:
        last = F.size(w) - width
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.alias("i")),
        )

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("int"), lambda total, x: total + x)

    def repeated(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
        )
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    return let(F.sort_array(by_hash(tokens)), repeated).cast("long")


def _count_chars(text: Column, others: str) -> Column:
    """Characters left when all runs that match ``others`` are taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts the rules vote on, one narrow row per document.

    A null text counts as empty: all counts are 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated_words(w, 3).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        )

    return (
        docs.select(
            "doc_id",
            let(words(F.col("text")), counts).alias("_w"),
            _count_chars(text, SPACE_RUN).alias("word_chars"),
            _count_chars(text, NOT_SYMBOLS).alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            _count_chars(text, "[^A-Z]+").alias("n_upper"),
            _count_chars(text, "[^!?]+").alias("n_marks"),
        )
        .select("doc_id", "_w.*", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_marks")
    )


def vote(good: Column, bad: Column) -> Column:
    """1 for good, 0 for bad, -1 to abstain."""
    return F.when(bad, 0).when(good, 1).otherwise(-1).cast("tinyint")


def default_rules() -> dict[str, Column]:
    """Name -> vote.  Each rule looks at one property and abstains in between."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    length = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    variety = F.pow(F.col("n_words").cast("double"), F.lit(0.75))  # different words grow more slowly than words
    return {
        "length": vote(F.col("n_words") >= 100, F.col("n_words") < 20),
        "word_length": vote(length.between(3.0, 9.0), (length < 2.0) | (length > 15.0)),
        "symbols": vote(per_word("n_symbols") <= 0.02, per_word("n_symbols") > 0.2),
        "lines": vote(dup <= 0.1, dup > 0.4),
        "repeats": vote(per_word("n_repeat_words") <= 0.15, per_word("n_repeat_words") > 0.4),
        "distinct": vote(F.col("n_distinct_words") >= 1.1 * variety, F.col("n_distinct_words") < 0.38 * variety),
        "capitals": vote(F.col("n_upper") <= 0.2 * F.col("word_chars"), F.col("n_upper") > 0.5 * F.col("word_chars")),
        "marks": vote(per_word("n_marks") <= 0.1, per_word("n_marks") > 0.5),
    }


#: Where the expectation-maximisation starts, by vote: P(vote | good), P(vote | bad).
#: A rule seldom blames a good document, and blames some of the bad ones.
START = {1: (0.8, 0.65), 0: (0.002, 0.25), -1: (0.198, 0.1)}

#: Bounds on the estimates.  Each rule looks for one fault with a wide margin:
#: it blames at most this share of good documents, and a good vote only says
#: that one fault is absent, so a bad document gets it nearly as often.
MOST_BLAMED = 0.002
LEAST_PRAISED = 0.8


def _bounded(by: dict[int, tuple[float, float]]) -> dict[int, tuple[float, float]]:
    """The estimates of one rule within the bounds, each class summing to 1."""
    good = {v: p for v, (p, _) in by.items()}
    bad = {v: q for v, (_, q) in by.items()}
    blamed = min(good[0], MOST_BLAMED)
    rest = (1 - blamed) / max(good[1] + good[-1], 1e-12)
    good = {1: good[1] * rest, 0: blamed, -1: good[-1] * rest}
    praised = max(bad[1], LEAST_PRAISED * good[1])
    rest = (1 - praised) / max(bad[0] + bad[-1], 1e-12)
    bad = {1: praised, 0: bad[0] * rest, -1: bad[-1] * rest}
    return {v: (max(good[v], 1e-9), max(bad[v], 1e-9)) for v in (1, 0, -1)}


def fit_votes(
    votes: DataFrame, names: Sequence[str], rounds: int = 30, prior: float = 0.8, strength: float = 10.0
) -> tuple[float, dict[str, dict[int, tuple[float, float]]]]:
    """Share of good documents and, per rule and vote, P(vote | good), P(vote | bad).

    Two-class latent model with independent rules; an abstention is a vote of
    its own.  Spark counts the rows by vote pattern, which gives at most 3 to
    the number of rules rows whatever the corpus; these sufficient statistics
    are all that the rounds of expectation-maximisation need.  ``strength``
    pseudo-documents per rule and class, voting as in START, and the bounds
    above keep the classes from swapping and small tables from degenerating.
    """
    patterns = votes.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    share, model = prior, {r: dict(START) for r in names}
    for _ in range(rounds if patterns else 0):
        good_of: dict[tuple[str, int], float] = {}
        all_of: dict[tuple[str, int], float] = {}
        total = good_total = 0.0
        for row in patterns:
            odds = math.log(share / (1 - share)) + sum(
                math.log(model[r][row[r]][0] / model[r][row[r]][1]) for r in names
            )
            good = row["n"] / (1 + math.exp(-max(min(odds, 700.0), -700.0)))
            total, good_total = total + row["n"], good_total + good
            for r in names:
                seen = (r, row[r])
                good_of[seen] = good_of.get(seen, 0.0) + good
                all_of[seen] = all_of.get(seen, 0.0) + row["n"]
        was = share
        share = min(max((good_total + strength * prior) / (total + strength), 1e-6), 1 - 1e-6)
        model = {
            r: _bounded({
                v: (
                    (good_of.get((r, v), 0.0) + strength * p) / (good_total + strength),
                    (all_of.get((r, v), 0.0) - good_of.get((r, v), 0.0) + strength * q) / (total - good_total + strength),
                )
                for v, (p, q) in START.items()
            })
            for r in names
        }
        if abs(was - share) < 1e-9:
            break
    return share, model


def posterior(share: float, model: dict[str, dict[int, tuple[float, float]]]) -> Column:
    """Probability that a document is good, given its votes."""
    logit = F.lit(math.log(share / (1 - share)))
    for r, by in model.items():
        weight = F.lit(0.0)
        for v, (good, bad) in by.items():
            weight = F.when(F.col(r) == v, F.lit(math.log(max(good, 1e-12) / max(bad, 1e-12)))).otherwise(weight)
        logit = logit + weight
    return 1 / (1 + F.exp(-logit))


def judge_quality(docs: DataFrame, rules: dict[str, Column] | None = None, threshold: float = 0.5, rounds: int = 30) -> DataFrame:
    """One row per document: counts, votes, posterior and verdict.

    ``kept`` is false when the base checks fail (fewer than 50 words, or over
    half of the words in repeated windows), else it is whether the posterior
    reaches ``threshold``.  Null texts count as empty and fail the base check.
    Repeated rows are judged alike; an empty table gives no rows.
    """
    rules = rules or default_rules()
    counted = text_features(docs).select("*", *[c.alias(f"vote_{r}") for r, c in rules.items()])
    stored = through_table(counted, "quality-votes")
    names = [f"vote_{r}" for r in rules]
    share, model = fit_votes(stored, names, rounds)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stored.withColumn("quality", posterior(share, model)).withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("quality") >= threshold)
    )
