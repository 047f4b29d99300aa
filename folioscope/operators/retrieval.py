"""Similar gold examples: TF-IDF postings, top-k, diverse picks, k-NN tags.

Postings keep (doc_id, para_id) and the labels that a retrieval may ask for.
Token counts are handed over in buckets of doc_id, so the norms need no further
exchange.  A query is first asked with its rarest tokens; the score that this
reaches tells which other tokens can still bring an example among the best k,
and the rest is only looked up for examples that the bounds leave.
"""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import styles as st
from folioscope.functions.styles import Vocabulary
from folioscope.functions.text import searched_text, tokens
from folioscope.session import BROADCAST_ROWS, checked_lookup, into_buckets, through_buckets, through_table
from folioscope.sources.documents import by_document

EXAMPLE = ["doc_id", "para_id"]
SCORE_PLACES = 9  # equal texts must tie whatever the summation order
POSTINGS = 500_000  # rows of a partition
LETTERS = 6  # bytes of text that a posting stands for, at least
FREQUENT = 1_000_000  # tokens whose document frequencies are broadcast
BOOST = 1.2  # of examples from the query's own book


def _words(rows: DataFrame, keys: list[str], text: str, mark: str | None = None) -> DataFrame:
    """(keys, token, _c, _n): each row's tokens with their count and that of all; ``mark`` is one more."""
    words = rows.select(*keys, tokens(searched_text(F.col(text))).alias("_w"))
    # Sized before the split, which would carry the whole list along with each token.
    sized = words.select(*keys, F.size("_w").alias("_n"), "_w")
    each = F.col("_w") if mark is None else F.concat(F.coalesce("_w", F.array().cast("array<string>")), F.array(F.lit(mark)))
    split = sized.select(*keys, "_n", F.explode(each).alias("token"))
    return split.groupBy(*keys, "token").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))


def token_counts(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, token, tf): share of each token in its row."""
    return _words(rows, keys, text).select(*keys, "token", (F.col("_c") / F.col("_n")).alias("tf"))


def inverse_frequency(counts: DataFrame, total: int, scale: str = "ratio") -> DataFrame:
    """(token, df, idf); idf = N / df, or its logarithm."""
    ratio = F.lit(total) / F.col("df")
    return counts.groupBy("token").agg(F.count("*").alias("df")).withColumn(
        "idf", F.log(ratio) if scale == "log" else ratio
    )


def _often(idf: DataFrame) -> tuple[int, bool]:
    """The least df, a power of two, whose tokens can be broadcast, and whether all others stand in one row each."""
    sizes = idf.groupBy(F.floor(F.log2("df")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()
    kept = 0
    for power, n in sorted(((r["power"], r["n"]) for r in sizes), reverse=True):
        if (kept := kept + n) > FREQUENT:
            return 1 << (power + 1), power == 0
    return 1, False


def weighted(counts: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """(EXAMPLE, also, token, df, idf, w, norm): TF-IDF weight and the row's vector length."""
    w = counts.select(*EXAMPLE, *also, "token", "df", "idf", (F.col("tf") * F.col("idf")).alias("w"))
    square = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*EXAMPLE))
    return w.withColumn("norm", F.sqrt(square))


class ExampleIndex:
    """Weighted postings of the usable gold rows.

    Token counts are written to the shared folder once, with the columns in
    ``carry`` (names, zones, tags that later restrict or raise examples);
    every retrieval reads them from there.  ``parts`` says that the examples
    are already placed by doc_id in as many partitions.  With ``each_row`` an
    example that stands several times is joined to its rows by ``knn_tags``.
    """

    def __init__(self, examples: DataFrame, scale: str = "ratio", carry: Sequence[str] = (), parts: int | None = None, each_row: bool = False):
        self.examples = examples
        self.each_row = each_row
        self.carry = tuple(carry)
        rows = examples
        if parts is None:
            size = examples.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            parts = max(2, -(-size // (POSTINGS * LETTERS)))
            rows = by_document(examples, EXAMPLE[0], parts)
        # One more token, empty, in each row counts the examples along the way.
        tf = (F.col("_c") / F.nullif("_n", F.lit(0))).alias("tf")
        unknown = [F.lit(None).cast(kind).alias(c) for c, kind in (("df", "bigint"), ("idf", "double"))]
        counted = _words(rows, [*EXAMPLE, *carry], "text", mark="").select(*EXAMPLE, *carry, "token", "_c", tf, *unknown)
        self._held = through_buckets(counted, "token-counts", parts, EXAMPLE[0], EXAMPLE)
        self._parts = parts
        total = self._held.where("token = ''").agg(F.sum("_c")).first()[0] or 0
        self.counts = self._held.where("token <> '' AND df IS NULL").drop("_c", "df", "idf")
        self.idf = through_table(inverse_frequency(self.counts, total, scale), "token-idf")

    @cached_property
    def known(self) -> DataFrame:
        """(EXAMPLE, carry, token, tf, df, idf), placed by doc_id as the counts are.

        The most frequent tokens are looked up in a broadcast.  Others have one
        idf if they stand in one row each; else their postings, few, are moved
        to their tokens, and come back to the counts with their df.
        """
        table, (least, single) = self.idf.select("token", "df", "idf"), self._often
        often = F.broadcast(table.where(F.col("df") >= least).withColumnsRenamed({"df": "_df", "idf": "_idf"}))
        held, df, idf = self._held, F.coalesce("df", "_df"), F.coalesce("idf", "_idf")
        if single:
            once = table.where("df = 1").select("idf").first()[0]
            df, idf = F.coalesce("_df", F.lit(1).cast("bigint")), F.coalesce("_idf", F.lit(once))
        elif least > 1:
            rare = self.counts.join(often.select("token"), "token", "left_anti").join(table.where(F.col("df") < least), "token")
            rare = rare.withColumn("_c", F.lit(0).cast("bigint")).repartition(self._parts, EXAMPLE[0])
            held = into_buckets(held, rare, self._parts, EXAMPLE[0], EXAMPLE)
        found = held.where("token <> ''").join(often, "token", "left").withColumns({"df": df, "idf": idf})
        return found.where("df IS NOT NULL").drop("_c", "_df", "_idf")

    @cached_property
    def _often(self) -> tuple[int, bool]:
        return _often(self.idf)

    @cached_property
    def postings(self) -> DataFrame:
        """(EXAMPLE, carry, token, df, idf, w, norm), placed by doc_id as the counts are."""
        return weighted(self.known, self.carry)

    def looked_up(self, counts: DataFrame) -> DataFrame:
        """``counts`` of other rows with df and idf, without tokens that no example has."""
        table, (least, _) = self.idf.select("token", "df", "idf"), self._often
        often = F.broadcast(table.where(F.col("df") >= least))
        found = counts.join(often, "token")
        if least == 1:
            return found
        rare = counts.join(often.select("token"), "token", "left_anti").join(table.where(F.col("df") < least), "token")
        return found.unionByName(rare.select(*found.columns))

    def joined_to_rows(self) -> ExampleIndex | None:
        """The index without carried columns, if it is to join examples to their rows and some stand several times."""
        if not self.each_row or self._held.where("token = '' AND _c > 1").isEmpty():
            return None
        part = copy(self)
        for name in ("postings", "impacts", "tops"):
            part.__dict__.pop(name, None)
        part.carry = ()
        return part

    @cached_property
    def labels(self) -> DataFrame:
        """The examples without their text, written once: a retrieval reads them several times."""
        return through_table(self.examples.drop("text"), "labels")

    def restricted(self, words: DataFrame) -> ExampleIndex:
        """The index with the postings of these tokens alone; norms count all tokens."""
        if words.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
            return self
        part = copy(self)
        for name in ("impacts", "tops"):
            part.__dict__.pop(name, None)
        part.postings = self.postings.join(F.broadcast(words), "token", "left_semi")
        return part

    @cached_property
    def impacts(self) -> DataFrame:
        """(EXAMPLE, carry, token, share): weights divided by the example's norm."""
        share = (F.col("w") / F.col("norm")).alias("share")
        return through_table(self.postings.select(*EXAMPLE, *self.carry, "token", share), "postings")

    @cached_property
    def tops(self) -> DataFrame:
        """(token, df, idf, top): the largest share of each token bounds what it can add."""
        rows = self.impacts.groupBy("token").agg(F.max("share").alias("top"))
        return through_table(rows.join(self.idf, "token"), "token-tops")


def _meet(postings: DataFrame, queries: DataFrame, on: list[str], salts: int = 64) -> DataFrame:
    """Postings joined to query rows.

    Query rows within the bound are broadcast; beyond it both sides are
    salted, so a token that sits in every row spreads over ``salts`` tasks.
    """
    if queries.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return postings.join(F.broadcast(queries), on)
    salt = F.pmod(F.xxhash64(*EXAMPLE), F.lit(salts)).cast("int")
    wide = queries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return postings.withColumn("_salt", salt).join(wide, [*on, "_salt"]).drop("_salt")


#: Slack for sums in another order, far below the places that scores keep.
SLACK = 1e-7


def _asked(queries: DataFrame, index: ExampleIndex, key: list[str], keep: list[str], text: str, names: dict[str, str]) -> DataFrame:
    """Query tokens that examples know: a (share of the query's norm), bound on
    what the token adds to any score, df of all tokens before it and
    the bound of it and all after it together, in the order of falling bounds."""
    counts = token_counts(queries, [*key, *keep], text)
    rows = checked_lookup(counts, index.tops, "token", "inner", F.xxhash64(*key))
    one = Window.partitionBy(*names.values())
    rows = rows.select(
        *[F.col(c).alias(n) for c, n in names.items()],
        *[F.col(c).alias(f"_q_{c}") for c in keep],
        "token", "df", "top", (F.col("tf") * F.col("idf")).alias("_wq"),
    ).withColumn("_a", F.col("_wq") / F.sqrt(F.sum(F.col("_wq") * F.col("_wq")).over(one)))
    turn = one.orderBy(F.desc("_bound"), "token")
    # An example's shares have length 1, so what tokens add is no more than their length either.
    later = one.orderBy("_bound", F.desc("token")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_bound", F.col("_a") * F.col("top"))
        .withColumn("_met", F.coalesce(F.sum("df").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.least(F.sum("_bound").over(later), F.sqrt(F.sum(F.col("_a") * F.col("_a")).over(later))))
        .drop("_wq", "df", "top")
    )


def candidates(
    index: ExampleIndex, postings: DataFrame, asked: DataFrame, names: list[str], on: list[str], k: int, boost: float, floor: float
) -> tuple[DataFrame, DataFrame]:
    """What can be among the best k: (query, EXAMPLE, _s) sums of the deciding tokens, and all query tokens.

    The tokens of highest bound are met first, up to a few examples for each
    place.  The k-th best sum is a score that k examples reach at least, so
    tokens whose bounds together stay below it cannot bring in an example
    alone: they are not joined.  Of the examples that the others bring, those
    stay whose sum and the bounds left reach it.  Query tokens get ``_reach``,
    and ``_late`` where they are yet to be added.
    """
    first = asked.where(F.col("_met") < 16 * k + 64).select(*names, "token", *on[1:], "_a")
    sums = _meet(postings, first, on).groupBy(*names, *EXAMPLE).agg(F.sum(F.col("_a") * F.col("share")).alias("_s"))
    best = Window.partitionBy(*names).orderBy(F.desc("_s"))
    kth = sums.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select(*names, F.col("_s").alias("_reach"))
    kth = through_table(kth, "reached")
    least = F.greatest(F.coalesce("_reach", F.lit(0.0)), F.lit(floor)) - SLACK
    marked = through_table(
        asked.join(F.broadcast(kth) if kth.count() <= BROADCAST_ROWS else kth, names, "left").withColumn("_reach", least)
        .withColumn("_late", boost * F.col("_rest") < F.col("_reach")),
        "query-tokens",
    )
    early = marked.where(~F.col("_late"))
    left = marked.groupBy(*names).agg(
        F.max("_reach").alias("_reach"), F.coalesce(F.max(F.when(F.col("_late"), F.col("_rest"))), F.lit(0.0)).alias("_left")
    )
    early = early.join(left.select(*names, "_left"), names).select(*names, "token", *on[1:], "_a", "_reach", "_left")
    sums = _meet(postings, early, on).groupBy(*names, *EXAMPLE).agg(
        F.sum(F.col("_a") * F.col("share")).alias("_s"), F.first("_reach").alias("_reach"), F.first("_left").alias("_left")
    )
    stay = boost * (F.col("_s") + F.col("_left")) >= F.col("_reach")
    return through_table(sums.where(stay).select(*names, *EXAMPLE, "_s"), "candidates"), marked


def retrieve(
    index: ExampleIndex,
    queries: DataFrame,
    key: list[str],
    k: int = 8,
    text: str = "text",
    where: Column | None = None,
    book: tuple[str, str] | None = None,
    same: tuple[str, str] | None = None,
    fill: bool = True,
    floor: float = 0.0,
) -> DataFrame:
    """Top-k examples per query by cosine similarity.

    ``where`` filters the examples; ``same`` = (query column, example column)
    restricts each query to examples with the same value, any case; ``book`` =
    (query column, example column) raises by a fifth the score of examples
    whose name starts with the query name's first part.  Ties go to the later
    example.  ``fill`` answers every query in full: examples of its restriction
    without a common token count with score 0, and a query without any known
    token gets the diverse examples, as ranked there, with similarity 0.
    Examples below ``floor`` may be left out (with ``fill`` off).
    """
    pool = index.labels if where is None else index.examples.where(where)
    extras = [pair[1] for pair in (book, same) if pair]
    index = index.restricted(_words(queries, [], text).select("token"))
    postings = index.impacts
    if where is not None or not set(extras) <= set(index.carry):
        missing = [c for c in extras if c not in index.carry]
        postings = postings.join(pool.select(*EXAMPLE, *missing), EXAMPLE)
    keep = list(dict.fromkeys(pair[0] for pair in (book, same) if pair))
    names = {c: f"_k{i}" for i, c in enumerate(key)}
    asked = _asked(queries, index, key, keep, text, names)
    on = ["token"]
    if same:
        asked = asked.withColumn("_same", F.upper(f"_q_{same[0]}"))
        postings = postings.withColumn("_same", F.upper(same[1]))
        on.append("_same")
    asked = through_table(asked, "asked")
    boost = BOOST if book else 1.0
    near, tokens_of = candidates(index, postings, asked, list(names.values()), on, k, boost, floor)
    # What the other tokens add is looked up for the candidates alone.
    late = tokens_of.where("_late").select(*names.values(), "token", "_a")
    wanted = near.join(late, [*names.values()]).drop("_s")
    more = _meet(postings.select(*EXAMPLE, "token", "share"), wanted, [*EXAMPLE, "token"])
    added = more.select(*names.values(), *EXAMPLE, (F.col("_a") * F.col("share")).alias("_s"))
    scored = near.unionByName(added).groupBy(*names.values(), *EXAMPLE).agg(F.sum("_s").alias("_s"))
    score = F.col("_s")
    if book:
        asking = asked.select(*names.values(), F.col(f"_q_{book[0]}").alias("_qb")).distinct()
        titles = pool.select(*EXAMPLE, F.col(book[1]).alias("_eb"))
        scored = _meet(titles, scored, EXAMPLE).join(asking, [*names.values()])
        prefix = F.startswith("_eb", F.split_part("_qb", F.lit("_"), F.lit(1)))
        score = F.when(prefix, score * BOOST).otherwise(score)
    scored = scored.select(*names.values(), *EXAMPLE, F.round(score, SCORE_PLACES).alias("score"))
    best = Window.partitionBy(*names.values()).orderBy(F.desc("score"), *[F.desc(c) for c in EXAMPLE])

    def first_k(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    top = first_k(scored)
    if fill:
        every = queries.select(
            *[F.col(c).alias(n) for c, n in names.items()], *([F.upper(same[0]).alias("_same")] if same else [])
        ).distinct()
        known = asked.select(*names.values()).distinct()
        filler = _latest(pool, 2 * k, same[1] if same else None, every.join(known, [*names.values()], "left_semi"))
        rows = top.drop("rank").unionByName(filler.select(*names.values(), *EXAMPLE, F.lit(0.0).alias("score")))
        top = first_k(rows.groupBy(*names.values(), *EXAMPLE).agg(F.max("score").alias("score")))
        # At most k diverse examples: one short list for all unanswered queries.
        picked = [r.asDict() for r in diverse(index.labels, k).collect()]
        if picked:
            shown = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.items()]) for r in picked])
            unknown = every.join(known, [*names.values()], "left_anti").withColumn("_e", F.explode(shown))
            top = top.unionByName(
                unknown.select(*names.values(), *[F.col(f"_e.{c}").alias(c) for c in EXAMPLE], F.lit(0.0).alias("score"), "_e.rank")
            )
    renamed = {"doc_id": "example_doc", "para_id": "example_para"}
    return top.withColumnsRenamed(renamed).withColumnsRenamed(
        {v: c for c, v in names.items()}
    ).withColumn("similarity", F.round("score", 4)).drop("score")


def _leading(rows: DataFrame, one: Sequence[str]) -> DataFrame:
    """Rows (one, _same, token, idf, w) with share, what is left of the vector from a token on, and two hashes of the vector.

    All vectors have their tokens in one order, the highest idf first; it is
    gone through from the end, as a frame that runs to the end is summed anew
    for each row.  The ordered window comes first, so that the others need no
    sort of their own.
    """
    whole, square = Window.partitionBy(*one), F.col("w") * F.col("w")
    later = whole.orderBy("idf", F.xxhash64("token"), "token").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*one, "_same", "token", "idf", "w").withColumn("left", F.sum(square).over(later))
    rows = rows.select("*", F.sqrt(F.sum(square).over(whole)).alias("norm"), *[
        F.bit_xor(F.xxhash64("token", "w", "_same", F.lit(n))).over(whole).alias(f"_v{n}") for n in (1, 2)
    ])
    return rows.where("_same IS NOT NULL").select(
        *one, "_same", "token", (F.col("w") / F.col("norm")).alias("share"), (F.sqrt("left") / F.col("norm")).alias("left"), "_v1", "_v2"
    )


def nearest(
    index: ExampleIndex, queries: DataFrame, key: list[str], same: tuple[str, str], floor: float, text: str = "text"
) -> DataFrame:
    """(key, example_doc, example_para, similarity): what ``retrieve`` ranks first for a query, if that is above ``floor``.

    Of a pair above the floor, the first common token stands, in both vectors,
    where what is left of the vector is still as long as the floor.  So only
    these leading tokens meet, few where tokens are rare.  The product of the
    shares and that of what is left behind bound the score; what can still be
    the best is summed in full.  Equal vectors count as one, the latest example
    of them.  The index carries the example's column of ``same``.
    """
    names = {c: f"_k{i}" for i, c in enumerate(key)}
    least, one, vector = floor - SLACK, list(names.values()), ["_same", "_v1", "_v2"]
    renamed = queries.select(*[F.col(c).alias(n) for c, n in names.items()], F.upper(same[0]).alias("_same"), text)
    asked = index.looked_up(token_counts(renamed, [*one, "_same"], text)).withColumn("w", F.col("tf") * F.col("idf"))
    asked = through_table(_leading(asked, one), "asked")
    vectors = asked.groupBy(*vector, "token").agg(F.first("share").alias("_a"), F.first("left").alias("_left"))

    def restricted(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_same": F.upper(same[1]), "w": F.col("tf") * F.col("idf")})

    leading = _leading(restricted(index.known), EXAMPLE).where(F.col("left") >= least)
    leading = leading.groupBy(*vector, "token").agg(
        F.max(F.struct(*EXAMPLE)).alias("_e"), F.first("share").alias("share"), F.first("left").alias("left")
    ).select("_same", "token", "_e", "share", "left")
    first = through_table(vectors.where(F.col("_left") >= least), "asked-leading")
    few = first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = leading.join(F.broadcast(first) if few else first, ["_same", "token"])
    behind = lambda left, own: F.sqrt(F.greatest(F.col(left) * F.col(left) - F.col(own) * F.col(own), F.lit(0.0)))
    product = F.col("_a") * F.col("share")
    met = met.withColumn("_least", product).withColumn("_most", product + behind("_left", "_a") * behind("left", "share"))
    near = met.groupBy(*vector, "_e").agg(F.sum("_least").alias("_least"), F.max("_most").alias("_most"))
    reach = F.greatest(F.max("_least").over(Window.partitionBy(*vector)) - SLACK, F.lit(least))
    near = near.withColumn("_reach", reach).where("_most >= _reach").select(*vector, F.col("_e.*"))
    near = through_table(near, "near")

    wanted = near.select(F.xxhash64(*EXAMPLE).alias("_id")).distinct()
    shown = index.known.withColumn("_id", F.xxhash64(*EXAMPLE))
    shown = shown.join(F.broadcast(wanted) if wanted.count() <= 2 * BROADCAST_ROWS else wanted, "_id", "left_semi").drop("_id")
    shown = _leading(restricted(shown), EXAMPLE).select(
        F.col("_same").alias("_zone"), *[F.col(c).alias(f"_e_{c}") for c in EXAMPLE], "token", "share"
    )
    its = [F.col(f"_e_{c}").eqNullSafe(F.col(c)) for c in EXAMPLE] + [F.col("_zone") == F.col("_same")]
    pairs = near.join(shown, reduce(lambda a, b: a & b, its)).select(*vector, *EXAMPLE, "token", "share")
    scored = pairs.join(vectors.drop("_left"), [*vector, "token"]).groupBy(*vector, *EXAMPLE).agg(
        F.round(F.sum(F.col("_a") * F.col("share")), SCORE_PLACES).alias("score")
    )
    best = scored.groupBy(*vector).agg(F.max(F.struct("score", *EXAMPLE)).alias("_b"))
    best = best.withColumn("similarity", F.round("_b.score", 4)).where(F.col("similarity") > floor)
    every = asked.select(*one, *vector).distinct()
    return every.join(best, vector).select(
        *[F.col(n).alias(c) for c, n in names.items()],
        F.col(f"_b.{EXAMPLE[0]}").alias("example_doc"), F.col(f"_b.{EXAMPLE[1]}").alias("example_para"), "similarity",
    )


def _latest(pool: DataFrame, n: int, same: str | None, every: DataFrame) -> DataFrame:
    """Every query with the ``n`` latest examples of its restriction.

    A query with fewer than k hits can only be filled up from those.
    """
    order = [F.desc(c) for c in EXAMPLE]
    if same is None:
        last = pool.select(*EXAMPLE).orderBy(*order).limit(n).collect()
        if not last:
            return every.limit(0).select("*", *[F.lit(None).cast("long").alias(c) for c in EXAMPLE])
        pairs = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in last])
        return every.withColumn("_e", F.explode(pairs)).select("*", "_e.*").drop("_e")
    turn = F.row_number().over(Window.partitionBy("_same").orderBy(*order))
    last = pool.select(F.upper(same).alias("_same"), *EXAMPLE).withColumn("_turn", turn).where(F.col("_turn") <= n)
    return every.join(last.drop("_turn"), "_same")


def diverse(examples: DataFrame, k: int = 8, tag: str = "gold_tag") -> DataFrame:
    """First example of each tag in tag order, then the best aligned others.

    Both halves are aggregates and top-k selections; no tag group is collected.
    """
    first = examples.groupBy(tag).agg(F.min(F.struct(*EXAMPLE)).alias("_e"))
    picked = first.orderBy(tag).limit(k).select("_e.*", F.lit(0).alias("_part"), F.col(tag).alias("_by"))
    rest = (
        examples.join(F.broadcast(picked.select(*EXAMPLE)), EXAMPLE, "left_anti")
        .orderBy(F.desc("alignment_score"), *EXAMPLE)
        .limit(k)
        .select(*EXAMPLE, F.lit(1).alias("_part"), (-F.col("alignment_score")).cast("string").alias("_by"), "alignment_score")
    )
    ordered = picked.withColumn("alignment_score", F.lit(None).cast("double")).unionByName(rest)
    order = Window.partitionBy(F.lit(0)).orderBy(
        "_part", F.when(F.col("_part") == 0, F.col("_by")), F.desc("alignment_score"), *EXAMPLE
    )
    return (
        ordered.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(*EXAMPLE, "rank")
    )


def top_tags(index: ExampleIndex, n: int = 20, tag: str = "gold_tag") -> DataFrame:
    """The most frequent tags of the examples; ties by name."""
    return index.examples.groupBy(tag).agg(F.count("*").alias("n")).orderBy(F.desc("n"), tag).limit(n)


def stats(index: ExampleIndex) -> DataFrame:
    rows = index.examples.agg(
        F.count("*").alias("total_examples"),
        F.count_distinct("doc_id").alias("num_documents"),
        F.round(F.avg("alignment_score"), 6).alias("avg_alignment_score"),
    )
    size = index.idf.agg(F.count("*").alias("vocab_size"))
    return rows.join(F.broadcast(size), F.lit(True))


def knn_tags(
    index: ExampleIndex, rows: DataFrame, vocabulary: Vocabulary, floor: float = 0.7
) -> DataFrame:
    """Tag of the most similar example for unknown predictions, above ``floor``.

    ``rows`` has mapped_tag and zone; only rows whose mapped tag is unknown
    and whose nearest vocabulary entry is plain text are looked up.  The text
    is not handed on.
    """
    keyed = rows.withColumn("_norm", st.normalize_style(F.col("mapped_tag"))).withColumn(
        "normalized_tag", st.enforce_membership(F.col("_norm"), vocabulary)
    )
    ask = ~vocabulary.has("mapped_tag") & F.col("normalized_tag").isin("TXT", "TXT-FLUSH")
    # Written once, with the texts that are asked.
    keyed = keyed.withColumn("_ask", ask).withColumn("text", F.when(F.col("_ask"), F.col("text"))).drop("_norm")
    keyed = through_table(keyed, "knn-rows")
    asked, joined = keyed.where("_ask"), index.joined_to_rows()
    if "zone" in index.carry and joined is None:
        best = nearest(index, asked, EXAMPLE, ("zone", "zone"), floor)
    else:
        best = retrieve(joined or index, asked, EXAMPLE, k=1, same=("zone", "zone"), fill=False, floor=floor).where(F.col("similarity") > floor)
    tags = index.examples.select(
        F.col("doc_id").alias("example_doc"), F.col("para_id").alias("example_para"), "gold_tag"
    )
    found = best.join(tags, ["example_doc", "example_para"]).select(
        *EXAMPLE,
        "similarity",
        st.enforce_membership(st.normalize_style(F.col("gold_tag")), vocabulary).alias("_g"),
        "gold_tag",
    ).where((F.col("_g") != "TXT") | (F.col("gold_tag") == "TXT"))
    return keyed.join(found.select(*EXAMPLE, "similarity", F.col("_g").alias("knn_tag")), EXAMPLE, "left").withColumn(
        "final_tag", F.coalesce("knn_tag", "normalized_tag")
    ).drop("_ask", "text")
