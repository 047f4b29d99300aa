"""URL filtering by fixed host rules and by mined association rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import let
from folioscope.session import through_table

#: (verdict, host and path) rules that go before the mined ones.
FIXED_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BAD = "is:bad"
#: Support is this part of the labelled pages, and so many pages at least.
MIN_SUPPORT = 0.005
MIN_PAGES = 20
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to /, ? or #, A-Z lower-cased;
    then up to ? or #.  Both are empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule fits its host and all subdomains, if the path starts with its own.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host suffixes and words, path words, query keys, scheme.

    Numbers are left out: they name one page and not a kind of page.
    """
    host, path = url_parts(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")

    def of_host(x: Column) -> Column:
        suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1))), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(x, k, F.size(x)), ".")))
        words = F.transform(F.flatten(F.transform(x, lambda y: F.split(y, "-"))), lambda y: F.concat(F.lit("word:"), y))
        return F.concat(suffixes, words)

    steps = F.filter(F.split(path, r"[/.]"), lambda x: x.rlike("^[^0-9]+$"))
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), 1)
    made = F.concat(
        let(labels, of_host),
        F.transform(steps, lambda x: F.concat(F.lit("path:"), F.lower(x))),
        F.transform(query, lambda x: F.concat(F.lit("query:"), x)),
    )
    return F.array_distinct(made)


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
) -> DataFrame:
    """(rule_id, tokens, confidence, support) of token sets that speak for bad pages.

    ``labelled`` has url and bad (0/1).  FP-growth finds the frequent token
    sets; a rule stays if confidence, support and lift are high enough and no
    part of its tokens is a rule of at least its confidence.  Without labels,
    or without such sets, there are no rules.
    """
    baskets = through_table(
        labelled.where("url IS NOT NULL AND bad IS NOT NULL").select(
            F.when(F.col("bad") == 1, F.array_append(url_tokens(F.col("url")), BAD)).otherwise(url_tokens(F.col("url"))).alias("items")
        ),
        "url-baskets",
    )
    least = min(1.0, max(min_support, MIN_PAGES / max(baskets.count(), 1)))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    strong = through_table(
        model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
        .where(F.col("lift") >= min_lift)
        .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"),
        "url-rules",
    )
    part = strong.select(F.col("tokens").alias("_t"), F.col("confidence").alias("_c"))
    inside = (F.size("_t") < F.size("tokens")) & (F.col("_c") >= F.col("confidence")) & (F.size(F.array_except("_t", "tokens")) == 0)
    # parts share a token with the whole, so the rules meet by token and not in all pairs
    redundant = (
        strong.withColumn("_k", F.explode("tokens"))
        .join(part.withColumn("_k", F.explode("_t")), "_k")
        .where(inside)
        .select("tokens")
        .distinct()
    )
    return strong.join(redundant, "tokens", "left_anti").withColumn("rule_id", F.xxhash64("tokens"))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule_id, confidence): the best mined rule of every url that has one.

    Inverted index: each rule stands under its rarest token, and only a url
    with that token is compared with it.  Distinct urls are matched once.
    """
    tokens = pages.select("url").where("url IS NOT NULL").distinct().withColumn("_own", url_tokens(F.col("url")))
    posts = tokens.select("url", "_own", F.explode("_own").alias("_k"))
    common = posts.join(rules.select(F.explode("tokens").alias("_k")).distinct(), "_k", "left_semi").groupBy("_k").agg(F.count("*").alias("_n"))
    rarest = F.row_number().over(Window.partitionBy("rule_id").orderBy("_n", "_k"))
    index = (
        rules.withColumn("_k", F.explode("tokens"))
        .join(common, "_k", "left")
        .withColumn("_turn", rarest)
        .where("_turn = 1")
        .select("_k", "rule_id", "tokens", "confidence")
    )
    met = posts.join(index, "_k").where(F.size(F.array_except("tokens", "_own")) == 0)
    best = F.max_by(F.struct("rule_id", "confidence"), F.struct("confidence", "rule_id"))
    return met.groupBy("url").agg(best.alias("_b")).select("url", "_b.rule_id", "_b.confidence")


def judge_urls(pages: DataFrame, labelled: DataFrame, fixed: Sequence[tuple[str, str]] = FIXED_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule and confidence of every page.

    The longest fixed rule that fits decides; elsewhere a page is blocked when
    a mined rule matches and allowed otherwise.  A null url has an empty host
    and path and is allowed.  Repeated rows are judged alike; an empty table
    gives no rows.
    """
    host, path = url_parts(F.col("url"))
    rule, verdict = fixed_rule(host, path, fixed)
    rows = pages.select("page_id", "url")
    found = match_rules(rows, mine_rules(labelled)).withColumnRenamed("rule_id", "mined_rule")
    mined = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(found, "url", "left").select(
        "page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "mined_rule", "confidence"
    )


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages made from a labelled document.

    The number at the end of a page's path is the doc_id of its document; a
    page is bad when that document is of low quality or toxic.
    """
    doc = F.regexp_extract(F.regexp_extract(F.col("url"), r"^[^?#]*", 0), r"/([0-9]{1,18})(?:[/.][^/]*)?$", 1)
    known = labels.groupBy("doc_id").agg(F.max(F.greatest(1 - F.col("quality"), F.col("toxic"))).alias("bad"))
    return pages.select("url", F.when(doc != "", doc).cast("long").alias("doc_id")).join(known, "doc_id").select("url", "bad")
