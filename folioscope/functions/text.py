"""Text expressions: stripping, previews, normal forms, tokens, similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope import fixed

BLANK = r"[\s\x{00A0}]"


def any_of(patterns: list[str]) -> str:
    """One alternation, so a pattern set costs a single ``rlike``.

    Leading anchors are moved out of the alternation: an anchored set then
    fails at once on every later position of a long text.
    """
    anchored = [p[1:] for p in patterns if p.startswith("^")]
    free = [p for p in patterns if not p.startswith("^")]
    parts = [f"^(?:{'|'.join(anchored)})"] if anchored else []
    return "|".join(parts + ([f"(?:{'|'.join(free)})"] if free else []))


BLANKS = " \t\n\r\f\x0b\u00a0"


def strip_blank(text: Column) -> Column:
    """Strip blanks, tabs and no-break spaces at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values: list[str]) -> Column:
    return F.expr(f"array({', '.join(quoted(v) for v in values)})")


def is_one_of(value: Column | str, values: list[str]) -> Column:
    """Membership in a literal set; a column name keeps plan building cheap."""
    if isinstance(value, str):
        return F.expr(f"`{value}` IN ({', '.join(quoted(v) for v in values)})")
    return value.isin(values)


def folded(text: Column) -> Column:
    return F.lower(strip_blank(text))


def preview(text: Column, limit: int = 200) -> Column:
    """First ``limit`` characters, with dots where something was cut."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def collapse_blank(text: Column) -> Column:
    return strip_blank(F.regexp_replace(text, f"{BLANK}+", " "))


def matching_text(text: Column) -> Column:
    """Inline tags out, blanks collapsed, lower case (retrieval, cache, gold)."""
    return F.lower(
        collapse_blank(F.regexp_replace(text, fixed.ANY_TAG_PATTERN, " "))
    )


def searched_text(text: Column) -> Column:
    """Inline tags out and lower case: has the tokens of ``matching_text``, whose blanks part them alike."""
    plain = F.regexp_replace(text, fixed.ANY_TAG_PATTERN, " ")
    return F.lower(F.when(F.contains(text, F.lit("<")), plain).otherwise(text))


def comparison_text(text: Column) -> Column:
    """Blanks collapsed and lower case; tags stay."""
    return F.lower(collapse_blank(text))


def style_text(name: Column) -> Column:
    return collapse_blank(F.coalesce(name, F.lit("")))


def stem_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.TOKEN_PATTERN), F.lit(0))


def strip_xml_tags(text: Column) -> Column:
    return strip_blank(F.regexp_replace(text, fixed.XML_TAG_PATTERN, ""))


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` so that ``body`` may use it often: it is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length: the similarity that stays in the JVM."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        1.0 - F.levenshtein(a, b) / longest
    )


def _longest_block(a: Column, b: Column) -> Column:
    """(size, end) of the longest common block, the first of them in ``a``.

    Going along ``a``, the best size grows by one whenever the piece that ends
    here and is one longer occurs in ``b``; where it grows last, the block
    ends.
    """

    def step(best: Column, end: Column) -> Column:
        size = best["size"]
        longer = a.substr(end - size, size + 1)
        grows = (end > size) & F.contains(b, longer)
        return F.when(grows, F.struct((size + 1).alias("size"), end.alias("end"))).otherwise(best)

    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("end"))
    return F.aggregate(F.sequence(F.lit(1), F.length(a)), start, step)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio: twice the letters in matching blocks over all letters.

    The longest common block, then what is left of it, then what is right of
    it, taken from a list of open pairs of pieces.  Two empty texts are equal;
    null counts as empty.  It stays in the JVM; the work grows with the square
    of the texts, so give it names and paragraphs, not documents.
    """
    piece = "struct<a: string, b: string>"

    def split(state: Column, pair: Column, block: Column) -> Column:
        size, i = block["size"], block["end"] - block["size"]
        j = F.instr(pair["b"], pair["a"].substr(i + 1, size)) - 1
        whole = F.lit(1 << 30)
        before = F.struct(pair["a"].substr(F.lit(1), i).alias("a"), pair["b"].substr(F.lit(1), j).alias("b"))
        after = F.struct(pair["a"].substr(i + size + 1, whole).alias("a"), pair["b"].substr(j + size + 1, whole).alias("b"))
        todo = F.filter(F.array(before, after), lambda p: (p["a"] != "") & (p["b"] != ""))
        rest = F.slice(state["todo"], F.lit(2), F.greatest(F.size(state["todo"]) - 1, F.lit(0)))
        return F.struct(
            F.when(size > 0, F.concat(rest, todo)).otherwise(rest).alias("todo"), (state["same"] + size).alias("same")
        )

    def step(state: Column, _: Column) -> Column:
        pair = F.get(state["todo"], 0)
        return F.when(F.size(state["todo"]) == 0, state).otherwise(
            let(_longest_block(pair["a"], pair["b"]), lambda block: split(state, pair, block))
        )

    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    first = F.filter(F.array(F.struct(x.alias("a"), y.alias("b"))), lambda p: (p["a"] != "") & (p["b"] != ""))
    start = F.struct(first.cast(f"array<{piece}>").alias("todo"), F.lit(0).alias("same"))
    # Each step takes one pair of pieces; a block of one letter or more leaves at most two.
    turns = F.sequence(F.lit(0), 2 * F.least(F.length(x), F.length(y)))
    same = F.aggregate(turns, start, step, lambda s: s["same"])
    both = F.length(x) + F.length(y)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * same / both)


def string_map(table: dict[str, str]) -> Column:
    return F.expr(f"map({', '.join(quoted(v) for pair in table.items() for v in pair)})")


def looked_up(table: dict[str, str], key: Column) -> Column:
    """Literal-map lookup, null where the key is missing."""
    return F.try_element_at(string_map(table), key)
