"""Style-name expressions: normal form, membership, nearest style, list tags.

Vocabularies, zone tables and chains are bounded parameters (plain Python
collections).  They are folded into the plan as literals, so membership tests
and remaps run inside the projection and never shuffle the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import fixed
from folioscope.functions.patterns import starts_with_ref_bullet
from folioscope.functions.text import (
    collapse_blank,
    edit_similarity,
    is_one_of,
    let,
    literal_array,
    looked_up,
    quoted,
    strip_blank,
)

_BASES = "|".join(fixed.LIST_BASES)
_POSITIONS = "|".join(fixed.LIST_POSITIONS)


def normalize_style(name: Column, box_prefix: Column | None = None) -> Column:
    """Canonical spelling of a style name.

    Order: blanks; box spelling (`EFP_BX-`, `BX-` become the default box
    family, upper case); vendor prefix; `SK_Hn`/`TBL-Hn` to `THn`, else the
    illegal family prefixes; aliases; `BX-` expansion; list positions on
    non-list bases.  Each step names its input once, so the expression stays
    linear in size.
    """
    text = collapse_blank(F.coalesce(name.cast("string"), F.lit("")))
    boxed = F.upper(
        F.regexp_replace(
            F.translate(text, "_", "-"), "^(?:[A-Z]{2,}-?BX-(?=.)|BX-)", "BX4-"
        )
    )
    text = F.when(text.contains("BX"), boxed).otherwise(text)
    text = F.regexp_replace(text, "^(?!SK_H[1-6]$)[A-Z]{2,}_(?=.)", "")
    text = F.regexp_replace(text, "^(?:SK_H|TBL-H)([1-6])$", "TH$1")
    text = F.regexp_replace(text, "^(?:BX4-|NBX1-)", "")
    text = F.coalesce(looked_up(fixed.STYLE_ALIASES, text), text)
    expansion = F.lit(f"{fixed.DEFAULT_BOX_PREFIX}-")
    if box_prefix is not None:
        expansion = F.concat(
            F.coalesce(
                F.nullif(box_prefix, F.lit("")), F.lit(fixed.DEFAULT_BOX_PREFIX)
            ),
            F.lit("-"),
        )
    text = F.regexp_replace(text, F.lit("^BX-"), expansion)
    return F.regexp_replace(
        text,
        f"(?<!^(?:{_BASES}))(?<!-(?:{_BASES}))-(?:{_POSITIONS})$",
        "",
    )


def normalize_name(name: str | None) -> str:
    """The same normal form for one parameter value (vocabulary entries)."""
    text = re.sub(r"\s+", " ", (name or "").replace("\u00a0", " ").strip())
    if "BX" in text:
        text = text.replace("_", "-")
        text = re.sub(r"^(?:[A-Z]{2,}-?BX-(?=.)|BX-)", "BX4-", text).upper()
    text = re.sub(r"^(?!SK_H[1-6]$)[A-Z]{2,}_(?=.)", "", text)
    text = re.sub(r"^(?:SK_H|TBL-H)([1-6])$", r"TH\1", text)
    text = re.sub(r"^(?:BX4-|NBX1-)", "", text)
    text = fixed.STYLE_ALIASES.get(text, text)
    text = re.sub(r"^BX-", f"{fixed.DEFAULT_BOX_PREFIX}-", text)
    m = re.fullmatch(rf"(.*)-(?:{_POSITIONS})", text)
    if m and m[1] not in fixed.LIST_BASES and not m[1].endswith(
        tuple(f"-{b}" for b in fixed.LIST_BASES)
    ):
        text = m[1]
    return text


def normalized(
    column: str, vocabulary: Vocabulary, box_prefix: Column | None = None
) -> Column:
    """Normal form of a column, with a hash lookup first: allowed tags, nearly
    all rows, skip the pattern steps."""
    return F.when(is_one_of(column, vocabulary.stable), F.col(column)).otherwise(
        normalize_style(F.col(column), box_prefix)
    )


class Vocabulary:
    """The bounded set of allowed styles, normalised and in tie-break order."""

    MAX_SIZE = 50_000

    def __init__(self, styles: Iterable[str] | DataFrame | None = None):
        if isinstance(styles, DataFrame):
            # Distinct names are counted, not rows; too many raise, none are cut.
            name = F.col(styles.columns[0])
            rows = styles.where(name.isNotNull()).select(name).distinct().limit(self.MAX_SIZE + 1).collect()
            if len(rows) > self.MAX_SIZE:
                raise ValueError(f"vocabulary exceeds {self.MAX_SIZE} styles")
            styles = [r[0] for r in rows]
        elif styles is None:
            styles = fixed.default_vocabulary()
        names = {normalize_name(s) for s in styles}
        names -= {"", *fixed.INVALID_VOCABULARY_ENTRIES}
        if len(names) > self.MAX_SIZE:
            raise ValueError(f"vocabulary exceeds {self.MAX_SIZE} styles")
        if not names:
            raise ValueError("vocabulary is empty")
        # Ties in similarity and prefix search: shortest, then alphabetical.
        self.names: list[str] = sorted(names, key=lambda s: (len(s), s))

    def __contains__(self, name: str) -> bool:
        return name in self._set

    @cached_property
    def _set(self) -> frozenset[str]:
        return frozenset(self.names)

    def has(self, tag: Column | str) -> Column:
        return is_one_of(tag, self.names)

    @cached_property
    def stable(self) -> list[str]:
        """Names that are their own normal form."""
        return [n for n in self.names if normalize_name(n) == n]

    def first(self, *candidates: str) -> str | None:
        """First candidate whose normal form is allowed (as spelled)."""
        return next((c for c in candidates if normalize_name(c) in self), None)

    def chain_map(self) -> dict[str, str]:
        """Unknown tag -> first allowed tag of its chain."""
        hits = {
            tag: self.first(*chain) for tag, chain in fixed.FALLBACK_CHAINS.items()
        }
        return {t: normalize_name(c) for t, c in hits.items() if c} or {"": ""}

    def family_map(self) -> dict[str, str]:
        """Family prefix -> its shortest member."""
        best: dict[str, str] = {}
        for name in self.names:
            for at in (i for i, ch in enumerate(name) if ch == "-"):
                best.setdefault(name[:at], name)
        return best

    def array(self) -> Column:
        return literal_array(self.names)


def _literal_or_null(value: str | None) -> Column:
    return F.lit(value).cast("string")


def nearest(tag: Column, vocabulary: Vocabulary, fold_case: bool = False,
            at_least: float = 0.6) -> Column:
    """Most similar allowed style, null below the threshold (edit similarity).

    Evaluated against the literal vocabulary, so the work is rows x vocabulary
    with no join; callers guard it so only unknown tags reach it.  Styles whose
    length alone keeps them below the threshold are not compared.
    """

    def scores(probe: Column) -> Column:
        def score(style: Column, i: Column) -> Column:
            other = F.upper(style) if fold_case else style
            longest = F.greatest(F.length(probe), F.length(other))
            apart = F.abs(F.length(probe) - F.length(other)) > (1 - at_least) * longest + 1e-6
            return F.struct(F.when(apart, F.lit(-1.0)).otherwise(edit_similarity(probe, other)).alias("s"), (-i).alias("i"))

        return F.array_max(F.transform(vocabulary.array(), score))

    best = let(F.upper(tag) if fold_case else tag, scores)
    return F.when(
        best["s"] >= at_least,
        F.element_at(vocabulary.array(), (1 - best["i"]).cast("int")),
    )


def family_fallback(tag: Column, vocabulary: Vocabulary) -> Column:
    """Fallback of the normaliser when nothing is similar enough."""
    last = _literal_or_null(vocabulary.first("TXT") or "TXT")

    def pick(*names: str) -> Column:
        hit = next((n for n in names if n in vocabulary), None)
        return F.coalesce(_literal_or_null(hit), last)

    digit = tag.rlike(r"\d")
    return (
        F.when(tag.startswith("H") & digit, pick("H3", "H2", "H1", "TXT"))
        .when(
            tag.contains("BL") | F.upper(tag).contains("BULLET"),
            pick("BL-MID", "BL", "TXT"),
        )
        .when(
            tag.contains("NL") | F.upper(tag).contains("NUMBER"),
            pick("NL-MID", "NL", "TXT"),
        )
        .when(tag.contains("REF"), pick("REF-U", "REF-N", "TXT"))
        .when(tag.contains("FIG"), pick("FIG-LEG", "TXT"))
        .when(tag.startswith("T") & digit, pick("T", "TXT"))
        .otherwise(last)
    )


def enforce_membership(norm: Column, vocabulary: Vocabulary) -> Column:
    """Normalised tag -> allowed tag: itself, nearest, or the family ladder."""
    return F.when(
        ~vocabulary.has(norm),
        F.when(norm == "", F.lit("TXT")).otherwise(
            F.coalesce(
                nearest(norm, vocabulary, fold_case=True),
                family_fallback(norm, vocabulary),
            )
        ),
    ).otherwise(norm)


def semantic_match(norm: Column, vocabulary: Vocabulary) -> Column:
    """Related allowed style: chain, then family, then similar; else null."""
    families = vocabulary.family_map()
    stem = F.regexp_extract(norm, "^(.*)-[^-]*$", 1)
    return F.coalesce(
        looked_up(vocabulary.chain_map(), norm),
        looked_up(families, stem) if families else _literal_or_null(None),
        nearest(norm, vocabulary),
    )


def ensure_allowed(norm: Column, vocabulary: Vocabulary, fallback: str = "TXT") -> Column:
    """Normalised tag -> allowed tag: itself, related, fallback, TXT, itself."""
    last = vocabulary.first(fallback, "TXT")
    return F.when(vocabulary.has(norm), norm).otherwise(
        F.coalesce(
            semantic_match(norm, vocabulary),
            _literal_or_null(normalize_name(last) if last else None),
            norm,
        )
    )


def zone_accepts_exact(
    tag: str, zone: str, zone_styles: dict[str, list[str]] | None = None
) -> Column:
    """Exact list test, a second time without trailing digits; unknown zones accept.

    The lists are a parameter (``sources.vocabulary.load_zone_rules``); without
    any every zone accepts.  Takes column names; the test is one expression.
    """
    if not zone_styles:
        return F.lit(True)
    cases = []
    for name, styles in zone_styles.items():
        listed = ", ".join(quoted(s) for s in styles)
        cases.append(
            f"WHEN {quoted(name)} THEN `{tag}` IN ({listed}) "
            f"OR regexp_replace(`{tag}`, '[0-9]+$', '') IN ({listed})"
        )
    return F.expr(f"CASE `{zone}` {' '.join(cases)} ELSE TRUE END")


def zone_accepts_wildcard(
    tag: str, zone: str, wildcards: dict[str, list[str]] | None = None
) -> Column:
    """Wildcard test: exact entries or `prefix*`; unknown zones accept."""
    cases = []
    for name, entries in (wildcards or fixed.ZONE_WILDCARDS).items():
        exact = ", ".join(quoted(e) for e in entries if not e.endswith("*"))
        starts = [
            f"startswith(`{tag}`, {quoted(e[:-1])})" for e in entries if e.endswith("*")
        ]
        tests = ([f"`{tag}` IN ({exact})"] if exact else []) + starts
        cases.append(f"WHEN {quoted(name)} THEN {' OR '.join(tests)}")
    return F.expr(f"CASE `{zone}` {' '.join(cases)} ELSE TRUE END")


def sanitize_tag(raw: Column, vocabulary: Vocabulary) -> Column:
    """Strict token, else first known token, else first token, else TXT."""
    up = F.upper(strip_blank(F.coalesce(raw, F.lit(""))))
    found = F.regexp_extract_all(up, F.lit("[A-Z0-9]+(?:[_-][A-Z0-9]+)*"), F.lit(0))
    known = F.filter(found, lambda c: vocabulary.has(normalize_style(c)))
    return F.when(up.rlike("^[A-Z0-9]+(?:[_-][A-Z0-9]+)*$"), up).otherwise(
        F.coalesce(F.get(known, 0), F.get(found, 0), F.lit("TXT"))
    )


def box_prefix(zone: Column, kind: Column) -> Column:
    """Prefix fixed by the zone, else by the box type, else null."""
    by_type = F.when(
        F.nullif(kind, F.lit("")).isNotNull(),
        F.coalesce(looked_up(fixed.BOX_PREFIXES, kind), F.lit("NBX")),
    )
    return F.coalesce(looked_up(fixed.BOX_ZONE_PREFIXES, zone), by_type)


def list_tag(
    kind: Column,
    position: Column,
    zone: Column,
    box_kind: Column,
    bullet_like: Column,
    base_tag: Column | None = None,
) -> Column:
    """Tag a list item should carry from its structure; null for other rows."""
    bullet, numbered = kind == "bullet", kind == "numbered"

    def by_kind(bl: Column, nl: Column, ul: Column) -> Column:
        return F.when(bullet, bl).when(numbered, nl).otherwise(ul)

    boxed = F.coalesce(box_prefix(zone, box_kind), F.lit("NBX"))
    suffix = by_kind(F.lit("-BL"), F.lit("-NL"), F.lit("-UL"))
    prefix = (
        F.when(
            zone == "TABLE",
            by_kind(
                F.lit("TBL"), F.lit("TNL"), F.when(bullet_like, "TBL").otherwise("TUL")
            ),
        )
        .when(zone.startswith("BOX_"), F.concat(boxed, suffix))
        .otherwise(
            by_kind(
                F.lit("BL"), F.lit("NL"), F.when(bullet_like, "BL").otherwise("UL")
            )
        )
    )
    if base_tag is not None:
        for marker in ("-UL", "-NL", "-BL"):
            kept = F.concat(
                F.substring_index(base_tag, marker, 1), F.lit(marker)
            )
            prefix = F.when(base_tag.contains(marker), kept).otherwise(prefix)
    present = (F.coalesce(kind, F.lit("")) != "") & (
        F.coalesce(position, F.lit("")) != ""
    )
    return F.when(present, F.concat(prefix, F.lit("-"), position))


def map_tag_alias(
    df: DataFrame,
    tag: str,
    vocabulary: Vocabulary,
    out: str = "mapped_tag",
    zone: str = "zone",
    text: str = "text",
    in_ref: str = "in_ref",
    box_prefix_col: str | None = None,
) -> DataFrame:
    """Known reply aliases and malformed variants -> allowed tags.

    An ordered ladder; a rung applies only if its candidate is allowed, else
    the next rung is tried.  The sanitised, normalised tag is staged once.
    """
    v = vocabulary
    prefix = F.col(box_prefix_col) if box_prefix_col else None
    staged = df.withColumn(
        "_m", normalize_style(sanitize_tag(F.col(tag), v), prefix)
    ).withColumns(
        {
            "_short": F.regexp_extract(F.col("_m"), r"^\d+-([A-Z0-9-]+)$", 1),
            "_zp": F.when(
                F.col(zone).startswith("BOX_"), F.col(zone).substr(F.lit(5), F.length(zone))
            ),
            "_bul": starts_with_ref_bullet(strip_blank(F.col(text))),
            "_ref": F.coalesce(F.col(in_ref), F.lit(False))
            | (F.coalesce(F.col(zone), F.lit("")) == "REFERENCE"),
        }
    )
    m, zp, bul, ref = F.col("_m"), F.col("_zp"), F.col("_bul"), F.col("_ref")
    place = F.coalesce(F.col(zone), F.lit(""))
    rungs: list[tuple[Column, Column]] = []

    def rung(when: Column, value: Column | str | None) -> None:
        if value is not None:
            rungs.append((when, F.lit(value) if isinstance(value, str) else value))

    def rung_if_allowed(when: Column, value: Column) -> None:
        rungs.append((when & v.has(value), value))

    def first(*names: str) -> str | None:
        return next((n for n in names if n in v), None)

    ref_tag = F.when(bul, "REF-U").otherwise("REF-N")
    rung_if_allowed(ref & m.rlike("^(UL|BL|NL)-"), ref_tag)
    rung_if_allowed(ref & (m == "BIBITEM"), ref_tag)
    rung(m == "BIBITEM", first("REF-U", "REF-N", "TXT"))
    rung(m == "COUT", first("COUT-1", "COUT-2", "TXT"))
    rung(m == "HH", first("H1") or "TXT")
    rung_if_allowed(m == "REF", ref_tag)
    for token, in_table in (("TYPE", ["T"]), ("TTL", ["T1", "T2", "T"])):
        rung_if_allowed(
            (m == token) & zp.isNotNull(), F.concat(zp, F.lit(f"-{token}"))
        )
        rung(
            (m == token) & (place == "TABLE"),
            first(*in_table) or (token if token == "TYPE" else None),
        )
    for kind, base in (("BL", "TBL"), ("NL", "TNL"), ("UL", "TUL")):
        shape = m.rlike(f"^TBL-{kind}-({_POSITIONS})$")
        rung_if_allowed(
            shape, F.concat(F.lit(base), F.regexp_extract(m, "(-[A-Z]+)$", 1))
        )
        rung(shape, first(f"{base}-MID"))
    rung(m == "TBL-TXT", first("T", "TD", "TXT"))
    rung(m == "BL-TXT", first("BL-MID", "TXT"))
    vendor = m.rlike("^(EFP|EYU)-")
    rest = m.substr(F.lit(5), F.length(m))
    rung_if_allowed(
        vendor & rest.startswith("BX-"),
        F.concat(F.lit("BX4-"), rest.substr(F.lit(4), F.length(rest))),
    )
    rung_if_allowed(vendor, rest)
    rung(vendor & (rest == "BX"), first("TXT"))
    # From here on a numeric prefix (`1-TTL`) is dropped from the working tag.
    w = F.when(F.col("_short") != "", F.col("_short")).otherwise(m)
    rung_if_allowed(zp.isNotNull(), F.concat(zp, F.lit("-"), w))
    rung_if_allowed(F.col("_short") != "", F.concat(F.lit("BX"), m))
    for suffix in ("TTL", "TYPE", "TXT"):
        rung_if_allowed(
            zp.isNotNull() & w.rlike(r"^\d+$"), F.concat(zp, F.lit(f"-{suffix}"))
        )
    family = (place == "TABLE") & w.rlike("^(BX|NBX|KT-|KP-|OBJ-)")
    for pos in ("FIRST", "LAST", "MID"):
        rung(family & w.endswith(f"-{pos}"), first(f"TBL-{pos}"))
    rung(family, F.lit("T") if "T" in v else w)
    rung((place == "TABLE") & w.rlike(r"^H\d+$"), first("TH1", "T2", "T"))
    rung_if_allowed(
        (place == "BACK_MATTER")
        & ~w.isin("SR", "SRH1")
        & w.rlike("^(FIG-|T|REF|H)"),
        ref_tag,
    )
    ladder = F.when(rungs[0][0], rungs[0][1])
    for cond, value in rungs[1:]:
        ladder = ladder.when(cond, value)
    return staged.withColumn(out, ladder.otherwise(w)).drop(
        "_m", "_short", "_zp", "_bul", "_ref"
    )


def foreign_style(tag: Column) -> Column:
    """Style-sheet names of other formats, under three spellings; else null."""
    up = F.upper(tag)
    return F.coalesce(
        looked_up(fixed.FOREIGN_STYLES, F.translate(up, "-_", "  ")),
        looked_up(fixed.FOREIGN_STYLES, F.translate(up, " _", "--")),
        looked_up(fixed.FOREIGN_STYLES, up),
    )


def trust_lock(
    norm: Column,
    tag: Column,
    confidence: Column,
    text: Column,
    vocabulary: Vocabulary,
    keep_marker_pmi: bool = False,
    floor: float = 0.90,
) -> Column:
    """Rows whose tag the repair ladder must not touch."""
    locked = vocabulary.has(norm) & (confidence >= floor)
    if keep_marker_pmi:
        t = strip_blank(text)
        locked = (
            locked | ((tag == "PMI") & t.startswith("<")) | (F.upper(t) == "<BL>")
        )
    return locked
