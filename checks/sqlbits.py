"""SQL fragments shared by the checking queries (DuckDB dialect)."""

from __future__ import annotations

from folioscope import fixed
from folioscope.functions.styles import Vocabulary


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS _v({columns})"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def any_has(text: str, patterns) -> str:
    return "(" + " OR ".join(has(text, p) for p in patterns) + ")"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"


def collapse(text: str) -> str:
    return strip(f"regexp_replace({text}, '[\\s\\x{{00A0}}]+', ' ', 'g')")


def matching(text: str) -> str:
    return "lower(" + collapse(f"regexp_replace({text}, '<[^>]+>', ' ', 'g')") + ")"


def low(text: str) -> str:
    return f"lower({strip(text)})"


def count_chars(text: str, chars: str) -> str:
    return f"(length({text}) - length(translate({text}, {lit(chars)}, '')))"


VOCAB = Vocabulary()
VOCAB_SQL = in_list(VOCAB.names)


def aliased(x: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fixed.STYLE_ALIASES.items())
    return f"CASE {x} {whens} ELSE {x} END"


def normalize_steps(source: str, column: str, out: str, prefix: str = "nz") -> str:
    """CTEs ending in ``{prefix}9``: every source column plus ``out``.

    Written step by step (one step per CTE), unlike the single expression it
    checks.
    """
    p = prefix
    return f"""
{p}1 AS (SELECT *, {collapse(f"coalesce({column}, '')")} AS _a FROM {source}),
{p}2 AS (SELECT *, CASE WHEN contains(_a, 'BX') THEN replace(_a, '_', '-') ELSE _a END AS _b FROM {p}1),
{p}3 AS (SELECT *, CASE WHEN NOT contains(_a, 'BX') THEN _b
   WHEN regexp_matches(_b, '^[A-Z]{{2,}}[-_]?BX[-_](.+)$') THEN upper('BX4-' || regexp_extract(_b, '^[A-Z]{{2,}}[-_]?BX[-_](.+)$', 1))
   WHEN starts_with(_b, 'BX-') THEN upper('BX4-' || substr(_b, 4)) ELSE upper(_b) END AS _c FROM {p}2),
{p}4 AS (SELECT *, CASE WHEN regexp_matches(_c, '^SK_H[1-6]$') THEN _c
   WHEN regexp_matches(_c, '^[A-Z]{{2,}}_(.+)$') THEN regexp_extract(_c, '^[A-Z]{{2,}}_(.+)$', 1) ELSE _c END AS _d FROM {p}3),
{p}5 AS (SELECT *, CASE WHEN regexp_matches(_d, '^(SK_H|TBL-H)[1-6]$') THEN 'TH' || right(_d, 1)
   WHEN starts_with(_d, 'BX4-') THEN substr(_d, 5) WHEN starts_with(_d, 'NBX1-') THEN substr(_d, 6) ELSE _d END AS _e FROM {p}4),
{p}6 AS (SELECT *, {aliased('_e')} AS _f FROM {p}5),
{p}7 AS (SELECT *, CASE WHEN starts_with(_f, 'BX-') THEN 'BX4-' || substr(_f, 4) ELSE _f END AS _g FROM {p}6),
{p}8 AS (SELECT *, regexp_replace(_g, '-(FIRST|MID|LAST)$', '') AS _base FROM {p}7),
{p}9 AS (SELECT * EXCLUDE (_a, _b, _c, _d, _e, _f, _g, _base),
   CASE WHEN _base = _g THEN _g WHEN _base IN ('BL','NL','UL','TBL','TNL','TUL')
     OR regexp_matches(_base, '-(BL|NL|UL|TBL|TNL|TUL)$') THEN _g ELSE _base END AS {out} FROM {p}8)"""


def ref_entry(text: str) -> str:
    t = strip(text)
    l = f"lower({t})"
    p = f"{count_chars(t, '.;:,')} >= 2"
    return f"""({t} <> '' AND NOT {has(l, fixed.SUGGESTED_READING_PATTERN)} AND (
      {has(t, fixed.REF_NUMBER_PATTERN)} OR {has(t, fixed.REF_BULLET_PATTERN)}
      OR (({has(l, fixed.YEAR_PATTERN)} OR contains({l}, 'doi') OR contains({l}, 'et al')) AND {p})
      OR ({has(t, '[A-Za-z].*,.+[.]')} AND {p})))"""


def features_sum(t: str) -> str:
    return "(" + " + ".join(f"{has(t, p)}::INT" for p in fixed.REFERENCE_FEATURE_PATTERNS) + ")"


def citation(text: str, strict: bool) -> str:
    t = strip(text)
    start, count = any_has(t, fixed.CITATION_START_PATTERNS), features_sum(t)
    core = f"({start} AND {count} >= 2)" if strict else f"({start} OR {count} >= 3)"
    return f"(length({t}) >= 20 AND {core})"


def feature_any(text: str) -> str:
    t = strip(text)
    return f"(length({t}) >= 15 AND {any_has(t, fixed.REFERENCE_FEATURE_PATTERNS)})"


def numbered_not_ref(text: str) -> str:
    t = strip(text)
    return f"""(length({t}) < 50 AND {has(t, '^[0-9]+[.][[:space:]]+')} AND NOT ({has(t, fixed.YEAR_PATTERN)}
      OR {has(t, fixed.REFERENCE_FEATURE_PATTERNS[0])} OR contains(lower({t}), 'doi')
      OR {has(t, '(?i)\\b(journal|vol\\.|volume|press)\\b')}))"""


def untagged(text: str) -> str:
    inner = f"regexp_replace({text}, {lit(fixed.XML_TAG_PATTERN)}, '', 'g')"
    return f"lower({strip(inner)})"


def ref_heading(text: str) -> str:
    c = untagged(text)
    phrases = " OR ".join(f"contains({c}, {lit(h)})" for h in fixed.REFERENCE_HEADINGS)
    return f"({c} IN {in_list(fixed.REFERENCE_HEADINGS)} OR (length({c}) <= 80 AND NOT {has(c, '[.!?;:][[:space:]]*$')} AND ({phrases})))"


def secondary_heading(text: str) -> str:
    return f"({untagged(text)} IN {in_list(fixed.SECONDARY_REFERENCE_HEADINGS)})"


def zone_exit(text: str) -> str:
    return f"({has(text, fixed.ZONE_EXIT_PATTERN)} AND NOT {has(text, fixed.REFERENCE_TAG_PATTERN)})"


def box_start(text: str) -> str:
    return any_has(low(text), [f"^<{t}>" for t in fixed.BOX_TAGS])


def box_end(text: str) -> str:
    return any_has(low(text), [f"^</{t}>" for t in fixed.BOX_TAGS])


def box_type(text: str) -> str:
    t = low(text)
    whens = []
    for name in fixed.BOX_PREFIXES:
        tags = [g for g in fixed.BOX_TAGS if name.replace(" ", r"\s*") in g]
        cond = f"contains({t}, {lit(name)})"
        if tags:
            cond += " OR " + any_has(t, [f"^<{g}>" for g in tags])
        whens.append(f"WHEN {cond} THEN {lit(name)}")
    return f"CASE WHEN NOT {box_start(text)} THEN NULL {' '.join(whens)} ELSE 'box' END"


def box_zone(kind: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit('BOX_' + v)}" for k, v in fixed.BOX_PREFIXES.items())
    return f"CASE {kind} {whens} END"


def list_kind(text: str) -> str:
    t = strip(text)
    return (f"CASE WHEN {has(t, fixed.BULLET_PATTERN)} THEN 'bullet' WHEN {has(t, fixed.NUMBERING_PATTERN)} "
            f"THEN 'numbered' WHEN {has(t, fixed.LETTERED_ITEM_PATTERN)} THEN 'unordered' END")


def caption(text: str) -> str:
    t = low(text)
    return (f"CASE WHEN {any_has(t, fixed.FIGURE_CAPTION_PATTERNS)} THEN 'figure' "
            f"WHEN {any_has(t, fixed.TABLE_CAPTION_PATTERNS)} THEN 'table' END")


def box_prefix(zone: str, kind: str) -> str:
    zones = " ".join(f"WHEN {zone} = {lit(k)} THEN {lit(v)}" for k, v in fixed.BOX_ZONE_PREFIXES.items())
    kinds = " ".join(f"WHEN {kind} = {lit(k)} THEN {lit(v)}" for k, v in fixed.BOX_PREFIXES.items())
    return f"CASE {zones} {kinds} WHEN coalesce({kind}, '') <> '' THEN 'NBX' END"


def list_tag(kind: str, pos: str, zone: str, box: str, bullet_like: str, base: str) -> str:
    pre = f"coalesce({box_prefix(zone, box)}, 'NBX')"
    return f"""CASE WHEN coalesce({kind}, '') = '' OR coalesce({pos}, '') = '' THEN NULL ELSE (CASE
      WHEN contains({base}, '-BL') THEN split_part({base}, '-BL', 1) || '-BL'
      WHEN contains({base}, '-NL') THEN split_part({base}, '-NL', 1) || '-NL'
      WHEN contains({base}, '-UL') THEN split_part({base}, '-UL', 1) || '-UL'
      WHEN {zone} = 'TABLE' THEN CASE {kind} WHEN 'bullet' THEN 'TBL' WHEN 'numbered' THEN 'TNL' ELSE CASE WHEN {bullet_like} THEN 'TBL' ELSE 'TUL' END END
      WHEN {zone} LIKE 'BOX\\_%' ESCAPE '\\' THEN {pre} || CASE {kind} WHEN 'bullet' THEN '-BL' WHEN 'numbered' THEN '-NL' ELSE '-UL' END
      ELSE CASE {kind} WHEN 'bullet' THEN 'BL' WHEN 'numbered' THEN 'NL' ELSE CASE WHEN {bullet_like} THEN 'BL' ELSE 'UL' END END
      END) || '-' || {pos} END"""


def _starting(*prefixes: str) -> list[str]:
    return [n for n in VOCAB.names if n.startswith(prefixes)] + ["PMI"]


#: Zone lists of the checks, by rule from the vocabulary; other zones accept all.
ZONES = {
    "METADATA": _starting("H2"),
    "FRONT_MATTER": _starting("C", "OBJ", "KT", "H2", "H3", "TXT"),
    "TABLE": [n for n in _starting("T", "UNT") if not n.startswith("TXT")],
    **{f"BOX_{f}": _starting(f"{f}-") for f in ("NBX", "BX1", "BX2", "BX3", "BX4")},
    "BACK_MATTER": _starting("REF", "SR", "BIB", "FIG", "UNFIG", "EOC", "APX", "BM", "TFN", "TSN"),
    "EXERCISE": _starting("EXER"),
}


def exact_zone_ok(tag: str, zone: str, styles=None) -> str:
    whens = " ".join(
        f"WHEN {zone} = {lit(z)} THEN ({tag} IN {in_list(s)} OR rtrim({tag}, '0123456789') IN {in_list(s)})"
        for z, s in (styles or ZONES).items()
    )
    return f"(CASE {whens} ELSE TRUE END)"


def wildcard_zone_ok(tag: str, zone: str) -> str:
    whens = []
    for z, entries in fixed.ZONE_WILDCARDS.items():
        parts = [
            f"starts_with({tag}, {lit(e[:-1])})" if e.endswith("*") else f"{tag} = {lit(e)}"
            for e in entries
        ]
        whens.append(f"WHEN {zone} = {lit(z)} THEN ({' OR '.join(parts)})")
    return f"(CASE {' '.join(whens)} ELSE TRUE END)"


def nearest_table(tags: str, column: str, out: str, fold: bool, at_least: float = 0.6) -> str:
    """Subquery: tag -> most similar vocabulary entry (ties: length, name)."""
    a = f"upper({column})" if fold else column
    b = "upper(v.style)" if fold else "v.style"
    return f"""(SELECT {column} AS tag, {out} FROM (
      SELECT t.{column}, v.style AS {out},
        CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE
             ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END AS s,
        row_number() OVER (PARTITION BY t.{column} ORDER BY s DESC, length(v.style), v.style) AS rn
      FROM (SELECT DISTINCT {column} FROM {tags}) t, (SELECT style FROM {values([(n,) for n in VOCAB.names], 'style')}) v
    ) WHERE rn = 1 AND s >= {at_least})"""


def chain_case(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in VOCAB.chain_map().items()) + " END"


def family_pick(x: str) -> str:
    """Shortest vocabulary entry of the family, by scanning the vocabulary."""
    return (f"(SELECT style FROM {values([(n,) for n in VOCAB.names], 'style')} "
            f"WHERE contains({x}, '-') AND starts_with(style, regexp_replace({x}, '-[^-]*$', '') || '-') "
            f"ORDER BY length(style), style LIMIT 1)")
