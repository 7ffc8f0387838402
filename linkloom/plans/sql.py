"""Generators of DuckDB SQL text that says the same as ``functions.text``, for the oracle."""

from __future__ import annotations

from ..functions import fixed


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(expr: str) -> str:
    """Words between white space as a list."""
    return f"list_filter(string_split_regex(coalesce({expr}, ''), '\\s+'), lambda w: w <> '')"


def mapped(table: dict[str, str], expr: str) -> str:
    return f"coalesce(MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in table.items())}}}[{expr}], {expr})"


def case(table: dict[str, str], expr: str, other: str) -> str:
    return f"coalesce(MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in table.items())}}}[{expr}], {other})"


def listed(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def joined(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def replaced(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(by)}, 'g')"


def canon_country(expr: str) -> str:
    s = replaced(f"lower(trim(coalesce({expr}, '')))", "[^a-z0-9]", "")
    return case({w: k for k, ws in fixed.COUNTRIES.items() for w in ws.split()}, s, f"upper({s})")


def country_key(expr: str) -> str:
    s = replaced(f"lower(coalesce({expr}, ''))", "[^a-z]", "")
    return case({w: k for k, ws in fixed.LEXICON_COUNTRIES.items() for w in ws.split()}, s, "'*'")


def fold_latin(expr: str) -> str:
    t = f"coalesce({expr}, '')"
    for k, v in fixed.CHARACTERS.items():
        t = f"replace({t}, {q(k)}, {q(v)})"
    return f"lower(strip_accents({t}))"


def normalize_legacy(expr: str) -> str:
    t = replaced(f"replace(lower(strip_accents(coalesce({expr}, ''))), '&', ' and ')", r"[^a-z0-9\s]", " ")
    return f"trim({replaced(t, r'\s+', ' ')})"


def clean(folded: str, kind: str, canonical: bool = True) -> str:
    """RE2 has no look-around: marks in the text stand for what it would keep."""
    t = folded
    if kind == "name":
        t = replaced(t, r"^\s*(?:m/s\.?|messrs\.?|m\.s\.)\s*", "")
    t = replaced(t, r"'s\b", "")
    for _ in range(2):  # matches may share a digit: a joined pair no longer matches
        t = replaced(t, r"(\d)(?:\s+[-/]\s*|[-/]\s+|/)(\d)", r"\1-\2")
    t = replaced(t, r"(\d{5})-\d{4}\b", r"\1")
    t = replaced(f"replace({t}, '&', ' & ')", r"[^a-z0-9\-&]+", " ")
    for _ in range(2):
        t = replaced(t, r"(\d)-(\d)", r"\1~\2")
    t = f"replace(replace({t}, '-', ' '), '~', '-')"
    if kind == "addr":
        t = replaced(replaced(t, r"\b([1-9]\d{2})\s+(\d{3})\b", r"\1\2"), r"\bcedex\s*\d*\b", " ")
    t = replaced(t, r"\b(\d+)(?:st|nd|rd|th|er|ere|e|eme|ieme)\b", r"\1")
    t = replaced(t, r"\b(\d+)\s*([bt])(?:is|er)\b", r"\1\2")
    # single letters in a row become one word: mark each, then drop the marks between them
    t = replaced(f"' ' || {replaced(t, r'\s+', '  ')} || ' '", " ([a-z]) ", r"<\1>")
    t = f"trim({replaced(f'''replace(replace(replace({t}, '><', ''), '<', ' '), '>', ' ')''', r'\s+', ' ')})"
    for pattern, by in fixed.PHRASES:
        t = replaced(t, pattern, by)
    w = words(t)
    if canonical:
        inner = mapped(fixed.number_words(), "w")
        w = f"list_transform(list_transform({w}, lambda w: {inner}), lambda w: {mapped(fixed.canonical_words(), 'w')})"
    if kind == "addr":
        w = f"list_filter({w}, lambda w: NOT list_contains({listed(fixed.ADDRESS_DROP)}, w))"
    return joined(w)


def normalize(expr: str, kind: str, canonical: bool = True) -> str:
    return clean(fold_latin(expr), kind, canonical)


def core_name(expr: str) -> str:
    kept = f"list_filter({words(expr)}, lambda w: NOT list_contains({listed(fixed.CORE_STOP)}, w))"
    return f"CASE WHEN len({kept}) > 0 THEN {joined(kept)} ELSE coalesce({expr}, '') END"


def initials(expr: str) -> str:
    return f"CASE WHEN len({words(expr)}) >= 2 THEN array_to_string(list_transform({words(expr)}, lambda w: w[1]), '') ELSE '' END"


def collapsed(expr: str) -> str:
    """Doubled characters once: RE2 has no back-references, so each letter has its turn."""
    for ch in "abcdefghijklmnopqrstuvwxyz":
        expr = replaced(expr, f"{ch}{ch}+", ch)
    return expr


def phonetic_key(expr: str, style: str) -> str:
    rules, final = (fixed.INDIC_KEY, "") if style == "indic" else (fixed.FRENCH_KEY, fixed.FRENCH_FINAL)
    k = "w"
    for a, b in rules:
        k = f"replace({k}, {q(a)}, {q(b)})"
    steps = f"list_transform(list_transform({words(expr)}, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '#' || w ELSE {collapsed(k)} END)"
    if final:
        stripped = replaced("w", f"[{final}]+$", "")
        steps += f", lambda w: CASE WHEN w LIKE '#%' OR {stripped} = '' THEN w ELSE {stripped} END)"
    else:
        steps += ", lambda w: w)"
    return joined(f"list_transform({steps}, lambda w: CASE WHEN w LIKE '#%' THEN w[2:] ELSE w[1] || {replaced('w[2:]', '[aeiou]', '')} END)")


def loan_key(expr: str) -> str:
    k = f"coalesce({expr}, '')"
    for a, b in fixed.LOAN_KEY:
        k = f"replace({k}, {q(a)}, {q(b)})"
    return collapsed(f"({k})[1] || {replaced(f'({k})[2:]', '[aeiouyh]', '')}")


def split_trade_names(expr: str) -> str:
    parts = f"list_filter(list_transform(string_split_regex(coalesce({expr}, ''), {q('(?i)' + fixed.TRADE_NAME)}), lambda p: trim(p, ' ,.-')), lambda p: p <> '')"
    return f"CASE WHEN len({parts}) > 0 THEN {parts} ELSE [coalesce({expr}, '')] END"


def numbers(expr: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(coalesce({expr}, ''), '[0-9]+')))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"
