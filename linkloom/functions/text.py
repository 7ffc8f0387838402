"""Text functions of record linkage as Column expressions: all run inside the JVM.

Null texts count as empty. Patterns are Unicode-aware where raw text is read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def bound(c: Column, use) -> Column:
    """``use`` of ``c``, which is evaluated once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def tokens(c: Column) -> Column:
    """Words between white space; no words gives an empty array. Names ``c`` once, as each mention would be evaluated."""
    return F.array_remove(F.split(text(c), r"\s+"), "")


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def looked_up(table: dict[str, str], c: Column) -> Column:
    """The value of ``c`` in a small fixed table, or ``c`` itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c)


def lookup(table: dict[str, str]):
    return lambda w: looked_up(table, w)


def literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


# --- countries --------------------------------------------------------------


def canon_country(c: Column) -> Column:
    """The label of a country's spelling; other countries are an open set, in capitals."""
    s = F.regexp_replace(F.lower(F.trim(text(c))), "[^a-z0-9]", "")
    table = {w: k for k, ws in fixed.COUNTRIES.items() for w in ws.split()}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), s), F.upper(s))


def country_key(c: Column) -> Column:
    """The lexicon's country: letters only, "*" if unknown."""
    s = F.regexp_replace(F.lower(text(c)), "[^a-z]", "")
    table = {w: k for k, ws in fixed.LEXICON_COUNTRIES.items() for w in ws.split()}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), s), F.lit("*"))


# --- scripts ----------------------------------------------------------------


def script_of(ch: Column) -> Column:
    """The script of a one-character string."""
    o = F.ascii(ch)
    out = F.when(o < 0x80, "ascii")
    for name, lo, _ in fixed.SCRIPTS:
        out = out.when(o.between(lo, lo + fixed.SCRIPT_WIDTH - 1), name)
    return out.when(o.between(*fixed.ARABIC), "arabic").when(o.between(*fixed.LATIN_ACCENTED), "latin_accented").otherwise("other")


def scripts_in(c: Column) -> Column:
    """The distinct scripts of a text's letters, without ascii, sorted."""
    letters = F.regexp_extract_all(text(c), F.lit(r"(\p{L})"), F.lit(1))
    return F.array_sort(F.array_remove(F.array_distinct(F.transform(letters, script_of)), "ascii"))


def nonlatin(c: Column) -> Column:
    """Whether a letter is neither ASCII nor accented Latin."""
    return text(c).rlike(r"[\p{L}&&[^\x00-\x7FÀ-ɏ]]")


# --- Latin letters ----------------------------------------------------------


def _accents() -> tuple[str, str]:
    """Accented Latin letters and what their decomposition begins with, by rule from the Unicode database."""
    import unicodedata

    pairs = []
    for o in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        d = unicodedata.normalize("NFKD", chr(o))
        base = "".join(x for x in d if not unicodedata.combining(x))
        if base != chr(o) and len(base) == 1 and ord(base) < 128:
            pairs.append((chr(o), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def fold_latin(c: Column) -> Column:
    """Latin text in lower-case ASCII: ligatures and signs replaced, accents removed. Other scripts stay (see ``udf.to_latin``)."""
    one = {k: v for k, v in fixed.CHARACTERS.items() if len(v) == 1}
    more = {k: v for k, v in fixed.CHARACTERS.items() if len(v) != 1}
    t = F.translate(text(c), "".join(one), "".join(one.values()))
    t = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), more.items(), t)
    return F.lower(F.regexp_replace(F.translate(t, _FROM, _TO), r"\p{M}+", ""))


def normalize_legacy(c: Column) -> Column:
    """The plain normaliser: accents off, & as and, everything but letters and digits a blank."""
    t = F.regexp_replace(F.replace(F.lower(F.regexp_replace(F.translate(text(c), _FROM, _TO), r"\p{M}+", "")), F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean(folded: Column, kind: str, canonical: bool = True) -> Column:
    """The normaliser behind ``fold_latin``: canonical lower-case tokens joined by blanks. ``kind``: name or addr."""
    t = folded
    if kind == "name":
        t = F.regexp_replace(t, r"^\s*(?:m/s\.?|messrs\.?|m\.s\.)\s*", "")
    steps = [
        (r"'s\b", ""),
        (r"(\d)\s*[-/]\s*(?=\d)", "$1-"),
        (r"(\d{5})-\d{4}\b", "$1"),
        (r"&", " & "),
        (r"[^a-z0-9\-&]+", " "),
        (r"(?<![0-9])-|-(?![0-9])", " "),
    ]
    if kind == "addr":
        steps += [(r"\b([1-9]\d{2})\s+(\d{3})\b", "$1$2"), (r"\bcedex\s*\d*\b", " ")]
    steps += [
        (r"\b(\d+)(?:st|nd|rd|th|er|ere|e|eme|ieme)\b", "$1"),
        (r"\b(\d+)\s*([bt])(?:is|er)\b", "$1$2"),
        (r"\b([a-z])\s+(?=[a-z]\b)", "$1"),
    ]
    steps += fixed.PHRASES
    t = reduce(lambda x, s: F.regexp_replace(x, *s), steps, t)
    words = tokens(t)
    if canonical:
        words = F.transform(words, lambda w: looked_up(fixed.canonical_words(), looked_up(fixed.number_words(), w)))
    if kind == "addr":
        words = F.filter(words, lambda w: ~w.isin(fixed.ADDRESS_DROP))
    return joined(words)


def normalize(c: Column, kind: str, canonical: bool = True) -> Column:
    """Normalised Latin text; romanise other scripts first."""
    return clean(fold_latin(c), kind, canonical)


def fix_ocr(c: Column) -> Column:
    """Digits that stand for letters in words of names (hea1th, 6roup, c0m), then lower case and lnc -> inc.

    A word changes if it is of letters and 0 1 5 6 8, has one or two digits, and three letters or more,
    or two letters around one digit.
    """

    def word(w: Column) -> Column:
        digits, letters = F.length(F.regexp_replace(w, "[^0-9]", "")), F.length(F.regexp_replace(w, "[^A-Za-z]", ""))
        around = (letters == 2) & (digits == 1) & w.rlike("^[A-Za-z].*[A-Za-z]$")
        noisy = w.rlike("^[A-Za-z01568]+$") & digits.between(1, 2) & ((letters >= 3) | around)
        return F.when(noisy, F.translate(w, "".join(fixed.OCR), "".join(fixed.OCR.values()))).otherwise(w)

    # runs of letters and the digits in question, and what lies between them
    parts = F.regexp_extract_all(text(c), F.lit(r"([A-Za-z01568]+|[^A-Za-z01568]+)"), F.lit(1))
    return F.regexp_replace(F.lower(F.array_join(F.transform(parts, word), "")), r"\bl(?=[nm][a-z]+)", "i")


# --- names ------------------------------------------------------------------


def core_name(norm: Column) -> Column:
    """A name without legal and filler words; the whole name if nothing else is left."""
    kept = F.filter(tokens(norm), lambda w: ~w.isin(fixed.CORE_STOP))
    return F.when(F.size(kept) > 0, joined(kept)).otherwise(text(norm))


def initials(c: Column) -> Column:
    w = tokens(c)
    return F.when(F.size(w) >= 2, F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), "")).otherwise(F.lit(""))


def _collapsed(w: Column) -> Column:
    return F.regexp_replace(w, r"(.)\1+", "$1")


def _word_key(w: Column, rules: list[tuple[str, str]], final: str) -> Column:
    k = _collapsed(reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), rules, w))
    if final:
        short = F.regexp_replace(k, f"[{final}]+$", "")
        k = F.when(short != "", short).otherwise(k)
    return F.concat(F.substring(k, 1, 1), F.regexp_replace(F.substring(k, 2, 1 << 20), "[aeiou]", ""))


def word_key(word: Column, style: str) -> Column:
    """The key of one word (style: indic or french); a word with digits stays."""
    rules, final = (fixed.INDIC_KEY, "") if style == "indic" else (fixed.FRENCH_KEY, fixed.FRENCH_FINAL)
    return F.when(word.rlike("[0-9]"), word).otherwise(_word_key(word, rules, final))


def phonetic_key(norm: Column, style: str) -> Column:
    """Each word's key (style: indic or french); words with digits stay."""
    return joined(F.transform(tokens(norm), lambda w: word_key(w, style)))


def loan_key(word: Column) -> Column:
    """The key of a loanword's spelling: consonants by sound, vowels, y and h only at the beginning, doubled letters once."""
    k = reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), fixed.LOAN_KEY, text(word))
    return _collapsed(F.concat(F.substring(k, 1, 1), F.regexp_replace(F.substring(k, 2, 1 << 20), "[aeiouyh]", "")))


def split_trade_names(raw: Column) -> Column:
    """The names in a raw name that trade-name words or brackets part; the name itself if nothing else is left."""
    parts = F.transform(F.split(text(raw), "(?i)(?U)" + fixed.TRADE_NAME), lambda p: F.regexp_replace(p, r"^[ ,.\-]+|[ ,.\-]+$", ""))
    kept = F.filter(parts, lambda p: p != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(text(raw)))


def distinct_tokens(norm: Column, known: Column) -> Column:
    """Words of a name that are not in ``known`` (an array of its country's legal, title and generic words)."""
    words = tokens(norm)
    kept = F.filter(words, lambda w: ~F.coalesce(F.array_contains(known, w), F.lit(False)))
    return F.when(F.size(kept) > 0, joined(kept)).otherwise(joined(words))


def name_conflict(a: Column, b: Column, pairs: Column) -> Column:
    """1 if a word of only one name and one of only the other are a known pair of different names ("x|y", x < y), else 0."""
    xs, ys = F.array_except(tokens(a), tokens(b)), F.array_except(tokens(b), tokens(a))
    hit = F.exists(xs, lambda x: F.exists(ys, lambda y: F.coalesce(F.array_contains(pairs, F.concat_ws("|", F.least(x, y), F.greatest(x, y))), F.lit(False))))
    return F.when(hit, 1.0).otherwise(0.0)


# --- addresses --------------------------------------------------------------


def split_landmarks(raw: Column) -> Column:
    """struct(core, landmark) of a raw address: landmark segments between commas, else inline ones with up to three words."""
    u = "(?i)(?U)"
    t = text(raw)
    hindi = F.regexp_extract_all(t, F.lit(u + "(" + fixed.LANDMARK_HINDI + ")"), F.lit(1))
    segments = F.split(F.regexp_replace(t, u + fixed.LANDMARK_HINDI, " "), "[,;]")
    start = u + r"^\s*(?:" + fixed.LANDMARK_START + r")\b"
    marks = F.concat(hindi, F.filter(segments, lambda s: s.rlike(start)))
    core = F.array_join(F.filter(segments, lambda s: ~s.rlike(start)), ", ")
    inline = F.regexp_extract_all(core, F.lit(u + "(" + fixed.LANDMARK_INLINE + ")"), F.lit(1))
    none = F.size(marks) == 0
    return F.struct(
        F.when(none, F.regexp_replace(core, u + fixed.LANDMARK_INLINE, " ")).otherwise(core).alias("core"),
        F.array_join(F.when(none, inline).otherwise(marks), " ").alias("landmark"),
    )


def address_parts(norm: Column) -> Column:
    """struct(pc, unit, house, arr) of a normalised address; "" where a part is missing."""
    return bound(text(norm), lambda t: bound(_postcode(t), lambda pc: _parts(t, pc)))


def _postcode(t: Column) -> Column:
    last = lambda p: F.try_element_at(F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1)), F.lit(-1))
    return F.coalesce(last(fixed.PIN), last(fixed.ZIP), F.lit(""))


def _parts(t: Column, pc: Column) -> Column:
    houses = F.regexp_extract_all(F.regexp_replace(t, fixed.UNIT, " "), F.lit(f"({fixed.HOUSE})"), F.lit(1))
    house = F.coalesce(F.try_element_at(F.array_remove(houses, pc), F.lit(1)), F.lit(""))
    city = F.create_map(*[F.lit(x) for kv in fixed.ARRONDISSEMENTS.items() for x in kv])
    coded = F.concat(F.try_element_at(city, F.substring(pc, 1, 2)), F.substring(pc, 4, 2).cast("int").cast("string"))
    named = r"\b(paris|lyon|marseille) (\d{1,2})\b"
    said = F.coalesce(F.concat(F.regexp_extract(t, named, 1), F.regexp_extract(t, named, 2).try_cast("int").cast("string")), F.lit(""))
    by_code = (F.length(pc) == 5) & F.substring(pc, 1, 2).isin(*fixed.ARRONDISSEMENTS) & (F.substring(pc, 3, 1) == "0") & (F.substring(pc, 4, 2) != "00")
    return F.struct(pc.alias("pc"), F.regexp_extract(t, fixed.UNIT, 1).alias("unit"), house.alias("house"), F.when(by_code, coded).otherwise(said).alias("arr"))


def _value_in(table: Column):
    return lambda w: F.try_element_at(table, w)


def region_key(country: Column, norm: Column, gazetteer=None, phrases: dict[str, str] | None = None) -> Column:
    """The one region that an address's words name; "" if none, several, or the country has no gazetteer.

    In the US, words count among the first two and last three, phrases anywhere.
    """
    rows = fixed.GAZETTEER if gazetteer is None else gazetteer
    phrases = fixed.REGION_PHRASES if phrases is None else phrases
    words = tokens(norm)
    out = F.lit("")
    for label in sorted({c for c, _, _ in rows}):
        table = F.create_map(*[F.lit(x) for c, r, w in rows if c == label for x in (w, r)])
        where = F.concat(F.slice(words, -F.least(F.size(words), F.lit(3)), 3), F.slice(words, 1, 2)) if label == "US" else words
        found = F.transform(F.when(F.size(words) > 0, where).otherwise(words), _value_in(table))
        if label == "US":
            found = F.concat(found, F.array(*[F.when(text(norm).rlike(rf"(?<!\S)(?:{p})(?!\S)"), F.lit(r)) for r, p in phrases.items()]))
        regions = F.array_distinct(F.array_compact(found))
        out = F.when((country == label) & (F.size(regions) == 1), F.try_element_at(regions, F.lit(1))).otherwise(out)
    return out


def numbers(c: Column) -> Column:
    """The distinct digit runs of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"([0-9]+)"), F.lit(1))))


# --- pairs ------------------------------------------------------------------


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def length_ratio(a: Column, b: Column) -> Column:
    x, y = F.length(text(a)), F.length(text(b))
    return F.least(x, y) / F.greatest(x, y, F.lit(1))


def acronym(core_a: Column, core_b: Column) -> Column:
    """1 if the initials of one core are the other without blanks."""
    hit = lambda a, b: (initials(a) != "") & (initials(a) == F.replace(text(b), F.lit(" "), F.lit("")))
    return F.when(hit(core_a, core_b) | hit(core_b, core_a), 1.0).otherwise(0.0)


def is_abbreviation(short: Column, long: Column) -> Column:
    """Whether ``short`` is shorter, begins alike, and its letters come in order in ``long``."""
    order = F.concat(F.lit("^"), F.array_join(F.transform(F.split(short, ""), lambda ch: F.concat(F.lit("\\Q"), ch, F.lit("\\E"))), ".*"))
    return (F.length(short) > 0) & (F.length(short) < F.length(long)) & F.regexp_like(long, order)


def same_if_known(a: Column, b: Column) -> Column:
    """1 or 0 if both texts are there, else null: missing evidence is no evidence."""
    return F.when((text(a) != "") & (text(b) != ""), (a == b).cast("double"))


def grams(c: Column) -> Column:
    """The set of a text's words and adjacent word pairs."""
    w = tokens(c)
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(w, pairs))


def escaped(words) -> str:
    return "|".join(re.escape(w) for w in words)
