"""Prepared record tables: everything that is derived from a record alone, once per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.udf import to_latin


class Lexicon:
    """Per-country word and phrase equivalences, classes of words, and pairs of look-alike names.

    ``words``: (country, field, variant, canonical), field name, addr or both, country or "*".
    ``classes``: (country, word, kind); ``conflicts``: (country, a, b). All are small tables
    of a lexicon's size and become literals of the plan; ``MOST`` is their checked bound.
    """

    MOST = 50_000

    def __init__(self, words=(), classes=(), conflicts=()):
        if max(map(len, (words, classes, conflicts)), default=0) > self.MOST:
            raise ValueError(f"a lexicon table has over {self.MOST} rows")
        self.words, self.classes, self.conflicts = list(words), list(classes), list(conflicts)
        self.countries = sorted({r[0] for r in [*self.words, *self.classes, *self.conflicts]} - {"*"})

    def apply(self, norm, country, field: str):
        """Rewrite a normalised text by its country's phrases (longest first), then words; addresses drop junk words."""
        out = None
        for label in [*self.countries, "*"]:
            rows = [(v, c) for k, f, v, c in self.words if k == label and f in (field, "both")]
            t = norm
            for variant, canonical in sorted((r for r in rows if " " in r[0]), key=lambda r: -len(r[0])):
                t = F.regexp_replace(t, rf"(?<!\S){X.escaped([variant])}(?!\S)", canonical)
            single = {v: c for v, c in rows if " " not in v}
            w = X.tokens(t)
            w = F.transform(w, X.lookup(single)) if single else w
            if field == "addr":
                w = F.filter(w, lambda x: ~x.isin(X.fixed.LEXICON_DROP))
            if label == "*":
                return X.joined(w) if out is None else out.otherwise(X.joined(w))
            out = F.when(country == label, X.joined(w)) if out is None else out.when(country == label, X.joined(w))

    def known(self, country):
        """Array of a country's words that don't tell names apart."""
        return self._of(country, {k: [w for c, w, kind in self.classes if c == k and kind in X.fixed.NOT_DISTINCT] for k in self.countries})

    def lookalikes(self, country):
        return self._of(country, {k: ["|".join(sorted(p)) for c, *p in self.conflicts if c == k] for k in self.countries})

    @staticmethod
    def _of(country, lists: dict[str, list[str]]):
        empty = F.array().cast("array<string>")
        return F.coalesce(*[F.when(country == k, X.literals(v)) for k, v in lists.items() if v], empty)


def prepare(records: DataFrame, lexicon: Lexicon | None = None, romanise: bool = True, gazetteer=None, baseline: bool = False) -> DataFrame:
    """All derived columns of ``records``. ``romanise=False`` keeps everything in the JVM (Latin texts only).

    ``baseline`` leaves out OCR repair and the lexicon, for comparisons.
    """
    lexicon = Lexicon() if lexicon is None or baseline else lexicon
    name, address = X.text(F.col("business_name")), X.text(F.col("business_address"))
    latin = lambda c: F.when(c.rlike(r"[^\x00-\x{5FF}]"), to_latin(c)).otherwise(X.fold_latin(c)) if romanise else X.fold_latin(c)
    key = X.country_key(F.col("country"))

    def norm(c, kind):
        if kind == "name" and not baseline:
            c = X.fix_ocr(c)
        return lexicon.apply(X.clean(latin(c), kind), key, kind)

    halves = X.split_landmarks(address)
    rows = records.withColumns({"ckey": key, "country": X.canon_country(F.col("country")), "_parts": halves, "_dba": X.split_trade_names(name)})
    rows = rows.withColumns({"norm_name": norm(name, "name"), "ml_addr": norm(address, "addr"), "norm_addr": norm(F.col("_parts.core"), "addr"), "landmark": norm(F.col("_parts.landmark"), "addr"), "nonlatin": X.nonlatin(name)})
    # trade names of romanised scripts would need a UDF inside a lambda: the Latin normaliser serves, which keeps what it cannot read
    rows = rows.withColumn("dba", F.transform("_dba", lambda p: X.normalize(p, "name")))
    rows = rows.withColumns({"core": X.core_name(F.col("norm_name")), "_address": X.address_parts(F.col("ml_addr")), "key_indic": X.phonetic_key(F.col("norm_name"), "indic"), "key_french": X.phonetic_key(F.col("norm_name"), "french")})
    rows = rows.withColumns(
        {
            **{k: F.col(f"_address.{k}") for k in ("pc", "unit", "house", "arr")},
            "name_nums": X.numbers(F.col("norm_name")),
            "nums": X.numbers(F.col("norm_addr")),
            "distinct": X.distinct_tokens(F.col("norm_name"), lexicon.known(F.col("ckey"))),
            "region": X.region_key(F.col("country"), F.col("ml_addr"), gazetteer),
        }
    )
    return core_frequency(rows.drop("_parts", "_dba", "_address"))


def core_frequency(prepared: DataFrame) -> DataFrame:
    """How many records of the table share country and core: counted with partial aggregation, then joined."""
    counts = prepared.groupBy("country", "core").agg(F.count("*").alias("core_freq"))
    return prepared.join(counts, ["country", "core"], "left").select(*prepared.columns, "core_freq")


def core_frequency_window(df: DataFrame, *keys: str) -> DataFrame:
    """The same as a window, for tables without hot keys."""
    return df.withColumn("core_freq", F.count("*").over(Window.partitionBy(*keys)))
