"""One query per operator over the test tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..functions.udf import similarity, to_latin
from ..operators import blocking, groups, judging, mining, model, pairs, policy
from ..operators import prepare as prepare_
from ..operators.prepare import Lexicon, prepare
from ..sources import adapters, records
from ..sources.stage import place, staged
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scans --------------------------------------------------------------------

_KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id", "lineitem": "l_orderkey"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, count(DISTINCT {k}) AS n_keys FROM {t}" for t, k in _KEYS.items()))
def scan_assert_counts(spark, sf_dir):
    out = None
    for t, k in _KEYS.items():
        row = table(spark, sf_dir, t).agg(F.count("*").alias("n_rows"), F.countDistinct(k).alias("n_keys")).select(F.lit(t).alias("name"), "n_rows", "n_keys")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def scan_unique_key(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 37 = 5")
def systematic_sample(spark, sf_dir):
    return records.systematic_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 37, 5)


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') c ON o_custkey = c_custkey")
def key_filtered_scan(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(ids, "o_custkey", "left_semi")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def head_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


# --- records ------------------------------------------------------------------

_COUNTRIES = ["U.S.A.", "India", "bharat", "France", "fr", "République Française", "Peru", ""]
_SQL_COUNTRY = f"{S.listed(_COUNTRIES)}[CAST(c_custkey % {len(_COUNTRIES)} + 1 AS INTEGER)]"


def _spelled(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.element_at(X.literals(_COUNTRIES), (F.col("c_custkey") % len(_COUNTRIES) + 1).cast("int")).alias("label"))


@query(f"SELECT c_custkey, {S.canon_country(_SQL_COUNTRY)} AS country FROM customer")
def country_canon(spark, sf_dir):
    return _spelled(spark, sf_dir).select("c_custkey", X.canon_country(F.col("label")).alias("country"))


@query(f"SELECT c_custkey, {S.country_key(_SQL_COUNTRY)} AS ckey FROM customer")
def country_key(spark, sf_dir):
    return _spelled(spark, sf_dir).select("c_custkey", X.country_key(F.col("label")).alias("ckey"))


_DOC_NAME = r"array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), ' ')"


def _doc_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("name"))


def _over_names(name: str, column: str, expr, sql: str) -> None:
    """A query of one text function over the documents' whole texts, as names."""
    ORACLE[name] = f"WITH t AS (SELECT doc_id, {_DOC_NAME} AS name FROM documents) SELECT doc_id, {sql} AS {column} FROM t"

    def f(spark, sf_dir):
        return _doc_names(spark, sf_dir).select("doc_id", expr(F.col("name")).alias(column))

    QUERIES[name] = f


_over_names("normalize_legacy", "norm", X.normalize_legacy, S.normalize_legacy("name"))
_over_names("core_name", "core", lambda c: X.core_name(X.normalize_legacy(c)), S.core_name(S.normalize_legacy("name")))
_over_names("stopword_fallback", "core", lambda c: X.core_name(X.joined(F.filter(X.tokens(X.normalize_legacy(c)), lambda w: w.isin(fixed.CORE_STOP)))), S.core_name(S.joined(f"list_filter({S.words(S.normalize_legacy('name'))}, lambda w: list_contains({S.listed(fixed.CORE_STOP)}, w))")))
_over_names("initials", "initials", lambda c: X.initials(X.normalize_legacy(c)), S.initials(S.normalize_legacy("name")))
_over_names("to_latin_accents", "latin", X.fold_latin, S.fold_latin("name"))
_over_names("phonetic_key_indic", "key", lambda c: X.phonetic_key(X.normalize_legacy(c), "indic"), S.phonetic_key(S.normalize_legacy("name"), "indic"))
_over_names("phonetic_key_french", "key", lambda c: X.phonetic_key(X.normalize_legacy(c), "french"), S.phonetic_key(S.normalize_legacy("name"), "french"))
_over_names("nonlatin_flag", "nonlatin", X.nonlatin, r"regexp_matches(regexp_replace(name, '[\x00-\x7FÀ-ɏ]', '', 'g'), '\pL')")


@query()
def romanised(spark, sf_dir):
    """Every whole text through the romaniser: an Arrow UDF."""
    return table(spark, sf_dir, "documents").select("doc_id", to_latin(F.col("text")).alias("latin"))


@query(
    r"""
    WITH t AS (SELECT lang, source, list_distinct(list_transform(regexp_extract_all(text, '\pL'), lambda c: CASE WHEN unicode(c) < 128 THEN 'ascii' WHEN unicode(c) BETWEEN 192 AND 591 THEN 'latin_accented' ELSE 'other' END)) AS s FROM documents),
    n AS (SELECT lang, count(*) AS n_rows FROM t GROUP BY 1),
    e AS (SELECT lang, unnest(s) AS script FROM t)
    SELECT e.lang, script, round(count(*) / any_value(n_rows), 6) AS share FROM e JOIN n ON e.lang = n.lang WHERE script <> 'ascii' GROUP BY e.lang, script
    """
)
def script_audit(spark, sf_dir):
    return mining.script_audit(table(spark, sf_dir, "documents"), "text", "lang").select("lang", "script", F.round("share", 6).alias("share"))


# Text with the forms that normalisation is about, made from part.
_FORMS = [
    "M/s. {n} Bros & Sons Private Limited",
    "{n} m g rd, 2nd Floor, PIN 560 001",
    "{k} - 3 / 45 Main Road, Paris 75008",
    "{n}'s Shopping Mall dba Joe's Pizza (old)",
    "Shop No {k}, next to City Hall, New York 10001-1234",
    "12 bis rue de la Paix cedex 07, 5eme etage",
    "hea1th c0m lnc {n} 6roup",
    "twenty first {n} Technologies, opp. Big Bazaar; block 7b",
]
_SQL_FORM = "replace(replace(" + S.listed(_FORMS) + f"[CAST(p_partkey % {len(_FORMS)} + 1 AS INTEGER)], '{{n}}', p_name), '{{k}}', CAST(p_partkey AS VARCHAR))"


def _forms(spark, sf_dir):
    k = F.col("p_partkey")
    form = F.element_at(X.literals(_FORMS), (k % len(_FORMS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(F.replace(form, F.lit("{n}"), F.col("p_name")), F.lit("{k}"), k.cast("string")).alias("t"))


def _over_forms(name: str, columns: dict[str, tuple]) -> None:
    ORACLE[name] = f"WITH t AS (SELECT p_partkey, {_SQL_FORM} AS t FROM part) SELECT p_partkey, " + ", ".join(f"{sql} AS {c}" for c, (_, sql) in columns.items()) + " FROM t"

    def f(spark, sf_dir):
        return _forms(spark, sf_dir).select("p_partkey", *[e(F.col("t")).alias(c) for c, (e, _) in columns.items()])

    QUERIES[name] = f


_over_forms("canonical_names", {"norm": (lambda c: X.normalize(c, "name"), S.normalize("t", "name"))})
_over_forms("canonical_addresses", {"norm": (lambda c: X.normalize(c, "addr"), S.normalize("t", "addr"))})
_over_forms("raw_tokens", {"norm": (lambda c: X.normalize(c, "name", canonical=False), S.normalize("t", "name", canonical=False))})
_over_forms("number_words", {"norm": (lambda c: X.joined(F.transform(X.tokens(F.lower(c)), lambda w: X.looked_up(fixed.number_words(), w))), S.joined(f"list_transform({S.words('lower(t)')}, lambda w: {S.mapped(fixed.number_words(), 'w')})"))})
_over_forms("number_set", {"nums": (lambda c: X.joined(X.numbers(c)), S.joined(S.numbers("t")))})
_over_forms("split_trade_names", {"names": (lambda c: F.array_join(X.split_trade_names(c), "|"), f"array_to_string({S.split_trade_names('t')}, '|')")})

_SQL_OCR_WORD = (
    "CASE WHEN regexp_matches(w, '^[A-Za-z01568]+$') AND len(regexp_replace(w, '[^0-9]', '', 'g')) BETWEEN 1 AND 2 AND (len(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 3 "
    "OR (len(regexp_replace(w, '[^A-Za-z]', '', 'g')) = 2 AND len(regexp_replace(w, '[^0-9]', '', 'g')) = 1 AND regexp_matches(w, '^[A-Za-z].*[A-Za-z]$'))) "
    "THEN translate(w, '01568', 'olsgb') ELSE w END"
)
_over_forms("ocr_fix", {"fixed": (X.fix_ocr, f"regexp_replace(lower(array_to_string(list_transform(regexp_extract_all(t, '[A-Za-z01568]+|[^A-Za-z01568]+'), lambda w: {_SQL_OCR_WORD}), '')), '\\bl([nm][a-z]+)', 'i\\1', 'g')")})

_SQL_MARKS = f"list_filter(string_split_regex(t, '[,;]'), lambda s: regexp_matches(s, {S.q('(?i)^\\s*(?:' + fixed.LANDMARK_START + r')\b')}))"
_SQL_CORE = f"array_to_string(list_filter(string_split_regex(t, '[,;]'), lambda s: NOT regexp_matches(s, {S.q('(?i)^\\s*(?:' + fixed.LANDMARK_START + r')\b')})), ', ')"
_SQL_INLINE = S.q("(?i)" + fixed.LANDMARK_INLINE)
_over_forms(
    "split_landmarks",
    {
        "core": (lambda c: X.split_landmarks(c)["core"], f"CASE WHEN len({_SQL_MARKS}) = 0 THEN regexp_replace({_SQL_CORE}, {_SQL_INLINE}, ' ', 'g') ELSE {_SQL_CORE} END"),
        "landmark": (lambda c: X.split_landmarks(c)["landmark"], f"CASE WHEN len({_SQL_MARKS}) = 0 THEN array_to_string(regexp_extract_all({_SQL_CORE}, {_SQL_INLINE}), ' ') ELSE array_to_string({_SQL_MARKS}, ' ') END"),
    },
)

_NORM_ADDRESS = S.normalize("t", "addr")


def _last(pattern: str) -> str:
    return f"coalesce(regexp_extract_all(a, {S.q(pattern)})[-1], '')"


@query(
    f"""
    WITH t AS (SELECT p_partkey, {_SQL_FORM} AS t FROM part), n AS (SELECT p_partkey, {_NORM_ADDRESS} AS a FROM t),
    p AS (SELECT *, CASE WHEN {_last(fixed.PIN)} <> '' THEN {_last(fixed.PIN)} ELSE {_last(fixed.ZIP)} END AS pc FROM n)
    SELECT p_partkey, pc, regexp_extract(a, {S.q(fixed.UNIT)}, 1) AS unit,
      coalesce(list_filter(regexp_extract_all(regexp_replace(a, {S.q(fixed.UNIT)}, ' ', 'g'), {S.q(fixed.HOUSE)}), lambda h: h <> pc)[1], '') AS house,
      CASE WHEN len(pc) = 5 AND pc[1:2] IN ('75', '69', '13') AND pc[3] = '0' AND pc[4:5] <> '00' THEN MAP {{'75': 'paris', '69': 'lyon', '13': 'marseille'}}[pc[1:2]] || CAST(CAST(pc[4:5] AS INTEGER) AS VARCHAR)
        WHEN regexp_matches(a, '\\b(paris|lyon|marseille) (\\d{{1,2}})\\b') THEN regexp_extract(a, '\\b(paris|lyon|marseille) (\\d{{1,2}})\\b', 1) || CAST(CAST(regexp_extract(a, '\\b(paris|lyon|marseille) (\\d{{1,2}})\\b', 2) AS INTEGER) AS VARCHAR)
        ELSE '' END AS arr
    FROM p
    """
)
def address_parts(spark, sf_dir):
    parts = X.address_parts(X.normalize(F.col("t"), "addr"))
    return _forms(spark, sf_dir).select("p_partkey", parts.alias("p")).select("p_partkey", "p.*")


_PLACES = ["pune nagpur road 5", "mumbai chennai link", "market st new york", "texas avenue far away from here ca", "12 rue lille", "nowhere 7", "delhi delhi", "ca 90210"]
_LABELS = ["INDIA", "US", "FRANCE", "PERU"]


def _sql_region() -> str:
    out = "''"
    for label in ("FRANCE", "INDIA", "US"):
        table_ = {w: r for c, r, w in fixed.GAZETTEER if c == label}
        where = "list_concat(list_slice(w, greatest(len(w) - 2, 1), len(w)), list_slice(w, 1, 2))" if label == "US" else "w"
        found = f"list_transform({where}, lambda x: MAP {{{', '.join(f'{S.q(k)}: {S.q(v)}' for k, v in table_.items())}}}[x])"
        if label == "US":
            found = f"list_concat({found}, [" + ", ".join(f"CASE WHEN regexp_matches(' ' || a || ' ', {S.q(f' (?:{p}) ')}) THEN {S.q(r)} END" for r, p in fixed.REGION_PHRASES.items()) + "])"
        distinct = f"list_distinct(list_filter({found}, lambda x: x IS NOT NULL))"
        out = f"CASE WHEN c = '{label}' AND len({distinct}) = 1 THEN {distinct}[1] ELSE {out} END"
    return out


@query(f"WITH t AS (SELECT p_partkey, {S.listed(_PLACES)}[CAST(p_partkey % {len(_PLACES)} + 1 AS INTEGER)] AS a, {S.listed(_LABELS)}[CAST(p_partkey % 4 + 1 AS INTEGER)] AS c FROM part), u AS (SELECT *, {S.words('a')} AS w FROM t) SELECT p_partkey, {_sql_region()} AS region FROM u")
def region_key_single_hit(spark, sf_dir):
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select("p_partkey", F.element_at(X.literals(_PLACES), (k % len(_PLACES) + 1).cast("int")).alias("a"), F.element_at(X.literals(_LABELS), (k % 4 + 1).cast("int")).alias("c"))
    return t.select("p_partkey", X.region_key(F.col("c"), F.col("a")).alias("region"))


_DOC_RECORDS = f"""
    f AS (SELECT md5(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1),
    r AS (SELECT CASE WHEN doc_id = first THEN 'S1-' WHEN doc_id % 2 = 0 THEN 'S2-' ELSE 'S3-' END || doc_id AS entity_id, {_DOC_NAME} AS business_name, source AS business_address, upper(lang) AS country,
          CASE WHEN doc_id <> first THEN 'S1-' || first END AS true_s1_id FROM documents JOIN f ON md5(text) = h)
"""


def _doc_records(spark, sf_dir):
    return adapters.document_records(table(spark, sf_dir, "documents"))


@query(
    f"""
    WITH {_DOC_RECORDS}, gt AS (SELECT true_s1_id AS s1_id, entity_id AS s23_id FROM r WHERE true_s1_id IS NOT NULL),
    own AS (SELECT * FROM r WHERE entity_id LIKE 'S1-%' AND ((country = 'EN' AND regexp_matches(business_address, '(?i)^SRC1$')) OR (country = 'FR' AND regexp_matches(business_address, '(?i)^src[0-4]$')))),
    kept AS (SELECT gt.* FROM gt SEMI JOIN own ON s1_id = entity_id),
    others AS (SELECT r.* FROM r WHERE entity_id NOT LIKE 'S1-%' AND (((country = 'EN' AND regexp_matches(business_address, '(?i)^SRC1$')) OR (country = 'FR' AND regexp_matches(business_address, '(?i)^src[0-4]$'))) OR entity_id IN (SELECT s23_id FROM kept)))
    SELECT 'own' AS side, entity_id FROM own UNION ALL SELECT 'other', entity_id FROM others
    """
)
def region_filter_sample(spark, sf_dir):
    r = _doc_records(spark, sf_dir)
    one = records.source_of(F.col("entity_id")) == "S1"
    truth = r.filter("true_s1_id is not null").select(F.col("true_s1_id").alias("s1_id"), F.col("entity_id").alias("s23_id"))
    own, others, _ = records.region_sample(r.filter(one), r.filter(~one), truth, [("EN", "^SRC1$"), ("FR", "^src[0-4]$")])
    return own.select(F.lit("own").alias("side"), "entity_id").unionByName(others.select(F.lit("other").alias("side"), "entity_id"))


@query("SELECT p_name, p_brand, p_partkey, count(*) OVER (PARTITION BY p_name, p_brand) AS core_freq, round(ln(1 + count(*) OVER (PARTITION BY p_name, p_brand)), 6) AS log_freq FROM part")
def core_freq_window(spark, sf_dir):
    n = F.count("*").over(Window.partitionBy("p_name", "p_brand"))
    return table(spark, sf_dir, "part").select("p_name", "p_brand", "p_partkey", n.alias("core_freq"), F.round(F.log1p(n), 6).alias("log_freq"))


# --- blocking -----------------------------------------------------------------

# Names of part on one side, shortened ones on the other; groups by brand.
_NAMES = """
    a AS (SELECT 'S1-' || p_partkey AS id, p_brand AS grp, lower(p_name || ' ' || p_type || ' ' || p_brand) AS name FROM part),
    b AS (SELECT 'S2-' || p_partkey AS id, p_brand AS grp, lower(CASE WHEN p_partkey % 3 = 0 THEN p_type || ' ' || p_name ELSE p_name || ' ' || p_size END) AS name FROM part),
"""


def _sql_grams(side: str) -> str:
    return f"""(SELECT grp, id, unnest(list_concat(
        flatten(list_transform({S.words('name')}, lambda w: list_transform(range(1, greatest(len(w), 1) + 1), lambda i: (' ' || w || ' ')[i:i+2]))),
        flatten(list_transform({S.words('name')}, lambda w: CASE WHEN len(w) + 2 > 3 THEN list_transform(range(1, greatest(len(w) - 1, 1) + 1), lambda i: (' ' || w || ' ')[i:i+3]) ELSE [] END)))) AS gram FROM {side})"""


_DF_FILTER = " WHERE df >= 2 AND df <= greatest(ceil(0.01 * n), 50)"

_TFIDF = f"""
    WITH {_NAMES}
    ca AS (SELECT grp, id, gram, count(*) AS tf FROM {_sql_grams('a')} GROUP BY ALL),
    cb AS (SELECT grp, id, gram, count(*) AS tf FROM {_sql_grams('b')} GROUP BY ALL),
    sz AS (SELECT grp, count(DISTINCT id) AS n FROM cb GROUP BY 1),
    df AS (SELECT grp, gram, count(*) AS df FROM cb GROUP BY ALL),
    idf AS (SELECT df.grp, gram, ln((1 + n) / (1 + df)) + 1 AS idf FROM df JOIN sz ON df.grp = sz.grp{_DF_FILTER}),
    xa AS (SELECT ca.grp, id, ca.gram, (1 + ln(tf)) * idf AS x FROM ca JOIN idf ON ca.grp = idf.grp AND ca.gram = idf.gram),
    xb AS (SELECT cb.grp, id, cb.gram, (1 + ln(tf)) * idf AS x FROM cb JOIN idf ON cb.grp = idf.grp AND cb.gram = idf.gram),
    wa AS (SELECT grp, id, gram, x / sqrt(sum(x * x) OVER (PARTITION BY grp, id)) AS w FROM xa),
    wb AS (SELECT grp, id, gram, x / sqrt(sum(x * x) OVER (PARTITION BY grp, id)) AS w FROM xb)
"""
#: The same with all grams: names are of few words, so at size the filter leaves next to none.
_TFIDF_OF_ALL = _TFIDF.replace(_DF_FILTER, "")


def _sides(spark, sf_dir):
    """(id, grp, name) of either side."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    a = part.select(F.concat(F.lit("S1-"), k.cast("string")).alias("id"), F.col("p_brand").alias("grp"), F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("name"))
    other = F.when(k % 3 == 0, F.concat_ws(" ", "p_type", "p_name")).otherwise(F.concat_ws(" ", F.col("p_name"), F.col("p_size").cast("string")))
    return a, part.select(F.concat(F.lit("S2-"), k.cast("string")).alias("id"), F.col("p_brand").alias("grp"), F.lower(other).alias("name"))


def _named(spark, sf_dir):
    counts = [blocking.term_counts(t.select("grp", "id", blocking.char_grams(F.col("name")).alias("t")), F.col("t"), "grp", "id") for t in _sides(spark, sf_dir)]
    idf = blocking.fitted(counts[1])
    return counts, idf, [blocking.weighted(c, idf) for c in counts]


@query(_TFIDF + "SELECT grp, gram, round(idf, 6) AS idf FROM idf")
def tfidf_df_filter(spark, sf_dir):
    return _named(spark, sf_dir)[1].select("grp", "gram", F.round("idf", 6).alias("idf"))


@query(_TFIDF + "SELECT grp, id, gram, round(w, 6) AS w FROM wb")
def tfidf_postings(spark, sf_dir):
    return _named(spark, sf_dir)[2][1].select("grp", "id", "gram", F.round("w", 6).alias("w"))


_TOPK = """, s AS (SELECT wa.id AS s1_id, wb.id AS s23_id, round(sum(wa.w * wb.w), 6) AS sim FROM wa JOIN wb ON wa.grp = wb.grp AND wa.gram = wb.gram GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY sim DESC, s23_id) AS r FROM s),
    top AS (SELECT s1_id, s23_id, sim FROM k WHERE r <= 5 AND sim >= 0.015)
"""


@query(_TFIDF + _TOPK + "SELECT * FROM top")
def tfidf_topk_name(spark, sf_dir):
    return blocking.top_k(*_named(spark, sf_dir)[2], 5)


@query(_TFIDF_OF_ALL + _TOPK + "SELECT count(*) FILTER (t.s1_id IS NOT NULL) AS found, count(*) AS total, round(count(*) FILTER (t.s1_id IS NOT NULL) / greatest(count(*), 1), 6) AS recall FROM part p LEFT JOIN top t ON t.s1_id = 'S1-' || p.p_partkey AND t.s23_id = 'S2-' || p.p_partkey")
def blocking_recall(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    truth = table(spark, sf_dir, "part").select(F.concat(F.lit("S1-"), k).alias("s1_id"), F.concat(F.lit("S2-"), k).alias("s23_id"))
    return blocking.recall(blocking.top_k_of_all(*_sides(spark, sf_dir), 5), truth).select("found", "total", F.round("recall", 6).alias("recall"))


@query(
    _TFIDF_OF_ALL + _TOPK + """, near AS (SELECT a.id AS s1_id, b.id AS s23_id, 0.5 AS sim FROM a JOIN b ON a.name = b.name AND a.grp = b.grp)
    SELECT coalesce(top.s1_id, near.s1_id) AS s1_id, coalesce(top.s23_id, near.s23_id) AS s23_id, top.sim AS blk_name, CAST(near.sim AS DOUBLE) AS blk_same,
      CAST((top.sim IS NOT NULL) AS INTEGER) + CAST((near.sim IS NOT NULL) AS INTEGER) AS n_blockers
    FROM top FULL JOIN near ON top.s1_id = near.s1_id AND top.s23_id = near.s23_id"""
)
def candidates_union(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    near = a.withColumnRenamed("id", "s1_id").join(b.withColumnRenamed("id", "s23_id").hint("merge"), ["grp", "name"]).select("s1_id", "s23_id", F.lit(0.5).alias("sim"))
    return blocking.union_views({"name": blocking.top_k_of_all(a, b, 5), "same": near})


@query(
    """
    WITH s1 AS (SELECT 'S1-' || c_custkey AS id, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE 'C' || c_nationkey % 3 END AS country, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'R' || c_custkey % 3 END AS region FROM customer),
    s2 AS (SELECT 'S2-' || s_suppkey AS id, CASE WHEN s_nationkey % 4 = 0 THEN '' ELSE 'C' || s_nationkey % 3 END AS country, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'R' || s_suppkey % 3 END AS region FROM supplier),
    g1 AS (SELECT *, country || '/' || CASE WHEN (region = '') THEN '*' ELSE region END AS grp FROM s1),
    g AS (SELECT DISTINCT grp, country, region FROM g1)
    SELECT id, grp FROM g1 UNION ALL
    SELECT s2.id, g.grp FROM s2 JOIN g ON (g.country = '' OR s2.country = g.country OR s2.country = '') AND (g.region = '' OR s2.region = g.region OR s2.region = '')
    """
)
def block_groups(spark, sf_dir):
    none = lambda c, k: F.when(c, "").otherwise(k)
    s1 = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("entity_id"),
        none(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("C"), (F.col("c_nationkey") % 3).cast("string"))).alias("country"),
        none(F.col("c_custkey") % 4 == 0, F.concat(F.lit("R"), (F.col("c_custkey") % 3).cast("string"))).alias("region"),
    )
    s2 = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S2-"), F.col("s_suppkey").cast("string")).alias("entity_id"),
        none(F.col("s_nationkey") % 4 == 0, F.concat(F.lit("C"), (F.col("s_nationkey") % 3).cast("string"))).alias("country"),
        none(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("R"), (F.col("s_suppkey") % 3).cast("string"))).alias("region"),
    )
    one, two = blocking.block_groups(s1, s2)
    return one.unionByName(two)


@query(
    f"""
    WITH {_DOC_RECORDS}, w AS (SELECT entity_id AS id, entity_id LIKE 'S1-%' AS one, unnest({S.words('lower(business_name)')}) AS gram FROM r),
    c AS (SELECT id, one, gram, count(*) AS tf FROM w GROUP BY ALL), n AS (SELECT count(DISTINCT id) AS n FROM c WHERE NOT one),
    idf AS (SELECT gram, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM c, n WHERE NOT one GROUP BY 1),
    x AS (SELECT id, one, c.gram, (1 + ln(tf)) * idf AS x FROM c JOIN idf ON c.gram = idf.gram),
    v AS (SELECT id, one, gram, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x),
    gt AS (SELECT true_s1_id AS s1_id, entity_id AS s23_id FROM r WHERE true_s1_id IS NOT NULL),
    d AS (SELECT gt.s1_id, gt.s23_id, round(sum(a.w * b.w), 6) AS cosine FROM gt JOIN v a ON a.id = gt.s1_id JOIN v b ON b.id = gt.s23_id AND a.gram = b.gram GROUP BY ALL)
    SELECT gt.s1_id, gt.s23_id, coalesce(cosine, 0) AS cosine FROM gt LEFT JOIN d ON gt.s1_id = d.s1_id AND gt.s23_id = d.s23_id
    """
)
def word_idf_cosine_pairs(spark, sf_dir):
    r = _doc_records(spark, sf_dir)
    one = records.source_of(F.col("entity_id")) == "S1"
    truth = r.filter("true_s1_id is not null").select(F.col("true_s1_id").alias("s1_id"), F.col("entity_id").alias("s23_id"))
    return blocking.word_cosine(truth, r.filter(one), r.filter(~one), "business_name", "cosine")


# --- pairs --------------------------------------------------------------------

_PAIR = "WITH p AS (SELECT p_partkey, p_name || ' ' || p_type AS a, replace(p_name, 'small', 'sm') || ' ' || p_brand AS b, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS x, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_size + p_partkey % 2 AS VARCHAR) END AS y FROM part) "


def _pairs(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat_ws(" ", "p_name", "p_type").alias("a"),
        F.concat_ws(" ", F.replace("p_name", F.lit("small"), F.lit("sm")), "p_brand").alias("b"),
        F.when(k % 3 == 0, "").otherwise(size.cast("string")).alias("x"),
        F.when(k % 4 == 0, "").otherwise((size + k % 2).cast("string")).alias("y"),
    )


_A, _B = F.col, F.col


def _over_pairs(name: str, columns: dict[str, tuple]) -> None:
    ORACLE[name] = _PAIR + "SELECT p_partkey, " + ", ".join(f"{sql} AS {c}" for c, (_, sql) in columns.items()) + " FROM p"

    def f(spark, sf_dir):
        return _pairs(spark, sf_dir).select("p_partkey", *[e().alias(c) for c, (e, _) in columns.items()])

    QUERIES[name] = f


_over_pairs("token_jaccard", {"j": (lambda: F.round(X.jaccard(F.array_distinct(X.tokens(F.col("a"))), F.array_distinct(X.tokens(F.col("b")))), 6), f"round({S.jaccard(S.words('a'), S.words('b'))}, 6)")})
_over_pairs("number_jaccard", {"j": (lambda: F.round(X.jaccard(X.numbers(F.col("x")), X.numbers(F.col("y"))), 6), f"round({S.jaccard(S.numbers('x'), S.numbers('y'))}, 6)")})
_over_pairs("null_policy_eq", {"eq": (lambda: X.same_if_known(F.col("x"), F.col("y")), "CASE WHEN x <> '' AND y <> '' THEN CAST(x = y AS DOUBLE) END")})
_over_pairs("length_ratio", {"r": (lambda: F.round(X.length_ratio(F.col("a"), F.col("b")), 6), "round(least(len(a), len(b)) / greatest(len(a), len(b), 1), 6)")})
_over_pairs("acronym", {"hit": (lambda: X.acronym(F.col("a"), X.initials(F.col("a"))), f"CASE WHEN {S.initials('a')} <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")})
_over_pairs("jaro_winkler_pairs", {"jw": (lambda: F.round(similarity(F.col("a"), F.col("b"), "jw")["jw"], 6), "round(jaro_winkler_similarity(a, b), 6)")})
_over_pairs(
    "name_conflict",
    {"conflict": (lambda: X.name_conflict(F.col("a"), F.col("b"), F.array(F.lit("sm|small"))), "CASE WHEN list_contains(" + S.words("a") + ", 'small') AND list_contains(" + S.words("b") + ", 'sm') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")},
)
_over_pairs(
    "distinct_tokens",
    {"d": (lambda: X.distinct_tokens(F.lower("a"), X.literals(["economy", "standard", "ring"])), f"array_to_string(CASE WHEN len(list_filter({S.words('lower(a)')}, lambda w: w NOT IN ('economy', 'standard', 'ring'))) > 0 THEN list_filter({S.words('lower(a)')}, lambda w: w NOT IN ('economy', 'standard', 'ring')) ELSE {S.words('lower(a)')} END, ' ')")},
)


@query()
def similarity_scores(spark, sf_dir):
    """All string kernels on a pair of texts; one Arrow UDF."""
    s = similarity(F.col("a"), F.col("b"), "ratio", "tsort", "tset", "part", "wr", "soft_min", "soft_max")
    return _pairs(spark, sf_dir).select("p_partkey", s.alias("s")).select("p_partkey", "s.*")


@query(
    r"""
    WITH v AS (SELECT w AS token, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS w FROM documents) GROUP BY 1),
    s AS (SELECT token AS short, token[1] AS head FROM v WHERE regexp_matches(token, '^[a-z]+$') AND len(token) <= 4 AND n >= 60),
    l AS (SELECT token AS long, token[1] AS head, n FROM v WHERE regexp_matches(token, '^[a-z]+$') AND len(token) > 1 AND n >= 20),
    h AS (SELECT short, long, n FROM s JOIN l ON s.head = l.head WHERE len(short) < len(long) AND regexp_matches(long, '^' || array_to_string(string_split(short, ''), '.*')))
    SELECT short, long, n FROM (SELECT *, row_number() OVER (PARTITION BY short ORDER BY n DESC, long) AS r FROM h) WHERE r <= 10
    """
)
def abbreviation_pairs(spark, sf_dir):
    v = mining.vocabulary(table(spark, sf_dir, "documents").select(F.lower("text").alias("t")), "t")
    return mining.abbreviations(v)


@query("SELECT 'S1-' || a.p_partkey AS s1_id, 'S2-' || b.p_partkey AS s23_id FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_size = b.p_size + 1")
def structured_key_pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    side = lambda prefix, size: part.select(F.concat(F.lit(prefix), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("pc"), F.concat_ws("/", F.col("p_brand"), size.cast("string")).alias("house"))
    return pairs.structured_key_pairs(side("S1-", F.col("p_size")), side("S2-", F.col("p_size") + 1), "pc", "house")


# --- windows and policy -------------------------------------------------------

# Scored pairs of suppliers and parts, with ties.
_SCORED = """
    p AS (SELECT 'S1-' || l_suppkey AS s1_id, 'S2-' || l_partkey AS s23_id, max((l_orderkey * 37 + l_linenumber * 11 + l_partkey) % 101) / 100 AS score,
          any_value(CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'street ' || (l_partkey % 23) END) AS norm_addr
          FROM lineitem GROUP BY l_suppkey, l_partkey),
    gt AS (SELECT s1_id, s23_id FROM (SELECT *, row_number() OVER (PARTITION BY s23_id ORDER BY md5(s1_id || s23_id)) AS r FROM p) WHERE r = 1 AND CAST(s23_id[4:] AS BIGINT) % 3 <> 0)
"""


def _scored(spark, sf_dir):
    key = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11 + F.col("l_partkey")) % 101
    address = F.when(F.col("l_partkey") % 9 == 0, "").otherwise(F.concat(F.lit("street "), (F.col("l_partkey") % 23).cast("string")))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", "l_partkey")
        .agg((F.max(key) / 100).alias("score"))
        .select(F.concat(F.lit("S1-"), F.col("l_suppkey").cast("string")).alias("s1_id"), F.concat(F.lit("S2-"), F.col("l_partkey").cast("string")).alias("s23_id"), "score", address.alias("norm_addr"))
    )


def _truth(spark, sf_dir):
    p = _scored(spark, sf_dir).select("s1_id", "s23_id")
    first = F.row_number().over(Window.partitionBy("s23_id").orderBy(F.md5(F.concat("s1_id", "s23_id"))))
    return p.withColumn("_r", first).filter((F.col("_r") == 1) & (F.substring("s23_id", 4, 20).cast("long") % 3 != 0)).drop("_r")


def _s1(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("S1-"), F.col("s_suppkey").cast("string")).alias("s1_id"))


def _sql_stats(key: str, tie: str, suffix: str) -> str:
    other = f"CASE WHEN row_number() OVER o = 1 THEN nth_value(score, 2) OVER f ELSE max(score) OVER (PARTITION BY {key}) END"
    return f"""WITH {_SCORED} SELECT s1_id, s23_id, CAST(row_number() OVER o AS INTEGER) AS g_rank_{suffix}, count(*) OVER (PARTITION BY {key}) AS g_n_{suffix}, round(score - {other}, 6) AS g_margin_{suffix}, {other} AS g_best_other_{suffix}
    FROM p WINDOW o AS (PARTITION BY {key} ORDER BY score DESC, {tie}), f AS (PARTITION BY {key} ORDER BY score DESC, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


@query(_sql_stats("s1_id", "s23_id", "s1"))
def group_rank_margin_s1(spark, sf_dir):
    r = groups.side_stats(_scored(spark, sf_dir), ["s1_id"], "score", ["s23_id"], "s1")
    return r.select("s1_id", "s23_id", "g_rank_s1", "g_n_s1", F.round("g_margin_s1", 6).alias("g_margin_s1"), "g_best_other_s1")


@query(_sql_stats("s23_id", "s1_id", "s23"))
def group_rank_margin_s23(spark, sf_dir):
    r = groups.side_stats(_scored(spark, sf_dir), ["s23_id"], "score", ["s1_id"], "s23")
    return r.select("s1_id", "s23_id", "g_rank_s23", "g_n_s23", F.round("g_margin_s23", 6).alias("g_margin_s23"), "g_best_other_s23")


@query(f"WITH {_SCORED} SELECT s1_id, s23_id, CAST(sum(CAST(score >= 0.5 AS INTEGER)) OVER (PARTITION BY s1_id) - CAST(score >= 0.5 AS INTEGER) AS BIGINT) AS g_n_ge50_s1, CAST(sum(CAST(score >= 0.9 AS INTEGER)) OVER (PARTITION BY s1_id) - CAST(score >= 0.9 AS INTEGER) AS BIGINT) AS g_n_ge90_s1 FROM p")
def strong_other_counts(spark, sf_dir):
    return groups.strong_others(_scored(spark, sf_dir), "s1_id", "score").select("s1_id", "s23_id", "g_n_ge50_s1", "g_n_ge90_s1")


@query(
    f"""WITH {_SCORED} SELECT s1_id, s23_id, CASE WHEN row_number() OVER o = 1 THEN nth_value(s23_id, 2) OVER f ELSE first_value(s23_id) OVER f END AS other_id, CASE WHEN row_number() OVER o = 1 THEN nth_value(score, 2) OVER f ELSE first_value(score) OVER f END AS g_top_p
    FROM p WINDOW o AS (PARTITION BY s1_id ORDER BY score DESC, s23_id), f AS (PARTITION BY s1_id ORDER BY score DESC, s23_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def best_other(spark, sf_dir):
    return groups.best_other(_scored(spark, sf_dir), "score").select("s1_id", "s23_id", "other_id", "g_top_p")


@query(
    f"""WITH {_SCORED} SELECT s1_id, s23_id, CASE WHEN norm_addr <> '' THEN count(*) OVER a - 1 ELSE 0 END AS g_same_addr_n,
    CASE WHEN norm_addr <> '' THEN CASE WHEN row_number() OVER o = 1 THEN nth_value(score, 2) OVER f ELSE max(score) OVER a END END AS g_same_addr_max
    FROM p WINDOW a AS (PARTITION BY s1_id, norm_addr), o AS (PARTITION BY s1_id, norm_addr ORDER BY score DESC, s23_id), f AS (PARTITION BY s1_id, norm_addr ORDER BY score DESC, s23_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def same_address_support(spark, sf_dir):
    return groups.same_address_support(_scored(spark, sf_dir), "score").select("s1_id", "s23_id", "g_same_addr_n", "g_same_addr_max")


_ONE = ", w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s23_id ORDER BY score DESC, s1_id) AS r FROM p) WHERE r = 1)"


@query(f"WITH {_SCORED}{_ONE} SELECT s1_id, s23_id, score FROM w")
def one_to_one(spark, sf_dir):
    return policy.one_to_one(_scored(spark, sf_dir), "score").select("s1_id", "s23_id", "score")


_SELECTED = _ONE + ", k AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, s23_id) AS k FROM w WHERE score >= 0.6), m AS (SELECT s1_id, s23_id, score FROM k WHERE (k = 1 AND score >= 0.6) OR (k > 1 AND score >= 0.93))"


def _selected(spark, sf_dir):
    return policy.select_matches(_scored(spark, sf_dir), "score", 0.6, 0.93)


@query(f"WITH {_SCORED}{_SELECTED} SELECT * FROM m")
def select_two_threshold(spark, sf_dir):
    return _selected(spark, sf_dir).select("s1_id", "s23_id", "score")


_F05 = """, n AS (SELECT s1_id, count(*) AS n_true FROM gt GROUP BY 1), q AS (SELECT m.s1_id, count(*) AS n_pred, count(gt.s1_id) AS tp FROM m LEFT JOIN gt ON m.s1_id = gt.s1_id AND m.s23_id = gt.s23_id GROUP BY 1),
    e AS (SELECT coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS np, coalesce(n_true, 0) AS nt FROM (SELECT 'S1-' || s_suppkey AS s1_id FROM supplier) s LEFT JOIN q ON s.s1_id = q.s1_id LEFT JOIN n ON s.s1_id = n.s1_id),
    pr AS (SELECT *, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS p, CASE WHEN nt > 0 THEN tp / nt ELSE 0 END AS r FROM e)
    SELECT round(avg(CASE WHEN nt = 0 AND np = 0 THEN 1 WHEN 0.25 * p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0 END), 6) AS macro_f05, count(*) AS entities FROM pr"""


@query(f"WITH {_SCORED}{_SELECTED}{_F05}")
def macro_f05(spark, sf_dir):
    return policy.macro_f05(_selected(spark, sf_dir), _truth(spark, sf_dir), _s1(spark, sf_dir)).select(F.round("macro_f05", 6).alias("macro_f05"), "entities")


@query(
    f"""WITH {_SCORED}{_ONE}, g AS (SELECT t1, t2 FROM range(20, 81, 5) a(t1), range(30, 96, 5) b(t2) WHERE t2 >= t1),
    y AS (SELECT w.s1_id, w.s23_id, score, CAST(gt.s1_id IS NOT NULL AS INTEGER) AS y FROM w LEFT JOIN gt ON w.s1_id = gt.s1_id AND w.s23_id = gt.s23_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, s23_id) AS k FROM y),
    c AS (SELECT t1, t2, s1_id, count(*) AS np, sum(y) AS tp FROM k, g WHERE round(score * 100) >= t1 AND ((k = 1) OR round(score * 100) >= t2) GROUP BY ALL),
    n AS (SELECT s1_id, count(*) AS nt FROM gt GROUP BY 1),
    e AS (SELECT g.t1, g.t2, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp, coalesce(nt, 0) AS nt FROM g CROSS JOIN (SELECT 'S1-' || s_suppkey AS s1_id FROM supplier) s LEFT JOIN c ON c.t1 = g.t1 AND c.t2 = g.t2 AND c.s1_id = s.s1_id LEFT JOIN n ON n.s1_id = s.s1_id),
    f AS (SELECT t1, t2, CASE WHEN nt = 0 AND np = 0 THEN 1 WHEN tp > 0 THEN 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) ELSE 0 END AS f FROM e)
    SELECT CAST(t1 AS INTEGER) AS t1, CAST(t2 AS INTEGER) AS t2, round(avg(f), 6) AS macro_f05 FROM f GROUP BY ALL"""
)
def tune_thresholds(spark, sf_dir):
    y = _scored(spark, sf_dir).join(_truth(spark, sf_dir).withColumn("y", F.lit(1)), ["s1_id", "s23_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    n = _s1(spark, sf_dir).join(_truth(spark, sf_dir).groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    return policy.tune_thresholds(y, "score", n).select("t1", "t2", F.round("macro_f05", 6).alias("macro_f05"))


@query(f"WITH {_SCORED}{_SELECTED} SELECT s.s1_id AS source1_entity_id, coalesce(l, '') AS matched_entity_ids FROM (SELECT 'S1-' || s_suppkey AS s1_id FROM supplier) s LEFT JOIN (SELECT s1_id, string_agg(DISTINCT s23_id, ',' ORDER BY s23_id) AS l FROM m GROUP BY 1) m ON s.s1_id = m.s1_id")
def id_lists(spark, sf_dir):
    return policy.id_lists(_selected(spark, sf_dir), _s1(spark, sf_dir))


# A list table with every fault.
_FAULTY = "l AS (SELECT CASE WHEN s_suppkey % 10 = 1 THEN 'S1-0' ELSE 'S1-' || s_suppkey END AS s1_id, CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'S2-' || s_suppkey || ',S2-' || s_suppkey WHEN 2 THEN 'S1-3,S3-' || s_suppkey WHEN 3 THEN 'X-' || s_suppkey WHEN 4 THEN 'S2-' || (s_suppkey + 100000) ELSE 'S2-1' END AS ids FROM supplier)"


@query(
    f"""WITH {_FAULTY}, req AS (SELECT 'S1-' || s_suppkey AS s1_id FROM supplier WHERE s_suppkey > 0), ok AS (SELECT CASE WHEN s_suppkey % 6 = 2 THEN 'S3-' ELSE 'S2-' END || s_suppkey AS id FROM supplier),
    x AS (SELECT s1_id, unnest(string_split(ids, ',')) AS id FROM l WHERE trim(ids) <> ''),
    f AS (SELECT 'duplicate_row' AS finding, s1_id AS o FROM l GROUP BY s1_id HAVING count(*) > 1
      UNION SELECT 'repeated_id', s1_id FROM x GROUP BY s1_id, id HAVING count(*) > 1
      UNION SELECT 'self_match', id FROM x WHERE id LIKE 'S1-%'
      UNION SELECT 'wrong_prefix', id FROM x WHERE NOT regexp_matches(id, '^S[123]-')
      UNION SELECT 'unknown_id', id FROM x WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT id FROM ok)
      UNION SELECT 'missing_s1', s1_id FROM req WHERE s1_id NOT IN (SELECT s1_id FROM l)
      UNION SELECT 'extra_s1', s1_id FROM l WHERE s1_id NOT IN (SELECT s1_id FROM req)),
    r AS (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY o) AS r FROM f)
    SELECT finding, count(*) AS offenders, string_agg(o, ', ' ORDER BY o) FILTER (r <= 5) AS examples FROM r GROUP BY 1"""
)
def validator_findings(spark, sf_dir):
    k = F.col("s_suppkey")
    t, s = k.cast("string"), table(spark, sf_dir, "supplier")
    ids = F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat(F.lit("S2-"), t, F.lit(",S2-"), t)).when(k % 6 == 2, F.concat(F.lit("S1-3,S3-"), t)).when(k % 6 == 3, F.concat(F.lit("X-"), t)).when(k % 6 == 4, F.concat(F.lit("S2-"), (k + 100000).cast("string"))).otherwise("S2-1")
    lists = s.select(F.when(k % 10 == 1, "S1-0").otherwise(F.concat(F.lit("S1-"), t)).alias("source1_entity_id"), ids.alias("matched_entity_ids"))
    required = s.filter("s_suppkey > 0").select(F.concat(F.lit("S1-"), t).alias("s1_id"))
    valid = s.select(F.concat(F.when(k % 6 == 2, "S3-").otherwise("S2-"), t).alias("s23_id"))
    return policy.findings(lists, required, valid)


@query(f"WITH {_SCORED}{_SELECTED} SELECT s1_id, s23_id FROM m ANTI JOIN (SELECT * FROM p WHERE score < 0.97) c USING (s1_id, s23_id)")
def matches_subset_of_candidates(spark, sf_dir):
    return policy.outside_candidates(_selected(spark, sf_dir), _scored(spark, sf_dir).filter("score < 0.97").select("s1_id", "s23_id"))


@query("SELECT DISTINCT 'S1-' || o_custkey AS s1_id, trim(x) AS s23_id FROM (SELECT o_custkey, unnest(string_split(o_orderpriority || ', ' || o_orderstatus || ',,' || o_orderstatus, ',')) AS x FROM orders) WHERE trim(x) <> ''")
def gt_parse(spark, sf_dir):
    lists = F.concat(F.col("o_orderpriority"), F.lit(", "), F.col("o_orderstatus"), F.lit(",,"), F.col("o_orderstatus"))
    return records.parsed_truth(table(spark, sf_dir, "orders").select(F.concat(F.lit("S1-"), F.col("o_custkey").cast("string")).alias("source1_entity_id"), lists.alias("matched_entity_ids")))


@query(
    f"""WITH {_DOC_RECORDS}, s1 AS (SELECT * FROM r WHERE entity_id LIKE 'S1-%'), s23 AS (SELECT * FROM r WHERE entity_id NOT LIKE 'S1-%'),
    gt AS (SELECT true_s1_id AS s1_id, CASE WHEN true_s1_id LIKE '%7' THEN entity_id || 'x' ELSE entity_id END AS s23_id FROM s23),
    n AS (SELECT s1.entity_id, country, count(gt.s1_id) AS n FROM s1 LEFT JOIN gt ON gt.s1_id = s1.entity_id GROUP BY ALL),
    c AS (SELECT s23_id, count(*) AS n FROM gt GROUP BY 1), b AS (SELECT gt.*, s1.country AS c1, s23.country AS c23 FROM gt LEFT JOIN s1 ON s1.entity_id = s1_id LEFT JOIN s23 ON s23.entity_id = s23_id)
    SELECT 's1_total' AS stat, '' AS label, CAST(count(*) AS DOUBLE) AS value FROM s1
    UNION ALL SELECT 's23_total', '', count(*) FROM s23
    UNION ALL SELECT 'singleton_share', '', round(avg(CAST(n = 0 AS DOUBLE)), 6) FROM n
    UNION ALL SELECT 'singleton_share_by_country', country, round(avg(CAST(n = 0 AS DOUBLE)), 6) FROM n GROUP BY country
    UNION ALL SELECT 'matches_per_s1', CAST(n AS VARCHAR), count(*) FROM n GROUP BY n
    UNION ALL SELECT 's23_claimed_by_more_than_one_s1', '', count(*) FILTER (n > 1) FROM c
    UNION ALL SELECT 'cross_country_true_pairs', '', count(*) FILTER (NOT coalesce(c1 = c23, false)) FROM b
    UNION ALL SELECT 'gt_ids_missing_from_sources', '', count(*) FILTER (c23 IS NULL) FROM b
    UNION ALL SELECT 's23_never_matched_share', '', round(avg(CAST(c.n IS NULL AS DOUBLE)), 6) FROM s23 LEFT JOIN c ON c.s23_id = s23.entity_id"""
)
def gt_diagnostics(spark, sf_dir):
    r = _doc_records(spark, sf_dir)
    one = records.source_of(F.col("entity_id")) == "S1"
    truth = r.filter("true_s1_id is not null").select(F.col("true_s1_id").alias("s1_id"), F.when(F.col("true_s1_id").endswith("7"), F.concat("entity_id", F.lit("x"))).otherwise(F.col("entity_id")).alias("s23_id"))
    return policy.diagnostics(truth, r.filter(one), r.filter(~one))


@query("SELECT o_orderkey, CASE WHEN u < 0.6 THEN 0 WHEN u < 0.8 THEN 1 ELSE 2 END AS part FROM (SELECT o_orderkey, CAST('0x' || md5(o_orderkey || '0')[1:8] AS BIGINT) / 4294967296 AS u FROM orders)")
def split_60_20_20(spark, sf_dir):
    return policy.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, CAST('0x' || md5(CAST(o_orderkey AS VARCHAR))[1:8] AS BIGINT) % 5 AS fold FROM orders")
def kfold_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", policy.fold(F.col("o_orderkey"), 5).alias("fold"))


# --- mining -------------------------------------------------------------------

_WORDS = r"(SELECT lang, lower(text) AS t, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents)"


def _lower(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", F.lower("text").alias("t"))


@query(f"SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(w) AS token FROM {_WORDS}) GROUP BY ALL")
def vocab_counts(spark, sf_dir):
    return mining.vocabulary(_lower(spark, sf_dir), "t", "lang")


@query(
    f"""WITH x AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM {_WORDS}), t AS (SELECT w[i] AS token, w, i FROM x WHERE regexp_matches(w[i], '^[a-z]{{1,4}}$')),
    s AS (SELECT token, 'left' AS side, w[i - 1] AS neighbour FROM t WHERE i > 1 UNION ALL SELECT token, 'right', w[i + 1] FROM t WHERE i < len(w))
    SELECT token, side, neighbour, count(*) AS n FROM s GROUP BY ALL"""
)
def neighbour_counts(spark, sf_dir):
    return mining.neighbours(_lower(spark, sf_dir), "t")


@query(
    f"""WITH v AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(w) AS token FROM {_WORDS}) WHERE lang IN ('en', 'de') GROUP BY ALL),
    a AS (SELECT token, n FROM v WHERE lang = 'en'), b AS (SELECT token, n FROM v WHERE lang = 'de'), ta AS (SELECT sum(n) AS ta FROM a), tb AS (SELECT sum(n) AS tb FROM b),
    j AS (SELECT coalesce(a.token, b.token) AS token, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b ON a.token = b.token)
    SELECT token, round(ln((na + 1) / ta) - ln((nb + 1) / tb), 6) AS log_ratio FROM j, ta, tb WHERE na + nb >= 20"""
)
def vocab_shift(spark, sf_dir):
    v = mining.vocabulary(_lower(spark, sf_dir), "t", "lang")
    of = lambda lang: v.filter(F.col("lang") == lang).select("token", "n")
    return mining.vocabulary_shift(of("en"), of("de")).select("token", F.round("log_ratio", 6).alias("log_ratio"))


# True pairs of texts that differ by known words.
_TEXT_PAIRS = "(SELECT p_partkey, lower(p_name || ' ' || p_type || ' shop') AS a, lower(replace(replace(p_name, 'small', 'little'), 'red', 'dark rose') || ' ' || p_type || ' shop') AS b FROM part)"


def _text_pairs(spark, sf_dir):
    b = F.replace(F.replace("p_name", F.lit("small"), F.lit("little")), F.lit("red"), F.lit("dark rose"))
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat_ws(" ", F.col("p_name"), F.col("p_type"), F.lit("shop"))).alias("a"), F.lower(F.concat_ws(" ", b, F.col("p_type"), F.lit("shop"))).alias("b"))


_ONE_SIDED = f"""WITH t AS (SELECT string_split(a, ' ') AS a, string_split(b, ' ') AS b FROM {_TEXT_PAIRS}),
    o AS (SELECT a, b, list_filter(list_distinct(a), lambda w: NOT list_contains(b, w)) AS oa, list_filter(list_distinct(b), lambda w: NOT list_contains(a, w)) AS ob FROM t),
    k AS (SELECT * FROM o WHERE len(oa) BETWEEN 1 AND 3 AND len(ob) BETWEEN 1 AND 3)"""


@query(
    f"""{_ONE_SIDED}, na AS (SELECT tok_a, count(*) AS na FROM (SELECT unnest(oa) AS tok_a FROM k) GROUP BY 1), nb AS (SELECT tok_b, count(*) AS nb FROM (SELECT unnest(ob) AS tok_b FROM k) GROUP BY 1),
    n AS (SELECT tok_a, tok_b, count(*) AS n FROM (SELECT tok_a, unnest(ob) AS tok_b FROM (SELECT unnest(oa) AS tok_a, ob FROM k)) GROUP BY ALL HAVING count(*) >= 10)
    SELECT n.tok_a, n.tok_b, n, round(n / least(na, nb), 6) AS conf FROM n JOIN na ON n.tok_a = na.tok_a JOIN nb ON n.tok_b = nb.tok_b"""
)
def token_variants(spark, sf_dir):
    return mining.token_variants(_text_pairs(spark, sf_dir), "a", "b").select("tok_a", "tok_b", "n", F.round("conf", 6).alias("conf"))


_SQL_SWAPS = f"""{_ONE_SIDED},
    g AS (SELECT list_filter(list_distinct(list_concat(a, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]))), lambda x: len(list_filter(string_split(x, ' '), lambda w: NOT list_contains(oa, w))) = 0) AS ga,
                 list_filter(list_distinct(list_concat(b, list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]))), lambda x: len(list_filter(string_split(x, ' '), lambda w: NOT list_contains(ob, w))) = 0) AS gb FROM k),
    occ AS (SELECT t, count(*) AS occ FROM (SELECT unnest(list_distinct(list_concat(ga, gb))) AS t FROM g) GROUP BY 1),
    xy AS (SELECT x, unnest(gb) AS y FROM (SELECT unnest(ga) AS x, gb FROM g)),
    n AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM xy WHERE NOT (contains(x, ' ') AND contains(y, ' ')) GROUP BY ALL HAVING count(*) >= 15),
    sw AS (SELECT n.a, n.b, n, n / least(oa.occ, ob.occ) AS rate FROM n JOIN occ oa ON oa.t = n.a JOIN occ ob ON ob.t = n.b WHERE n / least(oa.occ, ob.occ) >= 0.05)"""


@query(f"{_SQL_SWAPS} SELECT a, b, n, round(rate, 6) AS rate FROM sw")
def bigram_swaps(spark, sf_dir):
    return mining.swaps(_text_pairs(spark, sf_dir), "a", "b").select("a", "b", "n", F.round("rate", 6).alias("rate"))


@query(
    f"""{_SQL_SWAPS}, e AS (SELECT a AS token, b AS partner, n FROM sw WHERE rate >= 0.03 AND NOT contains(a, ' ') AND NOT contains(b, ' ') UNION ALL SELECT b, a, n FROM sw WHERE rate >= 0.03 AND NOT contains(a, ' ') AND NOT contains(b, ' ')),
    r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, partner) AS r FROM e)
    SELECT token, string_agg(partner, ',' ORDER BY r) AS partners FROM r WHERE r <= 4 GROUP BY 1"""
)
def swap_partners(spark, sf_dir):
    return mining.partners(mining.swaps(_text_pairs(spark, sf_dir), "a", "b")).select("token", F.array_join("partners", ",").alias("partners"))


@query(
    rf"""WITH v AS (SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM {_WORDS}) WHERE regexp_matches(token, '^[a-z]+$') GROUP BY 1),
    k AS (SELECT *, {S.phonetic_key('token', 'indic')} AS key FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, token) AS r FROM k), t AS (SELECT * FROM r WHERE r <= 5 AND key <> '')
    SELECT x.key, x.token AS a, y.token AS b FROM t x JOIN t y ON x.key = y.key AND x.token < y.token"""
)
def lookalike_keys(spark, sf_dir):
    v = mining.vocabulary(_lower(spark, sf_dir), "t").filter(F.col("token").rlike("^[a-z]+$"))
    return mining.lookalikes(v, X.word_key(F.col("token"), "indic"))


# Edges between parts that share name and type with the next key.
_EDGES = "e AS (SELECT p_partkey AS a, lead(p_partkey) OVER (PARTITION BY p_name, p_size ORDER BY p_partkey) AS b FROM part), ed AS (SELECT a, b FROM e WHERE b IS NOT NULL), ud AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed)"


@query(f"WITH RECURSIVE {_EDGES}, c(node, label) AS (SELECT a, a FROM ud UNION SELECT ud.b, c.label FROM c JOIN ud ON ud.a = c.node) SELECT node, min(label) AS component FROM c GROUP BY 1")
def synonym_components(spark, sf_dir):
    nxt = F.lead("p_partkey").over(Window.partitionBy("p_name", "p_size").orderBy("p_partkey"))
    edges = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), nxt.alias("b")).filter("b is not null")
    return mining.components(edges)


@query(f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, s23_id) AS rank FROM p), f AS (SELECT r.* FROM r ANTI JOIN gt USING (s1_id, s23_id) WHERE rank <= 5) SELECT s1_id, s23_id, score, CAST(rank AS INTEGER) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, s23_id) = 1")
def hard_negative_top1(spark, sf_dir):
    return mining.hard_negatives(_scored(spark, sf_dir), _truth(spark, sf_dir), "score").select("s1_id", "s23_id", "score", "rank")


_LABELLED = "d AS (SELECT d.doc_id, lang, quality AS y, n_chars % 97 AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", F.col("quality").alias("y"), (F.col("n_chars") % 97).alias("score"))


@query(f"WITH {_LABELLED} SELECT a.lang, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS auc FROM d a JOIN d b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY 1")
def auc_by_lang(spark, sf_dir):
    return mining.auc(_labelled(spark, sf_dir), "score", "y", "lang").filter("auc is not null").select("lang", F.round("auc", 6).alias("auc"))


@query(
    f"""WITH {_LABELLED}, h AS (SELECT *, row_number() OVER (PARTITION BY lang, y ORDER BY CASE WHEN y = 1 THEN score ELSE -score END, doc_id) AS r FROM d),
    k AS (SELECT *, row_number() OVER (PARTITION BY lang, y ORDER BY md5(doc_id || '0'), doc_id) AS k FROM h WHERE r <= 12) SELECT doc_id, lang, y, score FROM k WHERE k <= 4"""
)
def error_sample(spark, sf_dir):
    return mining.hard_cases(_labelled(spark, sf_dir), "score", "y", "lang", "doc_id", 4)


@query("SELECT event_type AS cause, CASE WHEN grouping(u) = 1 THEN 'all' ELSE u END AS key, round(avg(value), 6) AS mean FROM (SELECT event_type, value, CAST(user_id % 4 AS VARCHAR) AS u FROM events) GROUP BY GROUPING SETS ((event_type), (event_type, u))")
def cause_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value", (F.col("user_id") % 4).cast("string").alias("u"))
    return mining.cause_report(e, "u", "event_type", "value").select("cause", "key", F.round("mean", 6).alias("mean"))


@query("SELECT CAST((rn - 1) // 25 AS BIGINT) AS batch, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS ids FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) GROUP BY 1")
def batched_requests(spark, sf_dir):
    return mining.batched(table(spark, sf_dir, "customer"), "c_custkey", 25).select("batch", F.array_join("ids", ",").alias("ids"))


@query("SELECT event_id, sha1('{\"k\":' || CAST(json_extract(props, '$.k') AS INTEGER) || ',\"t\":\"' || event_type || '\"}') AS key FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 50")
def unanswered_requests(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("t")).alias("request"))
    answered = e.filter("request.k < 50").select(F.sha1(F.to_json("request")).alias("key")).distinct()
    return mining.unanswered(e, answered).select("event_id", "key")


@query("SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS DOUBLE) % 3 = 0 THEN NULL ELSE round(CAST(json_extract(props, '$.k') AS DOUBLE) / 100, 6) END AS p FROM events")
def judgement_reader(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))
    answers = e.filter("k % 3 <> 0").select(F.col("event_id").alias("key"), F.to_json(F.create_map(F.lit("yes"), F.col("k") / 100, F.lit("no"), 1 - F.col("k") / 100)).alias("answer"))
    return mining.judged(e.withColumn("key", F.col("event_id")), answers, "yes").select("event_id", F.round("p", 6).alias("p"))


@query("SELECT p_partkey, CASE WHEN p_size >= 5 AND p_retailprice % 1 >= 0.05 THEN 'same' WHEN p_size = 0 AND p_retailprice >= 50 THEN 'different' ELSE 'open' END AS verdict FROM part")
def acceptance_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("n"), (F.col("p_retailprice") % 1).alias("rate"), F.col("p_retailprice").alias("occ"))
    return mining.accepted_swaps(rows).select("p_partkey", "verdict")


# --- candidates for judging -----------------------------------------------------

_VOCAB = f"v AS (SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM {_WORDS}) WHERE regexp_matches(token, '^[a-z]+$') GROUP BY 1)"


def _vocab(spark, sf_dir):
    return mining.vocabulary(_lower(spark, sf_dir), "t").filter(F.col("token").rlike("^[a-z]+$"))


@query(f"WITH {_VOCAB} SELECT token, {S.loan_key('token')} AS key FROM v")
def loan_keys(spark, sf_dir):
    return _vocab(spark, sf_dir).select("token", X.loan_key(F.col("token")).alias("key"))


@query(f"WITH v AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(w) AS token FROM {_WORDS}) GROUP BY ALL) SELECT lang, token, n FROM v WHERE regexp_matches(token, '^[a-z]{{2,}}$') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) <= 50")
def word_class_items(spark, sf_dir):
    return judging.word_classes(mining.vocabulary(_lower(spark, sf_dir), "t", "lang"), 50, "lang")


@query(
    f"""WITH x AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM {_WORDS}), t AS (SELECT w[i] AS token, w, i FROM x WHERE w[i] IN {tuple(fixed.AMBIGUOUS)}),
    s AS (SELECT token, 'left' AS side, w[i - 1] AS neighbour FROM t WHERE i > 1 UNION ALL SELECT token, 'right', w[i + 1] FROM t WHERE i < len(w)),
    n AS (SELECT token, side, neighbour, count(*) AS n FROM s GROUP BY ALL), a AS (SELECT token, sum(n) AS n FROM n GROUP BY 1),
    r AS (SELECT token, neighbour AS following, n FROM n WHERE side = 'right' AND n >= 2 QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC, neighbour) <= 6)
    SELECT token, following, CAST(n AS BIGINT) AS n FROM r UNION ALL SELECT token, '', CAST(n AS BIGINT) FROM a"""
)
def ambiguous_contexts(spark, sf_dir):
    return judging.ambiguous_contexts(mining.neighbours(_lower(spark, sf_dir), "t"), min_count=2)


@query(f"WITH {_VOCAB} SELECT token, '{{\"word\":\"' || token || '\",\"meanings\":[' || array_to_string(list_transform(string_split({S.case(fixed.AMBIGUOUS, 'token', 'NULL')}, ' '), lambda m: '\"' || m || '\"'), ',') || ']}}' AS request FROM v WHERE token IN {tuple(fixed.AMBIGUOUS)}")
def meaning_requests(spark, sf_dir):
    return judging.meaning_requests(_vocab(spark, sf_dir).select("token"))


@query()
def transliteration_candidates(spark, sf_dir):
    """Words by loan key and by spelling: similar words among those that share a key or a 3-gram."""
    v = staged(_vocab(spark, sf_dir).filter("n >= 3"), "vocabulary")  # read four times
    return judging.transliterations(v.select("token"), v.filter("n >= 20").select("token"))


@query()
def transliteration_partners(spark, sf_dir):
    """The same over the words of text pairs, where mined swap partners come first."""
    pairs = _text_pairs(spark, sf_dir)
    v = pairs.select(F.explode(F.split(F.concat_ws(" ", "a", "b"), " ")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return judging.transliterations(v.filter("n >= 3").select("token"), v.filter("n >= 20").select("token"), swapped=mining.swaps(pairs, "a", "b"))


@query()
def similar_words(spark, sf_dir):
    return mining.similar_words(_vocab(spark, sf_dir).filter("n >= 30"))


@query()
def fuzzy_canonical(spark, sf_dir):
    return judging.fuzzy_canonical(_vocab(spark, sf_dir).select("token"))


@query(
    f"""{_SQL_SWAPS}, bw AS (SELECT a AS word, b AS other, n FROM sw UNION ALL SELECT b, a, n FROM sw)
    SELECT a, b, n FROM sw WHERE EXISTS (SELECT 1 FROM bw o WHERE contains(o.other, ' ') AND o.n >= 0.5 * sw.n AND ((o.word = sw.a AND list_contains(string_split(o.other, ' '), sw.b)) OR (o.word = sw.b AND list_contains(string_split(o.other, ' '), sw.a))))"""
)
def partial_phrases(spark, sf_dir):
    return judging.partial_phrases(mining.swaps(_text_pairs(spark, sf_dir), "a", "b")).select("a", "b", "n")


@query("SELECT p_partkey, trim(regexp_replace(' ' || replace(replace(' ' || p_name || ' ', ' red ring ', ' rr '), ' small ', ' sm ') || ' ', '\\s+', ' ', 'g')) AS name FROM part")
def lexicon_rewrite(spark, sf_dir):
    lexicon = Lexicon(words=[("US", "name", "red ring", "rr"), ("US", "both", "small", "sm"), ("FRANCE", "name", "red", "rouge")])
    return table(spark, sf_dir, "part").select("p_partkey", lexicon.apply(F.col("p_name"), F.lit("US"), "name").alias("name"))


# --- whole plans --------------------------------------------------------------


def _linkage(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lexicon = Lexicon(words=[("*", "name", "traders", "trading")], classes=[("US", w, "legal_form") for w in ("co", "ltd")], conflicts=[("US", "ring", "rung")])
    # prepared once: joins on top would otherwise carry the text expressions along
    p = staged(prepare(adapters.part_records(part), lexicon, romanise=False), "prepared")
    one = records.source_of(F.col("entity_id")) == "S1"
    return p.filter(one), p.filter(~one), adapters.part_truth(part), lexicon


@query()
def prepared_records(spark, sf_dir):
    a, b, _, _ = _linkage(spark, sf_dir)
    return a.unionByName(b)


@query()
def pair_feature_table(spark, sf_dir):
    """All 54 features of candidates that share a postcode or a house and unit."""
    a, b, _, lexicon = _linkage(spark, sf_dir)
    return _features(a, b, lexicon)


def _features(a, b, lexicon):
    found = pairs.structured_key_pairs(a, b, "pc").unionByName(pairs.structured_key_pairs(a, b, "house", "unit")).distinct()
    found = staged(found, "pairs").withColumns({"blk_name": F.lit(None).cast("double"), "blk_core": F.lit(None).cast("double"), "blk_text": F.lit(1.0), "n_blockers": F.lit(1)})
    return pairs.pair_features(found, a, b, lexicon)


@query()
def stage2_matrix(spark, sf_dir):
    """The second stage's columns behind a rule score."""
    a, b, _, lexicon = _linkage(spark, sf_dir)
    scored = staged(_features(a, b, lexicon), "features").withColumn("p", F.round((F.col("name_tset") + F.coalesce("addr_tset", F.lit(0.0))) / 2, 4).cast("double"))
    return groups.stage2(scored, "p", b)


@query()
def two_stage_gbt_score(spark, sf_dir):
    """Both boosted stages, trained and applied."""
    a, b, truth, lexicon = _linkage(spark, sf_dir)
    features = staged(_features(a, b, lexicon), "features")
    fitted = model.train_two_stage(features, truth, a, b, folds=2, maxIter=8, maxDepth=4)
    return fitted.predict(features, b)


# --- resources and rules --------------------------------------------------------


@query("SELECT 'S1-' || s_suppkey AS entity_id, s_name || ' \"' || s_suppkey AS business_name, '' AS business_address, 'C' || s_nationkey AS country FROM supplier")
def tsv_round_trip(spark, sf_dir):
    """Records written as tab-separated text and read again, with the checks of lines and keys."""
    k = F.col("s_suppkey").cast("string")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S1-"), k).alias("entity_id"), F.concat("s_name", F.lit(' "'), k).alias("business_name"), F.lit("").alias("business_address"), F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("country"))
    folder = place(spark, "tsv")
    records.write_tsv(rows, folder)
    return records.read_tsv(spark, folder, records.RECORD)


@query("SELECT 'S1-' || page_id AS entity_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS business_name, url AS business_address, upper(regexp_extract(html, '<html[^>]*lang=\"([a-z]+)\"', 1)) AS country FROM pages")
def page_records(spark, sf_dir):
    return adapters.page_records(table(spark, sf_dir, "pages"))


@query("SELECT p_partkey, p_brand AS country, p_name AS core, count(*) OVER (PARTITION BY p_brand, p_name) AS core_freq FROM part")
def core_frequency(spark, sf_dir):
    return prepare_.core_frequency(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("country"), F.col("p_name").alias("core")))


# Answers about pairs of words, as many kinds as the rules tell apart.
@query("SELECT p_partkey FROM part WHERE p_partkey % 11 / 10 >= 0.6 AND CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 7 / 6 END < 0.5 AND NOT (p_partkey % 3 = 0 AND p_partkey % 4 / 3 >= 0.5)")
def same_word_answers(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", (k % 11 / 10).alias("same"), F.when(k % 5 != 0, k % 7 / 6).alias("different"), F.when(k % 3 == 0, "different").when(k % 3 == 1, "same").alias("relation"), (k % 4 / 3).alias("p_relation"))
    return judging.same_word(rows).select("p_partkey")


@query(
    """WITH a AS (SELECT p_partkey, ['US', 'INDIA', 'FRANCE'][p_partkey % 3 + 1] AS country, ['name', 'addr'][p_partkey % 2 + 1] AS field, ['r', 'bd', 'mfg', 'svcs', 'x'][p_partkey % 5 + 1] AS token, CASE WHEN p_partkey % 7 = 0 THEN 'none' ELSE 'word' END AS choice, (p_partkey % 13) / 12 AS p FROM part)
    SELECT p_partkey FROM a WHERE choice <> 'none' AND p >= CASE WHEN field = 'addr' THEN 0.7 WHEN len(token) <= 2 THEN 0.9 ELSE 0.8 END AND (len(token) > 1 OR (country = 'FRANCE' AND field = 'addr' AND token = 'r'))"""
)
def accepted_abbreviations(spark, sf_dir):
    k = F.col("p_partkey")
    of = lambda values: F.element_at(X.literals(values), (k % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", of(["US", "INDIA", "FRANCE"]).alias("country"), of(["name", "addr"]).alias("field"), of(["r", "bd", "mfg", "svcs", "x"]).alias("token"), F.when(k % 7 == 0, "none").otherwise("word").alias("choice"), (k % 13 / 12).alias("p"))
    return judging.accepted_abbreviations(rows).select("p_partkey")


# Words of a type and size are one group; groups beyond twelve words go.
_WORD_EDGES = "e AS (SELECT DISTINCT 'w' || a AS a, 'w' || b AS b FROM (SELECT p_partkey AS a, lead(p_partkey) OVER (PARTITION BY p_name, p_size ORDER BY p_partkey) AS b FROM part) WHERE b IS NOT NULL), ud AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)"


@query(
    f"""WITH RECURSIVE {_WORD_EDGES}, c(node, label) AS (SELECT a, a FROM ud UNION SELECT ud.b, c.label FROM c JOIN ud ON ud.a = c.node), l AS (SELECT node, min(label) AS component FROM c GROUP BY 1),
    n AS (SELECT 'w' || l_partkey AS node, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT l.*, count(*) OVER (PARTITION BY component) AS size, coalesce(n, 0) AS n FROM l LEFT JOIN n USING (node)),
    k AS (SELECT *, first_value(node) OVER (PARTITION BY component ORDER BY n DESC, len(node), node) AS canonical FROM s WHERE size <= 12)
    SELECT node AS variant, canonical FROM k WHERE node <> canonical"""
)
def unified_words(spark, sf_dir):
    word = lambda c: F.concat(F.lit("w"), F.col(c).cast("string"))
    nxt = F.lead("p_partkey").over(Window.partitionBy("p_name", "p_size").orderBy("p_partkey"))
    edges = table(spark, sf_dir, "part").select("p_partkey", nxt.alias("n")).filter("n is not null").select(word("p_partkey").alias("a"), word("n").alias("b"))
    counts = table(spark, sf_dir, "lineitem").groupBy(word("l_partkey").alias("token")).agg(F.count("*").alias("n"))
    return judging.unified(edges, counts)


@query()
def padded_phrases(spark, sf_dir):
    """Swaps of a word and a phrase that says it with more words."""
    return judging.padded_phrases(mining.swaps(_text_pairs(spark, sf_dir), "a", "b")).select("a", "b", "n")


# --- documented alternatives that SQL expresses -------------------------------


@query(f"WITH {_SCORED} SELECT s1_id, s23_id, CASE WHEN score >= 0.9 THEN 'strong' WHEN score >= 0.6 AND norm_addr <> '' THEN 'supported' WHEN score >= 0.6 THEN 'weak' END AS rule FROM p WHERE score >= 0.6")
def rule_cascade(spark, sf_dir):
    rule = F.when(F.col("score") >= 0.9, "strong").when((F.col("score") >= 0.6) & (F.col("norm_addr") != ""), "supported").when(F.col("score") >= 0.6, "weak")
    return _scored(spark, sf_dir).select("s1_id", "s23_id", rule.alias("rule")).filter("rule is not null")


@query(
    f"""WITH {_SCORED}, x AS (SELECT p.*, gt.s1_id IS NOT NULL AS y, score >= 0.5 AS a, norm_addr <> '' AS b FROM p LEFT JOIN gt USING (s1_id, s23_id)),
    m AS (SELECT ln(((count(*) FILTER (a AND y) + 1) / (count(*) FILTER (y) + 2)) / ((count(*) FILTER (a AND NOT y) + 1) / (count(*) FILTER (NOT y) + 2))) AS wa, ln(((count(*) FILTER (b AND y) + 1) / (count(*) FILTER (y) + 2)) / ((count(*) FILTER (b AND NOT y) + 1) / (count(*) FILTER (NOT y) + 2))) AS wb FROM x)
    SELECT s1_id, s23_id, round(CASE WHEN a THEN wa ELSE 0 END + CASE WHEN b THEN wb ELSE 0 END, 6) AS weight FROM x, m"""
)
def fellegi_sunter(spark, sf_dir):
    x = _scored(spark, sf_dir).join(_truth(spark, sf_dir).withColumn("t", F.lit(1)), ["s1_id", "s23_id"], "left")
    x = x.select("s1_id", "s23_id", F.col("t").isNotNull().alias("y"), (F.col("score") >= 0.5).alias("a"), (F.col("norm_addr") != "").alias("b"))
    rate = lambda c, y: (F.count(F.when(c & y, 1)) + 1) / (F.count(F.when(y, 1)) + 2)
    w = lambda c: F.log(rate(F.col(c), F.col("y")) / rate(F.col(c), ~F.col("y")))
    m = x.agg(w("a").alias("wa"), w("b").alias("wb"))  # one row
    return x.join(F.broadcast(m), F.lit(True)).select("s1_id", "s23_id", F.round(F.when(F.col("a"), F.col("wa")).otherwise(0) + F.when(F.col("b"), F.col("wb")).otherwise(0), 6).alias("weight"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest whole linkage: n-gram candidates, assignment, two thresholds, lists."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("S1-"), F.col("p_partkey").cast("string")).alias("s1_id"))
    chosen = policy.select_matches(tfidf_topk_name(spark, sf_dir).withColumnRenamed("sim", "score"), "score", 0.6, 0.75)
    return policy.id_lists(chosen, part)
