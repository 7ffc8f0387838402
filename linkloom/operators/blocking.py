"""Candidate generation: n-gram TF-IDF similarity joins in blocking groups, in DataFrame operations.

Vectors are postings (group, id, gram, w). A Source 1 record lies in one group,
a Source 2/3 record in each group that may need it; so the theta condition on
country and region becomes an equi-join. Grams in too many records of a group
are dropped before the join, which bounds each posting list and thus the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.stage import staged

VIEWS = {"name": 20, "core": 10, "text": 40}
MIN_SIM = 0.015


def view(name: str) -> Column:
    """The text of a view of a prepared record."""
    return {"name": F.col("norm_name"), "core": F.col("core"), "text": F.concat(F.col("norm_name"), F.lit(" "), F.col("norm_addr"))}[name]


def _cut(w: Column, k: int):
    return lambda p: F.substring(w, p, F.lit(k))


def char_grams(c: Column, sizes=(3, 4)) -> Column:
    """Grams within each lower-case word, padded with a blank on either side; a padded word no longer than a gram counts once and stops there."""
    words = F.transform(X.tokens(F.lower(c)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column) -> Column:
        n = F.length(w)
        parts = []
        for i, k in enumerate(sizes):
            windows = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), _cut(w, k))
            if i == 0:
                parts.append(windows)
            else:  # a word that an earlier size took whole has no longer grams
                parts.append(F.when(n > sizes[i - 1], windows).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.flatten(F.transform(words, of))


def term_counts(rows: DataFrame, terms: Column, *keys: str) -> DataFrame:
    """(keys, gram, tf) of each row's terms."""
    return rows.select(*keys, F.explode(terms).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("tf"))


def fitted(pool: DataFrame, min_df: int = 2, max_df: float | None = 0.01, max_df_floor: int = 50, copies: bool = False) -> DataFrame:
    """(grp, gram, idf) over the pool's counts (grp, id, gram, tf): grams in at least min_df and at most max(ceil(max_df * n), floor) of the group's n records.

    Without ``max_df`` all grams. With ``copies`` the pool has a column n, the number of records that each id stands for.
    """
    n = F.sum("n") if copies else F.count("*")
    sizes = pool.select("grp", "id", *["n"] * copies).distinct().groupBy("grp").agg(n.alias("n"))
    df = pool.groupBy("grp", "gram").agg(n.alias("df"))
    kept = df.join(F.broadcast(sizes), "grp")  # groups are few
    if max_df is not None:
        kept = kept.filter((F.col("df") >= min_df) & (F.col("df") <= F.greatest(F.ceil(F.col("n") * max_df), F.lit(max_df_floor))))
    return kept.select("grp", "gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(grp, id, gram, w): (1 + ln tf) * idf over known grams, of length one per record.

    Joins of postings are shuffled by a hint: estimates know nothing of the rows that a text explodes into, so Spark
    would broadcast postings of a table that is small on disk.
    """
    raw = counts.join(idf.hint("merge"), ["grp", "gram"]).withColumn("x", (1 + F.log("tf")) * F.col("idf"))
    # one record's grams: a small window
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("grp", "id")))
    return raw.select("grp", "id", "gram", (F.col("x") / norm).alias("w"))


def block_groups(s1: DataFrame, s23: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, grp) of both sides. s1 and s23: entity_id, country, region.

    A Source 1 record looks in its country and region (all of the country if its region is unknown, everything if
    its country is). A Source 2/3 record is found under its own region or any if unknown, its own country or any.
    """
    label = lambda c, r: F.concat(c, F.lit("/"), F.when(r == "", "*").otherwise(r))
    one = s1.select(F.col("entity_id").alias("id"), label(F.col("country"), F.col("region")).alias("grp"), "country", "region")
    groups = one.select("grp", "country", "region").distinct()
    either = lambda c: F.explode(F.array_distinct(F.array(F.col(c), F.lit(""))))
    rows = s23.select(F.col("entity_id").alias("id"), "country", "region")
    known_c, known_r = F.col("country") != "", F.col("region") != ""
    both = rows.filter(known_c & known_r).select("id", either("country").alias("country"), "region").select("id", "country", either("region").alias("region")).join(groups, ["country", "region"])
    country = rows.filter(known_c & ~known_r).select("id", either("country").alias("country")).join(groups, "country")
    region = rows.filter(~known_c & known_r).select("id", either("region").alias("region")).join(groups, "region")
    # records without either are in every group; groups are few, and spread over salts lest one task has all such records
    salts = 32
    neither = rows.filter(~known_c & ~known_r).select("id", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).join(groups.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")), "salt")
    two = both.select("id", "grp")
    for part in (country, region, neither):
        two = two.unionByName(part.select("id", "grp"))
    return one.select("id", "grp"), two


def top_k(q: DataFrame, d: DataFrame, k: int, min_sim: float = MIN_SIM) -> DataFrame:
    """(s1_id, s23_id, sim): for each id of ``q`` the k most similar of ``d`` by dot product, ties to the smaller id, then the floor."""
    pairs = q.select("grp", F.col("id").alias("s1_id"), "gram", F.col("w").alias("wq")).join(d.select("grp", F.col("id").alias("s23_id"), "gram", F.col("w").alias("wd")).hint("merge"), ["grp", "gram"])
    sims = pairs.groupBy("s1_id", "s23_id").agg(F.round(F.sum(F.col("wq") * F.col("wd")), 6).alias("sim"))
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("sim"), "s23_id"))
    return sims.withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("sim") >= min_sim)).select("s1_id", "s23_id", "sim")


def _by_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, texts) of rows (id, grp, name), and (texts, first, n): the smallest of the ids with the same texts in the same groups, and their number."""
    ids = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("grp", "name"))).alias("texts"))
    return ids, ids.groupBy("texts").agg(F.min("id").alias("first"), F.count("*").alias("n"))


def top_k_of_all(s1: DataFrame, s23: DataFrame, k: int, min_sim: float = MIN_SIM) -> DataFrame:
    """(s1_id, s23_id, sim): ``top_k`` of rows (id, grp, name) over all their grams, however frequent or rare.

    Ids with the same texts have the same vector and the same neighbours, so each text's vector is made and compared once, in the
    name of its smallest id. A text beyond the first k (by similarity, then by that id) has no id among the k most similar, nor has one beyond
    a text's k smallest ids; the others come back in the end.
    """
    (a, texts_a), (b, texts_b) = _by_texts(s1), _by_texts(s23)
    counted = lambda texts: term_counts(texts.select(F.col("first").alias("id"), "n", F.inline("texts")).select("grp", "id", "n", char_grams(F.col("name")).alias("terms")), F.col("terms"), "grp", "id", "n")
    pool = staged(counted(texts_b), "pool")
    idf = fitted(pool, 1, None, copies=True)
    best = top_k(weighted(counted(texts_a), idf), weighted(pool, idf), k, min_sim).withColumnsRenamed({"s1_id": "first", "s23_id": "other"})
    by = lambda key, *order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    few = b.withColumn("_r", by("texts", "id")).filter(F.col("_r") <= k).join(texts_b.hint("merge"), "texts").select(F.col("first").alias("other"), F.col("id").alias("s23_id"))
    found = best.join(few.hint("merge"), "other").withColumn("_r", by("first", F.desc("sim"), "s23_id")).filter(F.col("_r") <= k).select("first", "s23_id", "sim")
    return a.join(texts_a.hint("merge"), "texts").select(F.col("id").alias("s1_id"), "first").join(found.hint("merge"), "first").select("s1_id", "s23_id", "sim")


def similarity_join(s1: DataFrame, s23: DataFrame, text: Column, k: int, groups=None, max_df: float | None = 0.01, max_df_floor: int = 50, min_df: int = 2, min_sim: float = MIN_SIM) -> DataFrame:
    """Blocking by one view of prepared tables: fit on ``s23`` of each group, then ``top_k``."""
    one, two = groups or block_groups(s1, s23)
    counted = lambda rows, g: term_counts(rows.select(F.col("entity_id").alias("id"), char_grams(text).alias("terms")).join(g, "id"), F.col("terms"), "grp", "id")
    pool = counted(s23, two)
    idf = fitted(pool, min_df, max_df, max_df_floor)
    return top_k(weighted(counted(s1, one), idf), weighted(pool, idf), k, min_sim)


def union_views(views: dict[str, DataFrame]) -> DataFrame:
    """(s1_id, s23_id, blk_<view>..., n_blockers): one shuffle instead of a chain of full outer joins."""
    rows = None
    for name, df in views.items():
        tagged = df.select("s1_id", "s23_id", F.lit(name).alias("view"), "sim")
        rows = tagged if rows is None else rows.unionByName(tagged)
    out = rows.groupBy("s1_id", "s23_id").agg(*[F.max(F.when(F.col("view") == v, F.col("sim"))).alias(f"blk_{v}") for v in views])
    return out.withColumn("n_blockers", sum((F.col(f"blk_{v}").isNotNull().cast("int") for v in views), F.lit(0)))


def candidates(s1: DataFrame, s23: DataFrame, views: dict[str, int] | None = None, **options) -> DataFrame:
    """All candidate pairs of prepared tables, from every view."""
    groups = block_groups(s1, s23)
    return union_views({v: similarity_join(s1, s23, view(v), k, groups, **options) for v, k in (views or VIEWS).items()})


def word_cosine(pairs: DataFrame, s1: DataFrame, s23: DataFrame, column: str, name: str) -> DataFrame:
    """``pairs`` with ``name``: the cosine of word TF-IDF vectors, fitted on all of ``s23`` without limits, of these pairs only."""
    counted = lambda rows: term_counts(rows.select(F.lit("*").alias("grp"), F.col("entity_id").alias("id"), X.tokens(F.lower(column)).alias("t")), F.col("t"), "grp", "id")
    pool = counted(s23)
    idf = fitted(pool, 1, None)
    q, d = weighted(counted(s1), idf), weighted(pool, idf)
    dots = (
        pairs.select("s1_id", "s23_id")
        .join(q.select(F.col("id").alias("s1_id"), "gram", F.col("w").alias("wq")).hint("merge"), "s1_id")
        .join(d.select(F.col("id").alias("s23_id"), "gram", F.col("w").alias("wd")).hint("merge"), ["s23_id", "gram"])
        .groupBy("s1_id", "s23_id")
        .agg(F.round(F.sum(F.col("wq") * F.col("wd")), 6).alias(name))
    )
    return pairs.join(dots.hint("merge"), ["s1_id", "s23_id"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def recall(candidates_: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true pairs found, all true pairs, their share (0 if there are none)."""
    hit = candidates_.select("s1_id", "s23_id").distinct().withColumn("hit", F.lit(1))
    return truth.join(hit.hint("merge"), ["s1_id", "s23_id"], "left").agg(F.count("hit").alias("found"), F.count("*").alias("total"), (F.count("hit") / F.greatest(F.count("*"), F.lit(1))).alias("recall"))
