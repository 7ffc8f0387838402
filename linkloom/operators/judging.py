"""Candidates and requests for judging word pairs, and the rules that accept answers; the judge itself is outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..functions.udf import similarity
from ..sources.stage import staged
from . import mining
from .blocking import char_grams


def noisy(word: Column) -> Column:
    """A digit inside, or an l that stands for i."""
    return word.rlike(r"[0-9]|^l[nm]")


def word_classes(vocab: DataFrame, top: int, *keys: str) -> DataFrame:
    """(keys, token, n): the most frequent alphabetic words of two letters or more."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "token")
    return vocab.filter(F.col("token").rlike("^[a-z]{2,}$")).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")


def ambiguous_contexts(neighbours: DataFrame, top: int = 6, min_count: int = 20) -> DataFrame:
    """(token, following, n): short forms of several meanings with the words that often follow, and alone ("")."""
    own = neighbours.filter(F.col("token").isin(*fixed.AMBIGUOUS))
    w = Window.partitionBy("token").orderBy(F.desc("n"), "neighbour")
    right = own.filter((F.col("side") == "right") & (F.col("n") >= min_count)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top)
    alone = own.groupBy("token").agg(F.sum("n").alias("n"))
    return right.select("token", F.col("neighbour").alias("following"), "n").unionByName(alone.select("token", F.lit("").alias("following"), "n"))


def meaning_requests(words: DataFrame) -> DataFrame:
    """(token, request): a JSON question about each short form that has several meanings."""
    rows = words.filter(F.col("token").isin(*fixed.AMBIGUOUS))
    meanings = F.split(X.looked_up(fixed.AMBIGUOUS, F.col("token")), " ")
    return rows.select("token", F.to_json(F.struct(F.col("token").alias("word"), meanings.alias("meanings"))).alias("request"))


def transliterations(words: DataFrame, targets: DataFrame, by_key: int = 6, by_spelling: int = 3, swapped: DataFrame | None = None, by_swap: int = 4, most_in_all: int = 12) -> DataFrame:
    """(token, candidates): for each word its swap partners among the targets (``swapped``, as ``mining.swaps`` has them),
    then the targets most similar by loan key, then by spelling, without repeats.

    Pairs come from an equi-join on 3-grams of the key and of the spelling, so nothing is compared that shares none.
    """
    clean = targets.filter(~noisy(F.col("token"))).select(F.col("token").alias("target"))
    out = None
    if swapped is not None:
        found = mining.partners(swapped, most=by_swap, among=clean.select(F.col("target").alias("partner"))).join(words.select("token"), "token", "left_semi")
        out = found.select("token", F.posexplode("partners").alias("_r", "target")).filter("token <> target").select("token", "target", F.concat(F.lit("0"), F.lpad(F.col("_r").cast("string"), 3, "0")).alias("order"))
    for kind, form, most in (("1", X.loan_key, by_key), ("2", lambda c: c, by_spelling)):
        a = staged(words.select("token", form(F.col("token")).alias("form")), "words")
        b = staged(clean.select("target", form(F.col("target")).alias("other")), "targets")
        top = mining.nearest(a, b, most).select("token", "target", F.concat(F.lit(kind), F.lpad(F.col("rank").cast("string"), 3, "0")).alias("order"))
        out = top if out is None else out.unionByName(top)
    first = out.groupBy("token", "target").agg(F.min("order").alias("order"))
    return first.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "target"))), lambda x: x["target"]).alias("candidates")).withColumn("candidates", F.slice("candidates", 1, most_in_all))


def fuzzy_canonical(words: DataFrame, cutoff: float = 90) -> DataFrame:
    """(token, canonical): the canonical form of a word, or of the closest canonical word of six letters or more; else itself."""
    table = fixed.canonical_words()
    known = words.sparkSession.createDataFrame([(w,) for w in table if len(w) >= 6], "other string")
    grams = lambda df, c: df.select(c, F.explode(F.array_distinct(char_grams(F.col(c), (3,)))).alias("gram"))
    near = grams(words.filter((F.length("token") >= 6) & ~F.col("token").isin(*table)), "token").join(F.broadcast(grams(known, "other")), "gram").select("token", "other").distinct()
    scored = near.withColumn("score", similarity(F.col("token"), F.col("other"), "ratio")["ratio"] * 100).filter(F.col("score") >= cutoff)
    best = scored.groupBy("token").agg(F.min_by("other", F.struct(-F.col("score"), F.col("other"))).alias("other"))
    form = F.coalesce("other", "token")
    return words.join(best, "token", "left").select("token", X.looked_up(table, form).alias("canonical"))


def partial_phrases(swaps: DataFrame) -> DataFrame:
    """Swaps of two words of which one is also swapped, at least half as often, with a phrase that holds the other."""
    both = swaps.select(F.col("a").alias("word"), F.col("b").alias("phrase"), F.col("n").alias("m")).unionByName(swaps.select(F.col("b").alias("word"), F.col("a").alias("phrase"), F.col("n").alias("m"))).filter(F.col("phrase").contains(" "))
    halves = both.select("word", F.explode(F.split("phrase", " ")).alias("half"), "m").groupBy("word", "half").agg(F.max("m").alias("m"))
    hit = None
    for x, y in (("a", "b"), ("b", "a")):
        part = swaps.join(halves, (swaps[x] == halves["word"]) & (swaps[y] == halves["half"]) & (halves["m"] >= 0.5 * swaps["n"]), "left_semi")
        hit = part if hit is None else hit.unionByName(part)
    return hit.distinct()


def padded_phrases(swaps: DataFrame, cutoff: float = 70) -> DataFrame:
    """Swaps of a word and a phrase that has a close form of the word, an abbreviation of it, or its canonical word, and more besides."""
    rows = swaps.filter(F.col("a").contains(" ") != F.col("b").contains(" ")).withColumns({"word": F.when(F.col("a").contains(" "), F.col("b")).otherwise(F.col("a")), "phrase": F.when(F.col("a").contains(" "), F.col("a")).otherwise(F.col("b"))})
    rows = rows.filter(F.replace("phrase", F.lit(" "), F.lit("")) != F.col("word"))
    parts = rows.select("a", "b", "word", F.explode(F.split("phrase", " ")).alias("part"))
    canonical = lambda c: X.looked_up(fixed.canonical_words(), c)
    close = (similarity(F.col("word"), F.col("part"), "ratio")["ratio"] * 100 >= cutoff) | (canonical(F.col("word")) == canonical(F.col("part"))) | X.is_abbreviation(F.col("word"), F.col("part")) | X.is_abbreviation(F.col("part"), F.col("word"))
    return swaps.join(parts.filter(close).select("a", "b").distinct(), ["a", "b"], "left_semi")


def same_word(answers: DataFrame, p_same: float = 0.6, p_different: float = 0.5) -> DataFrame:
    """Answers (same, different: probabilities; relation and its p) that say two words are the same."""
    return answers.filter((F.col("same") >= p_same) & (F.coalesce("different", F.lit(0.0)) < p_different) & ~F.coalesce((F.col("relation") == "different") & (F.col("p_relation") >= 0.5), F.lit(False)))


def accepted_abbreviations(answers: DataFrame) -> DataFrame:
    """Answers (country, field, token, choice, p): from 0.7, names from 0.8 (0.9 for two letters), single letters only r in French addresses."""
    n = F.length("token")
    least = F.when(F.col("field") == "name", F.when(n <= 2, 0.9).otherwise(0.8)).otherwise(0.7)
    return answers.filter((F.col("choice") != "none") & (F.col("p") >= least) & ((n > 1) | ((F.col("country") == "FRANCE") & (F.col("field") == "addr") & (F.col("token") == "r"))))


def unified(edges: DataFrame, counts: DataFrame, most: int = 12) -> DataFrame:
    """Accepted pairs as rewrites to one canonical word a group."""
    return mining.synonyms(edges, counts, most)
