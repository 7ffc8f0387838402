"""Evidence from corpora of records: vocabularies, variants, look-alikes, audits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.stage import staged


def vocabulary(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, token, n): token counts with partial aggregation."""
    return rows.select(*keys, F.explode(X.tokens(F.col(text))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def neighbours(rows: DataFrame, text: str, longest: int = 4) -> DataFrame:
    """(token, side, neighbour, n) of alphabetic tokens of at most ``longest`` letters."""
    w, none = F.col("w"), F.array(F.lit(None).cast("string"))
    # every word beside the one before and the one behind it: each word travels three times, whatever the text's length
    beside = F.arrays_zip(F.concat(none, w).alias("left"), w.alias("token"), F.concat(F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), none).alias("right"))
    at = rows.select(X.tokens(F.col(text)).alias("w")).filter(F.size("w") > 1).select(F.inline(beside)).filter(F.col("token").rlike(f"^[a-z]{{1,{longest}}}$"))
    sides = at.select("token", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("neighbour")), F.struct(F.lit("right").alias("side"), F.col("right").alias("neighbour")))).alias("x"))
    return sides.select("token", "x.side", "x.neighbour").filter("neighbour is not null").groupBy("token", "side", "neighbour").agg(F.count("*").alias("n"))


def vocabulary_shift(a: DataFrame, b: DataFrame, min_count: int = 20) -> DataFrame:
    """(token, log_ratio) of the add-one rates of two vocabularies (token, n)."""
    size = lambda v: v.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(1)), F.lit(1)).alias("total"))
    both = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), "token", "full").select("token", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb")).filter(F.col("na") + F.col("nb") >= min_count)
    # two single rows
    both = both.join(F.broadcast(size(a).withColumnRenamed("total", "ta")), F.lit(True)).join(F.broadcast(size(b).withColumnRenamed("total", "tb")), F.lit(True))
    return both.select("token", (F.log((F.col("na") + 1) / F.col("ta")) - F.log((F.col("nb") + 1) / F.col("tb"))).alias("log_ratio"))


def _one_sided(pairs: DataFrame, a: Column, b: Column, most: int) -> DataFrame:
    rows = pairs.withColumns({"oa": F.array_except(a, b), "ob": F.array_except(b, a)})
    return rows.filter(F.size("oa").between(1, most) & F.size("ob").between(1, most))


def token_variants(pairs: DataFrame, a: str, b: str, min_count: int = 10, most: int = 3) -> DataFrame:
    """(tok_a, tok_b, n, conf) of tokens that stand on one side each of true pairs; conf: n over the rarer token's count."""
    rows = _one_sided(pairs, F.array_distinct(X.tokens(F.col(a))), F.array_distinct(X.tokens(F.col(b))), most)
    na = rows.select(F.explode("oa").alias("tok_a")).groupBy("tok_a").agg(F.count("*").alias("na"))
    nb = rows.select(F.explode("ob").alias("tok_b")).groupBy("tok_b").agg(F.count("*").alias("nb"))
    n = rows.select(F.explode("oa").alias("tok_a"), "ob").select("tok_a", F.explode("ob").alias("tok_b")).groupBy("tok_a", "tok_b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    return n.join(na, "tok_a").join(nb, "tok_b").select("tok_a", "tok_b", "n", (F.col("n") / F.least("na", "nb")).alias("conf"))


def swaps(pairs: DataFrame, a: str, b: str, *keys: str, min_count: int = 15, min_rate: float = 0.05, most: int = 3) -> DataFrame:
    """(keys, a, b, n, rate) of unordered swaps of words, and of adjacent pairs against words, of true pairs.

    Only grams whose words are all one-sided count; rate is n over the rarer side's occurrences.
    """
    ta, tb = F.array_distinct(X.tokens(F.col(a))), F.array_distinct(X.tokens(F.col(b)))
    rows = _one_sided(pairs.withColumns({"ga": X.grams(F.col(a)), "gb": X.grams(F.col(b))}), ta, tb, most)
    own = lambda g, o: F.filter(g, lambda x: F.forall(F.split(x, " "), lambda w: F.array_contains(o, w)))
    rows = rows.withColumns({"ga": own(F.col("ga"), F.col("oa")), "gb": own(F.col("gb"), F.col("ob"))})
    occ = rows.select(*keys, F.explode(F.array_union("ga", "gb")).alias("t")).groupBy(*keys, "t").agg(F.count("*").alias("occ"))
    both = rows.select(*keys, F.explode("ga").alias("x"), "gb").select(*keys, "x", F.explode("gb").alias("y")).filter(~(F.col("x").contains(" ") & F.col("y").contains(" ")))
    n = both.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).groupBy(*keys, "a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    counted = n.join(occ.withColumnsRenamed({"t": "a", "occ": "occ_a"}), [*keys, "a"]).join(occ.withColumnsRenamed({"t": "b", "occ": "occ_b"}), [*keys, "b"])
    return counted.withColumn("rate", F.col("n") / F.least("occ_a", "occ_b")).filter(F.col("rate") >= min_rate).select(*keys, "a", "b", "n", "rate")


def partners(swapped: DataFrame, min_rate: float = 0.03, most: int = 4, among: DataFrame | None = None) -> DataFrame:
    """(token, partners): a word's swap partners of either direction, most frequent first, of those in ``among`` (partner) if given."""
    good = swapped.filter((F.col("rate") >= min_rate) & ~F.col("a").contains(" ") & ~F.col("b").contains(" "))
    both = good.select(F.col("a").alias("token"), F.col("b").alias("partner"), "n").unionByName(good.select(F.col("b").alias("token"), F.col("a").alias("partner"), "n"))
    if among is not None:
        both = both.join(among.distinct(), "partner", "left_semi")
    top = both.withColumn("_r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("n"), "partner"))).filter(F.col("_r") <= most)
    return top.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "partner"))), lambda x: x["partner"]).alias("partners"))


def lookalikes(vocab: DataFrame, key: Column, per_key: int = 5) -> DataFrame:
    """(key, a, b) with a < b of words that share a key, among each key's most frequent; words without a key go first."""
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "token"))
    # a key that hangs on the count is made once for each word, not pushed below the counting to each occurrence
    top = vocab.withColumn("key", F.when(F.col("n") > 0, key)).filter("key <> ''").withColumn("_r", best).filter(F.col("_r") <= per_key)
    # per_key words at most
    words = top.groupBy("key").agg(F.collect_list("token").alias("words")).filter(F.size("words") > 1)
    pairs = F.expr("flatten(transform(words, x -> transform(filter(words, y -> y > x), y -> struct(x as a, y as b))))")
    return words.select("key", F.explode(pairs).alias("p")).select("key", "p.a", "p.b")


def abbreviations(vocab: DataFrame, min_short: int = 60, min_long: int = 20, longest: int = 4, per_short: int = 10) -> DataFrame:
    """(short, long) where long spells out short: alike first letter (an equi-join), letters in order, the most frequent first."""
    words = vocab.filter(F.col("token").rlike("^[a-z]+$")).withColumn("head", F.substring("token", 1, 1))
    short = words.filter((F.length("token") <= longest) & (F.col("n") >= min_short)).select("head", F.col("token").alias("short"))
    long = words.filter((F.length("token") > 1) & (F.col("n") >= min_long)).select("head", F.col("token").alias("long"), "n")
    hit = short.join(long, "head").filter(X.is_abbreviation(F.col("short"), F.col("long")))
    return hit.withColumn("_r", F.row_number().over(Window.partitionBy("short").orderBy(F.desc("n"), "long"))).filter(F.col("_r") <= per_short).select("short", "long", "n")


def _letters(word: Column) -> Column:
    """A bit for each letter a to z that a word has, and one more if it has it twice or more."""
    bits = F.lit(0).cast("long")
    for i, ch in enumerate("abcdefghijklmnopqrstuvwxyz"):
        n = F.length(word) - F.length(F.replace(word, F.lit(ch), F.lit("")))
        bits = bits.bitwiseOR(F.when(n > 1, (1 << i) + (1 << (26 + i))).when(n > 0, 1 << i).otherwise(0).cast("long"))
    return bits


def alike(words: DataFrame, targets: DataFrame, least: float) -> DataFrame:
    """(form, other) of different or equal ``form`` of words and ``other`` of targets that share a character 3-gram
    and can be alike at a ratio of ``least`` or more (from 0 to 1); no such pair is left out.

    Each bit of the letters that only one form has is a letter to remove, so pairs are dropped where they are joined,
    before anything is shuffled or scored. Frequent grams are spread over salts.
    """
    from .blocking import char_grams

    salts = 16
    side = lambda df, c: df.select(c, F.length(c).alias(f"{c}_n"), _letters(F.col(c)).alias(f"{c}_m"), F.explode(F.array_distinct(char_grams(F.col(c), (3,)))).alias("gram"))
    w = side(words, "form").withColumn("salt", F.pmod(F.xxhash64("form"), F.lit(salts)).cast("int"))
    t = side(targets, "other").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = w.join(t.hint("merge"), ["gram", "salt"])
    if least > 0:
        both = both.filter(F.bit_count(F.col("form_m").bitwiseXOR(F.col("other_m"))) <= (F.col("form_n") + F.col("other_n")) * (1 - least) + 1e-6)
    return both.select("form", "other").distinct()


def similar_words(vocab: DataFrame, cutoff: float = 85, top: int = 5) -> DataFrame:
    """(token, other, score): the most similar words by ratio, among those that share a character 3-gram."""
    from ..functions.udf import similarity

    words = staged(vocab.select("token"), "words")
    near = alike(words.withColumnRenamed("token", "form"), words.withColumnRenamed("token", "other"), cutoff / 100).filter("form <> other").withColumnRenamed("form", "token")
    scored = near.withColumn("score", similarity(F.col("token"), F.col("other"), "ratio")["ratio"] * 100).filter(F.col("score") >= cutoff)
    return scored.withColumn("_r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "other"))).filter(F.col("_r") <= top).drop("_r")


#: Forms and others that are compared in one task at a time.
FORMS, OTHERS = 16_000, 200_000


def nearest(words: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(token, target, rank): for each of words (token, form) the ``most`` targets (target, other) most similar by ratio among those that
    share a 3-gram, ties to the smaller target.

    Distinct forms are compared, once for all words that have them, each with its ``most`` + 1 smallest targets (a word is no target of
    its own). Forms and others meet in cells of bounded size, each part of the ones with each of the others.
    """
    from ..functions.udf import NEAREST, nearest_in_cell

    by = lambda key, *order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    spelled = staged(targets.withColumn("_r", by("other", F.asc("target"))).filter(F.col("_r") <= most + 1).select("other", "target"), "spelled")
    forms = staged(words.select("form").distinct(), "forms")
    others = staged(spelled.groupBy("other").agg(F.min("target").alias("first")), "others")
    rows, cols = (max(1, -(-df.count() // n)) for df, n in ((forms, FORMS), (others, OTHERS)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cells = min(2 * rows * cols, 2000)
    a = forms.select("form", part("form", rows).alias("_a"), each(cols).alias("_b")).select("form", (F.col("_a") * cols + F.col("_b")).alias("cell"))
    b = others.select("other", "first", part("other", cols).alias("_b"), each(rows).alias("_a")).select("other", "first", (F.col("_a") * cols + F.col("_b")).alias("cell"))
    # numbered parts: small rows are much work here, so tasks are not to be put together by their bytes
    in_cell = lambda df: df.repartition(cells, "cell").groupBy("cell")
    near = in_cell(a).cogroup(in_cell(b)).applyInArrow(nearest_in_cell(most + 1), NEAREST)
    # a form's other has its best targets if it is among the first by score and its smallest target
    few = staged(near.withColumn("_r", by("form", F.desc("score"), F.asc("first"))).filter(F.col("_r") <= most + 1).drop("_r"), "nearest")
    best = few.join(spelled.hint("merge"), "other").withColumn("_r", by("form", F.desc("score"), F.asc("target"))).filter(F.col("_r") <= most + 1).select("form", "target", "score")
    ranked = words.join(best.hint("merge"), "form").filter("token <> target").withColumn("rank", by("token", F.desc("score"), F.asc("target")))
    return ranked.filter(F.col("rank") <= most).select("token", "target", "rank")


def script_audit(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, script, share): the share of a group's rows that hold letters of each script but ascii."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    n = rows.select(*keys, F.explode(X.scripts_in(F.col(text))).alias("script")).groupBy(*keys, "script").agg(F.count("*").alias("n"))
    return n.join(sizes, list(keys)).select(*keys, "script", (F.col("n") / F.col("rows")).alias("share"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over ``edges`` (a, b), by contraction with staged rounds.

    Each round points every node to the least of itself and its neighbours, follows these pointers by doubling to their ends, and
    replaces edges by those of the ends. An end that has taken in no other is beside a smaller one then and goes in the next round, so
    two rounds halve the nodes at least: chains of any length and order take a logarithm of rounds.
    """
    nodes = staged(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct(), "nodes")
    pairs = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, rounds = staged(pairs(edges), "edges"), []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")), "ends")
        while True:
            further = ends.select(F.col("a").alias("to"), F.col("to").alias("end"))
            moved = staged(ends.join(further.hint("merge"), "to").select("a", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "ends")
            ends = moved.select("a", "to")
            if moved.filter("moved").isEmpty():
                break
        rounds.append(ends)
        heads = left.join(ends.hint("merge"), "a").select(F.col("to").alias("a"), "b")
        tails = heads.join(ends.select(F.col("a").alias("b"), "to").hint("merge"), "b").select("a", F.col("to").alias("b"))
        left = staged(pairs(tails), "edges")
    if not rounds:
        return nodes.withColumn("component", F.col("node"))
    found = rounds.pop()
    while rounds:  # the maps one after the other, the smallest first
        last = found.select(F.col("a").alias("to"), F.col("to").alias("end"))
        found = staged(rounds.pop().join(last.hint("merge"), "to", "left").select("a", F.coalesce("end", "to").alias("to")), "labels")
    return nodes.join(found.hint("merge"), nodes["node"] == found["a"], "left").select("node", F.coalesce("to", "node").alias("component"))


def synonyms(edges: DataFrame, counts: DataFrame, most: int = 12) -> DataFrame:
    """(variant, canonical): words of a component of accepted edges rewrite to its most frequent (then shortest) word; larger components go."""
    c = components(edges)
    size = c.groupBy("component").agg(F.count("*").alias("size"))
    rows = c.join(size, "component").filter(F.col("size") <= most).join(counts.select(F.col("token").alias("node"), "n"), "node", "left")
    best = rows.groupBy("component").agg(F.min_by("node", F.struct(-F.coalesce("n", F.lit(0)), F.length("node"), F.col("node"))).alias("canonical"))
    return rows.join(best, "component").filter("node <> canonical").select(F.col("node").alias("variant"), "canonical")


def auc(rows: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """(keys, auc, n_pos, n_neg): area under the ROC curve from counts of each distinct score, ties at half."""
    by = rows.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = by.withColumn("q_below", F.coalesce(F.sum("q").over(w), F.lit(0)))
    total = below.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("q_below") + F.col("q") / 2)).alias("u"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return total.select(*keys, F.try_divide("u", F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def hard_negatives(candidates: DataFrame, truth: DataFrame, score: str, within: int = 5) -> DataFrame:
    """Each Source 1 record's best candidate that is no true pair, among its first ``within``."""
    w = Window.partitionBy("s1_id").orderBy(F.desc(score), "s23_id")
    first = candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= within).join(truth, ["s1_id", "s23_id"], "left_anti")
    return first.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def hard_cases(rows: DataFrame, score: str, label: str, key: str, ident: str, n: int, seed: str = "0") -> DataFrame:
    """Per key ``n`` of the 3n lowest-scored positives and of the 3n highest-scored negatives, drawn by a seeded hash."""
    out = None
    for y, order in ((1, F.asc(score)), (0, F.desc(score))):
        hard = rows.filter(F.col(label) == y).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order, ident))).filter(F.col("_r") <= 3 * n)
        drawn = hard.withColumn("_d", F.row_number().over(Window.partitionBy(key).orderBy(F.md5(F.concat(F.col(ident).cast("string"), F.lit(seed))), ident))).filter(F.col("_d") <= n).drop("_r", "_d")
        out = drawn if out is None else out.unionByName(drawn)
    return out


def cause_report(rows: DataFrame, key: str, cause: str, probability: str) -> DataFrame:
    """(cause, key, mean): by group and, with key "all", overall, in one rollup."""
    r = rows.rollup(cause, key).agg(F.avg(probability).alias("mean"), F.grouping(cause).alias("gc"), F.grouping(key).alias("gk")).filter("gc = 0")
    return r.select(F.col(cause).alias("cause"), F.when(F.col("gk") == 1, "all").otherwise(F.col(key)).alias("key"), "mean")


def batched(rows: DataFrame, order: str, size: int) -> DataFrame:
    """(batch, ids): ids in order, ``size`` to a request, numbered from 0 in ranges so that no task holds all."""
    ranked = rows.select(order).repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    counts = ranked.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_s")
    numbered = ranked.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1).join(F.broadcast(counts), "_p").withColumn("_i", F.col("_s") + F.col("_i"))
    return numbered.groupBy(F.floor(F.col("_i") / size).alias("batch")).agg(F.array_sort(F.collect_list(order)).alias("ids"))


def unanswered(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests (a struct column ``request``) whose SHA-1 key has no answer yet."""
    return requests.withColumn("key", F.sha1(F.to_json("request"))).join(answers.select("key"), "key", "left_anti")


def judged(items: DataFrame, answers: DataFrame, option: str) -> DataFrame:
    """``items`` with ``p``: the probability their answer (JSON of probabilities by option) gives ``option``; null without an answer."""
    return items.join(answers, "key", "left").withColumn("p", F.try_element_at(F.from_json("answer", "map<string,double>"), F.lit(option)))


def accepted_swaps(rows: DataFrame) -> DataFrame:
    """``rows`` (n, rate, occ) with ``verdict``: same from 5 swaps at a rate of 0.05, different with none in 50 occurrences, else open."""
    return rows.withColumn("verdict", F.when((F.col("n") >= 5) & (F.col("rate") >= 0.05), "same").when((F.col("n") == 0) & (F.col("occ") >= 50), "different").otherwise("open"))
