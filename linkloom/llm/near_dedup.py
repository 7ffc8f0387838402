"""Near-duplicate documents by bottom-k sketches.

One hash function gives every word shingle a value. A document's sketch holds
the ``SKETCH`` least values of its set. Documents with equal sets form a class,
found by a digest of the set; all further work is on classes.

Candidates come from inverted lists of retained values. All classes put their
values in one order, those that fewer classes retain first. Two sketches that pass
the estimate below share at least ``least_shared`` values, so the first of these
is among the first size - least_shared + 1 values of either (``rare_values``): only
lists of these values are made, and a class none of whose values another class
retains as often as that is in no list at all. This holds for certain while sketches are whole sets, and
but for a chance of about 1e-8 for a pair beyond.

Lists of up to ``SHORT`` classes give all their pairs, lists with equal members
once. In longer lists each class meets two pivots, of which one is the class with
the fewest values of its own, the nearest to what the list has in common.
Candidates pass an estimate of the Jaccard similarity from the sketch of the
union, with a margin of over five standard errors, and are confirmed on full sets.

Pivots may leave a long list in several components (``open_links``). Such lists hang
together by common members in families, and the classes outside a family's main
component are compared with all of it in blocks, on full sets. Families in which that
would take over ``MOST_COMPARISONS`` go another way to the same links: among the first
n - ceil(0.75 n) + 1 values of a full set, in the order of how many of these classes
hold a value, lies one that any class at the threshold shares. Short lists of these
give the pairs of different components, and only what is in long ones meets in blocks.
Nothing is capped, and no link between components is lost.

Defined cases: a document without text or words has an empty set, its own
component, and is kept. Rows that repeat a doc_id count as one document, which has
all links of its rows (a row without words stays by itself). A null doc_id gets a
null component and is kept. Only ASCII capitals are lowered. Other columns of the
input are never looked at; an empty table gives an empty result. A set is hashed in
stretches of a text, so memory follows the number of its words, not of its bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components
from .runtime import bounded, forget, scratch, skew_lookup, written

WORDS = 5
PERCENT = 75
SKETCH = 64
SHORT = 16
#: Standard errors that an estimate may be off.
MARGIN = 5.5
BLOCK_CLASSES = 256
#: Comparisons of two classes in blocks, for one family; beyond, lists of full sets come first. Either way finds the same.
MOST_COMPARISONS = 1 << 30
#: A list is heavy when it has this share of the classes; a class is in SKETCH lists at most, so they are few.
HEAVY_SHARE = 1e-3
#: Rows of ids that are broadcast at most (16 MB); more go through a shuffled join.
BROADCAST_IDS = 1_000_000
SIGNED_SCHEMA = "doc_id long, n_shingles long, digest binary, sketch array<long>"
U64 = np.uint64


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Each text's set of shingle values, sorted, as numbers of 63 bits."""
    out = []
    for _, b in K.blocks(texts):
        b.find_words()
        h = b.hashes(b.starts, b.ends, lower=True)
        w, of = b.windows(h, words)
        w = (w >> U64(1)).astype(np.int64)
        at = np.searchsorted(of, np.arange(b.n + 1))
        for i in range(b.n):
            n = int(b.n_words[i])
            if 0 < n < words:
                x = np.array([n], U64)
                for v in h[b.words[i] : b.words[i + 1]]:
                    x = K.mix(x * K._P + v)
                out.append((x >> U64(1)).astype(np.int64))
            else:
                out.append(np.unique(w[at[i] : at[i + 1]]))
    return out


def signed(docs: DataFrame, words: int = WORDS, sketch: int = SKETCH) -> DataFrame:
    """doc_id, the size of the set, its digest (null if empty) and its bottom-k sketch."""

    def run(batches):
        for batch in K.small_batches(batches, "text"):
            sets = shingle_sets(K.column(batch, "text"), words)
            digests = []
            for s in sets:
                u = s.view(U64)
                parts = (u.sum(dtype=U64), K.mix(u).sum(dtype=U64)) if len(s) else None
                digests.append(None if parts is None else np.array(parts, U64).tobytes() + len(s).to_bytes(4, "little"))
            short = [s[:sketch] for s in sets]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in short]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(short) if short else np.zeros(0, np.int64)))], names=["doc_id", "n_shingles", "digest", "sketch"])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, SIGNED_SCHEMA)


def lists(rows: DataFrame, classes: int, short: int = SHORT) -> DataFrame:
    """The inverted lists of ``rows`` (key, node): members of those with 2 to ``short`` nodes; node and key, row by row, of longer ones.

    Heavy lists (``HEAVY_SHARE`` of the ``classes`` or more) are long for certain: no task gathers them.
    """
    schema = "members array<long>, node long, key long"

    def run(batches):
        held = None  # the last list, which may go on in the next batch
        open_key = None  # a long list whose members so far are out already

        def close(key, node, last: bool):
            nonlocal held, open_key
            starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
            sizes = np.diff(np.append(starts, len(key)))
            is_long = sizes > short
            if open_key is not None and key[0] == open_key:
                is_long[0] = True
            good = ~is_long & (sizes > 1)
            held = None
            if not last and not is_long[-1]:
                good[-1] = False
                held = key[starts[-1] :], node[starts[-1] :]
            open_key = key[-1] if is_long[-1] else None
            if is_long.any():
                of = np.repeat(is_long, sizes)
                n = int(of.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array(node[of]), pa.array(key[of])], names=["members", "node", "key"])
            if good.any():
                of, n = np.repeat(good, sizes), int(good.sum())
                offsets = np.concatenate(([0], np.cumsum(sizes[good]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(node[of])), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["members", "node", "key"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(2)]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            yield from close(*columns, last=False)
        if held is not None:
            yield from close(*held, last=True)

    most = max(short, int(classes * HEAVY_SHARE))
    heavy = F.broadcast(written(rows.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > most).select("key"), "heavy"))
    met = rows.join(heavy, "key", "left_anti").select("key", "node").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, schema)
    return met.unionByName(rows.join(heavy, "key", "left_semi").select(F.lit(None).cast("array<long>").alias("members"), "node", "key"))


def pairs_of(short_lists: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the members of lists."""
    pairs = F.expr("flatten(transform(members, (x, i) -> transform(slice(members, i + 2, size(members)), y -> struct(x as a, y as b))))")
    return short_lists.select("members").distinct().select(F.explode(pairs).alias("p")).select("p.a", "p.b").filter("a < b").distinct()


def least_shared(n: int, percent: int = PERCENT, sketch: int = SKETCH) -> int:
    """How many retained values a class with ``n`` shingles shares at least with any that passes ``estimated``."""
    j = percent / 100
    # where a sketch leaves values out, the sketch of the union holds ``sketch`` values or more
    cut = math.ceil(sketch * j - MARGIN * math.sqrt(sketch * j * (1 - j)))
    whole = -(-percent * n // 100)
    return max(1, min(cut, whole) if 100 * n > percent * sketch else whole)


def rare_values(values: DataFrame, least: Column) -> DataFrame:
    """(node, size, own, keys): the values of each class by which those that share ``least`` with it meet for certain.

    ``values`` (written): node, n, size of the class's values, key. All classes put their values in one order, rare
    ones first. If two share s values, the first of these is at place size - s + 1 or before in either. Values of one
    class alone (``own`` of them) come first and meet nothing.
    """
    counts = written(values.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "counts")
    shared = skew_lookup(values, "key", counts).filter("m is not null")
    of = shared.groupBy("node", "n", "size").agg(F.array_sort(F.collect_list(F.struct("m", "key"))).alias("values"))
    places = F.greatest(F.lit(0), F.size("values") - least + F.lit(1)).cast("int")
    return of.select("node", "size", (F.col("size") - F.size("values")).alias("own"), F.slice("values", F.lit(1), places)["key"].alias("keys")).filter(F.size("keys") > 0)


def estimated(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose similarity, as the sketch of the union estimates it, may reach the threshold."""
    sketches = classes.select("node", "n", "sketch")
    with_a = skew_lookup(pairs, "a", sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")))
    both = with_a.join(sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b").select("a", "b", "na", "nb", "sa", "sb")
    j = percent / 100

    def run(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            (ao, av), (bo, bv) = ((batch.column(i).offsets.to_numpy(), batch.column(i).values.to_numpy()) for i in (4, 5))
            keep = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            for i in np.flatnonzero(keep).tolist():
                x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
                # up to here both sketches hold all values of their sets
                known = min([v[-1] for v, n in ((x, na[i]), (y, nb[i])) if len(v) < n], default=np.iinfo(np.int64).max)
                both_values = np.concatenate((x[: np.searchsorted(x, known, "right")], y[: np.searchsorted(y, known, "right")]))
                both_values.sort()
                same = int((both_values[1:] == both_values[:-1]).sum())
                size = len(both_values) - same
                margin = 0 if known == np.iinfo(np.int64).max else MARGIN * math.sqrt(j * (1 - j) / size)
                keep[i] = same >= size * (j - margin)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, values): the full sets of some documents."""
    few = nodes.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(nodes) if few else nodes, F.col("doc_id") == F.col("node"), "left_semi")

    def run(batches):
        for batch in K.small_batches(batches, "text"):
            sets = shingle_sets(K.column(batch, "text"), words)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], names=["node", "values"])

    return bounded(rows).mapInArrow(run, "node long, values array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b), a written table, whose full sets (node, values) reach the threshold."""
    with_a = skew_lookup(pairs, "a", sets.select(F.col("node").alias("a"), F.col("values").alias("va")), wide=True)
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("values").alias("vb")), "b")
    same = F.size(F.array_intersect("va", "vb"))
    return both.select("a", "b", same.alias("i"), (F.size("va") + F.size("vb")).alias("s")).filter(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("s") - F.col("i"))).select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b), a written table, whose documents' full sets reach the threshold."""
    nodes = written(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "node"), "nodes")
    return verified(pairs, written(full_sets(docs, nodes, words), "sets"), percent)


def block_links(left: list, right: list, percent: int = PERCENT, slice_: int = 4096) -> list[tuple[int, int]]:
    """For rows (node, component, values) on either side: one link of each left row to each other component on the right."""
    ids = [np.concatenate([np.asarray(r[2]) for r in side]) for side in (left, right)]
    vocabulary = np.intersect1d(*ids)
    shared = np.zeros((len(left), len(right)), np.float32)
    placed = []
    for side, values in zip((left, right), ids, strict=True):
        of = np.repeat(np.arange(len(side)), [len(r[2]) for r in side])
        at = np.searchsorted(vocabulary, values)
        good = (at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == values) if len(vocabulary) else np.zeros(len(values), bool)
        placed.append((of[good], at[good]))
    for lo in range(0, len(vocabulary), slice_):
        parts = []
        for side, (of, at) in zip((left, right), placed, strict=True):
            m = np.zeros((len(side), min(slice_, len(vocabulary) - lo)), np.float32)
            inside = (at >= lo) & (at < lo + slice_)
            m[of[inside], at[inside] - lo] = 1
            parts.append(m)
        shared += parts[0] @ parts[1].T
    na, nb = (np.array([len(r[2]) for r in side]) for side in (left, right))
    i = shared.astype(np.int64)
    ok = 100 * i >= percent * (na[:, None] + nb[None] - i)
    other = np.array([r[1] for r in left])[:, None] != np.array([r[1] for r in right])[None]
    out = []
    for x, y in zip(*np.nonzero(ok & other), strict=True):
        out.append((x, right[y][1], left[x][0], right[y][0]))
    return [(a, b) for a, b in {(x, c): (a, b) for x, c, a, b in out}.values()]


def family_links(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """Links (a, b) from classes outside a family's largest component to the rest of it.

    ``members``: node, family, component; ``sets``: node, values. None if every family is one component.
    """
    parts = members.groupBy("family", "component").agg(F.count("*").alias("m"))
    main = parts.groupBy("family").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("parts"), F.sum("m").alias("size")).filter("parts > 1")
    main = written(main, "families")
    if main.isEmpty():
        return None
    open_ = written(skew_lookup(members, "family", main).filter("main is not null"), "members")
    rows = open_.join(sets, "node").select("node", "component", "family", "main", "size", "values")
    blocks = F.ceil(F.col("size") / BLOCK_CLASSES).cast("int")
    # left and right blocks of a family meet in a grid of up to 16 x 16 tiles
    grid = F.least(F.col("blocks"), F.lit(16))
    rows = rows.select("family", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), (F.col("component") != F.col("main")).alias("minor"), F.struct("node", "component", "values").alias("row"))
    rows = written(rows, "rows")
    sides = []
    for side, part, own, other in (("left", rows.filter("minor"), "x", "y"), ("right", rows, "y", "x")):
        packed = part.groupBy("family", "blocks", "block").agg(F.collect_list("row").alias(side))
        sides.append(packed.select("family", side, F.pmod("block", grid).alias(own), F.explode(F.sequence(F.lit(0), grid - F.lit(1))).alias(other)))
    tiles, others = sides
    joined = tiles.join(others, ["family", "x", "y"]).select("left", "right")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = (_rows_of(batch.column(c), i) for c in (0, 1))
                found = block_links(left, right, percent)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _rows_of(lists_: pa.ListArray, i: int) -> list:
    lo, hi = lists_.offsets[i].as_py(), lists_.offsets[i + 1].as_py()
    rows = lists_.values.slice(lo, hi - lo)
    values = rows.field(2)
    offsets, flat = values.offsets.to_numpy(), values.values.to_numpy()
    return [(n, c, flat[offsets[k] : offsets[k + 1]]) for k, (n, c) in enumerate(zip(rows.field(0).to_pylist(), rows.field(1).to_pylist(), strict=True))]


def contracted(long_: DataFrame) -> DataFrame:
    """(node, family): which long lists (written rows node, key) hang together by common members; one row per node."""
    first = long_.groupBy("node").agg(F.min("key").alias("first"))
    first = written(first, "first")
    edges = skew_lookup(long_, "node", first).select(F.col("key").alias("a"), F.col("first").alias("b")).filter("a <> b").distinct()
    labels = components(edges).select(F.col("node").alias("first"), F.col("component").alias("family"))
    return skew_lookup(first, "first", labels).select("node", F.coalesce("family", "first").alias("family"))


def open_links(lists_: DataFrame, label: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, most: int = MOST_COMPARISONS) -> DataFrame | None:
    """Links between components within long lists (node, key) that the pivots left; None if there is no such list."""
    placed = written(skew_lookup(lists_, "node", label).select("node", "key", F.coalesce("component", "node").alias("component")), "placed")
    parts = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key", F.lit(True).alias("open"))
    open_ = written(skew_lookup(placed, "key", written(parts, "parts")).filter("open").select("node", "key", "component"), "open")
    if open_.isEmpty():
        return None
    members = written(contracted(open_.select("node", "key")).join(open_.select("node", "component").distinct(), "node"), "members")
    sizes = members.groupBy("family", "component").agg(F.count("*").alias("m")).groupBy("family").agg((F.sum("m") * (F.sum("m") - F.max("m"))).alias("work"))
    routed = written(skew_lookup(members, "family", written(sizes, "sizes")), "routed")
    in_blocks, in_lists = (routed.filter(c).select("node", "family", "component") for c in (F.col("work") <= most, F.col("work") > most))
    links = family_links(in_blocks, full_sets(docs, in_blocks.select("node"), words), percent)
    if not in_lists.isEmpty():
        more = list_links(in_lists.select("node", "component"), docs, words, percent)
        links = more if links is None else links.unionByName(more)
    return links


def list_links(open_: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links between components of classes (node, component) by lists of the rarest values of full sets."""
    sets = written(full_sets(docs, open_.select("node"), words), "open-sets")
    size = F.size("values")
    values = written(sets.select("node", size.alias("n"), size.alias("size"), F.explode("values").alias("key")), "open-values")
    least = F.ceil(F.col("n") * F.lit(percent) / F.lit(100)).cast("int")
    rare = written(rare_values(values, least).select("node", F.explode("keys").alias("key")), "open-rare")
    met = written(lists(rare, open_.count()), "open-lists")
    pairs = pairs_of(met.filter("members is not null"))
    of = open_.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    apart = pairs.join(open_.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(of, "b").filter("ca <> cb").select("a", "b")
    links = written(verified(written(apart, "apart"), sets, percent), "open-links")
    long_ = written(met.filter("key is not null").select("node", "key"), "open-long")
    if long_.isEmpty():
        return links
    more = family_links(written(contracted(long_).join(open_, "node"), "members"), sets, percent)
    return links if more is None else links.unionByName(more)


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows, the classes, and confirmed links (a, b) between them that connect all that is linked."""
    rows = written(signed(docs, words), "signed")
    known = rows.filter("digest is not null and doc_id is not null")
    classes = written(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch"), F.count("*").alias("copies")), "classes")
    values = written(classes.select("node", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("key")), "values")
    least = F.element_at(F.array(*[F.lit(least_shared(n, percent)) for n in range(1, SKETCH + 2)]), F.least(F.col("n"), F.lit(SKETCH + 1)).cast("int"))
    rare = written(rare_values(values, least), "rare")
    forget(values)
    found = written(lists(rare.select("node", F.explode("keys").alias("key")), classes.count()), "lists")
    pairs = pairs_of(found.filter("members is not null"))
    long_ = written(found.filter("key is not null").select("node", "key"), "long")
    owners = skew_lookup(long_, "node", rare.groupBy("node").agg(F.min("own").alias("own")))
    pivots = owners.groupBy("key").agg(F.min_by("node", F.struct("own", F.xxhash64("node"))).alias("p"), F.min_by("node", F.xxhash64("node", F.lit(1))).alias("q"))
    met = skew_lookup(long_, "key", written(pivots, "pivots"))
    stars = [met.select(F.least("node", c).alias("a"), F.greatest("node", c).alias("b")).filter("a < b").distinct() for c in ("p", "q")]
    candidates = written(pairs.unionByName(stars[0]).unionByName(stars[1]).distinct(), "candidates")
    forget(rare, found)
    links = written(confirmed(written(estimated(candidates, classes, percent), "estimated"), docs, words, percent), "links")
    if not long_.isEmpty():
        more = open_links(long_, components(links), docs, words, percent)
        if more is not None:
            links = written(links.unionByName(more), "links")
    same = known.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("doc_id")
    same = written(same, "repeated")
    if not same.isEmpty():  # rows of one document with different texts
        of = known.join(same, "doc_id", "left_semi").join(classes.select("digest", "node"), "digest").select("doc_id", "node").distinct()
        links = written(links.unionByName(of.join(of.groupBy("doc_id").agg(F.min("node").alias("least")), "doc_id").select(F.col("least").alias("a"), F.col("node").alias("b")).filter("a <> b")), "links")
    return rows, classes, links


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept (doc_id = component_id), one row per row."""
    with scratch() as keep:
        rows, classes, links = link(docs, words, percent)
        label = components(links)
        known = classes.join(label, "node", "left").select("digest", F.coalesce("component", "node").alias("component"), "node", "copies").filter("copies > 1 or component <> node")
        known = keep(written(known.select("digest", "component"), "known"))
        keep(rows)
    placed = skew_lookup(rows.select("doc_id", "n_shingles", "digest"), "digest", known)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept, one document of each component, whole and unchanged."""
    with scratch() as keep:
        gone = keep(written(near_duplicates(docs, words, percent).filter(~F.col("kept")).select("doc_id").distinct(), "gone"))
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["doc_id"], "left_anti")
