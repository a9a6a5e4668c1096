"""Near-duplicate groups with an LSH forest over MinHash signatures.

A document's set are its distinct runs of four words.  Documents of equal sets are one
node.  A signature has ``TREES * DEPTHS[0]`` MinHash values, and every tree is an order
of them of its own: tree t begins with the values from ``t * DEPTHS[0]`` on, and goes
round.  Neighbours in a tree's sorted order are candidates if their signatures share
a prefix.  How long it must be adapts to the region: nodes that share the first
five values are a region of the tree, and one of over ``CROWD`` nodes is cut by ten
values, then by twenty.  A pair at a similarity of 0.8 shares no region of any of
the 32 trees once in 320,000.

Of a crowded region, by five values, one node is held against all others first.  Then
all pairs within a region of up to ``CROWD`` nodes, at any depth, are candidates, but for
those that links have brought together by then.  Set sizes and parity
bits prune them, exactly: no pair that reaches the similarity is left out.  The full
sets confirm the rest.  What a crowded region still leaves apart is held
against each other by the region's five values: those outside its main group in turn
against all that they aren't linked with yet, until each has had its turn.  So depth
saves work but loses no pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, saved, star
from .neardup import PARITIES, _hashes, _may_reach, _slices

#: Words of a shingle; least similarity in hundredths.
WORDS, SIMILARITY = 4, 80
#: Trees, and lengths of the prefixes that make regions.
TREES, DEPTHS = 32, (5, 10, 20)
#: Most nodes of a region that are compared pair by pair; nodes, or pairs of one node, that a part of a larger one has; nodes held against a region's others in one round.
CROWD, PART, ROUND = 32, 2048, 256
_SHIFTS = np.random.default_rng(7).integers(0, 1 << 63, TREES * DEPTHS[0], np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = "id long, key long, content long, size long, parity array<long>, signature array<int>"


def shingle_set(text: bytes | None) -> np.ndarray:
    """Hashes of the distinct shingles of one text, in order; none for a text without words."""
    words = (text or b"").lower().split()
    parts = list(_hashes(words, b" ".join(words), WORDS)) if words else []
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def sketch(shingles: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Hash, parity bits and signature of a set."""
    least = np.full(len(_SHIFTS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1 << 12):
        np.minimum(least, (shingles[k : k + (1 << 12), None] * _SHIFTS).min(axis=0), out=least)
    odd = np.bincount((shingles % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return xxhash.xxh64_intdigest(shingles.tobytes()), np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"), (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(batches):
    for batch, texts in _slices(batches):
        sets = [shingle_set(x) for x in texts]
        found = [sketch(s) for s in sets]
        content = np.array([c for c, _, _ in found], np.uint64).view(np.int64)
        lists = (pa.array([x[k] if len(s) else None for x, s in zip(found, sets)], pa.list_(kind)) for k, kind in ((1, pa.int64()), (2, pa.int32())))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(content), pa.array([len(s) for s in sets], pa.int64()), *lists], [c.split()[0] for c in _SKETCH.split(", ")])


def _sets(batches):
    for batch, texts in _slices(batches):
        yield pa.RecordBatch.from_arrays([batch.columns[0], pa.array([shingle_set(x).view(np.int64) for x in texts], pa.list_(pa.int64()))], ["content", "s"])


def _regions(nodes: DataFrame, trees: DataFrame, depth: int) -> DataFrame:
    """``content`` and ``at``, ``tree``, ``n`` of its regions by ``depth`` values that others share; ``trees`` has the ``content`` and ``tree`` to look at."""
    circle = F.concat("signature", F.slice("signature", 1, DEPTHS[-1]))
    found = nodes.select("content", circle.alias("v")).join(trees, "content") if trees is not None else nodes.select("content", circle.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    found = found.select("content", "tree", F.xxhash64("tree", F.slice("v", F.col("tree") * DEPTHS[0] + 1, depth)).alias("at"))
    return saved(found.join(found.groupBy("at").agg(F.count("*").alias("n")).where("n > 1"), "at"), "regions")


def _parts(n: str) -> Column:
    """Parts that ``n`` rows of one key are dealt to: one, but for very large keys."""
    return F.ceil(F.col(n) / PART).cast("int")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``, different) whose full sets reach the similarity; pairs of a ``b`` that has very many are dealt to parts."""
    pairs = saved(pairs, "candidates")
    crowds = pairs.groupBy("b").agg(F.count("*").alias("n"))
    dealt = pairs.join(crowds, "b").select("a", "b", F.pmod("a", _parts("n")).cast("int").alias("part"))
    of_b = sets.select(F.col("content").alias("b"), F.col("s").alias("sb")).join(crowds, "b").select("b", "sb", F.explode(F.sequence(F.lit(0), _parts("n") - 1)).alias("part"))
    both = dealt.join(sets.select(F.col("content").alias("a"), F.col("s").alias("sa")), "a").join(of_b, ["b", "part"])
    common = F.size(F.array_intersect("sa", "sb"))
    return saved(both.where(100 * common >= SIMILARITY * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "similar")


def _rooted(found: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``node``, ``root`` over the links ``found`` and what ``roots`` has linked before."""
    return saved(components(found if roots is None else found.unionByName(star(roots))).distinct(), "roots")


def links(nodes: DataFrame, texts: DataFrame, crowd: int = CROWD, at_once: int = ROUND) -> DataFrame:
    """Edges ``a``, ``b`` between contents that connect exactly what the similarity links, but for pairs that no tree brings together.

    ``nodes`` (saved) has ``content``, ``row``, ``size``, ``parity``, ``signature``; ``texts`` has ``row`` and ``text``.
    """
    levels, trees = [], None
    for depth in DEPTHS:
        levels.append(_regions(nodes, trees, depth))
        trees = levels[-1].where(F.col("n") > crowd).select("content", "tree")
    side = lambda d, name, *more: d.select(*more, F.col("content").alias(name), F.col("size").alias(f"n{name}"), F.col("parity").alias(f"p{name}"))
    near = _may_reach(*(F.col(x) for x in ("na", "nb", "pa", "pb")))

    in_regions = levels[0].select("content").distinct()
    parity = saved(in_regions.join(nodes.select("content", "row", "size", "parity"), "content"), "shared")
    needed = texts.join(parity.select("row", "content"), "row").groupBy("content").agg(F.first("text").alias("text"))
    sets = saved(needed.mapInArrow(_sets, "content long, s array<long>"), "sets")

    crowded = levels[0].where(F.col("n") > crowd).select("at", "content", "n")
    crowded = crowded.join(crowded.groupBy("content").agg(F.sum("n").alias("met")), "content").join(parity.drop("row"), "content")
    members = saved(crowded.withColumn("part", F.pmod("content", _parts("n")).cast("int")), "crowded")
    every_part = F.explode(F.sequence(F.lit(0), _parts("n") - 1)).alias("part")
    none_crowded, roots = members.isEmpty(), None
    if not none_crowded:
        # One node of each crowded region is held against all others first: what it links need not be linked pair by pair.
        first = F.max_by(F.struct("content", "size", "parity", "n"), F.struct("met", "content"))
        centres = saved(members.groupBy("at").agg(first.alias("x")).select("at", "x.*"), "centres")
        met = side(members, "a", "at", "part").join(side(centres, "b", "at", every_part), ["at", "part"]).where((F.col("a") != F.col("b")) & near)
        roots = _rooted(_confirmed(met.select("a", "b").distinct(), sets))
        done = centres.select("at", "content")

    sizes = nodes.select("content", "size")
    if roots is not None:
        sizes = sizes.join(roots, sizes.content == roots.node, "left").select("content", "size", F.coalesce("root", "content").alias("root"))
    few = [level.where(F.col("n") <= crowd).select("at", "content") for level in levels]
    pairs = None
    for of in few:
        of = of.join(sizes, "content")
        a, b = (of.select("at", F.col("content").alias(x), F.col("size").alias(f"n{x}"), F.col("root" if roots is not None else "content").alias(f"of_{x}")) for x in "ab")
        met = a.join(b, "at").where((F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b")) & (100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb"))).select("a", "b")
        pairs = met if pairs is None else pairs.unionByName(met)
    pairs = pairs.distinct().join(side(parity, "a"), "a").join(side(parity, "b"), "b").where(near).select("a", "b")
    found = _confirmed(pairs, sets)
    if none_crowded:
        return found

    turn = 1
    while True:
        # Every node is linked with its root alone from here on, so that no round goes over the links of those before.
        roots = _rooted(found, roots)
        rooted = saved(members.join(roots, members.content == roots.node, "left").select(*members.columns, F.coalesce("root", "content").alias("root")), "rooted")
        main = rooted.groupBy("at", "root").agg(F.count("*").alias("k")).groupBy("at").agg(F.max(F.struct("k", "root")).alias("x")).select("at", F.col("x.root").alias("main"))
        left = saved(rooted.join(main, "at").where("root <> main").join(done, ["at", "content"], "left_anti"), "left")
        if left.isEmpty():
            return star(roots)
        shares = left.groupBy("at").agg(F.ceil(F.count("*") / at_once).alias("shares"), F.min("content").alias("least"))
        centres = left.join(shares, "at").where((F.col("content") == F.col("least")) | (F.pmod(F.xxhash64("content", F.lit(turn)), F.col("shares")) == 0)).select("at", "content", "size", "parity", "root", "n")
        centres = saved(centres, "centres")
        met = side(rooted, "a", "at", "part", "root").join(side(centres, "b", "at", every_part, F.col("root").alias("of_b")), ["at", "part"]).where((F.col("root") != F.col("of_b")) & near)
        found = _confirmed(met.select("a", "b").distinct(), sets)
        done, turn = done.unionByName(centres.select("at", "content")), turn + 1


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, at_once: int = ROUND) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_shingles``, ``component_id`` (the smallest id that can be reached, itself included), ``kept``.

    ``kept`` holds where both ids are equal.  Null texts and texts without words link with
    nothing, not with each other either: their component is their own id.  Rows
    without an id take the component of those they link with, or null, and are kept
    if that is null.  Rows that repeat an id link by their own texts.  Extra columns
    are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    marked = saved(texts.mapInArrow(_sketches, _SKETCH), "sketches")
    row = F.xxhash64("id", "key")
    nodes = marked.where("size > 0").groupBy("content").agg(F.min_by(F.struct(row.alias("row"), "size", "parity", "signature"), row).alias("x"), F.min("id").alias("least"))
    nodes = saved(nodes.select("content", "x.*", "least"), "nodes")
    found = components(links(nodes, texts.select(row.alias("row"), "text"), crowd, at_once))
    roots = found.distinct().join(nodes.select(F.col("content").alias("node"), "least"), "node")
    lifted = roots.join(roots.groupBy("root").agg(F.min("least").alias("of_root")), "root").select(F.col("node").alias("content"), "of_root")
    # Saved, so that the join with all rows is of two plain tables, of which Spark can split a content that very many rows have.
    named = saved(nodes.select("content", "least").join(lifted, "content", "left").select("content", F.coalesce("of_root", "least").alias("first")), "named")
    out = marked.select("id", "size", F.when(F.col("size") > 0, F.col("content")).alias("content")).join(named, "content", "left")
    out = out.select("id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("first")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
