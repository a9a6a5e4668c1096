"""SimHash near-duplicate groups with pigeonring candidate filtering.

Fingerprints are 64-bit SimHashes over word shingles.  Two fingerprints link
when at most ``RADIUS`` bits differ.  Candidates come from the pigeonring
principle: lay the bits in a ring of ``RADIUS + 1`` segments; for any linked
pair some segment starts a chain in which the first ``l`` segments differ in at
most ``l * RADIUS / (RADIUS + 1)`` bits, for every ``l``.  So the start segment
is equal (the join key), the first two differ in at most one bit, and only then
the full Hamming distance is taken.

Exact copies share a fingerprint and are one node.  A segment value that more
than ``BUCKET`` fingerprints share is not joined with itself: its members emit
the fingerprints at most one bit away within the two other segments, and
members that meet at such a midpoint are linked as a star.  Two members of the
bucket meet at a midpoint exactly when at most two bits differ, and at most 65
fingerprints can meet at one, so that way is exact and linear in the bucket.

Two bits are met by texts that are all but equal.  Texts whose five-word shingles
have a Jaccard similarity of 0.8 differ in about ten bits, a radius at which
every segment's neighbourhood is a constant share of all pairs.  ``keep_one``
therefore links such texts as well: MinHash bands give candidates, set sizes and
parity bits prune them, and the exact similarity verifies the rest.  Each distinct
shingle flips one of ``64 * PARITIES`` bits of its text, so two texts differ in at most
as many bits as shingles that only one of them has: the bound leaves out no pair
that reaches the similarity.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, components, saved, star, without

RADIUS = 2
#: (first bit, bits) of the ring's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Most fingerprints of one segment value that are compared pair by pair.
BUCKET = 64
SEED = 42
#: Near copies: words of a shingle, least similarity, words of 64 parity bits.
WORDS, SIMILARITY, PARITIES = 5, 0.8, 8
#: MinHash bands and rows; a pair at the least similarity misses all bands once in 1,900.
BANDS, ROWS = 32, 7
#: Most texts of a band's value that are compared pair by pair; parts that a crowded value is dealt to.
CROWD, SALT = 32, 32
#: Texts of a crowded value that are held against its others in one round.
ROUND = 256
#: Texts that a task takes from a batch at once.
ROWS_AT_ONCE = 256
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(words: list[bytes], joined: bytes, shingle: int):
    """XXH64 of all runs of ``shingle`` words (fewer words: of the whole), in arrays of bounded size."""
    width = min(shingle, len(words))
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    digest, spans = xxhash.xxh64_intdigest, list(zip(starts, ends[width - 1 :]))
    for k in range(0, len(spans), 1 << 12):
        yield np.fromiter((digest(joined[s:e], SEED) for s, e in spans[k : k + (1 << 12)]), np.uint64)


def minhash_bands(text: bytes | None) -> tuple[int, int, np.ndarray, list[int]]:
    """Hash of the words of one text, number and parity bits of the distinct shingles, and the value of each band over them; zeros and none for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0, 0, np.zeros(PARITIES, np.uint64), []
    joined, parts = b" ".join(words), []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for h in _hashes(words, joined, WORDS):
        parts.append(h)
        np.minimum(least, (h[:, None] * _MULTIPLIERS).min(axis=0), out=least)
    values = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    distinct = np.unique(np.concatenate(parts))
    odd = np.bincount((distinct % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return xxhash.xxh64_intdigest(joined, SEED), len(distinct), np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8"), values


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """The fingerprint of one text in UTF-8; zero for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    total, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for h in _hashes(words, b" ".join(words), shingle):
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _slices(batches):
    """Batches of at most ``ROWS_AT_ONCE`` rows, with their last column, a text, as a list of bytes."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            yield batch, batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()


def _fingerprint_batches(batches):
    for batch, texts in _slices(batches):
        fp = np.fromiter(map(simhash, texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], [*batch.schema.names[:-1], "fp"])


def _sketch_batches(batches):
    for batch, texts in _slices(batches):
        fp = np.fromiter(map(simhash, texts), np.uint64, len(texts)).view(np.int64)
        found = [minhash_bands(x) for x in texts]
        content = np.array([c for c, _, _, _ in found], np.uint64).view(np.int64)
        parity, bands = (pa.array([np.array(x[k], np.uint64).view(np.int64) for x in found], pa.list_(pa.int64())) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp), pa.array(content), pa.array([n for _, n, _, _ in found], pa.int64()), parity, bands], [*batch.schema.names[:-1], "fp", "content", "size", "parity", "bands"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``fp`` (the 64 bits as a bigint) for every row of ``docs``; null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprint_batches, "id long, fp long")


def _segment(fp, k: int):
    first, bits = SEGMENTS[k % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a``, ``b`` that connect exactly what the radius links, over distinct ``fp``."""
    fp = F.col("fp")
    keys = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _segment(fp, k).alias("part")) for k in range(len(SEGMENTS))))).alias("s")).select("fp", "s.k", "s.part")
    sizes = keys.groupBy("k", "part").agg(F.count("*").alias("n")).where("n > 1")
    keys = saved(keys.join(sizes, ["k", "part"]), "segments")
    usual, crowded = keys.where(F.col("n") <= bucket), keys.where(F.col("n") > bucket)

    differ = F.col("a").bitwiseXOR(F.col("b"))
    second = F.coalesce(*(F.when(F.col("k") == k, F.bit_count(_segment(differ, k + 1))) for k in range(len(SEGMENTS))))
    pairs = (
        usual.select("k", "part", F.col("fp").alias("a"))
        .join(usual.select("k", "part", F.col("fp").alias("b")), ["k", "part"])
        .where(F.col("a") < F.col("b"))
        .where(second <= 2 * RADIUS // (RADIUS + 1))
        .where(F.bit_count(differ) <= RADIUS)
        .select("a", "b")
    )
    flips = F.coalesce(*(F.when(F.col("k") == k, F.array(F.lit(0).cast("long"), *(F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long") for j, (first, bits) in enumerate(SEGMENTS) if j != k for b in range(first, first + bits)))) for k in range(len(SEGMENTS))))
    midpoints = crowded.repartition("fp").select("fp", F.explode(flips).alias("flip")).select("fp", fp.bitwiseXOR(F.col("flip")).alias("at"))
    stars = midpoints.groupBy("at").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("met")).where(F.size("met") > 1).select("a", F.explode("met").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def _may_reach(na: Column, nb: Column, pa_: Column, pb: Column) -> Column:
    """Whether sizes and parity bits allow the least similarity; true for every pair that reaches it."""
    differ = reduce(add, (F.bit_count(F.get(pa_, F.lit(k)).bitwiseXOR(F.get(pb, F.lit(k)))) for k in range(PARITIES)))
    # The small margin is for rounding: n shingles in all and the least similarity leave n (1 - s) / (1 + s) to one side alone.
    return (F.least(na, nb) >= SIMILARITY * F.greatest(na, nb)) & (differ <= (na + nb) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6)


def _shingle_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``content``, ``s`` (distinct shingle hashes) of ``nodes``; ``texts`` has their rows."""
    found = texts.select(F.xxhash64("id", "key").alias("row"), F.col("text").alias("t")).join(nodes.select("row", "content"), "row").groupBy("content").agg(F.first("t").alias("t"))
    hashes = F.transform(F.array_remove(F.split(ascii_lower(F.col("t")), "[\\x20\\x09-\\x0D]+"), ""), lambda x: F.xxhash64(x))
    runs = F.transform(F.sequence(F.lit(0), F.size("h") - WORDS), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(WORDS))))
    return found.select("content", hashes.alias("h")).select("content", F.when(F.size("h") >= WORDS, F.array_distinct(runs)).otherwise(F.array(F.xxhash64("h"))).alias("s"))


def _verified(pairs: DataFrame, sets: DataFrame, salt: int = 1) -> DataFrame:
    """The rows of ``pairs`` (contents ``a``, ``b``) whose exact similarity reaches the threshold; ``b`` may be crowded, and is dealt to ``salt`` parts."""
    pairs = saved(pairs, "candidates")
    of_b = sets.join(pairs.select(F.col("b").alias("content")).distinct(), "content", "left_semi").select(F.col("content").alias("b"), F.col("s").alias("sb"), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("part"))
    both = pairs.join(sets.select(F.col("content").alias("a"), F.col("s").alias("sa")), "a").withColumn("part", F.pmod("a", F.lit(salt)).cast("int")).join(of_b, ["b", "part"])
    common = F.size(F.array_intersect("sa", "sb"))
    return saved(both.where(common >= SIMILARITY * (F.size("sa") + F.size("sb") - common)).select(*pairs.columns), "similar")


def similar_links(marked: DataFrame, texts: DataFrame, crowd: int = CROWD, at_once: int = ROUND) -> DataFrame:
    """Edges ``a``, ``b`` between fingerprints of texts with similar shingles.

    ``texts`` has ``id``, ``key``, ``text``; ``marked`` has ``id``, ``key``, ``fp``,
    ``content``, ``size``, ``parity``, ``bands`` for the same rows.  A band value of up to ``crowd``
    texts is compared pair by pair.  Of a more crowded one the text that meets
    most others is held against all.  Members that are then not linked with most
    of the value's texts, over whatever links, are held in turn against all that
    they are not linked with yet, about ``at_once`` at once.  The value's main group
    may change between rounds: a member counts as done only once it was held
    against the others itself.
    """
    row = F.xxhash64("id", "key")
    nodes = saved(marked.where(F.size("bands") > 0).groupBy("content").agg(F.min_by(F.struct(row.alias("row"), "fp", "size", "parity", "bands"), row).alias("x")).select("content", "x.*"), "contents")
    keys = nodes.select("content", "fp", "size", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("at"), "content", "fp", "size")
    keys = saved(keys.join(keys.groupBy("at").agg(F.count("*").alias("n")).where("n > 1"), "at"), "bands")
    sets = saved(_shingle_sets(texts, nodes.join(keys.select("content").distinct(), "content", "left_semi")), "sets")
    a = lambda rows, *more: rows.select("at", F.col("content").alias("a"), F.col("fp").alias("fa"), F.col("size").alias("na"), *more)
    b = lambda rows, *more: rows.select("at", F.col("content").alias("b"), F.col("fp").alias("fb"), F.col("size").alias("nb"), *more)
    near = _may_reach(*(F.col(x) for x in ("na", "nb", "pa", "pb")))
    edges = lambda rows: rows.select(F.col("fa").alias("a"), F.col("fb").alias("b"))

    parity = keys.select("content").distinct().join(nodes.select("content", "parity"), "content")
    of = lambda name, bits: parity.select(F.col("content").alias(name), F.col("parity").alias(bits))
    usual = keys.where(F.col("n") <= crowd)
    sized = F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")
    pairs = a(usual).join(b(usual), "at").where((F.col("a") < F.col("b")) & sized).select("a", "fa", "na", "b", "fb", "nb").distinct()
    pairs = pairs.join(of("a", "pa"), "a").join(of("b", "pb"), "b").where(near).select("a", "fa", "b", "fb")
    found = edges(_verified(pairs, sets))

    crowded = keys.where(F.col("n") > crowd)
    crowded = crowded.join(crowded.groupBy("content").agg(F.sum("n").alias("met")), "content").join(parity, "content")
    members = saved(crowded.withColumn("part", F.pmod("content", F.lit(SALT)).cast("int")).withColumn("root", F.col("fp")), "crowded")
    if members.isEmpty():
        return found
    all_parts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part")
    centres = members.groupBy("at").agg(F.max(F.struct("met", "content", "fp", "size", "parity", "root")).alias("x")).select("at", "x.content", "x.fp", "x.size", "x.parity", "x.root")
    done, turn = None, 0
    while True:
        centres = saved(centres, "centres")
        met = a(members, F.col("parity").alias("pa"), "part", "root").join(b(centres, F.col("parity").alias("pb"), all_parts, F.col("root").alias("of_b")), ["at", "part"]).where((F.col("a") != F.col("b")) & ((F.col("root") != F.col("of_b")) | (turn == 0)) & near)
        found = found.unionByName(edges(_verified(met.select("a", "fa", "b", "fb").distinct(), sets, SALT)))
        roots = saved(components(found).distinct(), "roots")
        found = star(roots)  # so that no round goes over all links of those before
        members = saved(members.drop("root").join(roots, members.fp == roots.node, "left").select("at", "content", "fp", "size", "parity", "met", "part", F.coalesce("root", "fp").alias("root")), "crowded")
        main = members.groupBy("at", "root").agg(F.count("*").alias("k")).groupBy("at").agg(F.max(F.struct("k", "root")).alias("x")).select("at", F.col("x.root").alias("main"))
        rooted = members.join(main, "at").where("root <> main").select("at", "content", "fp", "size", "parity", "root")
        held = centres.select("at", "content")
        done = held if done is None else done.unionByName(held)
        left = saved(rooted.join(done, ["at", "content"], "left_anti"), "left")
        if left.isEmpty():
            return found
        turn += 1
        shares = left.groupBy("at").agg(F.ceil(F.count("*") / at_once).alias("shares"), F.min("content").alias("first"))
        centres = left.join(shares, "at").where((F.col("content") == F.col("first")) | (F.pmod(F.xxhash64("content", F.lit(turn)), F.col("shares")) == 0)).select("at", "content", "fp", "size", "parity", "root")


def _groups(marked: DataFrame, order: Column, bucket: int, more: DataFrame | None = None) -> DataFrame:
    """Every fingerprint of ``marked`` (saved rows with ``fp``) with ``first``, the least ``order`` in its group; ``more``: further links."""
    nodes = saved(marked.groupBy("fp").agg(F.min(order).alias("least")), "nodes")
    linked = links(nodes.select("fp"), bucket)
    found = components(linked if more is None else linked.unionByName(more))
    roots = found.join(nodes, found.node == nodes.fp).select("fp", "root", "least")
    groups = roots.groupBy("root").agg(F.min("least").alias("group_least"))
    lifted = roots.join(groups, "root").select("fp", "group_least")
    return nodes.join(lifted, "fp", "left").select("fp", F.coalesce("group_least", "least").alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``fp``, ``component_id``.

    ``component_id`` is the smallest id that can be reached over links, itself
    included.  Texts without words share the fingerprint zero, which links like
    any other.  A repeated row is returned as often as it comes; rows without an
    id get a component if any member has an id, else null.  Extra columns of
    ``docs`` are ignored.
    """
    marked = saved(fingerprints(docs, id_col, text_col), "fingerprints")
    named = _groups(marked, F.col("id"), bucket)
    return marked.join(named, "fp", "left").select("id", "fp", F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, crowd: int = CROWD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with one row of every near-duplicate group: the one with the smallest id.

    Groups are linked by fingerprints within ``RADIUS`` and by five-word shingles
    with a similarity of at least ``SIMILARITY``.

    Rows without an id come after those with one.  Of rows that share the id one
    text stays, by its hash; of rows that repeat id and text, any one.  Rows of one
    id whose texts are in different groups stay apart.
    """
    doc_id, key = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    texts = docs.select(doc_id.alias("id"), key.alias("key"), F.col(text_col).cast("string").alias("text"))
    sketched = saved(texts.mapInArrow(_sketch_batches, "id long, key long, fp long, content long, size long, parity array<long>, bands array<long>"), "fingerprints")
    similar, marked = similar_links(sketched, texts, crowd), sketched.select("id", "key", "fp")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    same = lambda rows: doc_id.eqNullSafe(rows["_id"]) & (key == rows["_key"])
    # A row stays if it is its group's first: no row need meet its group, whose exact copies share one fingerprint.
    first = _groups(marked, row, bucket, similar).select(F.col("first.id").alias("_first"), F.col("first.key").alias("_first_key")).distinct()
    gone = marked.join(first, F.col("id").eqNullSafe(F.col("_first")) & (F.col("key") == F.col("_first_key")), "left_anti").select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct()
    gone = saved(gone, "gone")
    left = without(docs, gone, same(gone), broadcast_rows)
    repeated = saved(marked.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    if repeated.isEmpty():
        return left
    return left.join(repeated, same(repeated), "left_anti").unionByName(left.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, text_col]))
