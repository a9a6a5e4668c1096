"""Benchmark decontamination: SimHash windows of the size of an item, multi-index Hamming blocks, exact verification.

Texts are lower-cased and cut into runs of letters and digits; shingles are
five words (an item with fewer words is one shingle).  A window of a document
has as many shingles as the item it is held against.

A window that reaches the threshold holds nearly all shingles of its item, so it holds
one of the item's few rarest, its prefix: only documents with such a shingle are
candidates for the item, and a shingle that many items share makes none, but for items
of nothing else.  For a candidate, windows are laid where any shingle of the item
puts its start, and are held against this item alone.

Windows and items are fingerprinted with a SimHash that weighs a shingle by its
repeats.  The 64 bits are cut into ``len(BLOCKS)`` blocks; two fingerprints
within ``RADIUS`` bits agree in some block within ``RADIUS // len(BLOCKS)`` bits.
Windows meet the stored blocks of their item, and pass if some block agrees; none
within the radius is missed.  Pairs within the radius are verified by the exact weighted Jaccard similarity of their
shingles.  Of 166,000 pairs drawn at a similarity of 0.8, with 9 to 400 shingles, one
differed in more than 23 bits (seven in 10,000 in more than 19).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, let, saved, without

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 23
#: Bits of the blocks of a fingerprint.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Most item shingles that are broadcast; those of a larger benchmark are joined by shuffling the corpus's shingles.
BROADCAST_SHINGLES = 400_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(hashes: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, given the hashes of the words."""
    at = lambda i: F.xxhash64(F.lit(width), *(F.get(hashes, i + k) for k in range(width)))
    return F.when(F.size(hashes) >= width, F.transform(F.sequence(F.lit(0), F.size(hashes) - width), at)).otherwise(F.array().cast("array<bigint>"))


def simhash(values: Column) -> Column:
    """Fingerprint of an array of 64-bit hashes: a bit is set that more than half of them have."""
    bit = lambda b: F.when(2 * F.size(F.filter(values, lambda x: F.getbit(x, b) == 1)) > F.size(values), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda all_, b: all_.bitwiseOR(bit(b)))


def _block_values(fp: Column) -> Column:
    first, out = 0, []
    for k, bits in enumerate(BLOCKS):
        out.append(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1)).alias("value")))
        first += bits
    return F.array(*out)


def benchmark_items(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``width``, ``n``, ``shingles``, ``fp`` of every item that has words; items of equal id and text count once."""
    found = items.select(F.col(item_col).cast("long").alias("item_id"), words(F.col(text_col).cast("string")).alias("w")).where(F.size("w") > 0).distinct()
    found = found.select("item_id", F.least(F.size("w"), F.lit(SHINGLE)).alias("width"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    by_width = F.coalesce(*(F.when(F.col("width") == k, shingles(F.col("h"), k)) for k in range(1, SHINGLE + 1)))
    found = found.select("item_id", "width", by_width.alias("shingles")).withColumn("n", F.size("shingles"))
    return found.withColumn("fp", simhash(F.col("shingles"))).withColumn("item", F.xxhash64("item_id", "shingles"))


def prefixes(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``item``, ``width``, ``shingle``: the rarest shingles of every item, of which a window that reaches the threshold holds one."""
    each = items.select("item", "width", "n", F.explode("shingles").alias("shingle"))
    each = each.groupBy("item", "width", "n", "shingle").agg(F.count("*").alias("times"))
    rare = each.join(each.groupBy("shingle").agg(F.count("*").alias("items")), "shingle")
    # A window (shorter than the item where its document is) that reaches the threshold holds that share of the item's shingles, repeats included.  The margin is for rounding.
    needed = F.ceil(F.col("n") * threshold - 1e-9)
    before = F.sum("times").over(Window.partitionBy("item").orderBy("items", "shingle")) - F.col("times")
    return rare.withColumn("before", before).where(F.col("before") <= F.col("n") - needed).select("item", "width", "shingle")


def windows(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", broadcast_shingles: int = BROADCAST_SHINGLES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``item``, ``start`` (word), ``n``, ``window`` (shingle hashes): item-sized windows of documents that hold a shingle of the item's prefix.

    The corpus is read once for the candidates, whatever the items' widths, and once
    more for their shingles.  Where the prefixes are too many to broadcast, both sides
    are shuffled by shingle.
    """
    sizes = items.groupBy("width").agg(F.sum("n").alias("n")).orderBy("width").collect()  # five rows at most
    text = F.col(text_col).cast("string")
    row, hashes = F.xxhash64(F.col(doc_col).cast("long"), text), F.transform(words(text), lambda x: F.xxhash64(x))
    by_width = let(hashes, lambda h: F.array(*(F.struct(F.lit(r.width).alias("width"), shingles(h, r.width).alias("s")) for r in sizes))) if sizes else F.array().cast("array<struct<width:int,s:array<bigint>>>")
    of = lambda d: d.select("doc_id", "row", F.explode_outer(by_width).alias("x")).select("doc_id", "row", "x.width", "x.s")
    marked = docs.select(F.col(doc_col).cast("long").alias("doc_id"), row.alias("row"), F.col(text_col))

    known = saved(prefixes(items, threshold), "prefixes")
    each = of(marked).select("row", "width", F.explode_outer("s").alias("shingle"))  # plain explode would compute s once more, to test that it has elements
    rare = F.broadcast(known) if sum(r.n for r in sizes) <= broadcast_shingles else known
    candidates = saved(each.join(rare, ["width", "shingle"]).select("row", "width", "item").distinct(), "candidates")

    rows = candidates.select("row").distinct()
    holding = of(marked.join(F.broadcast(rows) if candidates.count() <= BROADCAST_ROWS else rows, "row", "left_semi"))
    holding = saved(holding.join(candidates.select("row", "width").distinct(), ["row", "width"], "left_semi"), "holding")
    at = holding.select("row", "width", F.inline_outer(F.transform("s", lambda x, p: F.struct(p.alias("p"), x.alias("shingle"), F.get("s", p - 1).alias("before")))))
    own = candidates.join(items.select("item", "n", "shingles"), "item").select("row", "width", "item", "n", F.inline(F.transform("shingles", lambda x, q: F.struct(q.alias("q"), x.alias("shingle"), F.get("shingles", q - 1).alias("previous")))))
    # Only the first shingle of a run that fits the item puts a window; the others would put the same one.
    first = (F.col("p") == 0) | F.col("previous").isNull() | (F.col("before") != F.col("previous"))
    hits = at.join(own, ["row", "width", "shingle"]).where(first).select("row", "width", "item", "n", F.greatest(F.col("p") - F.col("q"), F.lit(0)).alias("start")).distinct()
    return holding.join(hits, ["row", "width"]).select("doc_id", "item", "start", "n", F.slice("s", F.col("start") + 1, F.col("n")).alias("window"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity``, ``start_word``, ``n_shingles``: the best window of every document for every item at or above the threshold.

    Ties go to the first window.  Null or empty texts, and items without words,
    match nothing.  Rows that repeat an id count together.  Extra columns are
    ignored.
    """
    items = saved(benchmark_items(benchmark, item_col, item_text_col), "items")
    laid = windows(docs, items, doc_col, text_col, broadcast_shingles, threshold)
    laid = saved(laid.withColumn("content", F.xxhash64("n", "window")), "windows")
    contents = saved(laid.groupBy("content").agg(F.first("window").alias("window")).withColumn("fp", simhash(F.col("window"))), "contents")

    stored = items.select("item", F.col("fp").alias("item_fp"), F.inline(_block_values(F.col("fp")))).select("item", "item_fp", "block", F.col("value").alias("item_value"))
    met = laid.select("item", "content").distinct().join(contents.select("content", "fp"), "content")
    probes = met.select("item", "content", "fp", F.inline(_block_values(F.col("fp"))))
    apart = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    pairs = probes.join(stored, ["item", "block"]).where((apart("value", "item_value") <= RADIUS // len(BLOCKS)) & (apart("fp", "item_fp") <= RADIUS)).select("content", "item").distinct()

    of_items = items.select("item", F.size("shingles").alias("item_total"), F.explode("shingles").alias("shingle")).groupBy("item", "item_total", "shingle").agg(F.count("*").alias("in_item"))
    of_windows = contents.select("content", F.size("window").alias("total"), F.explode("window").alias("shingle")).groupBy("content", "total", "shingle").agg(F.count("*").alias("in_window"))
    both = pairs.join(of_windows, "content").join(of_items, ["item", "shingle"]).groupBy("content", "item", "total", "item_total").agg(F.sum(F.least("in_item", "in_window")).alias("common"))
    similar = both.select("content", "item", (F.col("common") / (F.col("total") + F.col("item_total") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= threshold)
    named = similar.join(items.select("item", "item_id").distinct(), "item")
    hits = laid.select("doc_id", "item", "start", "n", "content").join(named, ["item", "content"])
    best = F.struct("similarity", (-F.col("start")).alias("start"), "n")
    return hits.groupBy("doc_id", "item_id").agg(F.max(best).alias("best")).select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.start")).alias("start_word"), F.col("best.n").alias("n_shingles"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item.

    A row is known by its id and text, so rows without an id are dropped too, and
    a clean row stays that shares its id with one that leaks.  Empty tables, null and
    empty texts pass through.
    """
    row = F.xxhash64(F.col(doc_col).cast("long"), F.col(text_col).cast("string"))
    found = leaks(docs.select(row.alias("_row"), text_col), benchmark, "_row", text_col).select(F.col("doc_id").alias("_leaked")).distinct()
    found = saved(found, "leaked")
    return without(docs, found, row == found["_leaked"], broadcast_rows)
