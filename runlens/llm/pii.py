"""Personal data: patterns, and terms that reveal a protected value.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers.
Every value found is a protected entity.  Words of the texts that hold an entity,
wherever they stand, are held against their frequency in the whole corpus: a term discloses an entity when
their pointwise mutual information reaches ``SHARE`` of the entity's own
information content, that is, when seeing the term all but gives the entity
away.  Frequencies are counted in documents.  A term also needs ``CONTEXTS``
different contexts (the word with its two neighbours) in texts that hold the entity, so that
copies of one passage are no evidence.  In texts that hold the entity such terms are spans of the
kind ``term``; sanitising removes them, and generalises entities to their kind.

DataFrame functions alone are used.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, pieces, running, saved

#: (kind, pattern, what a text needs at least): leftmost, non-overlapping matches.  Runs are tried from their start alone (or from where
#: the last match ended) and never given back, which matches the same and takes linear time: what fails from a run's start fails within it.
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]++\."),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
TERM = "term"
#: Different contexts that evidence needs; share of the entity's information that a term must give.
CONTEXTS, SHARE = 3, 0.9
_SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"
_EMPTY = f"array<{_SPAN}>"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]+", "")
    n = F.length(digits)
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        doubled = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
        return F.when(n.between(14, 19), F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def matches(text: Column, kind: str, rank: int, pattern: str, needs: str) -> Column:
    """All matches of a pattern with their offsets, as an array of spans."""
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))

    def spans(between: Column, found: Column) -> Column:
        # Between, match, between, match: running sums of the lengths are the starts and the ends.
        both = F.flatten(F.transform(F.arrays_zip(lengths(F.slice(between, F.lit(1), F.size(found))).alias("b"), lengths(found).alias("f")), lambda x: F.array(x["b"], x["f"])))
        at = running(both, lambda x, y: x + y)
        return let(at, lambda at: F.transform(found, lambda v, k: F.struct(F.get(at, 2 * k).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.get(at, 2 * k + 1).alias("end"), v.alias("value"))))

    every = let(F.split(text, pattern), lambda between: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: spans(between, found)))
    return F.when(text.rlike(needs), every).otherwise(F.array().cast(_EMPTY))


def base_spans(text: Column) -> Column:
    """Spans of all kinds, by start, then kind."""
    found = [_kept(matches(text, kind, rank, pattern, needs), kind) for rank, (kind, pattern, needs) in enumerate(KINDS)]
    return F.sort_array(F.concat(*found))


def _kept(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["value"]))


def _terms(text: Column) -> Column:
    """Hashes of the words of at least three letters, in order."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: F.length(x) >= 3), lambda x: F.xxhash64(x))


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``row_key``, ``spans`` of every row; ``text`` and the columns in ``carry`` where there are spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    d = d.withColumn("spans", base_spans(F.col("text"))).withColumn("row_key", F.when(F.size("spans") > 0, F.xxhash64("id", "text")))
    return d.select("id", "row_key", "spans", *(F.when(F.size("spans") > 0, F.col(c)).alias(c) for c in d.columns if c == "text" or c.startswith("carried_")))


def disclosing_terms(found: DataFrame, docs: DataFrame, text_col: str = "text", contexts: int = CONTEXTS, share: float = SHARE) -> DataFrame:
    """``row_key``, ``term`` (hash): terms over the disclosure threshold of some entity of the row, from spans as of ``detected`` and the whole corpus."""
    holding = found.where(F.size("spans") > 0)
    entities = holding.select("row_key", F.explode("spans").alias("s")).select("row_key", F.xxhash64("s.kind", "s.value").alias("entity")).distinct()
    # Entities that the same texts hold have the same evidence: they count as one, so that a text with many costs no product of entities and terms.
    held = F.struct(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("row_key", F.lit(k))).alias(f"s{k}") for k in (1, 2)))
    holders = entities.groupBy("entity").agg(held.alias("x")).where(F.col("x.n") >= contexts).select("entity", F.xxhash64("x").alias("group"), F.col("x.n").alias("n_entity"))
    holders = saved(holders, "holders")
    groups = holders.select(F.col("group").alias("entity_group"), "n_entity").distinct()
    entities = entities.join(holders, "entity").select("row_key", F.col("group").alias("entity_group")).distinct()
    # (term, context) of a text; what repeats is left to the counts, as array_distinct compares structs pair by pair.
    around = lambda w: F.transform(w, lambda x, i: F.struct(x.alias("term"), F.xxhash64(F.get(w, i - 1), x, F.get(w, i + 1)).alias("context")))
    # Begun at a token's start alone, the search stays linear in texts without blanks.
    bare = lambda part: F.regexp_replace(part, r"(?<!\S)\S*[@0-9]\S*", " ")
    words = F.transform(_between(F.col("text"), F.col("spans")), lambda part: _terms(bare(part)))
    at = holding.select("row_key", words.alias("parts")).select("row_key", F.flatten(F.transform("parts", around)).alias("at"))
    seen = entities.join(at, "row_key").select("entity_group", "row_key", F.inline_outer("at"))  # plain inline would compute the array once more, to test that it has elements
    joint = seen.groupBy("entity_group", "term").agg(F.count_distinct("context").alias("n_contexts"), F.count_distinct("row_key").alias("n_joint"))
    joint = joint.where(F.col("n_contexts") >= contexts).join(groups, "entity_group")

    corpus = docs.select(F.array_distinct(_terms(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("w"))
    everywhere = corpus.select(F.explode_outer("w").alias("term")).groupBy("term").agg(F.count("*").alias("n_docs"))
    total = float(docs.count())
    both = joint.join(everywhere, "term")
    information = F.log(total / F.col("n_entity"))
    mutual = F.log(total * F.col("n_joint") / (F.col("n_entity") * F.greatest("n_docs", "n_joint")))
    revealing = both.where((information > 0) & (mutual >= share * information))
    return entities.join(revealing.select("entity_group", "term"), "entity_group").select("row_key", "term").distinct()


def _ends(spans: Column) -> Column:
    """For every span, how far it and those before it reach."""
    return running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))


def _between(text: Column, spans: Column) -> Column:
    """The parts of ``text`` before, between and after the spans."""
    inner = lambda parts, ends: F.transform(spans, lambda s, k: cut(parts, F.coalesce(F.get(ends, k - 1), F.lit(0)), s["start"]))
    last = lambda parts, ends: cut(parts, F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)), F.length(text))
    return let(pieces(text), lambda parts: let(_ends(spans), lambda ends: F.concat(inner(parts, ends), F.array(last(parts, ends)))))


def _free_terms(spans: Column) -> Column:
    """Sorted ``spans`` without the terms that overlap another span: what comes before reaches into them, or the next one starts within them."""
    fits = lambda all_, ends: lambda x, k: (x["kind"] != TERM) | ((F.coalesce(F.get(ends, k - 1), F.lit(0)) <= x["start"]) & (F.coalesce(F.get(all_, k + 1)["start"], x["end"]) >= x["end"]))
    return let(spans, lambda all_: let(_ends(F.transform(all_, lambda s: F.struct(F.when(s["kind"] == TERM, 0).otherwise(s["end"]).alias("end")))), lambda ends: F.filter(all_, fits(all_, ends))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def with_terms(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``found`` (saved rows of ``detected``) with ``all_spans``: its spans and those of disclosing terms, sorted."""
    terms = disclosing_terms(found, docs, text_col)
    holding, plain = found.where(F.size("spans") > 0), found.where(F.size("spans") == 0)
    by_row = terms.groupBy("row_key").agg(F.collect_set("term").alias("terms"))
    joined = holding.join(by_row, "row_key", "left")
    words = matches(F.col("text"), TERM, len(KINDS), r"\p{L}+", r"\p{L}")
    more = F.filter(words, lambda x: F.array_contains("terms", F.xxhash64(F.lower(x["value"]))))
    joined = joined.withColumn("all_spans", F.when(F.col("terms").isNotNull(), _free_terms(F.sort_array(F.concat("spans", more)))).otherwise(F.col("spans"))).drop("terms")
    # Rows without spans have no key and take no part in the join, where they would all meet in one task.
    return joined.unionByName(plain.withColumn("all_spans", F.col("spans")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``spans``, ``all_spans`` (arrays of start, rank, kind, end, value) of every row; also ``base`` and ``joined``, written as kind:start:end.

    Terms are words of three letters or more; shorter ones give too little evidence and never count.
    Null text counts as empty.  Repeated rows are returned as often as they come,
    extra columns are ignored.  No spans give empty strings.
    """
    found = saved(detected(docs, id_col, text_col), "personal")
    return with_terms(found, docs, text_col).select("id", "spans", "all_spans", _joined(F.col("spans")).alias("base"), _joined(F.col("all_spans")).alias("joined"))


def sanitised_text(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets, terms removed; where spans overlap the first counts, and the rest of a longer one goes."""

    def written(parts: Column, ends: Column) -> Column:
        before = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0))
        mark = lambda s, k: F.when((s["start"] < before(k)) | (s["kind"] == TERM), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        kept = F.transform(spans, lambda s, k: F.concat(cut(parts, before(k), s["start"]), mark(s, k)))
        return F.concat(F.array_join(kept, ""), cut(parts, F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)), F.length(text)))

    return let(pieces(text), lambda parts: let(_ends(spans), lambda ends: written(parts, ends)))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data generalised and disclosing terms removed; rows without any, null texts among them, stay as they are.

    Words of one or two letters are never terms.
    """
    others = tuple(c for c in docs.columns if c != text_col)
    found = detected(docs, id_col, text_col, others)
    hit = saved(found.where(F.size("spans") > 0), "personal")
    clean = sanitised_text(F.col("text"), F.col("all_spans"))
    changed = with_terms(hit, docs, text_col).select(*(clean.alias(c) if c == text_col else F.col(f"carried_{c}").alias(c) for c in docs.columns))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    untouched = docs.where(F.size(base_spans(text)) == 0)
    return untouched.unionByName(changed)
