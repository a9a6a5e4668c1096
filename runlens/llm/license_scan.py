"""License scan: exact set-similarity join of text blocks with license templates.

A block is a run of ``BLOCK_WORDS`` consecutive words (more, if a template has more) that
begins at a word of some template, wherever lines break.  A block matches a template when it holds at least
nine tenths of the template's distinct words.  Words are put
in one global order, rarest in the corpus first.  A block that reaches the
threshold must share a word of the template's prefix (its rarest words but the
last ``needed - 1``); prefixes are joined on words, pairs are dropped where the
block is too short or where the words left after the shared positions can't reach
the threshold, and the rest are verified by their exact overlap.

Words that are in no template can't count, so a block is the set of its template words,
and only documents whose words could cover a template are cut into blocks.  A run
that begins elsewhere holds no more template words than the one at its first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, saved

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's distinct words that a block must hold, in tenths; least number of words in a block.
THRESHOLD_TENTHS, BLOCK_WORDS = 9, 40
#: Phrases and labels found word by word (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates: well-known sentences of licenses, by label (fixed values).
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "boost": "distributed under the boost software license version 1 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc0-1.0": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATOR), "")


def _literal(items) -> Column:
    return F.array(*(F.lit(x) for x in items)) if items else F.array().cast("array<string>")


def _stands(parts: list[str]):
    """Whether the words from place ``i`` on are ``parts``."""
    return lambda i: _all(F.get(F.col("words"), i + k) == F.lit(w) for k, w in enumerate(parts))


def needed(size: int, tenths: int = THRESHOLD_TENTHS) -> int:
    return -(-size * tenths // 10)


def block_length(templates: dict[str, str]) -> int:
    """Words of a block: as many as the longest template, so that each can match whole."""
    return max([BLOCK_WORDS, *(len(t.split()) for t in templates.values())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, tenths: int = THRESHOLD_TENTHS, block_words: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``n_blocks`` (different blocks that match a template).

    Null text counts as empty.  ``score`` is 1 where a phrase stands, else the
    largest share of a template that a matching block holds, else 0.  Rows that
    repeat id and text are returned as often as they come; extra columns are
    ignored.  Time is linear in the words of a text.
    """
    templates = TEMPLATES if templates is None else templates
    block_words = block_length(templates) if block_words is None else block_words
    templates = {k: sorted(set(t.split())) for k, t in templates.items()}
    vocabulary = sorted({w for t in templates.values() for w in t} | {w for p in PHRASES for w in p.split()})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row_key"), words(text).alias("words"))
    d = d.withColumn("known", F.array_intersect("words", _literal(vocabulary)))

    marks = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        has = _all(F.array_contains("known", w) for w in parts)
        at = F.when(has, F.filter(F.sequence(F.lit(0), F.size("words") - 1), _stands(parts))).otherwise(F.array().cast("array<int>"))
        marks.append((label, at))
    covered = F.lit(False)
    for t in templates.values():
        covered = covered | (F.size(F.array_intersect("known", _literal(t))) >= needed(len(t), tenths))
    least = min((needed(len(t), tenths) for t in templates.values()), default=1)
    known_at = F.filter(F.transform("words", lambda w, k: F.struct(k.alias("k"), w.alias("w"))), lambda x: x["w"].isin(vocabulary))
    in_block = lambda at, x, k: F.array_distinct(F.transform(F.filter(F.slice(at, k + 1, F.lit(block_words)), lambda y: y["k"] < x["k"] + block_words), lambda y: y["w"]))
    # A block is one text of its words in order: different ones of many texts are found by hashing, of many arrays by comparing each with each.
    block = lambda at: lambda x, k: let(in_block(at, x, k), lambda b: F.when(F.size(b) >= least, F.array_join(F.array_sort(b), " ")))
    blocks = let(known_at, lambda at: F.array_distinct(F.array_compact(F.transform(at, block(at)))))
    d = d.select("id", "row_key", F.size("words").cast("long").alias("n_words"), "known", *(at.alias(f"at_{k}") for k, (_, at) in enumerate(marks)), F.when(covered, blocks).alias("blocks"))
    all_at = F.flatten(F.array(*(F.col(f"at_{k}") for k in range(len(marks)))))
    found = F.array_sort(F.array_compact(F.array(*(F.when(F.size(f"at_{k}") > 0, F.lit(label)) for k, (label, _) in enumerate(marks)))))
    d = d.withColumns({"n_base": F.size(all_at).cast("long"), "first_word": F.array_min(all_at).cast("long"), "last_word": F.array_max(all_at).cast("long"), "found": found})
    d = saved(d.drop(*(f"at_{k}" for k in range(len(marks)))), "licenses")

    # One row per word of the templates: its size is fixed by them.
    counts = {r.word: r.n for r in d.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rows = []
    for label, t in templates.items():
        ordered, need = sorted(t, key=order.index), needed(len(t), tenths)
        rows += [F.struct(F.lit(w).alias("word"), F.lit(label).alias("label"), F.lit(k).alias("t_at"), F.lit(len(t)).alias("t_size"), F.lit(need).alias("need"), _literal(ordered).alias("t_words")) for k, w in enumerate(ordered[: len(t) - need + 1])]
    prefixes = docs.sparkSession.range(1).select(F.inline(F.array(*rows)))
    ordered = d.where("blocks is not null").select("id", "row_key", F.posexplode("blocks").alias("block", "b_words")).select("id", "row_key", "block", F.array_intersect(_literal(order), F.split("b_words", " ")).alias("b_words")).distinct()
    each = ordered.select("*", F.size("b_words").alias("b_size"), F.posexplode("b_words").alias("b_at", "word"))
    pairs = each.join(F.broadcast(prefixes), "word")
    pairs = pairs.where((F.col("b_size") >= F.col("need")) & (F.col("b_at") <= F.col("b_size") - F.col("need")))
    pairs = pairs.where(F.least(F.col("t_size") - F.col("t_at"), F.col("b_size") - F.col("b_at")) >= F.col("need"))
    pairs = pairs.select("id", "row_key", "block", "label", "t_size", "need", F.size(F.array_intersect("b_words", "t_words")).alias("common")).where(F.col("common") >= F.col("need")).distinct()
    hits = pairs.groupBy("row_key", F.col("id").alias("_id")).agg(F.array_sort(F.collect_set("label")).alias("more"), F.max(F.col("common") / F.col("t_size")).alias("share"), F.countDistinct("block").alias("n_blocks"))

    out = d.select("id", "row_key", "n_words", "n_base", "first_word", "last_word", "found").join(hits.withColumnRenamed("row_key", "_key"), (F.col("row_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    labels = F.array_sort(F.array_union("found", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "id", "n_words", "n_base", "first_word", "last_word", F.array_join("found", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
