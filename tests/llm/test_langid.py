"""The registered language query against prediction by partial matching, byte by byte."""

import math
import zlib
from collections import Counter

from runlens.llm import langid, queries

FOLDER = "/root/testdata/sf0.001"


def bits(counts, data):
    """Code length of a text under one language's counts of bytes by context."""
    total = 0.0
    for j, x in enumerate(data):
        for n in range(min(j, langid.ORDER), -2, -1):
            seen = counts.get(data[j - n : j]) if n >= 0 else None
            if n == -1:
                total += 8
            elif seen:
                size, distinct = sum(seen.values()), len(seen)
                if seen[x]:
                    total -= math.log2(seen[x] / (size + distinct))
                    break
                total -= math.log2(distinct / (size + distinct))
    return total


def test_registered_query_matches_byte_by_byte(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts: dict = {}
    for doc_id, text, lang in docs:
        if lang is None or text is None or zlib.crc32(str(doc_id).encode()) % 4 == 2:
            continue
        table, data = counts.setdefault(lang, {}), text.lower().encode()
        for n in range(langid.ORDER + 1):
            for j in range(n, len(data)):
                table.setdefault(data[j - n : j], Counter())[data[j]] += 1
    # The smallest tables have fewer rows a language than the sample may have, so all count.
    assert 1 < len(counts) and len(docs) < langid.SAMPLE
    got = {r.doc_id: r for r in queries.queries()["op4_language_id"](spark, FOLDER).collect()}
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2 and d.text]
    chosen = sorted(held or docs, key=lambda d: len(d.text))[:50]
    for doc_id, text, _ in chosen:
        if not any(map(str.isalpha, text)):
            assert got[doc_id].lang_pred == langid.UNDETERMINED
            continue
        costs = {lang: bits(table, text.lower().encode()) for lang, table in counts.items()}
        best = min(sorted(costs), key=costs.get)
        rest = sorted(costs.values())
        assert got[doc_id].lang_pred == best or rest[1] - rest[0] < 1e-2
        assert abs(got[doc_id].score - 1 / sum(2 ** min(0.0, costs[best] - c) for c in costs.values())) < 1e-2
