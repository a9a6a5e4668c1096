"""Decontamination without all pairs, and license blocks in linear time."""

import random
import time

from runlens.llm import decontam, license_scan


def planted(seed, n_items, words=60, per_item=1):
    """Items of one length, and documents that each hold one of them with a few words changed: (docs, items, similarity by (doc, item))."""
    rng, docs, items, want = random.Random(seed), [], [], {}
    for k in range(n_items):
        own = [f"w{rng.randrange(50_000)}" for _ in range(words)]
        items.append((k, " ".join(own)))
        for _ in range(per_item):
            edited = list(own)
            for at in rng.sample([*range(4), *range(words - 4, words)], rng.randint(0, 4)):
                edited[at] = "edited"
            runs = lambda x: {tuple(x[i : i + 5]) for i in range(words - 4)}
            common = len(runs(own) & runs(edited))
            want[len(docs), k] = common / (2 * (words - 4) - common)
            docs.append((len(docs), " ".join([f"a{rng.randrange(900)}" for _ in range(30)] + edited + [f"b{rng.randrange(900)}" for _ in range(30)])))
    return docs, items, want


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_recall_near_the_threshold(spark):
    docs, items, want = planted(1, 300, per_item=2)
    near = {k for k, s in want.items() if 0.8 <= s <= 0.9}
    assert len(near) > 150
    found = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(*frames(spark, docs, items)).collect()}
    assert all(abs(found[k] - want[k]) < 1e-9 for k in found)
    missed = {k for k, s in want.items() if s >= 0.8} - set(found)
    assert len(missed) <= 1 and not {k for k, s in want.items() if s > 0.9} & missed


def test_few_candidates(spark):
    """Items of one length that share a passage: only documents with a rarer shingle of an item are candidates for it."""
    docs, items, _ = planted(2, 400)
    shared = " ".join(f"s{k}" for k in range(20))
    items = [(k, f"{shared} {t}") for k, t in items]
    docs = [(k, " ".join([*t.split()[:30], shared, *t.split()[30:]])) for k, t in docs[:100]] + [(1000 + k, f"{shared} lorem {k}") for k in range(200)]
    d, b = frames(spark, docs, items)
    laid = decontam.windows(d, decontam.saved(decontam.benchmark_items(b), "items"))
    assert laid.select("doc_id", "item").distinct().count() <= 100
    limits = [decontam.leaks(d, b, broadcast_shingles=n).count() for n in (0, 1_000_000)]
    assert limits[0] == limits[1] >= 50


def test_shorter_documents(spark):
    """A document shorter than an item is held against it as it is."""
    item = [f"w{k}" for k in range(30)]
    docs = [(1, " ".join(item[:25])), (2, " ".join(item[3:])), (3, " ".join(item[:20]))]
    found = {r.doc_id: r.similarity for r in decontam.leaks(*frames(spark, docs, [(9, " ".join(item))])).collect()}
    assert found == {1: 21 / 26, 2: 23 / 26}


def test_license_blocks_take_linear_time(spark):
    words = sorted({w for t in license_scan.TEMPLATES.values() for w in t.split()})
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choices(words, k=n))
    license_scan.scan(spark.createDataFrame([(1, text(100))], "doc_id long, text string")).collect()
    d = spark.createDataFrame([(1, text(64_000))], "doc_id long, text string")
    began = time.time()
    assert license_scan.scan(d).first().n_words == 64_000
    assert time.time() - began < 25  # a few seconds; pair by pair it was minutes


def test_long_templates_match_whole(spark):
    long = " ".join(f"term{k}" for k in range(70))
    docs = [(1, f"before {long} after"), (2, " ".join(long.split()[:60])), (3, f"{long[:200]}")]
    found = {r.id: r.labels for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates={"long": long, "short": "licensed under x"}).collect()}
    assert found == {1: "long", 2: "", 3: ""}
