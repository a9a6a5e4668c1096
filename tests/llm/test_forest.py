"""MinHash near-duplicates against brute force."""

import random
import re

import pytest

from runlens.llm import forest, queries


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def brute(docs):
    """Components by sets, of rows (id, text); a row's component is the smallest id that its row reaches."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    out = []
    for k, (doc_id, _) in enumerate(docs):
        first = least.get(find(k))
        out.append((doc_id, len(sets[k]), first, doc_id == first))
    return sorted(map(str, out))


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, content string, at int").repartition(3)


def found(spark, docs, **more):
    return sorted(map(str, map(tuple, forest.near_duplicates(frame(spark, docs), **more).collect())))


def copies(seed, groups, size, words=60):
    """Groups of texts in which each differs from one before in up to a tenth of the words."""
    rng, docs = random.Random(seed), []
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    for _ in range(groups):
        texts = [[rng.choice(vocabulary) for _ in range(words)]]
        for _ in range(size - 1):
            own = list(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own = own[: rng.randint(words - 8, words)] * rng.choice([1, 1, 2])
            texts.append(own)
        docs += [" ".join(t) for t in texts]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("crowd, at_once", [(32, 256), (3, 2), (1, 1)])
def test_groups(spark, crowd, at_once):
    docs = copies(crowd, 6, 12)
    assert found(spark, docs, crowd=crowd, at_once=at_once) == brute(docs)


def test_a_passage_that_many_share(spark):
    """Texts that share half of their words crowd the regions but don't link; a few pairs among them do."""
    rng, docs = random.Random(2), []
    common = [f"c{k}" for k in range(60)]
    for k in range(60):
        own = common + [f"w{k}-{i}" for i in range(28)]
        docs.append(" ".join(own))
        if k % 10 == 0:
            docs.append(" ".join(own[:-2]))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    assert found(spark, docs, crowd=2, at_once=3) == brute(docs)


def test_near_copies_make_few_links(spark, monkeypatch):
    """The links that rounds go over grow with the texts of a group, not with its pairs."""
    rng, docs, seen = random.Random(4), [], []
    for k in range(150):
        own = [f"w{i}" for i in range(80)]
        own[rng.randrange(80)] = f"x{k}"
        docs.append((k, " ".join(own)))
    plain = forest.components
    monkeypatch.setattr(forest, "components", lambda edges: seen.append(edges.distinct().count()) or plain(edges))
    assert found(spark, docs, crowd=16) == brute(docs)
    assert sum(seen) <= 4 * len(docs)


def test_odd_rows(spark):
    docs = [(10, None), (11, ""), (12, " \n\t"), (13, "One two"), (7, "one  TWO"), (14, "one two three four"), (15, "One two three\x0bfour"), (16, "Élan élan a b"), (17, "élan élan a b"), (None, "one two"), (None, "alone"), (18, "word " * 50_000), (19, "word " * 40_000), (13, "One two"), (20, "x y z"), (20, "p q r s t"), (21, "p q r s t"), (5, "one two three")]
    assert found(spark, docs) == brute(docs)
    assert found(spark, docs[:0]) == [] and found(spark, docs[:3]) == brute(docs[:3])


def test_threshold_is_exact(spark):
    """Eight of ten shingles link, eight of eleven don't."""
    words = [f"w{k}" for k in range(30)]
    docs = []
    for size, common in ((9, 8), (10, 8), (9, 7)):
        base = [f"s{size}-{common}-{w}" for w in words]
        docs += [" ".join(base[: size + 3]), " ".join(base[size - common : size + 3])]  # common shingles of size in all
    docs = list(enumerate(docs))
    assert found(spark, docs) == brute(docs)
    assert [r.split(", ")[2] for r in brute(docs)] == ["0", "0", "2", "2", "4", "5"]


def test_registered(spark, tmp_path):
    docs = copies(9, 4, 5)
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.queries()["op13_minhash_neardup"](spark, str(tmp_path))
    assert rows.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(str, map(tuple, rows.collect()))) == brute(docs)
