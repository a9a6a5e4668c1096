"""Token alignment against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from runlens.llm import alignment, queries

SIGNS = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "12", ".", ",", "'s", "'ll", "　", "\x1c", "\x85", "\xa0", "\0", "<|endoftext|>", "</s>", "<0x41>", "<unk>", "中", "𝔘", "‍", " the", " and", "é"]


@pytest.fixture(scope="module")
def encoders():
    with open(queries.BYTES, encoding="utf-8") as f, open(queries.PIECES, "rb") as g:
        return alignment.Encoders(f.read(), g.read())


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def whole(encoders, library, text):
    """Ids of a whole text by the libraries, none if its bytes don't come back."""
    if not text:
        return [], []
    a, b = library.encode(" " + text, add_special_tokens=False).ids, encoders.b.encode(text)
    for ids, table in ((a, encoders.bytes_a), (b, encoders.bytes_b)):
        if b"".join(table[k] for k in ids) != (" " + text).encode():
            return [], []
    return a, b


def brute(encoders, library, docs):
    rows, held, top = [], Counter(), Counter()
    for doc_id, text in docs:
        spans, (a, b) = [], whole(encoders, library, text)
        for ids, table in ((a, encoders.bytes_a), (b, encoders.bytes_b)):
            ends = np.cumsum([len(table[k]) for k in ids]).tolist()
            spans.append(list(zip([0, *ends], ends, ids)))
        links = [(p[2], q[2]) for p in spans[0] for q in spans[1] if max(p[0], q[0]) < min(p[1], q[1])]
        low, parts = 0, []
        for high in sorted({p[1] for p in spans[0]} & {q[1] for q in spans[1]}):
            parts.append("|".join(",".join(str(x[2]) for x in side if low < x[1] <= high) for side in spans))
            low = high
        held.update(set(links))
        rows.append((doc_id, len(a), len(b), len(parts), links, hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""))
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return [(d, na, nb, g, len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), h) for d, na, nb, g, links, h in rows]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 100])
def test_merge_path(piece):
    rng = random.Random(piece)
    for _ in range(100):
        n = rng.randint(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n})) for _ in range(2))
        i, j, group_a, group_b = alignment.overlaps(a, b, piece)
        low_a, low_b, both = [0, *a[:-1]], [0, *b[:-1]], set(a) & set(b)
        assert list(zip(i.tolist(), j.tolist())) == [(x, y) for x in range(len(a)) for y in range(len(b)) if max(low_a[x], low_b[y]) < min(a[x], b[y])]
        assert group_a.tolist() == [sum(t < x for t in both) for x in a]
        assert group_b.tolist() == [sum(t < x for t in both) for x in b]


def test_pieces_have_equal_work():
    a, b = np.arange(1, 1_000_001), np.array([1_000_000])
    cuts_a, cuts_b = alignment.diagonals(a, b, 4096)
    work = np.diff(cuts_a) + np.diff(cuts_b)
    assert (work[:-1] == 4096).all() and work.sum() == len(a) + len(b)


def test_words_give_what_whole_texts_give(encoders, library):
    rng = random.Random(7)
    for _ in range(10):
        texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 30))) for _ in range(150)] + ["x" * 5000, "\n" * 5000 + "y", None]
        for text, (a, b) in zip(texts, encoders.texts(texts)):
            assert (a.tolist(), b.tolist()) == whole(encoders, library, text), text


def test_a_task_remembers_a_bounded_number_of_words(encoders, library, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 20_000)
    monkeypatch.setattr(alignment, "AT_ONCE", 10)
    at_once, learn = [], encoders.learn
    monkeypatch.setattr(encoders, "learn", lambda words: (at_once.append(len(words)), learn(words)))
    encoders.forget()
    for k in range(20):
        texts = [f"the common word is {' '.join(f'w{k}x{j}' for j in range(40))}"]
        assert [(a.tolist(), b.tolist()) for a, b in encoders.texts(texts)] == [whole(encoders, library, x) for x in texts]
        assert k == 0 or {"the", "common", "word", "is"} <= encoders.code.keys()
        assert encoders.size < 40_000
    assert max(at_once) == 10 and sum(at_once) == 20 * 40 + 4


def test_rows_go_to_python_few_at_once(spark, monkeypatch):
    seen, key = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, saved = spark.conf.get(key), alignment.saved
    monkeypatch.setattr(alignment, "saved", lambda df, name, *more: (seen.append((name, spark.conf.get(key))), saved(df, name, *more))[1])
    docs = spark.createDataFrame([(1, "to be"), (2, "or not")], "doc_id long, text string")
    assert alignment.align(docs, queries.BYTES, queries.PIECES).count() == 2
    assert seen == [("blocks", str(alignment.ROWS_AT_ONCE)), ("counts", before)] and spark.conf.get(key) == before


def test_aligned(spark, encoders, library):
    rng = random.Random(3)
    words = ["the", "tokenizer", "alignment", "naïve", "1234", "foo_bar", "…", "end.\n", "Zürich"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)] + [None, "", "▁", "the", "the", " ", "a  b ", "word " * 20_000]
    docs = [(k if k != 5 else None, t, "pair", 1) for k, t in enumerate(texts)] + [(3, texts[3], "pair", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, pair string, block int").repartition(3)
    want = sorted(map(str, brute(encoders, library, [d[:2] for d in docs if d[1] is None or len(d[1]) < 50_000])))
    # The longest text is tested apart, for the brute force takes quadratic time.
    found = alignment.align(df.where("length(text) < 50000 or text is null"), queries.BYTES, queries.PIECES, piece=16, block_bytes=300)
    assert found.columns == [c.split()[0] for c in alignment._OUT.split(", ")]
    assert sorted(str(tuple(r)) for r in found.collect()) == want
    long = alignment.align(df.where("length(text) >= 50000"), queries.BYTES, queries.PIECES).first()
    a, b = whole(encoders, library, "word " * 20_000)
    assert (long.n_a, long.n_b, long.n_links) == (len(a), len(b), len(a) + len(b) - long.n_groups)
    assert alignment.align(df.limit(0), queries.BYTES, queries.PIECES).count() == 0


def test_registered(spark, encoders, library, tmp_path):
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choices(["to", "be", "or", "notwithstanding", "¿qué?"], k=20))) for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, queries.queries()["op11_alignment"](spark, str(tmp_path)).collect())) == brute(encoders, library, docs)
