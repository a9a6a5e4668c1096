"""The corpus pipeline, stage by stage, against a brute-force version on small tables."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from runlens.llm import decontam, neardup
from runlens.llm.queries import THRESHOLD, TOKENIZER

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioustrn") for _ in range(r.randint(2, 7))) for _ in range(n))


def shouted(seed):
    return " ".join(w.upper() + "!!|" for w in prose(seed, 80).split())


def fingerprint(text):
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def one_of_each_group(rows):
    fp, root = {i: fingerprint(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: five_words(t) for i, t in rows.items()}
    for a, b in itertools.combinations(sorted(rows), 2):
        if (fp[a] ^ fp[b]).bit_count() <= neardup.RADIUS or len(sets[a] & sets[b]) >= neardup.SIMILARITY * len(sets[a] | sets[b]) > 0:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: t for i, t in rows.items() if find(i) == i}


def reworded(text, seed, changes):
    words, r = text.split(), random.Random(seed)
    for k in r.sample(range(len(words)), changes):
        words[k] = "".join(r.choice("bcdfg") for _ in range(6))
    return " ".join(words)


@pytest.mark.parametrize("crowd", [2, 5, neardup.CROWD])
def test_near_copies_are_linked_in_crowds_too(spark, crowd):
    texts = [prose(1000 + k, 60) for k in range(20)]  # unlike each other
    texts += [reworded(prose(1100, 200), k, k % 4) for k in range(60)]  # one large group of near copies
    texts += [reworded(prose(1200 + k, 150), k, n) for k in range(10) for n in (0, 3, 9)]  # within and beyond the threshold
    texts += [prose(1300, 60) + " " + prose(1301 + k, 60) for k in range(40)]  # a passage that many share
    texts += ["two words", "Two  words", "", None]
    rows = dict(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows.items()], DOCS)
    left = {r.doc_id for r in neardup.keep_one(docs, crowd=crowd).collect()}
    assert left == set(one_of_each_group(rows)) and len([i for i in left if 20 <= i < 80]) == 1 and set(range(20)) <= left


def test_near_copies_that_repeat_a_line_are_linked(spark):
    rows = {}
    for k in range(24):  # the same shingles but for the repeated line's own ends: the counts move the fingerprint
        line, rest = prose(2000 + k, 10), prose(2100 + k, 590)
        rows[2 * k], rows[2 * k + 1] = f"{line} {rest}", f"{' '.join([line] * 20)} {rest}"
    far = [k for k in range(24) if (fingerprint(rows[2 * k]) ^ fingerprint(rows[2 * k + 1])).bit_count() > 16]
    assert far
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows.items()], DOCS)
    for crowd in (1, neardup.CROWD):
        assert {r.doc_id for r in neardup.keep_one(docs, crowd=crowd).collect()} == set(one_of_each_group(rows)) == set(range(0, 48, 2))


@pytest.mark.parametrize("at_once", [2, 3])
def test_links_of_a_crowded_value_outlast_a_change_of_its_main_group(spark, at_once):
    old, new = prose(4000, 300).split(), prose(4001, 300).split()
    # Texts turn from old into new; only neighbours are similar: main - bridge - B - middle - C.
    made = [(0, 5), (24, 1), (48, 3), (72, 1), (96, 3)]
    texts = [" ".join(new[:at] + old[at:-1] + [f"own{at}x{k}"]) for at, n in made for k in range(n)]
    sets = [five_words(t) for t in texts]
    linked = {(x, y) for x, y in itertools.combinations(range(len(texts)), 2) if len(sets[x] & sets[y]) >= neardup.SIMILARITY * len(sets[x] | sets[y])}
    steps = [at for at, n in made for _ in range(n)]
    assert linked == {(x, y) for x, y in itertools.combinations(range(len(texts)), 2) if abs(steps[x] - steps[y]) <= 24}
    # The first centre is the largest content, of the main group; the next is the smallest outside it, the middle, which merges B and C into the new main group (no B is drawn with it).
    content = {0: 100, 24: 50, 48: 6, 72: 1, 96: 30}
    rows, seen = [], {}
    for k, (text, at) in enumerate(zip(texts, steps)):
        seen[at] = seen.get(at, -1) + 1
        _, size, parity, _ = neardup.minhash_bands(text.encode())
        rows.append((k, 0, k + 1, content[at] + seen[at], size, parity.view("<i8").tolist(), [7]))
    marked = spark.createDataFrame(rows, "id long, key long, fp long, content long, size long, parity array<long>, bands array<long>")
    told = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "id long, key long, text string")
    found = {(r.a, r.b) for r in neardup.similar_links(marked, told, crowd=2, at_once=at_once).collect()}
    reached, more = {1}, {1}
    while more:
        more = {y for x in more for e in found if x in e for y in e} - reached
        reached |= more
    assert reached == set(range(1, len(texts) + 1))


def test_rounds_go_over_a_link_a_text(spark):
    rows = [(k, 0, k + 1, k, *neardup.minhash_bands(" ".join([*prose(5000, 300).split()[:-1], f"x{k}"]).encode())[1:]) for k in range(60)]
    texts = spark.createDataFrame([(k, 0, " ".join([*prose(5000, 300).split()[:-1], f"x{k}"])) for k in range(60)], "id long, key long, text string")
    marked = spark.createDataFrame([(*r[:5], r[5].view("<i8").tolist(), [k // 12, 9]) for k, r in enumerate(rows)], "id long, key long, fp long, content long, size long, parity array<long>, bands array<long>")
    found = {(r.a, r.b) for r in neardup.similar_links(marked, texts, crowd=12).collect()}
    assert len(found) == 60 and {x for e in found for x in e} == set(range(1, 61))


def test_parity_bits_never_exclude_a_similar_pair():
    for k in range(300):
        text = prose(3000 + k, 20 + 10 * k)
        other = reworded(text, k, k % 4 * (1 + k // 60)) + (" " + prose(1, k % 30) if k % 3 else "")
        (_, na, pa, _), (_, nb, pb, _) = (neardup.minhash_bands(x.encode()) for x in (text, other))
        a, b = five_words(text), five_words(other)
        assert (na, nb) == (len(a), len(b)) and sum(int(x).bit_count() for x in pa ^ pb) <= len(a ^ b)


def shingled(text):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    return [tuple(words[k : k + decontam.SHINGLE]) for k in range(len(words) - decontam.SHINGLE + 1)]


def leaked(text, items):
    found = shingled(text)
    for item in map(shingled, items):
        for k in range(max(1, len(found) - len(item) + 1)):
            window = found[k : k + len(item)]
            common = sum((Counter(window) & Counter(item)).values())
            if item and common / (len(window) + len(item) - common) >= decontam.THRESHOLD:
                return True
    return False


def without_personal_data(text):
    text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text)
    return re.sub(r"[0-9]+(\.[0-9]+){3}", "[IP]", text)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    item = prose(900, 60)
    texts = [prose(k, 80) for k in range(60)] + [shouted(300 + k) for k in range(40)]
    texts += [texts[3], texts[3] + " zz", texts[4] + "\n"]  # copies
    texts += [prose(400, 40) + " " + item + " " + prose(401, 40), prose(402, 30) + " " + " ".join(item.split()[:-2] + ["other", "end"])]  # leaks
    texts += [f"{prose(403, 50)} mail jo.do@ex-a.org now {prose(404, 40)}", f"{prose(405, 60)} from 10.0.0.255 {prose(406, 30)}", f"é {prose(407, 80)}"]
    texts += [None, "", prose(408, 6000)]
    rows = [(i, t, "en" if i % 7 else None, "s" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, prose(901, 45))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {i: t for i, t, *_ in rows}, [item, prose(901, 45)]


def by_id(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


def test_stages_match_brute_force(spark, tables):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    folder, texts, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality classifier"](spark, docs, folder)
    assert good.columns == columns
    passed = {i: r.text for i, r in by_id(good).items()}
    assert set(range(60)) <= set(passed) and not set(range(60, 100)) & set(passed) and {100, 101, 102, 103, 104, 105, 106} <= set(passed)
    assert all(texts[i] == t for i, t in passed.items())

    single = stages["near duplicates"](spark, good, folder)
    assert single.columns == columns
    left = one_of_each_group(passed)
    assert {i: r.text for i, r in by_id(single).items()} == left and not {100, 102} & set(left)

    clean = stages["decontamination"](spark, single, folder)
    assert clean.columns == columns
    left = {i: t for i, t in left.items() if not leaked(t, items)}
    assert {i: r.text for i, r in by_id(clean).items()} == left and not {103, 104} & set(left)

    private = stages["personal data"](spark, clean, folder)
    assert private.columns == columns and private.schema == docs.schema
    left = {i: t and without_personal_data(t) for i, t in left.items()}
    found = by_id(private)
    assert {i: r.text for i, r in found.items()} == left and "[EMAIL]" in left[105] and "[IP]" in left[106]
    assert all(r.n_chars == (len(r.text) if r.text is not None else r.n_chars) for r in found.values())

    # The whole run gives the same documents, encoded as the library does.
    whole = by_id(corpus_pipeline.run(spark, folder))
    assert set(whole) == set(left)
    for i, r in whole.items():
        ids = library.encode(left[i] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_quality_threshold_is_the_query_s():
    assert THRESHOLD == 0.3


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_over_nothing(spark, tables, name, stage):
    folder, _, _ = tables
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert stage(spark, empty, folder).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_over_nulls_and_repeated_rows(spark, tables, name, stage):
    folder, _, _ = tables
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", None, None, None), (2, prose(600, 200), "en", "s", 5), (2, prose(600, 200), "en", "s", 5)]
    got = stage(spark, spark.createDataFrame(rows, DOCS), folder).collect()
    assert len(got) <= len(rows)
    if name in ("decontamination", "personal data", "byte-pair encoding"):
        assert len(got) == len(rows)
    if name == "near duplicates":
        assert sorted(r.doc_id for r in got) == [1, 2]
