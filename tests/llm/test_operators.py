"""Corpus operators against brute force on small tables with awkward rows."""

import base64
import hashlib
import itertools
import random
import re
import struct
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from runlens.llm import bpe, chat, common, decontam, langid, license_scan, neardup, pii, quality_model, quality_rules, warc

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, host int, words string, spans string"


def docs(spark, texts, start=0):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(start + i, t, "en", "s" if i % 2 else None, 1, "x", 2, "y", "z") for i, t in enumerate(texts)], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioustrn") for _ in range(r.randint(2, 7))) for _ in range(n))


AWKWARD = [None, "", " \n\t ", "one", "one two", "Ünï ONE two\x1cthree", prose(1, 3000), prose(1, 3000), "a b " * 4000]


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def test_quality_rules(spark):
    texts = [*AWKWARD, "x#y\nx#y\n\n|%\n" + prose(3, 30), prose(4, 20) + " " + prose(5, 12) + " " + prose(4, 20)]
    got = {r.id: r for r in quality_rules.judge(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)


def test_prior_takes_chance_out(spark):
    def sums(rates, n, seed):
        r = random.Random(seed)
        return spark.createDataFrame([(f"h{k}", n, sum(r.random() < p for _ in range(n))) for k, p in enumerate(rates)], "host string, n_docs long, n_any long")

    # Small hosts of one true rate: their raw rates spread widely by chance alone, so the prior holds them together.
    mean, weight = quality_rules.prior(sums([0.3] * 800, 4, 1), "n_any")
    assert abs(mean - 0.3) < 0.03 and weight > 30
    r = random.Random(2)
    mean, weight = quality_rules.prior(sums([r.betavariate(6, 14) for _ in range(800)], 30, 3), "n_any")
    assert abs(mean - 0.3) < 0.02 and 14 < weight < 28  # 20 is true
    assert quality_rules.prior(sums([], 1, 4), "n_any") == (0.0, 1000.0) and quality_rules.prior(sums([0.5], 10, 5), "n_any")[1] == 1000.0


def test_one_rule_alone_rejects_a_host(spark):
    rows = [(i, prose(i, 40) + (" ###$$$%%%&&&***|||" * 4 if i < 60 and i % 5 < 2 else ""), "bad" if i < 64 else f"h{i % 4}" if i % 9 else None) for i in range(400)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.kept for r in got if r.host == "bad"} == {False} and {r.kept for r in got if r.host != "bad"} == {True}
    assert {r.host_rate for r in got if r.host is None} == {None}


def test_bad_host_is_rejected(spark):
    rows = [(i, prose(i, 40) + (" ###$$$%%%&&&***|||" * 4 if i < 60 else ""), "bad" if i < 64 else f"h{i % 4}") for i in range(200)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.kept for r in got if r.host == "bad"} == {False} and {r.kept for r in got if r.host != "bad"} == {True}


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["mit"]
    texts = [*AWKWARD, "CC BY cc-by\nAll Rights\nReserved!", "GNU General Public License", prose(6, 50) + "\n" + mit.upper().replace(" free ", " ") + "\n" + prose(7, 9), "mit license permission granted", mit.replace(" ", "\n * "), "\n\n".join(" ".join(mit.split()[k : k + 5]) for k in range(0, 25, 5)), " ".join(f"{w} {prose(k, 2)}" for k, w in enumerate(mit.split()))]
    got = {r.id: r for r in license_scan.scan(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        at = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        want, score = {x for _, x in at}, float(bool(at))
        for label, words in license_scan.TEMPLATES.items():
            template = set(words.split())
            for k in range(len(w)):
                held = len(template & set(w[k : k + license_scan.BLOCK_WORDS]))
                if 10 * held >= license_scan.THRESHOLD_TENTHS * len(template):
                    want.add(label)
                    score = max(score, held / len(template))
        assert r.labels == ",".join(sorted(want)) and abs(r.score - score) < 1e-12
    for k in (2, 4, 5):
        assert "mit" in got[len(AWKWARD) + k].labels
    assert not got[len(AWKWARD) + 6].labels


def test_license_scan_of_many_lines(spark):
    text = "licensed under the apache license version 2 0\n" + "the license\nof it\n" * 50_000
    began = time.time()
    row = license_scan.scan(docs(spark, [text])).first()
    assert row.labels == "apache-2.0" and row.n_words == 200_008 and time.time() - began < 60


@pytest.mark.parametrize("bucket", [64, 1])
def test_near_duplicates(spark, bucket):
    base = prose(8, 400).split()
    near = [" ".join(base[:k] + ["zz"] + base[k + 1 :]) for k in range(0, 400, 9)]
    texts = [*AWKWARD, " ".join(base), *near, *(prose(100 + k, 60) for k in range(30))]
    rows = neardup.near_duplicates(docs(spark, texts, 5), bucket=bucket).collect()
    fp = {}
    for i, t in enumerate(texts):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t or "")) if x]
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fp[i + 5] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in fp}
    for _ in fp:
        for a, b in itertools.combinations(fp, 2):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    assert {r.id: (r.fp % (1 << 64), r.component_id) for r in rows} == {i: (fp[i], root[i]) for i in fp}
    # keep_one also links five-word similarity of 0.8.
    words = {i + 5: lower(t or "").encode().split() for i, t in enumerate(texts)}
    five = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    alike = [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 2 or len(five[a] & five[b]) >= 0.8 * len(five[a] | five[b]) > 0]
    for _ in fp:
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    assert sorted(r.doc_id for r in neardup.keep_one(docs(spark, texts, 5), broadcast_rows=0).collect()) == sorted(set(root.values()))
    kept = neardup.keep_one(docs(spark, texts, 5))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values())) and kept.columns == SCHEMA.replace(",", "").split()[::2]


def test_one_row_of_each_group_with_repeated_and_missing_ids(spark):
    a, b, c = prose(70, 60), prose(71, 60), prose(72, 60)
    rows = [(1, a), (2, a), (2, b), (3, b), (None, b), (None, c), (None, c), (4, None), (4, None), (5, ""), (6, prose(73, 60)), (6, prose(74, 60))]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, a), (2, b), (0, c), (4, ""), *rows[-2:]])


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.sql("SELECT 100L AS a, 100L AS b"))
    found = {r.node: r.root for r in common.components(edges).collect()}
    assert found == {i: 0 for i in range(61)}


def test_leaks(spark):
    items = [prose(20, 40), prose(21, 25), "four word item here", None, "", prose(22, 60)]
    b = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    w = items[5].split()
    near = " ".join(w[:58] + ["changed", "end"])
    texts = [*AWKWARD, prose(30, 100) + " " + items[0].upper() + ". " + prose(31, 50), items[1], "x " + items[2] + " y", prose(32, 20) + " " + near, " ".join(w[:30]), prose(33, 500)]
    first = len(AWKWARD)
    for limit in (400_000, 40):
        got = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs(spark, texts), b, broadcast_shingles=limit).collect()}
        assert set(got) == {(first, 0), (first + 1, 1), (first + 2, 2), (first + 3, 5)}
        assert got[first, 0].similarity == 1 and got[first, 0].start_word == 100
        assert 0.8 <= got[first + 3, 5].similarity < 1
    assert decontam.leaks(docs(spark, texts), b.limit(0)).count() == 0
    for rows in (400_000, 0):
        assert decontam.without_leaks(docs(spark, texts), b, broadcast_rows=rows).count() == len(texts) - 4


def test_leaks_by_weighted_similarity(spark):
    r = random.Random(77)
    items = {k: prose(2000 + k, 30 + 9 * k) for k in range(8)}
    items[8] = " ".join([prose(2100, 6)] * 6)  # repeats weigh
    texts = []
    for k, item in items.items():
        for changes in range(8):
            w = item.split()
            for at in r.sample(range(len(w)), min(len(w), changes)):
                w[at] = "changed"
            texts.append(f"{prose(3000 + len(texts), 12)} {' '.join(w)} {prose(4000 + len(texts), 7)}")
    cut = lambda t: [x for x in re.split(r"[\W_]+", t.lower()) if x]
    want = {}
    for d, t in enumerate(texts):
        w = cut(t)
        all_ = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for i, item in items.items():
            v = cut(item)
            own = [tuple(v[k : k + 5]) for k in range(len(v) - 4)]
            for start in range(len(all_)):
                window = all_[start : start + len(own)]
                common = sum((Counter(window) & Counter(own)).values())
                similarity = common / (len(window) + len(own) - common)
                if similarity >= decontam.THRESHOLD and similarity > want.get((d, i), (0,))[0]:
                    want[d, i] = (similarity, start)
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for limit in (400_000, 10):
        got = {(x.doc_id, x.item_id): (x.similarity, x.start_word) for x in decontam.leaks(docs(spark, texts), table, broadcast_shingles=limit).collect()}
        assert got == want and sum(s < 0.9 for s, _ in want.values()) >= 5


def test_rows_that_leak_go_whatever_their_ids(spark):
    item = prose(25, 40)
    rows = [(None, item), (None, prose(26, 60)), (7, prose(27, 60)), (7, f"{prose(28, 30)} {item}"), (8, prose(29, 60)), (None, None)]
    left = decontam.without_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted((rows[k] for k in (1, 2, 4, 5)), key=key)


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, m):
    d = [int(c) for c in re.sub(r"[^0-9]", "", m)]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base(t):
    found = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(KINDS) for m in re.finditer(p, t) if valid(kind, m[0]))
    return ",".join(f"{KINDS[k][0]}:{s}:{e}" for s, k, e in found)


def test_personal_data(spark):
    texts = [*AWKWARD, "é a.b@c-d.org,x@y.z 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4242 4242-4242 4242 +1 (555) 123-4567 +49 1 4111111111111111", "7" * 30000, "@@a@b@c.de.", "9" * 16 + " 4222222222222 +123456789012345678"]
    got = pii.scan(docs(spark, texts)).collect()
    assert {r.id: r.base for r in got} == {i: base(t or "") for i, t in enumerate(texts)}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert clean[0] is None and clean[6] == texts[6] and clean[len(AWKWARD)].startswith("é [EMAIL],[EMAIL] [IP].[IP]")


def test_disclosing_terms(spark):
    texts = [f"{prose(50 + k, 12)} {w} zorkman {v} reach at jo@ex.org {prose(90 + k, 12)}" for k, (w, v) in enumerate([("alpha", "beta"), ("gamma", "delta"), ("kappa", "sigma"), ("omega", "theta")])]
    texts += [prose(200 + k, 40) + " reach" for k in range(60)] + [texts[0]] * 5
    rows = pii.scan(docs(spark, texts)).collect()
    for r in rows:
        terms = {texts[r.id][s.start : s.end] for s in r.all_spans if s.kind == "term"}
        assert terms == ({"zorkman"} if "jo@ex.org" in texts[r.id] else set())


def test_disclosing_terms_far_from_the_entity(spark):
    texts = [f"{prose(700 + k, 1)} zorkman {prose(710 + k, 60)} reach at jo@ex.org" for k in range(4)]
    texts += [f"copied zorbert passage {prose(720 + k, 60)} at bo@ex.org" for k in range(4)]  # one context alone
    texts += [prose(800 + k, 40) + " reach at" for k in range(60)]
    for r in pii.scan(docs(spark, texts)).collect():
        terms = {texts[r.id][s.start : s.end] for s in r.all_spans if s.kind == "term"}
        assert ("zorkman" in terms) == ("jo@ex.org" in texts[r.id]) and not terms & {"zorbert", "reach"}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert not any("zorkman" in t for t in clean.values()) and "zorbert" in clean[4]


@pytest.mark.parametrize("text", ["a" * 300_000 + " x@y.zz", " ".join(f"u{k}@ex.org zorkman" for k in range(20_000)), "7" * 200_000 + " 1.2.3.4", "@a" * 50_000 + " x@y.zz"], ids=["run", "emails", "digits", "signs"])
def test_personal_data_of_long_texts(spark, text):
    began = time.time()
    table = docs(spark, [text] * 3)
    row = pii.scan(table).first()
    found = [text[s.start : s.end] for s in row.spans]
    assert found == [w for w in text.split(" ") if len(w) < 20 and ("@" in w or "." in w)]
    if len(found) == 1:
        assert pii.sanitise(table).first().text == text.removesuffix(found[0]) + ("[EMAIL]" if "@" in found[0] else "[IP]")
    else:
        assert pii.sanitise(table).first().text.count("[EMAIL]") == len(found) == 20_000
    assert time.time() - began < 60


def test_terms_keep_clear_of_other_spans(spark):
    texts = [f"{prose(50 + k, 3)} zorkman zorkman@ex.org zorkmané {v} zorkman" for k, v in enumerate(["alpha", "beta", "gamma", "delta"])]
    texts += [prose(200 + k, 40) for k in range(60)]
    for r in pii.scan(docs(spark, texts)).where("id < 4").collect():
        terms = [(s.start, s.end) for s in r.all_spans if s.kind == "term" and texts[r.id][s.start : s.end] == "zorkman"]
        mail = texts[r.id].index("zorkman@")
        assert terms == [(m.start(), m.end()) for m in re.finditer(r"zorkman(?!@|é)", texts[r.id])] and (mail, mail + 7) not in terms


def test_bpe_of_any_vocabulary_and_long_words(spark):
    width = 1 << 20
    ranks, made = {5 * width + 6: 0, 70_000 * width + 6: 2, 6 * width + 5: 1}, [70_000, 9, 100_000]
    assert bpe.merge_word([5, 6, 6, 5, 6, 5], ranks, made, width) == [100_000, 70_000, 5]
    r = random.Random(3)
    for _ in range(300):
        ranks, made = {}, []
        for a in range(6):
            for b in range(6):
                ranks[a * 50 + b] = 0
        order = list(ranks)
        r.shuffle(order)
        ranks = {pair: k for k, pair in enumerate(order) if k % 3}
        made = [r.randint(0, 49) for _ in order]
        word = [r.randint(0, 5) for _ in range(r.randint(1, 40))]
        want = list(word)
        while True:
            best = min(((ranks[a * 50 + b], k) for k, (a, b) in enumerate(zip(want, want[1:])) if a * 50 + b in ranks), default=None)
            if best is None:
                break
            want[best[1] : best[1] + 2] = [made[best[0]]]
        assert bpe.merge_word(list(word), ranks, made, 50) == want


def test_bpe(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    r = random.Random(9)
    signs = "abcXYZ 's't  \n\t\x1c\x85​　ΣςσÉİıﬁ½²٣中🙂é<|endoftext|>12!?''ll"
    texts = [*AWKWARD, "a<|endoftext|>b<|startoftext|>", "x" * 5000, "ab" * 2000, *("".join(r.choice(signs) for _ in range(60)) for _ in range(200))]
    for row in bpe.tokens(docs(spark, texts), TOKENIZER).collect():
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert bytes(row.ids) == struct.pack(f"<{len(ids)}I", *ids) and row.n_tokens == len(ids)
        assert row.decoded == library.decode(ids, skip_special_tokens=False)


def test_chats(spark):
    rows = [(1, 0, "user", "</s>[INST] a\\b <|im_end|>\n"), (1, 1, "assistant", "\\<|im_start|>x"), (1, 1, "assistant", "\\<|im_start|>x"), (2, None, None, None), (None, 3, "assistant", "ö\\"), (4, 0, "as\nsis\\ntant", ""), *((5, k, "assistant", prose(k, 3)) for k in range(5000))]
    turns = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, part int")
    formatted = chat.format_chats(turns)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] or 0)), key=lambda r: r[0]):
        group = sorted(group, key=lambda r: (r[1] or -1))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in group)
        loss = "".join(r[3] for r in group if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(group), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    text = "".join(r.formatted for r in formatted.where("conv_id = 1").collect())
    assert text.count("<|im_start|>") == 3 and "</s>" not in text and "[INST]" not in text
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


def test_archives(spark):
    pages = [(1, "https://a.example.com:8080/x?y#z", "<p>ä\r\n\r\nb</p>"), (2, "http://EXAMPLE.com", None), (3, None, ""), (4, "http://example.com/", "<p>ä\r\n\r\nb</p>"), (None, "http://n.org/", "none"), (6, "http://[bad", "q" * 200_000)]
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, sha int")
    folder, index = warc.archive_and_index(spark, table)
    got = {r.page_id: r for r in warc.read_pages(table, index, folder).collect()}
    assert len(got) == len(pages)
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), i or -1)
    for i, _, h in pages:
        data, keeper = (h or "").encode(), best[h or ""]
        revisit = i is not None and keeper != i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None)
    found = warc.lookup(index, folder, ["http://example.com/", "http://n.org/", "http://no.where/"])
    assert sorted(x[0] for x in found["http://example.com/"]) == [2, 4] and found["http://n.org/"][0][2] == b"none" and found["http://no.where/"] == []


@pytest.mark.parametrize("lines", [2, 7, 1000])
def test_index_of_many_captures(spark, monkeypatch, lines):
    monkeypatch.setattr(warc, "BLOCK_LINES", lines)
    rows = [(k, "http://hot.org/" if k % 3 else f"http://h{k % 7}.org/{k % 11}", f"page {k // 2}") for k in range(400)]
    rows += rows[:5] + [(None, "http://hot.org/", "x"), (None, None, None), (None, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, index = warc.archive_and_index(spark, table)
    got = Counter((r.page_id, r.payload_digest) for r in warc.read_pages(table, index, folder).collect())
    assert got == Counter((i, warc.payload_digest((h or "").encode())) for i, _, h in rows)
    found = warc.lookup(index, folder, ["http://hot.org/", "http://h3.org/3", "http://h9.org/"])
    for u, captures in found.items():
        assert sorted(i if i is not None else -1 for i, _, _ in captures) == sorted(-1 if i is None else i for i, x, _ in rows if x == u)
    assert warc.read_pages(table.limit(0), warc.archive_and_index(spark, table.limit(0))[1], folder).count() == 0


def test_language(spark):
    r = random.Random(4)
    word = lambda s: "".join(r.choice(s) for _ in range(5))
    text = lambda lang: " ".join(word("abcde" if lang == "x" else "deéfg") for _ in range(60))
    rows = [(i, text("xy"[i % 2]), "xy"[i % 2]) for i in range(120)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = [(i, text("xy"[i % 2]), None) for i in range(40)] + [(40, None, None), (41, "½ ² ٣ 12 !", None), (42, "A", None), (42, "A", None), (43, "", None), (44, text("x") * 9000, None)]
    got = {p.id: p for p in langid.predict(spark.createDataFrame(test, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[i].lang_pred == "xy"[i % 2] for i in range(40)) and {got[k].lang_pred for k in (40, 41, 43)} == {"und"} and got[42].lang_pred in "xy" and got[44].lang_pred == "x"
    # The vectorised code length equals one computed byte by byte.
    data = test[0][1].encode()
    for k in range(2):
        counts = {}
        for _, t, lang in rows:
            if lang == model.languages[k]:
                b = t.lower().encode()
                for n in range(1, langid.ORDER + 2):
                    for j in range(len(b) - n + 1):
                        counts.setdefault(b[j : j + n - 1], Counter())[b[j + n - 1]] += 1
        bits = 0.0
        import math

        for j, x in enumerate(data):
            for n in range(min(j, langid.ORDER), -2, -1):
                seen = counts.get(data[j - n : j]) if n >= 0 else None
                if n == -1:
                    bits += 8
                elif seen:
                    total, distinct = sum(seen.values()), len(seen)
                    if seen[x]:
                        bits -= math.log2(seen[x] / (total + distinct))
                        break
                    bits -= math.log2(distinct / (total + distinct))
        assert abs(model.lengths(data)[k] - bits) < 1e-2


def test_quality_classifier(spark):
    good = [prose(k, 80) for k in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in prose(500 + k, 80).split()) for k in range(60)]
    stats = quality_model.document_statistics(docs(spark, [*good, *bad, None, ""]))
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210) if i % 3] + [(0, None)], "doc_id long, quality int")
    model = quality_model.train(stats, labels)
    got = {r.id: r.score for r in quality_model.score_statistics(stats, model).collect()}
    assert len(got) == 212 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.3) == (i < 150) for i in range(0, 210, 3))
    full = quality_model.score_documents(docs(spark, [*good, *bad, None]), model, score_col="q")
    assert {r.doc_id: round(r.q, 6) for r in full.collect()} == {i: round(s, 6) for i, s in got.items() if i < 211}
    none = quality_model.train(stats, labels.limit(0))
    assert quality_model.score_statistics(stats, none).first().score == 0.5


@pytest.mark.parametrize("run", [neardup.near_duplicates, license_scan.scan, quality_rules.judge, pii.scan, neardup.keep_one, pii.sanitise])
def test_empty_tables(spark, run):
    assert run(docs(spark, ["x"]).limit(0)).count() == 0
