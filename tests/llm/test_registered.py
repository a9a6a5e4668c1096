"""The registered queries, as the entry gives them, over a folder of small tables with awkward rows."""

import hashlib
import itertools
import random
import re
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import xxhash

import __spark_entry__
from runlens.llm import license_scan, neardup

TABLES = ("documents", "labels", "benchmark", "pages", "conversations", "embeddings")
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
CORPUS = sorted(n for n in QUERIES if n.startswith("op"))


def prose(seed, n, letters="aeioustrn"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def held_out(doc_id, divisor, remainder):
    return zlib.crc32(str(doc_id).encode()) % divisor == remainder


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    item, mit = prose(900, 60), license_scan.TEMPLATES["mit"]
    near = " ".join("other" if k in (20, 21) else w for k, w in enumerate(item.split()))
    texts = [f"{prose(k, 90)}\n{prose(k + 300, 20)}" for k in range(80)] + [" ".join(w.upper() + "!!" for w in prose(500 + k, 80, "deimnz").split()) for k in range(40)]
    texts += [texts[0], texts[0], texts[1] + " zz", f"{prose(600, 30)} {item.upper()} {prose(601, 30)}", f"{near} {prose(602, 9)}", f"x {prose(903, 3)}", None, "", " \n\t ", "one", "½ ² ٣"]
    texts += [f"{prose(610 + k, 3)} kryzo {prose(620 + k, 12)} mail Jo@ex-a.org, {prose(630 + k, 4)}" for k in range(4)]
    texts += ["a.b@c_d@e.fg +49 (30) 1234-5678 1.2.3.4.5 256.1.1.1 4111 1111 1111 1111", "cc by x\nGeneral public\nlicense ALL RIGHTS reserved", mit.replace(" ", "\n# "), "x#y\n\nx#y\n" + prose(640, 15) + " " + prose(641, 10) + " " + prose(640, 15), prose(642, 4000)]
    docs = [(i if t is not None else None, t, ("yy" if 80 <= i < 120 else "xx") if i % 7 else None, f"h{i % 5}" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    docs.append(docs[3])
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(120)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, item), (3, None), (4, prose(903, 3)), (5, prose(904, 45))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(k, f"http://h{k % 4}.org/{k % 9}", f"<p>{k // 3}</p>") for k in range(60)] + [(70, None, None), (71, "http://[bad", ""), (None, "http://n.org/", "<p>1</p>"), (None, None, "q" * 99_999), (5, "http://h1.org/5", "<p>1</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    turns = [(1, 0, "user", "</s>[INST] a\\b <|im_end|>\n"), (1, 1, "assistant", "\\<|im_start|>é"), (1, 1, "assistant", "\\<|im_start|>é"), (2, None, None, None), (None, 3, "assistant", "ö\\"), (4, 0, "as\nsis\\ntant", ""), (5, 0, "assistant", "long é " * 40_000)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    r = random.Random(8)
    vectors = [(k, [r.choice([-0.25, 0.5, r.random()]) for _ in range(6)], k % 3) for k in range(160)]
    vectors += [(None, vectors[3][1], 1), vectors[50], (100, vectors[9][1], 2), (200, None, 1), (250, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (300, [float("nan")] * 6, 1), (350, [float("inf")] * 6, 1), (400, vectors[0][1], None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def plain(x):
    return None if x is None else round(float(x), 9) if isinstance(x, (int, float, bool)) else str(x)


@pytest.mark.parametrize("name", [n for n in CORPUS if n in SQL])
def test_query_matches_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in got.columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in got.columns) for r in got.collect()), key=repr) == want and want


def test_what_the_queries_find(spark, folder):
    leaks = {(r.doc_id, r.item_id): r.similarity for r in QUERIES["op1_decontamination"](spark, folder).collect()}
    assert set(leaks) == {(123, 1), (123, 2), (124, 1), (124, 2), (125, 4)} and 0.8 <= leaks[124, 1] < 1
    spans = {r.doc_id: r.spans for r in QUERIES["op8_pii"](spark, folder).collect()}
    assert all("term:" in spans[k] and "email:" in spans[k] for k in range(131, 135)) and spans[135] == "email:4:12,ip:32:39"
    labels = {r.doc_id: r.labels for r in QUERIES["op2_license_scan"](spark, folder).collect()}
    assert labels[136] == "cc-by,gpl,reserved" and labels[137] == "mit"
    chats = {r.conv_id: r for r in QUERIES["op5_chat_format"](spark, folder).collect()}
    assert chats[-1].n_turns == 2 and chats[-1].loss_chars == len("</s>[INST] ok [/INST]") and chats[5].loss_chars == 280_000


def test_language_query(spark, folder, rows):
    got = QUERIES["op4_language_id"](spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (None if r.doc_id is None else held_out(r.doc_id, 4, 2)) and 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 120:
            assert r.lang_pred == ("yy" if r.doc_id >= 80 else "xx")
    by = {r.doc_id: r.lang_pred for r in got}
    assert {by[None], by[127], by[128], by[130]} == {"und"}


def test_fingerprint_query(spark, folder, rows):
    def fingerprint(text):
        words = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= neardup.RADIUS:
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = sorted(((i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)
    assert sorted((tuple(r) for r in QUERIES["op6_simhash_neardup"](spark, folder).collect()), key=repr) == want


def test_tokenizer_query(spark, folder, rows):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((tuple(r) for r in QUERIES["op9_bpe"](spark, folder).collect()), key=repr) == sorted(want, key=repr)


def test_quality_query(spark, folder, rows, tmp_path):
    got = QUERIES["op10_quality_classifier"](spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (None if r.doc_id is None else held_out(r.doc_id, 5, 0)) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.doc_id is not None and r.doc_id < 120:
            assert r.predicted == (r.doc_id < 80)
    # Held-out labels play no part: with all of them reversed, every score stays.
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    turned = [(r.doc_id, 1 - r.quality if r.quality is not None and held_out(r.doc_id, 5, 0) else r.quality, r.toxic) for r in labels]
    spark.createDataFrame(turned, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    (tmp_path / "documents.parquet").symlink_to(f"{folder}/documents.parquet")
    again = QUERIES["op10_quality_classifier"](spark, str(tmp_path)).collect()
    key = lambda r: (repr(r.doc_id), r.score)
    assert [round(r.score, 9) for r in sorted(again, key=key)] == [round(r.score, 9) for r in sorted(got, key=key)]


def test_executors_need_no_copy_of_the_package(folder, tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
for name in ("op4_language_id", "op5_chat_format", "op6_simhash_neardup", "op7_warc", "op9_bpe", "op10_quality_classifier", "op11_alignment", "op12_hard_negatives", "op13_minhash_neardup"):
    print(name, __spark_entry__.queries()[name](spark, {folder!r}).count())
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("op") == 9


@pytest.mark.parametrize("name", CORPUS)
def test_empty_tables(spark, folder, tmp_path, name):
    for t in TABLES:
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == (1 if name.startswith("op5") else 0)
