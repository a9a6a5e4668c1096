"""Alignment of two tokenizers' tokens by merge-path partitioning.

Both tokenizations of a text cover the same bytes, so aligning them is merging two
sorted lists of token ends.  The texts of a block are laid end to end on one axis of
bytes and merged at once: diagonal binary searches cut the merge into pieces of
equal work, whatever the lengths of the texts, and every piece emits its overlaps
from its own slices alone.  A group ends where both lists have an end; ends that
fall to two pieces are found by the piece's left neighbour, and groups that a cut
divides are stitched by adding up what the pieces before have closed.

How many documents hold a pair of ids linked is a sum over the whole corpus.  A
block of documents sends every different pair once, with its number of documents;
the sums come back to the block by the same key.  So a pair that all documents hold
is as many rows as there are blocks, and no group is larger than a block.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import saved

#: Ends of either side that a piece merges; bytes of text after which a block is full; rows that go to a task's Python at once, and bytes of blocks a row group has: what a task holds does not grow with its input.
PIECE, BLOCK_BYTES, ROWS_AT_ONCE, GROUP_BYTES = 1 << 16, 1 << 20, 64, 1 << 24
#: Bytes of encoded words after which a task forgets those that did not come again; new words that are encoded as one text; characters of a word from which the file's own library encodes it.
REMEMBERED, AT_ONCE, LONG = 1 << 25, 1 << 15, 4096
#: A space after a sign that is none: no token of either tokenizer crosses it (white space by Unicode; re counts four more signs).
_CUT = re.compile("(?<=[\\S\\x1c-\\x1f]) ")
#: How the byte-level file's library cuts a text before it merges (a fixed value of that file's kind).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, n_pairs array<int>, place array<int>, times array<int>, pair array<long>, held array<long>"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Encoders:
    """Ids of both tokenizers for texts, word by word, with the bytes that every id stands for.

    Neither tokenizer merges across a space that follows another sign, so a text's
    words are encoded once each and remembered.  New words of a block are encoded as
    one text and cut apart by their bytes.
    """

    def __init__(self, bytes_file: str, piece_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole_a = Tokenizer.from_str(bytes_file)
        self.whole_a.encode_special_tokens = True
        self.whole_a.no_padding()
        self.whole_a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        byte_of = {s: k for k, s in enumerate(byte_symbols())}
        names = self.whole_a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for s, k in self.whole_a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[k] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        self.a = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks={x: k for k, x in enumerate(self.bytes_a) if x and self.whole_a.id_to_token(k) not in self._added()}, special_tokens={})
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(s[3:5], 16)]) if self.b.is_byte(k) else s.replace("▁", " ").encode() for k, s in enumerate(pieces)]
        self.width_a, self.width_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        #: Ids in decimals behind the sign that goes before them: first and further ones of a group, of both sides.
        self.decimals = [b"%c%d" % (sign, k) for n, signs in ((len(self.width_a), b";,"), (len(self.width_b), b"|,")) for sign in signs for k in range(n)]
        self.space = self.b.piece_to_id("▁")
        if any(re.search("[^▁]▁", s) for s in pieces):
            raise ValueError("a piece crosses the beginning of a word")
        self.forget()

    def _added(self) -> set[str]:
        return {x.content for x in self.whole_a.get_added_tokens_decoder().values()}

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.ids_a: list[bytes] = []
        self.ids_b: list[bytes] = []
        self.odd: set[int] = set()
        self.again: set[str] = set()
        self.size = 0

    def forget_rare(self) -> None:
        """Keep only words that came again in a later block, up to half of what is remembered."""
        code, ids_a, ids_b, odd, again = self.code, self.ids_a, self.ids_b, self.odd, self.again
        self.forget()
        for word in again:
            if self.size > REMEMBERED // 2:
                break
            k = code[word]
            self._keep(word, ids_a[k], ids_b[k], k in odd)

    def _keep(self, word: str, a: bytes, b: bytes, odd: bool = False) -> None:
        if odd:
            self.odd.add(len(self.ids_a))
        self.code[word] = len(self.ids_a)
        self.ids_a.append(a)
        self.ids_b.append(b)
        self.size += len(word) + len(a) + len(b) + 200

    def _one(self, word: str) -> None:
        whole = " " + word
        a = self.whole_a.encode(whole, add_special_tokens=False).ids if len(word) >= LONG else self.a.encode_ordinary(whole)
        b = self.b.encode(word) if word else [self.space]
        odd = any(b"".join(map(table.__getitem__, ids)) != whole.encode() for table, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        self._keep(word, array("I", a).tobytes(), array("I", b).tobytes(), odd)

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't remembered yet."""
        plain = [w for w in words if len(w) < LONG and w and not w[-1].isspace() and "▁" not in w and "\0" not in w]
        ends = np.cumsum([len(w.encode()) + 1 for w in plain])
        if plain:
            together = " ".join(plain)
            a, b = np.array(self.a.encode_ordinary(" " + together), np.uint32), np.array(self.b.encode(together), np.uint32)
            cuts = []
            for ids, width in ((a, self.width_a), (b, self.width_b)):
                at = np.concatenate([[0], np.cumsum(width[ids])])
                cut = np.searchsorted(at, ends)
                cuts.append(np.concatenate([[0], cut]) if at[-1] == ends[-1] and (at[cut] == ends).all() else None)
            if cuts[0] is None or cuts[1] is None or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != (" " + together).encode():
                plain = []
            else:
                raw_a, raw_b = a.tobytes(), b.tobytes()
                for w, a0, a1, b0, b1 in zip(plain, (4 * cuts[0]).tolist(), (4 * cuts[0][1:]).tolist(), (4 * cuts[1]).tolist(), (4 * cuts[1][1:]).tolist()):
                    self._keep(w, raw_a[a0:a1], raw_b[b0:b1])
        for w in words if not plain else [w for w in words if w not in self.code]:
            self._one(w)

    def texts(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every text the ids of a space and the text by both tokenizers; none for texts whose bytes either doesn't give back."""
        if self.size > REMEMBERED:
            self.forget_rare()
        cut = [_CUT.split(x) if x else [] for x in texts]
        words = set(chain.from_iterable(cut))
        seen = words & self.code.keys()
        self.again |= seen
        new = list(words - seen)
        for at in range(0, len(new), AT_ONCE):
            self.learn(new[at : at + AT_ONCE])
        code, ids_a, ids_b, out = self.code.__getitem__, self.ids_a.__getitem__, self.ids_b.__getitem__, []
        for text, words in zip(texts, cut):
            codes = list(map(code, words))
            a, b = (np.frombuffer(b"".join(map(ids, codes)), np.uint32) for ids in (ids_a, ids_b))
            if self.odd and not self.odd.isdisjoint(codes):
                whole = (" " + text).encode()
                if any(b"".join(map(table.__getitem__, ids.tolist())) != whole for table, ids in ((self.bytes_a, a), (self.bytes_b, b))):
                    a = b = np.zeros(0, np.uint32)
            out.append((a, b))
        return out


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of ``a`` and ``b`` (of equal values, ``a`` first) stands after every ``piece`` values: how many of either are behind."""
    at = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        # a[mid] is behind the diagonal if it comes no later than the value of b that would take its place
        behind = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(at - mid - 1, 0, max(len(b) - 1, 0))] if len(a) and len(b) else np.zeros(len(at), bool))
        low, high = np.where(behind, mid + 1, low), np.where(open_ & ~behind, mid, high)
    return low, at - low


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping places of two tokenizations, given their ends (ascending, without repeats, the last ones equal).

    Returns places in ``a`` and in ``b`` of every overlap, in order, and the group of every place of ``a`` and of ``b``.
    """
    cuts_a, cuts_b = diagonals(a, b, piece)
    left, right, group_a, group_b, closed = [], [], [], [], 0
    for a0, a1, b0, b1 in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:]):
        own_a, own_b = a[a0:a1], b[b0:b1]
        in_b, in_a = b0 + np.searchsorted(own_b, own_a, "left"), a0 + np.searchsorted(own_a, own_b, "right")
        # An end of b that equals the end of a before it closes a group; that one may be the last of the piece to the left.
        ties = (in_a > 0) & (a[np.maximum(in_a - 1, 0)] == own_b)
        # Overlaps end where either side's token ends; where both do, the value of a stands for both.  Each moves one of both on, or both.
        before, alone = np.concatenate([[0], np.cumsum(ties)]), np.flatnonzero(~ties)
        i, j = np.empty((2, a1 - a0 + len(alone)), np.int64)
        at_a, at_b = np.arange(a1 - a0) + in_b - b0 - before[in_b - b0], in_a[alone] - a0 + alone - before[alone]
        i[at_a], j[at_a] = np.arange(a0, a1), in_b
        i[at_b], j[at_b] = in_a[alone], b0 + alone
        left.append(i)
        right.append(j)
        # A place's group is the number of groups closed before it; the tie of an equal end of a comes after it.
        group_a.append(closed + before[in_b - b0])
        group_b.append(closed + before[:-1])
        closed += int(before[-1])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(left), join(right), join(group_a), join(group_b)


def _starts(groups: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(groups, np.arange(n + 1))


def block_of(encoders: Encoders, ids: list, texts: list[str | None], piece: int = PIECE) -> dict:
    """The columns of a block: figures of its documents, their different pairs, and the block's."""
    found = encoders.texts(texts)
    sizes_a, sizes_b = (np.array([len(x[k]) for x in found], np.int64) for k in (0, 1))
    a, b = (np.concatenate([x[k] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64) for k in (0, 1))
    i, j, group_a, group_b = overlaps(np.cumsum(encoders.width_a[a]), np.cumsum(encoders.width_b[b]), piece)
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    # Every document ends with a group.
    last = np.where(sizes_a > 0, group_a[np.maximum(ends_a - 1, 0)] + 1, 0) if len(a) else np.zeros(len(ids), np.int64)
    n_groups = np.diff(np.maximum.accumulate(np.concatenate([[0], last])))

    texts_of = _group_texts(encoders, a, b, group_a, group_b, sizes_a, sizes_b)
    doc = np.repeat(np.arange(len(ids)), sizes_a)[i] if len(i) else i
    place, pair = pd.factorize(a[i] << 32 | b[j])
    of, held = pd.factorize(doc * max(len(pair), 1) + place)
    where = held % max(len(pair), 1)
    return {
        "doc_id": ids, "n_a": sizes_a, "n_b": sizes_b, "n_groups": n_groups, "groups_sha256": [hashlib.sha256(x).hexdigest() if x else "" for x in texts_of],
        "n_pairs": np.bincount(held // max(len(pair), 1), minlength=len(ids)).astype(np.int32), "place": where.astype(np.int32), "times": np.bincount(of, minlength=len(held)).astype(np.int32), "pair": pair, "held": np.bincount(where, minlength=len(pair)),
    }


def _group_texts(encoders: Encoders, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for every document."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    starts_a, starts_b = _starts(group_a, n), _starts(group_b, n)
    # A token stands behind all of its side before it and those of the other side's groups before its own (b: and of its own).
    signs, first = np.empty(len(a) + len(b), np.int64), len(encoders.width_a)
    for ids, starts, at, opening in ((a, starts_a, np.arange(len(a)) + starts_b[group_a], 0), (b, starts_b, np.arange(len(b)) + starts_a[group_b + 1], 2 * first)):
        inside = np.ones(len(ids), bool)
        inside[starts[:-1]] = False
        signs[at] = opening + ids + inside * (first if opening == 0 else len(encoders.width_b))
    parts = np.split(signs, np.cumsum(sizes_a + sizes_b)[:-1])
    return [b"".join(map(encoders.decimals.__getitem__, x.tolist()))[1:] for x in parts]


def _blocks(files, piece: int, block_bytes: int):
    bytes_file, piece_model = files

    def run(batches):
        encoders, ids, texts, size, k = Encoders(bytes_file.value, piece_model.value), [], [], 0, 0
        schema = pa.schema([("block", pa.int64()), *((n, pa.list_(t)) for n, t in (("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int32()), ("place", pa.int32()), ("times", pa.int32()), ("pair", pa.int64()), ("held", pa.int64())))])

        def row():
            found = block_of(encoders, ids, texts, piece)
            arrays = [pa.array([TaskContext.get().partitionId() << 32 | k], pa.int64())]
            for field in list(schema)[1:]:
                values = pa.array(found[field.name], field.type.value_type)
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text or "") + 16
                    if size >= block_bytes:
                        yield row()
                        ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield row()

    return run


def _figures(key, block: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links; ``counts`` has ``at``, ``n``, ``best`` of the block's pairs."""
    rows = block.to_pydict()
    n_pairs = len(rows["pair"][0])
    n, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
    at = counts.column("at").to_numpy()
    n[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
    place, times, ends = np.array(rows["place"][0], np.int64), np.array(rows["times"][0], np.int64), np.cumsum(rows["n_pairs"][0])
    sums = lambda x: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[ends]]))
    of = {name: rows[name][0] for name in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
    of |= {"n_links": sums(times), "n_best": sums(times * best[place]), "count_sum": sums(times * n[place])}
    return pa.table({name: pa.array(of[name], pa.string() if name == "groups_sha256" else pa.int64()) for name in (c.split()[0] for c in _OUT.split(", "))})


@contextmanager
def _few_at_once(spark: SparkSession) -> Iterator[None]:
    """Tables made within send few rows at once to Python: a batch of long texts is as large as they are."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(ROWS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def align(docs: DataFrame, bytes_file: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: its tokens by both tokenizers, their groups and links, and what the links count corpus-wide.

    ``bytes_file`` is a byte-level BPE file, ``piece_model`` a BPE model with byte fallback
    (both of fixed size; every executor gets them once).  Null and empty texts, and
    those that either tokenizer's bytes do not give back, have zeros and an empty
    digest.  Rows without an id count as documents too, and repeated rows once each;
    extra columns are ignored.
    """
    spark = docs.sparkSession
    with open(bytes_file, encoding="utf-8") as f, open(piece_model, "rb") as g:
        files = spark.sparkContext.broadcast(f.read()), spark.sparkContext.broadcast(g.read())
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with _few_at_once(spark):
        # A row is a block and a reader holds a row group of lists at once, so row groups are small.
        blocks = saved(chosen.mapInArrow(_blocks(files, piece, block_bytes), _BLOCK), "blocks", {"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 4})

    counts = blocks.select(F.inline(F.arrays_zip("pair", "held"))).groupBy("pair").agg(F.sum("held").alias("n"))
    counts = saved(counts.withColumn("a", F.shiftright("pair", 32)), "counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    of_blocks = blocks.select(F.col("block").alias("of"), F.posexplode("pair").alias("at", "pair")).join(counts, "pair").select("of", "at", "n", "best")
    return blocks.groupBy("block").cogroup(of_blocks.groupBy("of")).applyInArrow(_figures, _OUT)
