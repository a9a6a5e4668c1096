"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The tokenizer file (its path is a parameter) is of the byte-level kind with word
ends: NFC, lower case, white space dropped, contractions, runs of letters, single
digits and runs of other signs as words, every word's last symbol marked.

Within a word the leaves of a segment tree hold the rank, then the position, of
the pair that starts there.  The root is the leftmost pair of lowest rank; a
merge changes three leaves and, in logarithmic time, the nodes above them, until
no pair can be merged.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = 1 << 62
#: Entries after which a task's memory of encoded words starts anew.
REMEMBERED = 400_000
#: Characters that str.split() takes for white space, but the tokenizer doesn't.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        out[b], spare = (chr(b), spare) if b in printable else (chr(spare), spare + 1)
    return out


def merge_word(symbols: list[int], ranks: dict[int, int], made: list[int], width: int) -> list[int]:
    """Merge the symbols of one word; ``ranks`` has a pair's rank by ``left * width + right``, ``made`` the symbol by rank.

    ``tree[1]`` is the root and ``tree[2 * k]``, ``tree[2 * k + 1]`` are the children of ``tree[k]``.
    """
    n, find = len(symbols), ranks.get
    if n < 3:
        rank = find(symbols[0] * width + symbols[1]) if n == 2 else None
        return symbols if rank is None else [made[rank]]
    bits = n.bit_length()
    mask, leaves = (1 << bits) - 1, 1 << (n - 2).bit_length()
    tree, left = [NONE] * (2 * leaves), symbols[0]
    for i in range(1, n):
        right = symbols[i]
        rank = find(left * width + right)
        if rank is not None:
            tree[leaves + i - 1] = rank << bits | i - 1
        left = right
    for k in range(leaves - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    best = tree[1]
    if best == NONE:
        return symbols
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    while best != NONE:
        i = best & mask
        new = symbols[i] = made[best >> bits]
        j = after[i]
        k = after[i] = after[j]
        h = before[i]
        symbols[j] = -1
        tree[leaves + i] = NONE
        if k >= 0:
            before[k] = i
            tree[leaves + j] = NONE
            rank = find(new * width + symbols[k])
            if rank is not None:
                tree[leaves + i] = rank << bits | i
        x = y = leaves + i >> 1
        z = leaves + (j if k >= 0 else i) >> 1
        if h >= 0:
            x = leaves + h >> 1
            rank = find(symbols[h] * width + new)
            tree[leaves + h] = NONE if rank is None else rank << bits | h
        # The three leaves' nodes, level by level; they soon are one and the same.
        while True:
            a, b = tree[2 * z], tree[2 * z + 1]
            tree[z] = a if a < b else b
            if y != z:
                a, b = tree[2 * y], tree[2 * y + 1]
                tree[y] = a if a < b else b
            if x != y:
                a, b = tree[2 * x], tree[2 * x + 1]
                tree[x] = a if a < b else b
            if z == 1:
                break
            x, y, z = x >> 1, y >> 1, z >> 1
        best = tree[1]
    return [x for x in symbols if x >= 0]


class Tokenizer:
    """Encoder and decoder for one tokenizer file's content."""

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
    SPACE = regex.compile(r"\p{White_Space}+")

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.width = max(ids.values()) + 1
        self.made = [ids[a + b] for a, b in pairs]
        self.ranks = {ids[a] * self.width + ids[b]: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        signs = byte_symbols()
        self.inner, self.last = [ids[s] for s in signs], [ids[s + end] for s in signs]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        names = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.known: dict[str, bytes] = {}

    def remember(self, text: str, ids: bytes) -> bytes:
        if len(text) < 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = ids
        return ids

    def word(self, word: str) -> bytes:
        """Ids of one word, as little-endian 32-bit integers."""
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return self.remember(word, array("I", merge_word(symbols, self.ranks, self.made, self.width)).tobytes())

    def chunk(self, chunk: str) -> bytes:
        """Ids of a text without white space; a chunk of one word is that word."""
        words = self.WORDS.findall(chunk)
        if len(words) == 1:
            return self.word(chunk)
        known, make = self.known.get, self.word
        return self.remember(chunk, b"".join([known(w) or make(w) for w in words]))

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        odd = any(c in text for c in _SEPARATORS)
        known, make = self.known.get, self.chunk
        return b"".join([known(x) or make(x) for x in (self.SPACE.split(text) if odd else text.split())])

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self.plain(x) for x in self.cut.split(text))

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces, special ones kept: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, array("I", ids)))


def tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row and ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers), ``decoded``.

    Null text counts as empty: no ids and an empty decoded text.  Repeated rows
    are returned as often as they come; columns not in ``keep`` are dropped.
    The file's text goes to every executor once (it has a fixed size).
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches):
        tokenizer = Tokenizer(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [tokenizer.encode(x.as_py() or "") for x in part.column(part.num_columns - 1)]
                out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(tokenizer.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *out], [*keep, "n_tokens", "ids", "decoded"])

    chosen = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "n_tokens long, ids binary, decoded string"])
    return chosen.mapInArrow(run, schema)
