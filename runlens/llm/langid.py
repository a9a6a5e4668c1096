"""Language identification by prediction by partial matching.

Per language, byte contexts of up to ``ORDER`` bytes count the bytes that follow
them.  A byte costs, in its longest context known to the language, its share of
``count / (total + distinct)``; a byte not seen there costs an escape,
``distinct / (total + distinct)``, and is then coded in the next shorter context,
down to all 256 bytes alike.  Contexts that a language never saw cost nothing and
are skipped.  Counts are frozen after training, and excluded bytes aren't.  The
language with the shortest code for the whole text is predicted.

All languages share one trie.  Its nodes carry, for every language, the code
length of their last byte after the bytes before it, so that a text is coded by
walking the trie for all its positions at once in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 3
#: Training rows per language, at most (in expectation): rows are drawn by a hash of the id.
SAMPLE = 1000
UNDETERMINED = "und"


@dataclass
class Model:
    """``child[d]``: for every node of depth d and byte its node at depth d + 1, or -1.  ``cost[d]``: bits by node and language.  ``escape[d]``: bits by node, as a context, and language."""

    languages: list[str]
    child: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code length of every byte of one text, by language."""
        n, order = len(data), len(self.child) - 1
        out = np.zeros((n, len(self.languages)), np.float32)
        todo = np.arange(n)
        for d in range(order, -1, -1):  # d bytes of context
            if d == 0:
                out[todo] += self.cost[0][data[todo]]
                break
            usable = todo >= d
            at, rest = todo[usable], todo[~usable]
            node = np.zeros(len(at), np.int32)
            for k in range(d, 0, -1):
                depth = d - k
                node = np.where(node >= 0, self.child[depth][node, data[at - k]], -1)
            known = node >= 0
            end = np.where(known, self.child[d][node, data[at]], -1)
            hit = end >= 0
            out[at[hit]] += self.cost[d][end[hit]]
            missed = known & ~hit
            out[at[missed]] += self.escape[d][node[missed]]
            todo = np.concatenate([rest, at[~hit]])
        return out

    def lengths(self, text: bytes) -> np.ndarray:
        """Bits of the whole text by language."""
        data, total = np.frombuffer(text, np.uint8), np.zeros(len(self.languages))
        step = 1 << 18
        for s in range(0, len(data), step):
            lead = min(s, len(self.child) - 1)
            total += self.bits(data[s - lead : s + step])[lead:].sum(axis=0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and the probability of it under equal priors; ties go to the first by name."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        bits = self.lengths(text.lower().encode("utf-8", "replace"))
        best = int(bits.argmin())
        return self.languages[best], float(1 / np.exp2(np.minimum(0, bits[best] - bits)).sum())


def build(counts: list[tuple[str, bytes, int]]) -> Model:
    """The model of (language, context and byte, times)."""
    languages = sorted({x for x, _, _ in counts})
    number, width = {x: k for k, x in enumerate(languages)}, len(languages)
    child: list[np.ndarray] = []
    cost: list[np.ndarray] = []
    escape: list[np.ndarray] = []
    ids: dict[bytes, int] = {b"": 0}
    below: np.ndarray = np.full((256, width), 8.0)  # cost by 'node at the depth above'
    shorter: dict[bytes, int] = {bytes([b]): b for b in range(256)}
    by_length: list[list[tuple[str, bytes, int]]] = [[] for _ in range(max((len(g) for _, g, _ in counts), default=1))]
    for x in counts:
        by_length[len(x[1]) - 1].append(x)
    for rows in by_length:
        grams = sorted({g for _, g, _ in rows})
        if not child:
            grams = [bytes([b]) for b in range(256)]
        place = {g: k for k, g in enumerate(grams)}
        times = np.zeros((len(grams), width))
        for lang, g, n in rows:
            times[place[g], number[lang]] += n
        context = np.array([ids[g[:-1]] for g in grams])
        total, distinct = np.zeros((len(ids), width)), np.zeros((len(ids), width))
        np.add.at(total, context, times)
        np.add.at(distinct, context, times > 0)
        leave = np.where(total > 0, -np.log2(np.maximum(distinct, 1) / np.maximum(total + distinct, 1)), 0.0)
        lower = below[[shorter[g[1:]] if child else g[0] for g in grams]]
        here = np.where(times > 0, -np.log2(np.maximum(times, 1) / np.maximum(total + distinct, 1)[context]), leave[context] + lower)
        links = np.full((len(ids), 256), -1, np.int32)
        links[context, [g[-1] for g in grams]] = np.arange(len(grams))
        child.append(links)
        cost.append(here.astype(np.float32))
        escape.append(leave.astype(np.float32))
        ids, below, shorter = place, here, place
    return Model(languages, child, cost, escape)


def _count_batches(batches):
    found: dict[tuple[str, int], dict[int, int]] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8).astype(np.int64)
            key = np.zeros(len(data), np.int64)
            for length in range(1, ORDER + 2):
                if len(data) < length:
                    break
                key = (key[: len(data) - length + 1] << 8) | data[length - 1 :]
                table = found.setdefault((lang, length), {})
                for k, n in zip(*(x.tolist() for x in np.unique(key, return_counts=True))):
                    table[k] = table.get(k, 0) + n
    rows = [(lang, length, k, n) for (lang, length), table in found.items() for k, n in table.items()]
    for at in range(0, len(rows), 50_000):
        a, b, c, d = zip(*rows[at : at + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], ["lang", "length", "gram", "n"])


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit to ``rows``; those without language or text are left out.

    At most ``sample`` rows of a language are expected to count: where it has
    more, a row counts if the hash of its id falls below the share that is wanted.
    Whole texts count.  What reaches the driver is a row per language and the summed
    counts of the sample's runs of up to four bytes, in the worst case as many as the sample has bytes.
    """
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).where("lang is not null and text is not null")
    shares = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    chosen = F.lit(False)
    place = F.shiftrightunsigned(F.xxhash64("id", F.lit("train")), 11) / float(1 << 53)
    for r in shares:
        chosen = chosen | ((F.col("lang") == r.lang) & (place < min(1.0, sample / r["count"])))
    counted = rows.where(chosen).select("lang", "text").mapInArrow(_count_batches, "lang string, length int, gram long, n long")
    summed = counted.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    return build([(a, c.to_bytes(b, "big"), n) for a, b, c, n in sorted(zip(summed["lang"], summed["length"], summed["gram"], summed["n"]))])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score`` for every row; ``und`` and 0 if the text is null or has no letter.

    Repeated rows are returned as often as they come, extra columns are ignored, and
    texts of any length are coded in parts.  Without languages every row is ``und``.
    """
    # Plain arrays: executors need not be able to import this package.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.child, model.cost, model.escape))

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([min(1.0, max(0.0, s)) for _, s in found], pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, lang_pred string, score double")
