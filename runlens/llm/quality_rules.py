"""Host-level quality rules with shrunken failure rates.

Rules are evaluated per document.  Failures are summed by host, per rule and for
any rule.  Every such rate is shrunk towards the corpus with a beta prior of its
own, whose parameters come from the hosts: its mean is the corpus's rate, its
weight follows from how much more the hosts' rates spread than chance alone would
make them (method of moments with the binomial variance taken out).  A host is
rejected whose shrunken rate of failing documents reaches ``HOST_LIMIT``, or whose
rate for a single rule reaches ``RULE_LIMIT``, and the verdict is joined back to
its documents.  Documents without a host are judged by their own rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

SPACE = r"[\x20\x09-\x0D]+"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: A document fails: more symbols per 100 words, more repeated lines per 100 lines, other mean lengths of words than these.
MOST_SYMBOLS, MOST_DUP_LINES, WORD_LENGTHS = 30, 30, (2.0, 20.0)
HOST_LIMIT, RULE_LIMIT = 0.5, 0.3
#: Bounds of a prior's weight in documents: the moments give none where the hosts' rates vary no more than by chance, or too little where few hosts do.
PRIOR_WEIGHT = (10.0, 1000.0)
RULES = ("too_short", "repetitive", "symbols", "dup_lines", "word_length")


def _measures(text: Column) -> Column:
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(words.alias("words"), lines.alias("lines"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"))


def repeated_words(hashes: Column, repeats: Column) -> Column:
    """Words covered by windows that come twice or more; ``repeats``: (hash, position) of all windows, sorted."""
    twice = F.filter(repeats, lambda x, i: (x["h"] == F.get(repeats, i - 1)["h"]) | (x["h"] == F.get(repeats, i + 1)["h"]))
    return F.array_sort(F.transform(twice, lambda x: x["i"]))


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts and rule failures of every row: ``id``, ``host``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, a boolean per rule, ``base_failed``, ``failed``.

    Null text has no words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), _measures(text).alias("m"))
    d = d.select("id", "host", "m.words", "m.lines", "m.n_symbols", "m.word_chars")
    d = d.select(
        "id", "host", "n_symbols", "word_chars", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda x: F.xxhash64(x)).alias("h"),
    )
    window = F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("h"), i + k) for k in range(WINDOW)))))
    d = d.withColumn("h", F.coalesce(window, F.array().cast("array<bigint>")))
    d = d.withColumn("repeats", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("at", repeated_words(F.col("h"), F.col("repeats"))).drop("h", "repeats")
    covered = F.aggregate(F.transform("at", lambda x, i: F.coalesce(F.least(F.lit(WINDOW), F.get(F.col("at"), i + 1) - x), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")
    mean_length = F.col("word_chars") / F.col("n_words")
    d = d.withColumns({
        "too_short": F.col("n_words") < LEAST_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words"),
        "dup_lines": 100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"),
        "word_length": F.when(F.col("n_words") > 0, ~mean_length.between(*WORD_LENGTHS)).otherwise(False),
    })
    any_rule = F.lit(False)
    for r in RULES:
        any_rule = any_rule | F.col(r)
    return d.withColumn("base_failed", F.col("too_short") | F.col("repetitive")).withColumn("failed", any_rule)


def prior(sums: DataFrame, failures: str) -> tuple[float, float]:
    """Mean and weight (both parameters' sum) of the beta prior of a rate, from ``n_docs`` and ``failures`` by host.

    The spread of the hosts' rates, weighted by documents, is expected to be
    ``mean (1 - mean) ((k - 1) + r (n - sum(n_i ** 2) / n - (k - 1)))`` over ``k`` hosts with ``n`` documents,
    where ``r`` is the prior's share of the variance, 1 / (weight + 1).
    """
    n, x = F.col("n_docs").cast("double"), F.col(failures).cast("double")
    k, total, squares, failed, raw = sums.agg(F.count("*"), F.sum(n), F.sum(n * n), F.sum(x), F.sum(x * x / n)).first()
    mean = failed / total if total else 0.0
    if k < 2 or not 0 < mean < 1:
        return mean, PRIOR_WEIGHT[1]
    spread, room = raw - failed * mean, total - squares / total - (k - 1)
    share = (spread / (mean * (1 - mean)) - (k - 1)) / room if room > 0 else 0.0
    weight = 1 / share - 1 if share > 0 else PRIOR_WEIGHT[1]
    return mean, min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])


def host_verdicts(rules: DataFrame, limit: float = HOST_LIMIT, rule_limit: float = RULE_LIMIT) -> DataFrame:
    """``host``, ``n_docs``, failures and a shrunken rate per rule, ``host_rate`` (any rule), ``host_rejected``; null hosts have none."""
    failures = {"any": "failed", **{r: r for r in RULES}}
    counts = (F.sum(F.col(c).cast("long")).alias(f"n_{name}") for name, c in failures.items())
    sums = saved(rules.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), *counts), "hosts")
    out, rejected = sums, F.lit(False)
    for name in failures:
        mean, weight = prior(sums, f"n_{name}")
        rate = (F.col(f"n_{name}") + weight * mean) / (F.col("n_docs") + weight)
        out = out.withColumn("host_rate" if name == "any" else f"rate_{name}", rate)
        rejected = rejected | (rate >= (limit if name == "any" else rule_limit))
    return out.withColumn("host_rejected", rejected)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT, rule_limit: float = RULE_LIMIT) -> DataFrame:
    """The rules of every row with ``host_rate``, ``host_rejected`` and ``kept``.

    A row is kept unless it fails a base rule or its host is rejected; a row without
    a host has no rate and isn't rejected for one.  Rows are returned as often as
    they come; extra columns are ignored.
    """
    rules = saved(document_rules(docs, id_col, text_col, host_col), "rules")
    verdicts = host_verdicts(rules, limit, rule_limit).select(F.col("host").alias("_host"), "host_rate", "host_rejected")
    joined = rules.join(verdicts, F.col("host") == F.col("_host"), "left").drop("_host").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
