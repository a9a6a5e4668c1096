"""Step names, states and time arithmetic as columns.

Fixed values: workflow states 0 idle, 1 running, 2 completed, 3 failed, 4 stalled;
execution-log states 0 pending, 1 completed, 2 failed; ``$`` separates the parts
of a step name.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDLE, RUNNING, COMPLETED, FAILED, STALLED = range(5)
STATES = ("idle", "running", "completed", "failed", "stalled")
LOG_PENDING, LOG_COMPLETED, LOG_FAILED = range(3)
#: Kind by first part of a step name of two parts.
KINDS = {"durably_execute": "execute", "wait": "sleep", "wait_until": "wait", "continue_if": "continue", "durably_repeat": "repeat_coordination", "branch": "branch", "merge": "merge"}
#: Lifecycle marks: an empty first part, then one of these.
LIFECYCLE = {"workflow_completion": "completion", "workflow_failure": "failure", "workflow_retry": "retry"}


def now_at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def seconds_after(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, ts)


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds as a double; independent of time zones for timestamps without one."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def iso(ts: Column) -> Column:
    """ISO 8601 to the second, as metadata has it."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def time_of(text: Column) -> Column:
    """A time given as text, in UTC: an offset at its end counts, a time without one is in UTC; none where it is no time."""
    instant = lambda t: F.timestamp_add("MICROSECOND", F.unix_micros(t.try_cast("timestamp")), now_at("1970-01-01 00:00:00"))
    # In a lambda the text is computed once, and the code around it stays small.
    read = lambda t: F.when(t.rlike(r":[0-9.]+ ?([+-][0-9:]+|[A-Z]+)$"), instant(t)).otherwise(t.try_cast("timestamp_ntz"))
    return F.get(F.transform(F.array(text), read), F.lit(0))


def metadata_time(key: str) -> Column:
    """A time in a step's metadata; none where it is missing or no time."""
    return time_of(F.get_json_object("metadata", f"$.{key}"))


def label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _parts(step: Column) -> Column:
    return F.split(step, r"\$", 3)


def _named(names: dict[str, str], key: Column) -> Column:
    """Value of a fixed map: one lookup, where a chain of conditions would repeat the key's expression."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)


def _kind(parts: Column) -> Column:
    two, three = F.size(parts) == 2, F.size(parts) == 3
    kind = F.when(two, _named(KINDS, parts[0])).when(three & (parts[0] == "durably_repeat"), "repeat_run").when(three & (parts[0] == "") & F.get(parts, 1).isin(*LIFECYCLE), "lifecycle")
    return F.coalesce(kind, F.lit("unknown"))


def step_kind(step: Column) -> Column:
    return _kind(_parts(step))


def parsed(rows: DataFrame, step: str = "step_name") -> DataFrame:
    """``rows`` with ``kind``, ``step`` (name, condition, branches or lifecycle mark) and ``number`` of their step names.

    The number is the third part (unix seconds of a run, or an error log's id).  Names are
    split once; each column is made of the one before, so that no expression contains another.
    """
    parts = F.col("_parts")
    rows = rows.withColumn("_parts", _parts(F.col(step))).withColumn("kind", _kind(parts))
    label = F.when(F.col("kind") == "unknown", F.col(step)).when(F.col("kind") == "lifecycle", _named(LIFECYCLE, F.get(parts, 1))).otherwise(F.get(parts, 1))
    number = F.when(F.col("kind").isin("repeat_run", "lifecycle"), F.get(parts, 2).try_cast("bigint"))
    return rows.withColumns({"step": label, "number": number}).drop("_parts")


#: Beginning of the step names of a kind.
PREFIXES = {kind: f"{first}$" for first, kind in KINDS.items()} | {"repeat_run": "durably_repeat$", "lifecycle": "$"}


def of_kinds(rows: DataFrame, *kinds: str, step: str = "step_name") -> DataFrame:
    """The rows of some kinds, parsed.  The names' beginnings are tested first, which reaches a Parquet scan."""
    begins = reduce(or_, (F.col(step).startswith(x) for x in sorted({PREFIXES[k] for k in kinds})))
    return parsed(rows.where(begins), step).where(F.col("kind").isin(*kinds))


def state_name(state: Column) -> Column:
    return F.get(F.array(*(F.lit(s) for s in STATES)), state)


def human_duration(seconds: Column) -> Column:
    """Two units, such as ``1m 04s``, ``3h 12m`` or ``2d 21h``."""
    s = F.floor(seconds).cast("bigint")
    two = lambda big, unit, a, b: F.concat(F.floor(s / big).cast("bigint").cast("string"), F.lit(a + " "), F.lpad((F.floor(s / unit).cast("bigint") % int(big / unit)).cast("string"), 2, "0"), F.lit(b))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, two(60, 1, "m", "s")).when(s < 86400, two(3600, 60, "h", "m")).otherwise(two(86400, 3600, "d", "h"))


#: States as lists show them: active work first, finished last.
STATE_ORDER = ("running", "idle", "stalled", "failed", "completed")


def state_place(name: Column) -> Column:
    """Place of a state's name in lists; unknown names come last, whatever they are."""
    return F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(s) for s in STATE_ORDER)), name), F.lit(0)), F.lit(len(STATE_ORDER) + 1)).cast("int")


#: Labels of kinds (fixed values).
KIND_LABELS = {"execute": "execute", "sleep": "wait", "wait": "wait until", "continue": "continue if", "repeat_coordination": "repeat", "repeat_run": "run", "lifecycle": "workflow", "branch": "branch", "merge": "merge", "unknown": "step"}
#: Kinds whose attempts are looks at a condition.
POLLING = ("wait", "continue", "sleep")
#: Keys of metadata that lists leave out (fixed values).
INTERNAL_KEYS = ("error_log_id", "poll", "poll_token", "cursors")


def kind_label(kind: Column) -> Column:
    return F.coalesce(_named(KIND_LABELS, kind), kind)


def attempts_note(kind: Column, attempts: Column) -> Column:
    """What a count of attempts over one says of a step; nothing for the coordination of runs, which counts these."""
    n = attempts.cast("string")
    return F.when((attempts <= 1) | (kind == "repeat_coordination"), None).when(kind.isin(*POLLING), F.concat(F.lit("checked "), n, F.lit("×"))).otherwise(F.concat(n, F.lit(" attempts")))


def percent(rate: Column) -> Column:
    """A rate as text: a dash without one, whole percents from 1 on, at most two decimals below, and never 0% for more than nothing."""
    p = rate * 100
    tenths = F.regexp_replace(F.call_function("format_number", F.round(p, 2), F.lit("0.00")), "0$", "")
    return F.when(rate.isNull(), "—").when(p == 0, "0%").when(p < 0.01, "<0.01%").when(p < 1, F.concat(tenths, F.lit("%"))).otherwise(F.concat(F.round(p).cast("bigint").cast("string"), F.lit("%")))


def trend_arrow(points: Column) -> Column:
    return F.when(points == 0, "—").when(points > 0, "▲").otherwise("▼")


def trend_points(points: Column) -> Column:
    """Points with their sign, or ``flat``."""
    return F.when(points == 0, "flat").otherwise(F.concat(F.when(points > 0, "+").otherwise("−"), F.call_function("format_number", F.abs(points), F.lit("0.0"))))


def bar_steps(value: Column, most: Column) -> Column:
    """Percent of the largest value, in steps of five."""
    return F.when(most == 0, 0).otherwise(F.round(value / most * 20).cast("int") * 5)


def duration_steps(seconds: Column, most: Column) -> Column:
    """The same on a square-root scale, at most 100; nothing to show without a positive duration."""
    return F.when(F.coalesce((seconds <= 0) | (most <= 0), F.lit(True)), 0).otherwise(F.least(F.round(F.sqrt(seconds / most) * 20).cast("int") * 5, F.lit(100)))


def framework_step(step: Column) -> Column:
    """Whether a log is the engine's own: a mark, or a step with two separators."""
    return step.startswith("$") | (F.length(step) - F.length(F.replace(step, F.lit("$"), F.lit(""))) >= 2)
