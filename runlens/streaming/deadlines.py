"""Timers on keyed state: sleeps that come due, waits that time out, runs that go stale, and branches that are complete.

Both operators take a stream of changes in whatever order and over however many
batches.  Their state is a few numbers a key and is dropped once a key is done.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# What keeps the state runs in executors and travels by value, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The session keeps streams' state in the store that timers need."""
    key, store = _PROVIDER
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Groups of keys, fixed for as long as a stream's state lasts; no time at all.
GROUPS, NEVER = 4096, (1 << 63) - 1
_SPAN = np.dtype([("lacking", bool), ("key", np.int64), ("due", np.int64), ("ended", np.int64), ("told", bool)])


class _Deadlines(StatefulProcessor):
    """A group's keys with their time due and end (milliseconds), and whether their outcome was told.

    Every look at the state and every timer is a call to the engine, so a group of keys
    has one value, which is read and written once a batch, and one timer, at its earliest time due.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.spans = handle.getValueState("spans", "spans binary")

    def _held(self) -> np.ndarray:
        found = self.spans.get()
        return np.frombuffer(found[0] if found else b"", _SPAN)

    def _hold(self, spans: np.ndarray, timer: int) -> None:
        """Keep the spans; ``timer`` is the one that is set."""
        first = int(spans["due"].min(initial=NEVER))
        if first != timer:
            if timer != NEVER:
                self.handle.deleteTimer(timer)
            if first != NEVER:
                self.handle.registerTimer(first)
        if len(spans):
            self.spans.update((spans.tobytes(),))
        else:
            self.spans.clear()

    def _rows(self, spans: np.ndarray, outcome: str, at: str) -> pd.DataFrame:
        key = pd.Series(pd.array(spans["key"], "Int64")).mask(spans["lacking"]) if spans["lacking"].any() else spans["key"]
        return pd.DataFrame({"key": key, "due_ms": spans["due"], "outcome": outcome, "at_ms": spans[at]})

    def handleInputRows(self, key, rows, timerValues):
        held = self._held()
        before = pd.DataFrame({"lacking": held["lacking"], "key": held["key"], "due": held["due"], "ended": held["ended"], "untold": ~held["told"], "due_now": NEVER})
        now = [x[["lacking", "key", "ended"]].assign(due=NEVER, untold=True, due_now=x["due"]) for x in rows]
        least = pd.concat([before, *now]).astype({"untold": "int8"}).groupby(["lacking", "key"], as_index=False).min()
        least["due"] = least["due"].where(least["due"] < NEVER, least["due_now"])
        least = least[(least["due"] < NEVER) | (least["ended"] < NEVER)]
        spans = np.empty(len(least), _SPAN)
        for name in ("lacking", "key", "due", "ended"):
            spans[name] = least[name]
        told = least["untold"].to_numpy() == 0
        found = ~told & (spans["due"] < NEVER) & (spans["ended"] <= spans["due"])
        spans["told"] = told | found
        self._hold(spans, int(held["due"].min(initial=NEVER)))
        yield self._rows(spans[found], "ended", "ended")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        spans = self._held()
        up = spans["due"] <= timerValues.getCurrentWatermarkInMs()
        self._hold(spans[~up], NEVER)  # a timer that went off is gone
        yield self._rows(spans[up & ~spans["told"]], "reached", "due")

    def close(self) -> None:
        pass


def deadlines(changes: DataFrame, groups: int = GROUPS) -> DataFrame:
    """``key``, ``due``, ``outcome``, ``at`` of every key, once: ``ended`` when its end came no later than it was due, ``reached`` when time was up before.

    ``changes`` is a stream with a watermark on ``at``: ``key``, ``at``, ``what`` (``begin``,
    ``end``, or anything else, which only moves time on) and ``due`` of begins.  An end may come
    before its begin; of several begins in one batch the earliest due counts, and
    later ones change nothing.  Time is up once the watermark has reached it.  Keys go
    by hash into ``groups``, so that a key costs no call of its own.
    """
    ms = lambda what, c: F.coalesce(F.when(F.col("what") == what, F.unix_millis(F.col(c))), F.lit(NEVER))
    group = F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("group")
    rows = changes.select(group, "at", F.col("key").isNull().alias("lacking"), F.coalesce(F.col("key").cast("long"), F.lit(0)).alias("key"), ms("begin", "due").alias("due"), ms("end", "at").alias("ended"))
    told = rows.groupBy("group").transformWithStateInPandas(_Deadlines(), "key long, due_ms long, outcome string, at_ms long", "append", "eventTime")
    return told.select("key", F.timestamp_millis("due_ms").alias("due"), "outcome", F.timestamp_millis("at_ms").alias("at"))


class _Barrier(StatefulProcessor):
    """A branch's number of children (none before the seal), how many are complete, and whether it was told."""

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", "children long, complete long, told boolean")

    def handleInputRows(self, key, rows, timerValues):
        children, complete, told = self.count.get() or (None, 0, False)
        for batch in rows:
            seals = batch.children[batch.what == "sealed"].dropna()
            children = int(seals.iloc[0]) if children is None and len(seals) else children
            complete += int((batch.what == "completed").sum())
        done = not told and children is not None and complete >= children
        self.count.update((children, complete, told or done))
        yield pd.DataFrame([(key[0], children)] if done else [], columns=["branch_id", "children"])

    def close(self) -> None:
        pass


def barriers(changes: DataFrame) -> DataFrame:
    """``branch_id``, ``children`` of every branch, once, when it is sealed and all its children are complete.

    ``changes`` is a stream with a watermark on ``at``: ``branch_id``, ``child_id``, ``at`` and ``what``:
    ``completed`` for a child, ``sealed`` with the number of ``children`` for the branch.  They may
    come in any order and more than once: repeated deliveries go out by child, over all tasks,
    before a branch's own are counted, so that its state is three values however many children it has.
    """
    once = changes.dropDuplicates(["branch_id", "child_id", "what", "at"])
    return once.groupBy("branch_id").transformWithStateInPandas(_Barrier(), "branch_id long, children long", "append", "none")
