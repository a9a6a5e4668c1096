"""Stateful streams over several batches and restarts, and sinks that are replayed."""

import datetime
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from runlens.functions.steps import label, now_at
from runlens.operators import fleet
from runlens.operators import steps as st
from runlens.sources.keyset import by_key
from runlens.streaming import deadlines as deadline_module
from runlens.streaming import ledger, stateful
from runlens.streaming.deadlines import barriers, deadlines, keyed_state
from test_history import LOGS, WF, table


def fed(spark, folder, parts, schema, job, delay="1 hour"):
    """Rows that ``job`` has written once the parts came one after the other, the stream starting anew for each."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("at", delay)
        with keyed_state(spark):
            job(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def in_parts(rows, n):
    size = -(-len(rows) // n)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


@pytest.fixture(scope="module")
def history(spark):
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    logs, wf, rng = [], [], random.Random(4)
    for k in range(1, 25):
        begin, length = rng.randrange(0, 600), rng.choice([0, 10, 30, 45, 300])
        logs.append({"id": k, "workflow_id": k, "step_name": f"wait$w{k}", "state": 0, "started_at": at(begin), "metadata": f'{{"wait_until":"{at(begin + length).replace(" ", "T")}Z"}}'})
        wf.append({"id": k, "key": f"k{k}", "state": 1, "locked_at": at(begin), "locked_by": "w"})
    return table(spark, WF, wf), table(spark, LOGS, logs)


@pytest.mark.parametrize("n", [1, 3])
def test_sleeps_equal_the_batch(spark, tmp_path, history, n):
    now = "2024-01-01 06:00:00"
    rows = sorted(map(tuple, stateful.sleep_changes(history[1], now).collect()), key=lambda r: r[1])
    found = fed(spark, str(tmp_path), in_parts(rows, n), stateful._CHANGES, deadlines)
    want = {r.id for r in st.sleeps(history[1].where(F.col("started_at") <= now_at(now)), now_at(now)).where("done").collect()}
    got = [r.key for r in found.where("outcome = 'reached'").collect()]
    assert len(want) > 3 and sorted(got) == sorted(want)


@pytest.mark.parametrize("n", [1, 2])
def test_wait_timeouts_equal_the_batch(spark, tmp_path, history, n):
    now = "2024-01-01 06:00:00"
    logs = history[1].withColumns({"step_name": F.replace("step_name", F.lit("wait$"), F.lit("wait_until$")), "metadata": F.replace("metadata", F.lit("wait_until"), F.lit("timeout_at"))})
    rows = sorted(map(tuple, stateful.wait_changes(logs, now).collect()), key=lambda r: r[1])
    found = fed(spark, str(tmp_path), in_parts(rows, n), stateful._CHANGES, deadlines)
    want = {r.id for r in st.evaluated_waits(logs.where(F.col("started_at") <= now_at(now)), now_at(now), F.lit(False)).where("stalls").collect()}
    assert len(want) > 3 and sorted(r.key for r in found.where("outcome = 'reached'").collect()) == sorted(want)


@pytest.mark.parametrize("n", [1, 3])
def test_stale_runs_equal_the_batch(spark, tmp_path, history, n):
    now = "2024-01-01 06:00:00"
    rows = sorted(map(tuple, stateful.run_changes(history[0], now).collect()), key=lambda r: r[1])
    found = fed(spark, str(tmp_path), in_parts(rows, n), stateful._CHANGES, deadlines)
    want = {r.id for r in fleet.stranded(history[0], now_at(now)).collect()}
    assert len(want) > 3 and sorted(r.key for r in found.collect()) == sorted(want)


def test_ends_before_begins(spark, tmp_path):
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    rows = [(1, at(5), "end", None), (2, at(0), "begin", at(10)), (3, at(0), "begin", at(10)), (4, at(0), "begin", at(10)), (1, at(0), "begin", at(10)), (3, at(10), "end", None), (4, at(11), "end", None), (4, at(0), "begin", at(10)), (-1, at(90), "tick", None)]
    text = spark.createDataFrame(rows, "key long, at string, what string, due string").select("key", F.col("at").cast("timestamp").alias("at"), "what", F.col("due").cast("timestamp").alias("due"))
    parts = [[tuple(r)] for r in text.collect()]
    found = fed(spark, str(tmp_path), [parts[0] + parts[1] + parts[2], parts[3] + parts[4], parts[5] + parts[6] + parts[7], parts[8]], stateful._CHANGES, deadlines, "2 hours")
    assert found.count() == 2 and {r.key: r.outcome for r in found.collect()} == {1: "ended", 3: "ended"}  # the watermark has not come to the others' time
    more = text.where("key = -1").withColumn("at", F.expr("at + INTERVAL 1 HOUR"))
    found = fed(spark, str(tmp_path), [[tuple(r) for r in more.collect()]], stateful._CHANGES, deadlines, "2 hours")
    assert {r.key: (r.outcome, str(r.at)[11:16]) for r in found.collect()} == {1: ("ended", "00:05"), 3: ("ended", "00:10"), 2: ("reached", "00:10"), 4: ("reached", "00:10")}


def test_keys_that_share_a_group(spark, tmp_path):
    rng, minute, rows = random.Random(6), spark_time, []
    for _ in range(400):
        key, what, at = rng.choice([None, *range(-20, 100), -(1 << 63), (1 << 63) - 1, (1 << 53) + 1]), rng.choice(["begin", "begin", "end", "other"]), rng.randrange(200)
        rows.append((key, minute(at), what, minute(at + rng.randrange(-5, 60)) if what != "other" and rng.random() < 0.9 else None))
    parts, told, due, ended = in_parts(rows, 3), {}, {}, {}
    for part in parts:
        now = {}
        for key, at, what, until in part:
            if what == "begin" and until is not None:
                now[key] = min(now.get(key, until), until)
            if what == "end":
                ended[key] = min(ended.get(key, at), at)
        due = now | due
        told |= {k: ("ended", d, ended[k]) for k, d in due.items() if k not in told and k in ended and ended[k] <= d}
    want = {k: ("reached", d, d) for k, d in due.items()} | told
    got = fed(spark, str(tmp_path), [*parts, [(-1 << 40, minute(90_000), "tick", None)]], stateful._CHANGES, lambda s: deadlines(s, 2), "1000 hours").collect()
    assert len(got) == len(want) and len({o for o, *_ in want.values()}) == 2
    assert {r.key: (r.outcome, r.due, r["at"]) for r in got} == want


def spark_time(minutes):
    """Minutes of a year as a time, as sessions in UTC collect it."""
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def test_a_group_is_one_look_at_the_state():
    class Engine:
        def __init__(self):
            self.calls, self.value, self.timers = Counter(), None, set()

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls["get"] += 1
            return self.value

        def update(self, value):
            self.calls["update"] += 1
            self.value = value

        def clear(self):
            self.calls["clear"] += 1
            self.value = None

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

        def getCurrentWatermarkInMs(self):
            return self.watermark

    engine, keys = Engine(), deadline_module._Deadlines()
    keys.init(engine)
    rows = pd.DataFrame({"lacking": False, "key": range(1000), "due": range(1, 1001), "ended": [5 if k % 2 else deadline_module.NEVER for k in range(1000)]})
    told = pd.concat(keys.handleInputRows((0,), iter([rows[:600], rows[600:]]), engine))
    assert told.key.tolist() == list(range(5, 1000, 2)) and set(told.outcome) == {"ended"}
    assert engine.calls == {"get": 1, "update": 1} and engine.timers == {1}
    for engine.watermark, left in ((500, {501}), (1000, set())):
        engine.timers.clear()  # the engine removes the one that goes off
        told = pd.concat([told, *keys.handleExpiredTimer((0,), engine, None)])
        assert engine.timers == left
    assert sorted(told.key) == list(range(1000)) and engine.value is None and engine.calls == {"get": 3, "update": 2, "clear": 1}


CHANGES = "branch_id long, child_id long, at timestamp, what string, children long"


@pytest.mark.parametrize("seed", [1, 2])
def test_barriers_in_any_order(spark, tmp_path, seed):
    rng, rows, want = random.Random(seed), [], {}
    base = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS t").first().t
    for b in range(12):
        n = rng.choice([0, 1, 3, 6])
        done = n if b % 3 else rng.randint(0, n)
        sealed = b % 4 != 3
        rows += [(b, 100 * b + c, base, "completed", None) for c in range(done)] + ([(b, None, base, "sealed", n)] if sealed else [])
        if sealed and done == n:
            want[b] = n
    rows += rng.sample(rows, len(rows) // 2)
    rng.shuffle(rows)
    found = fed(spark, str(tmp_path), in_parts(rows, 3), CHANGES, barriers).collect()
    assert len(found) == len(want) and {r.branch_id: r.children for r in found} == want


EVENTS = "key long, at timestamp"


def events(spark, *rows):
    return spark.createDataFrame(rows, "key long, at string").select("key", F.col("at").cast("timestamp").alias("at"))


def test_a_batch_that_comes_twice_adds_nothing(spark, tmp_path):
    to = str(tmp_path)
    write = ledger.insert_once(to, ["key"], ["at"])
    first = events(spark, (1, "2024-01-02"), (1, "2024-01-01"), (None, "2024-01-05"))
    write(first, 0)
    write(first, 0)
    write(events(spark, (1, "2023-01-01"), (2, "2024-01-03"), (None, "2020-01-01")), 1)
    write(first, 2)
    got = sorted((str(r.key), str(r["at"])[:10], r.batch) for r in ledger.rows(spark, to, "rows", EVENTS).collect())
    assert got == [("1", "2024-01-01", 0), ("2", "2024-01-03", 1), ("None", "2024-01-05", 0)]
    assert [(r.batch, r.delivered, r.kept) for r in ledger.entries(spark, to).orderBy("batch").collect()] == [(0, 3, 2), (1, 3, 1), (2, 3, 0)]


def test_a_run_that_stops_before_the_ledger(spark, tmp_path):
    to = str(tmp_path)
    for k in range(3):
        events(spark, (k, "2024-01-01"), (9, f"2024-01-0{k + 1}")).coalesce(1).write.mode("append").parquet(f"{to}/in")
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{to}/in")

    def stop(number):
        if number == 1:
            raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        ledger.run(stream(), to, ledger.insert_once(to, ["key"], ["at"], stop))
    assert ledger.rows(spark, to, "rows", EVENTS).count() == 2
    for _ in range(2):
        ledger.run(stream(), to, ledger.insert_once(to, ["key"], ["at"]))
        assert sorted(r.key for r in ledger.rows(spark, to, "rows", EVENTS).collect()) == [0, 1, 2, 9]


def test_late_rows_are_kept_apart(spark, tmp_path):
    to = str(tmp_path)
    write = ledger.split_late(to, "at", "1 day")
    batches = [events(spark, (1, "2024-01-05"), (2, "2024-01-01")), events(spark, (3, "2024-01-04"), (4, "2024-01-03"), (5, "2024-01-09"), (6, None)), events(spark, (7, "2024-01-07"), (8, "2024-01-08")), events(spark)]
    for k, b in enumerate(batches):
        write(b, k)
        write(b, k)
    keys = lambda name: sorted(r.key for r in ledger.rows(spark, to, name, EVENTS).collect())
    assert keys("late") == [4, 7] and keys("rows") == [1, 2, 3, 5, 6, 8]
    assert [(r.delivered, r.kept) for r in ledger.entries(spark, to).orderBy("batch").collect()] == [(2, 2), (4, 3), (2, 1), (0, 0)]


def test_labels_do_not_depend_on_the_zone(spark):
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            d = spark.range(1).select(stateful._zoned(now_at("2024-07-01 12:30:00")).alias("at"))
            assert d.select(F.unix_seconds("at").alias("s"), label(stateful._unzoned(F.col("at"))).alias("t")).first() == (1719837000, "2024-07-01 12:30:00")
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_source_by_keys_resumes(spark, tmp_path):
    source, schema = f"{tmp_path}/in", "id long, name string"

    def add(*keys):
        spark.createDataFrame([(k, f"n{k}", 1) for k in keys], "id long, name string, other int").repartition(2).write.option("parquet.block.size", 1024).mode("append").parquet(source)

    def run():
        by_key(spark, source, "id", schema).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    run_empty = by_key(spark, source, "id", schema)
    assert run_empty.columns == ["id", "name"]
    add(*range(0, 50, 2), None)
    assert run() == [*range(0, 50, 2)]
    assert run() == [*range(0, 50, 2)]
    add(*range(49, 80), 7)  # 7 lies behind the last key
    assert run() == [*range(0, 50, 2), *range(49, 80)]
    add(100)
    assert run() == [*range(0, 50, 2), *range(49, 80), 100]
    assert spark.read.parquet(f"{tmp_path}/out").where("name <> 'n' || id").isEmpty()
