"""Every query against its SQL in DuckDB, and golden values."""

import math

import duckdb
import pytest

from runlens.functions.steps import human_duration, now_at, parsed
from runlens.operators import analytics, branches, fleet
from runlens.plans import oracle, queries
from runlens.sources.history import NOW

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), oracle.oracle_sql()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 9) if isinstance(x, (int, float, bool)) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_step_grammar(spark):
    cases = [("durably_execute$a", "execute", "a", None), ("wait$a", "sleep", "a", None), ("wait_until$c", "wait", "c", None), ("durably_repeat$n", "repeat_coordination", "n", None), ("durably_repeat$n$12", "repeat_run", "n", 12), ("durably_repeat$n$x", "repeat_run", "n", None), ("merge$a,b", "merge", "a,b", None), ("$workflow_failure$7", "lifecycle", "failure", 7), ("$workflow_completion$", "lifecycle", "completion", None), ("odd", "unknown", "odd", None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "s string")
    rows = parsed(df, "s").select("s", "kind", "step", "number").collect()
    assert [tuple(r) for r in rows] == cases


def test_human_duration(spark):
    df = spark.createDataFrame([(5,), (64,), (11520,), (248400,)], "s long")
    assert [r[0] for r in df.select(human_duration(df.s)).collect()] == ["5s", "1m 04s", "3h 12m", "2d 21h"]


def workflows(spark, rows):
    schema = "id long, job_class string, state int, started_at timestamp_ntz, completed_at timestamp_ntz, updated_at timestamp_ntz"
    df = spark.createDataFrame([], schema)
    if rows:
        df = spark.sql("VALUES " + ", ".join(f"({i}L, '{c}', {s}, TIMESTAMP_NTZ '2024-01-30 00:00:00', {'TIMESTAMP_NTZ ' + repr('2024-01-30 00:01:40') if s == 2 else 'CAST(NULL AS TIMESTAMP_NTZ)'}, TIMESTAMP_NTZ '2024-01-30 00:02:00')" for i, c, s in rows)).toDF(*df.columns)
    return df


def test_totals(spark):
    row = analytics.window_totals(workflows(spark, [(1, "A", 2), (2, "A", 2), (3, "B", 2), (4, "B", 3)]), now_at(NOW)).first()
    assert (row.completed, row.failed, row.terminal, row.completion_rate, row.failure_rate, row.avg_seconds) == (3, 1, 4, 0.75, 0.25, 100)


def test_empty_window(spark):
    row = analytics.window_totals(workflows(spark, []), now_at(NOW), "bogus").first()
    assert row.terminal == 0 and row.completion_rate is None and row.failure_rate is None


def test_state_stats_cap(spark):
    got = {r.state: (r.capped, r.shown) for r in fleet.state_stats(workflows(spark, [(1, "A", 3), (2, "A", 3)]), cap=1).collect()}
    assert got["failed"] == (1, "1+") and got["running"] == (0, "0")


def test_pages_cover_everything(spark):
    rows = spark.range(7)
    seen, before = [], None
    while True:
        page = fleet.page(rows, per=3, before=before).orderBy("id", ascending=False).collect()
        seen += [r.id for r in page]
        if not page[0].has_next:
            break
        before = page[-1].id
    assert seen == [6, 5, 4, 3, 2, 1, 0]
    assert sorted(r.id for r in fleet.page(rows, per=2, after=3).collect()) == [4, 5]


def test_retention_splits_all(spark):
    from runlens.sources.history import derive

    wf = derive(spark, FOLDER).workflows
    gone, kept = branches.expired(wf, now_at(NOW), 20, 30).count(), branches.survivors(wf, now_at(NOW), 20, 30).count()
    assert gone + kept == wf.count() and gone > 0
