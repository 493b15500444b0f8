"""Plans that queries must have, and streams that must not depend on their batches."""

import os
import time

import pytest
from pyspark.sql import functions as F

from chronolith import registry
from chronolith.operators import differ, listing, pending, spans
from chronolith.operators.listing import ExecutionFilter
from chronolith.sources import bridge, files
from chronolith.streaming import jobs
from tests.test_golden import executions, history


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture
def stored(spark, tmp_path):
    x = executions(spark, [{"workflow_id": f"w{k}", "created_at": k} for k in range(50)])
    x.write.parquet(f"{tmp_path}/x")
    return spark.read.parquet(f"{tmp_path}/x")


def test_filters_and_columns_reach_the_scan(stored):
    rows = listing.page(stored, ExecutionFilter(status="running", created_after=10, workflow_id_prefix="w1"))
    text = plan(rows.select("workflow_id", "created_at"))
    for part in ("EqualTo(status,running)", "GreaterThanOrEqual(created_at,10)", "StringStartsWith(workflow_id,w1)"):
        assert part in text
    assert "ReadSchema: struct<workflow_id:string,status:string,created_at:bigint>" in text
    assert "TakeOrderedAndProject" in text


def test_a_cursor_prunes_the_scan(stored):
    text = plan(listing.page(stored, cursor="000000000000020|w5"))
    assert "LessThan(created_at,20)" in text


def test_pending_work_shuffles_once(spark, tmp_path):
    h = history(spark, [("w", p, p, "activityScheduled", p, None, None) for p in range(20)])
    h.write.parquet(f"{tmp_path}/h")
    text = plan(pending.pending(spark.read.parquet(f"{tmp_path}/h")))
    assert text.count("Exchange (") <= 2 and "Join" not in text  # named in the tree and once below it


def test_first_of_reduces_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, k, "x") for k in range(5)], "key long, pos long, v string")
    text = plan(differ.first_of(rows, ["key"], ["pos"]))
    assert text.count("partial_min_by") >= 1


@pytest.mark.parametrize("cuts", [[], [7], [3, 5, 20, 31], list(range(1, 40))])
def test_retry_state_does_not_depend_on_batches(spark, tmp_path, cuts):
    rows = [(k, k % 3, 1000 + k, "activityCompleted" if k % 11 == 10 else "activityRetryScheduled") for k in range(40)]
    edges = [0, *cuts, len(rows)]
    schema = "event_id long, key long, ts long, type string"
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        path = tmp_path / f"part{n}"
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(str(path))
        (file,) = [f for f in os.listdir(path) if f.endswith(".parquet")]
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(path / file, tmp_path / "in" / f"{n:03}.parquet")
        os.utime(tmp_path / "in" / f"{n:03}.parquet", (time.time() + n, time.time() + n))
    out = jobs.drained(jobs.retry_timers(jobs.stream(spark, str(tmp_path / "in"), files_at_once=1)))
    got = sorted((r.key, r.event_id, r.attempt, r.wait_ms) for r in out.collect())
    want, count = [], {}
    for event, key, _, kind in rows:
        count[key] = 0 if kind == "activityCompleted" else count.get(key, 0) + 1
        if kind != "activityCompleted":
            want.append((key, event, count[key], min(100 * 2 ** (count[key] - 1), 30_000)))
    assert got == sorted(want)


def test_signals_are_delivered_once(spark, tmp_path):
    rows = spark.createDataFrame([(k % 4, 1, k % 4 + 10, "signal", 1.0) for k in range(12)], "event_id long, key long, ts long, type string, value double")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    out = jobs.drained(jobs.signals(jobs.stream(spark, f"{tmp_path}/in", files_at_once=1)))
    assert out.groupBy("event_id").count().where(F.col("count") > 1).count() == 0 and out.count() == 4


def in_order(spark, tmp_path, parts, schema):
    """A folder whose files are read one after the other, a part each."""
    os.makedirs(tmp_path / "in", exist_ok=True)
    for n, rows in enumerate(parts):
        path = tmp_path / f"part{n}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
        (file,) = [f for f in os.listdir(path) if f.endswith(".parquet")]
        os.rename(path / file, tmp_path / "in" / f"{n:03}.parquet")
        os.utime(tmp_path / "in" / f"{n:03}.parquet", (time.time() + n, time.time() + n))
    return jobs.stream(spark, str(tmp_path / "in"), files_at_once=1)


def test_marks_hold_between_batches(spark, tmp_path):
    parts = [[(1, 5), (1, 3), (2, 1)], [(1, 5), (1, 6), (2, 0), (3, None)], [(1, 4), (2, 2), (3, 1)]]
    out = jobs.drained(jobs.beyond_mark(in_order(spark, tmp_path, parts, "key long, n long"), "n"))
    assert sorted(map(tuple, out.collect())) == [(1, 3), (1, 5), (1, 6), (2, 1), (2, 2), (3, 1)]


def test_beats_move_the_deadline_between_batches(spark, tmp_path):
    parts = [[(1, 1000), (2, 1000)], [(1, 1100), (2, 1050), (1, 1201)], [(3, 9000)]]
    out = jobs.drained(jobs.silences(in_order(spark, tmp_path, parts, "key long, ts long"), 100))
    # a beat at the deadline is in time, one behind it is not; the last beat may still be followed
    assert sorted((r.key, r.beats, r.expired_at) for r in out.collect()) == [(1, 1, 1301), (1, 2, 1200), (2, 2, 1150)]


def test_timers_fire_once(spark, tmp_path):
    start, stop = "timerStarted", "timerCanceled"
    parts = [
        [(1, 1000, start, 2000), (2, 1000, start, 2000), (3, 1000, start, 99_000), (4, 1000, start, 1500)],
        [(1, 1100, start, 1200), (2, 1100, stop, None), (6, 1100, start, 1100)],
        [(5, 5000, start, 1200)],  # due before it starts
        [(1, 5000, start, 6000), (4, 5000, stop, None), (7, 8000, start, 9000)],
    ]
    schema = "timer long, ts long, type string, fire_at long"
    out = jobs.drained(jobs.fired(in_order(spark, tmp_path, parts, schema)))
    assert sorted(map(tuple, out.collect())) == [(1, 2000), (4, 1500), (5, 1200), (6, 1100)]


def test_timers_share_a_group(spark, tmp_path):
    start, stop = "timerStarted", "timerCanceled"
    parts = [
        [(k, 1000, start, 2000 + k % 3) for k in range(50)] + [(None, 1000, start, 1500)],
        [(k, 1100, stop, None) for k in range(0, 50, 5)] + [(60, 1100, stop, None), (60, 1200, start, 9000)],
        [(60, 5000, start, 1200), (61, 5000, start, 5000), (62, 5000, start, 4000), (0, 5000, start, 3000)],
    ]
    schema = "timer long, ts long, type string, fire_at long"
    out = jobs.drained(jobs.fired(in_order(spark, tmp_path, parts, schema), groups=1)).collect()
    want = [(k, 2000 + k % 3) for k in range(50) if k % 5] + [(62, 4000)]
    assert sorted(tuple(r) for r in out if r.timer is not None) == want
    assert [r.fire_at for r in out if r.timer is None] == [1500]


def test_timers_are_kept_in_few_groups(spark, tmp_path):
    rows = [(k, 1000 + k, "timerStarted", 2000) for k in range(20_000)]
    base = f"{tmp_path}/run"
    events = in_order(spark, tmp_path, [rows], "timer long, ts long, type string, fire_at long")
    assert jobs.drained(jobs.fired(events, groups=16), base=base).count() == 20_000
    assert spark.read.format("statestore").load(f"{base}/checkpoint").count() <= 16


def test_streams_without_rows(spark, tmp_path):
    events = in_order(spark, tmp_path, [[]], "timer long, key long, ts long, type string, fire_at long")
    for job in (jobs.fired(events), jobs.silences(events, 100), jobs.beyond_mark(events, "ts")):
        assert jobs.drained(job).count() == 0


def test_waits_take_signals_in_order(spark):
    schema = "key long, event_id long, ts long, value double"
    waits = spark.createDataFrame([(1, 1, 10, None), (1, 2, 20, None), (1, 3, 30, None), (2, 4, 10, None)], schema)
    given = spark.createDataFrame([(1, 8, 5, 0.5), (1, 9, 25, 1.5)], schema)
    out = spans.answered(waits, given).select("wait_id", "signal_id", "taken_at")
    assert sorted(map(tuple, out.collect())) == [(1, 8, 10), (2, 9, 25), (3, None, None), (4, None, None)]


def test_checkpoints_go_with_their_attempt(spark):
    work = spark.createDataFrame([("w", 0, 2), ("w", 1, 1)], "workflow_id string, seq long, attempt long")
    beats = spark.createDataFrame(
        [("w", 0, 1, 9, 1, 1.0), ("w", 0, 2, 5, 2, 2.0), ("w", 0, 2, 5, 3, 3.0), ("w", 0, 2, 4, 4, 4.0)],
        "workflow_id string, seq long, attempt long, ts long, event_id long, value double",
    )
    out = pending.with_checkpoint(work, beats).select("seq", "checkpoint", "checkpoint_at")
    assert sorted(map(tuple, out.collect())) == [(0, 3.0, 5), (1, None, None)]


def test_joins_of_whole_histories_sort_none(spark, tmp_path):
    x = executions(spark, [{"workflow_id": f"w{k}"} for k in range(4)])
    events = [(f"w{k}", p, p, "signal", p, None, None) for k in range(4) for p in range(k + 1)]
    history(spark, events).write.parquet(f"{tmp_path}/h")
    h = spark.read.parquet(f"{tmp_path}/h")
    ids = spark.createDataFrame([("w1", 1), ("w3", 2)], "workflow_id string, keep long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        _, left = files.rolled_over(x, h, ids)
        _, cut = files.reset(x, h, ids, 7)
        # the one sort is that of the rewound histories, in as many partitions as asked for
        assert plan(left).count("SortMergeJoin") == 0 and plan(cut).count("SortMergeJoin") == 0
        assert "hashpartitioning(workflow_id" in plan(cut) and ", 7), REPARTITION_BY_NUM" in plan(cut)
        assert sorted(r.workflow_id for r in left.collect()) == ["w0"] + ["w2"] * 3
        want = ["w0", "w1"] + ["w2"] * 3 + ["w3"] * 2
        assert sorted(r.workflow_id for r in cut.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_steps_are_numbered_in_bounded_partitions(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(bridge, "PART_ROWS", 500)
    lines = bridge.read(spark, sf_dir, "lineitem").count()
    assert bridge.parts(spark, sf_dir) == lines // 500 + 1
    assert f", {lines // 500 + 1}), REPARTITION_BY_NUM" in plan(bridge.steps(spark, sf_dir))


def test_costly_expressions_get_all_cores(spark, sf_dir):
    for name in ("schema_round_trip", "schema_validate_rows", "schema_strict_lists"):
        n = spark.sparkContext.defaultParallelism
        assert f"RoundRobinPartitioning({n})" in plan(registry.QUERIES[name](spark, sf_dir))


def test_detail_and_pages_shuffle_little(spark, sf_dir):
    detail = registry.QUERIES["describe_detail"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert detail.count("l_linenumber") and detail.count("Window [") == 1
    page = registry.QUERIES["list_page1"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert page.index("Window [") < page.index("LeftSemi")  # the steps of other executions go before they are numbered
