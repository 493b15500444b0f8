"""Fixed inputs and outputs of the operators, small enough to read."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from chronolith.functions import calendar, schema, temporal, text
from chronolith.functions.calendar import Rule
from chronolith.operators import differ, grouping, lineage, listing, liveness, pending
from chronolith.operators.listing import ExecutionFilter
from chronolith.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def ids(df, column="workflow_id"):
    return [r[column] for r in df.collect()]


def executions(spark, rows):
    columns = "workflow_id string, run_id int, name string, task_queue string, status string, created_at long, closed_at long, task_failures int, parent_id string, parent_seq long"
    full = [
        {"run_id": 0, "name": "greeter", "task_queue": "default", "status": "running", "created_at": 1000, "closed_at": None, "task_failures": 0, "parent_id": None, "parent_seq": None} | r
        for r in rows
    ]
    order = [c.strip().split(" ")[0] for c in columns.split(",")]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in full], columns)


def history(spark, rows):
    columns = "workflow_id string, run_id int, pos long, ts long, type string, seq long, child_id string, error string"
    return spark.createDataFrame([(w, 0, p, t, k, s, c, e) for w, p, t, k, s, c, e in rows], columns)


def test_listing_filters_and_order(spark):
    x = executions(
        spark,
        [
            {"workflow_id": "a", "status": "completed"},
            {"workflow_id": "b", "name": "poller", "task_queue": "agents"},
            {"workflow_id": "c", "name": "poller", "task_failures": 3},
        ],
    )
    assert ids(listing.page(x, ExecutionFilter(stuck=True))) == ["c"]
    assert ids(listing.page(x, ExecutionFilter(stuck=False))) == ["b", "a"]
    assert ids(listing.page(x, ExecutionFilter(name="poller"))) == ["c", "b"]
    assert ids(listing.page(x, ExecutionFilter(task_queue="agents"))) == ["b"]
    t = executions(spark, [{"workflow_id": f"t{k}", "created_at": k} for k in (900, 1000, 2000, 3000)])
    assert ids(listing.page(t, ExecutionFilter(created_after=2000))) == ["t3000", "t2000"]
    assert ids(listing.page(t, ExecutionFilter(created_after=2000, created_before=3000))) == ["t2000"]
    assert ids(listing.page(t))[-2:] == ["t1000", "t900"]


def test_pages_meet_every_row_once(spark):
    x = executions(spark, [{"workflow_id": f"w{k:03}"} for k in range(12)])
    seen, cursor = [], None
    while True:
        rows = listing.page(x, limit=5, cursor=cursor).collect()
        if not rows:
            break
        seen += [r.workflow_id for r in rows]
        cursor = f"{rows[-1].created_at:015}|{rows[-1].workflow_id}"
    assert seen == sorted(seen, reverse=True) and len(set(seen)) == 12
    many = executions(spark, [{"workflow_id": f"w{k:03}"} for k in range(300)])
    assert listing.page(many, limit=10_000).count() == 200
    with pytest.raises(ValueError):
        listing.page(x, limit=0)


def test_groups_put_trouble_first(spark):
    rows = [{"workflow_id": f"h{k}", "task_queue": "healthy"} for k in range(20)]
    rows += [{"workflow_id": "s", "task_queue": "troubled", "task_failures": 1}]
    got = grouping.by(executions(spark, rows), "task_queue").collect()
    assert [r.task_queue for r in got] == ["troubled", "healthy"]
    assert (got[0].total, got[0].running, got[0].stuck) == (1, 1, 1)
    assert grouping.by(executions(spark, []), "task_queue").count() == 0


def test_retrying_activities(spark):
    a = spark.createDataFrame(
        [("w", 0, "charge", 2, "x", 5000), ("w", 1, "charge", 3, None, 2000), ("w", 2, "notify", 1, None, None), ("w", 3, None, 9, None, None)],
        "workflow_id string, seq long, name string, attempts int, last_error string, next_attempt_at long",
    )
    got = [(r.name, r.retrying, r.attempts, r.next_attempt_at, r.last_error) for r in grouping.retrying(a).collect()]
    assert got == [("charge", 2, 5, 2000, "x"), ("notify", 1, 1, None, None)]


def test_pending_keeps_kinds_apart(spark):
    h = history(
        spark,
        [
            ("w", 0, 1, "activityScheduled", 1, None, None),
            ("w", 1, 2, "timerStarted", 2, None, None),
            ("w", 2, 3, "timerFired", 1, None, None),
            ("w", 3, 4, "childStarted", 3, "w.0.3", None),
            ("w", 4, 5, "childCompleted", 3, None, None),
        ],
    )
    got = {(r.kind, r.seq) for r in pending.pending(h).collect()}
    assert got == {("activity", 1), ("timer", 2)}


def test_retention(spark):
    x = executions(
        spark,
        [
            {"workflow_id": "p"},
            {"workflow_id": "at", "status": "completed", "closed_at": 1000},
            {"workflow_id": "late", "status": "completed", "closed_at": 1001},
            {"workflow_id": "old", "status": "failed", "created_at": 1},
            {"workflow_id": "kept", "status": "completed", "closed_at": 5, "parent_id": "p", "parent_seq": 1},
            {"workflow_id": "told", "status": "completed", "closed_at": 5, "parent_id": "p", "parent_seq": 2},
        ],
    )
    h = history(spark, [("old", 0, 900, "timerStarted", 0, None, None), ("p", 0, 1, "childCompleted", 2, None, None)])
    got = {r.workflow_id: r.blocked for r in lineage.retention(x, h, 1000).collect()}
    assert got == {"at": False, "old": False, "kept": True, "told": False}
    assert "old" not in ids(lineage.retention(x, h, 899))


def test_cascade_stops_at_settled(spark):
    x = executions(
        spark,
        [
            {"workflow_id": "a"},
            {"workflow_id": "b", "parent_id": "a"},
            {"workflow_id": "c", "parent_id": "b", "status": "completed"},
            {"workflow_id": "d", "parent_id": "c"},
        ],
    )
    got = lineage.cancel_cascade(x, x.where("workflow_id = 'a'"))
    assert {(r.workflow_id, r.depth) for r in got.collect()} == {("a", 0), ("b", 1)}


def test_name_served_is_three_valued(spark):
    workers = spark.createDataFrame(
        [("q", "workflow", "1", ["greet"]), ("silent", "workflow", "2", None), ("silent", "workflow", "3", ["greet"]), ("acts", "activity", "4", ["greet"])],
        "task_queue string, role string, identity string, serves array<string>",
    )
    asked = spark.createDataFrame(
        [("q", "greet"), ("q", "other"), ("none", "greet"), ("silent", "greet"), ("acts", "greet")], "task_queue string, name string"
    )
    got = {(r.task_queue, r.name): r.served for r in liveness.name_served(asked, workers).collect()}
    assert got == {("q", "greet"): True, ("q", "other"): False, ("none", "greet"): None, ("silent", "greet"): None, ("acts", "greet"): None}


@pytest.mark.parametrize(
    ("given", "ms"),
    [("250ms", 250), ("90s", 90_000), ("30 minutes", 1_800_000), ("5m", 300_000), ("2 hours", 7_200_000), ("3 days", 259_200_000),
     ("1w", 604_800_000), ("1h 30m", 5_400_000), ("1m30s", 90_000), ("1.5s", 1500), ("1.5 days", 129_600_000), ("0.0004ms", 0), ("1H", 3_600_000),
     ("500", None), ("", None), (" ", None), ("5 fortnights", None), ("1 month", None), ("2 years", None), ("1mo", None), ("5m and 3s", None), ("-5m", None)],
)
def test_durations(spark, given, ms):
    assert one(spark, temporal.duration_ms(F.lit(given))) == ms
    if ms is None:
        with pytest.raises(ValueError):
            temporal.duration_to_ms(given)
    else:
        assert temporal.duration_to_ms(given) == ms


@pytest.mark.parametrize(
    ("after", "every", "offset", "fire"),
    [(0, 1000, 0, 1000), (999, 1000, 0, 1000), (1000, 1000, 0, 2000), (-1, 1000, 0, 0), (-1000, 1000, 0, 0), (-1001, 1000, 0, -1000),
     (-1, 1000, 250, 250), (0, 3_600_000, 900_000, 900_000), (900_000, 3_600_000, 900_000, 4_500_000), (5, 1, 0, 6)],
)
def test_interval_boundaries(spark, after, every, offset, fire):
    assert one(spark, temporal.next_boundary(F.lit(after), F.lit(every), F.lit(offset))) == fire


@pytest.mark.parametrize(
    ("after", "low", "high", "fire"),
    [(0, 5500, None, 6000), (0, 6000, None, 6000), (0, None, 2500, 1000), (2000, None, 2500, None), (0, None, 1000, None), (0, 5001, 5999, None), (0, 5000, 5001, 5000)],
)
def test_interval_bounds(spark, after, low, high, fire):
    lit = lambda v: F.lit(v).cast("long")
    assert one(spark, temporal.next_fire(lit(after), lit(1000), lit(0), lit(low), lit(high))) == fire


def test_backoff_and_retry(spark):
    wait = [one(spark, temporal.backoff_ms(F.lit(n), F.lit(100), F.lit(2.0), F.lit(350.0))) for n in (1, 2, 3)]
    assert wait == [100, 200, 350]
    assert one(spark, temporal.backoff_ms(F.lit(1), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0
    assert [one(spark, temporal.should_retry(F.lit(n), F.lit(3))) for n in (1, 2, 3)] == [True, True, False]
    assert not one(spark, temporal.should_retry(F.lit(1), F.lit(-5)))


def ms(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1000)


def plain_fires(rule, start, end):
    """All instants of a rule from ``start`` to ``end``, minute by minute: a reading is met when the
    zone's clock shows it, or a later one, for the first time."""
    zone, out, seen = ZoneInfo(rule.tz), [], None

    def matches(w):
        return (
            w.minute in rule.minute and w.hour in rule.hour
            and (rule.day_of_month is None or w.day in rule.day_of_month)
            and (rule.month is None or w.month in rule.month)
            and (rule.day_of_week is None or w.isoweekday() % 7 in rule.day_of_week)
        )

    for t in range(start - 172_800_000, end + 1, 60_000):
        shown = datetime.fromtimestamp(t // 1000, zone).replace(tzinfo=None)
        w = shown if seen is None else seen + timedelta(minutes=1)
        while w <= shown:
            if matches(w) and t not in out:
                out.append(t)
            w += timedelta(minutes=1)
        seen = shown if seen is None else max(seen, shown)
    return out


CALENDAR = [
    (Rule(), ms(2031, 5, 7, 1), 3),
    (Rule((5, 50), (0, 13)), ms(2031, 12, 31, 12), 3),
    (Rule(hour=(7,), day_of_week=(0, 6)), ms(2031, 5, 7), 9),
    (Rule((30,), (2,), tz="Europe/Berlin"), ms(2031, 3, 29), 4),  # skipped on the 30th
    (Rule((15,), (2,), tz="Europe/Berlin"), ms(2031, 10, 25), 4),  # twice on the 26th
    (Rule((10,), (2,), tz="Australia/Lord_Howe"), ms(2031, 10, 3), 4),  # skips half an hour
    (Rule((0,), (0,), tz="America/Santiago"), ms(2031, 9, 5), 4),  # skips midnight
    (Rule((45,), (23,), tz="Pacific/Auckland"), ms(2031, 4, 4), 4),
]


@pytest.mark.parametrize(("rule", "start", "days"), CALENDAR)
def test_calendar(spark, rule, start, days):
    end = start + days * 86_400_000
    fires = plain_fires(rule, start, end)
    at = sorted({start, *[f + d for f in fires for d in (-60_000, 0, 60_000) if start <= f + d < end]})
    df = spark.createDataFrame([(t,) for t in at] + [(None,)], "t long")
    got = df.select("t", calendar.next_fire(rule, F.col("t")).alias("n"), calendar.previous_fire(rule, F.col("t")).alias("p")).collect()
    for r in got:
        if r.t is None:
            assert r.n is None and r.p is None
            continue
        if any(f > r.t for f in fires):
            assert r.n == min(f for f in fires if f > r.t)
        if any(f <= r.t for f in fires):
            assert r.p == max(f for f in fires if f <= r.t)


def test_calendar_looks_far(spark):
    leap = Rule(day_of_month=(29,), month=(2,))
    assert one(spark, calendar.next_fire(leap, F.lit(ms(2032, 2, 29)))) == ms(2036, 2, 29)
    assert one(spark, calendar.next_fire(leap, F.lit(ms(2096, 3, 1)))) == ms(2104, 2, 29)
    assert one(spark, calendar.previous_fire(leap, F.lit(ms(2035, 1, 1)))) == ms(2032, 2, 29)
    never = Rule(day_of_month=(30,), month=(2,))
    assert one(spark, calendar.next_fire(never, F.lit(0))) is None
    assert Rule(hour=(24,), tz="Nowhere/At_All").problems() == ["hour must be from 0 to 23", "unknown time zone Nowhere/At_All"]


def test_spans_keep_conditions_and_activities_apart(spark):
    from chronolith.operators import spans

    rows = [
        (1, "k", 0, 10, "conditionParked"), (2, "k", 1, 20, "conditionParked"), (3, "k", 1, 30, "conditionUnparked"), (4, "k", 0, 50, "conditionUnparked"),
        (5, "k", 0, 60, "activityRetryScheduled"), (6, "k", 1, 65, "activityStarted"), (7, "k", 0, 66, "activityCompleted"), (8, "k", 0, 75, "activityStarted"),
        (9, "k", 1, 80, "activityRetryScheduled"),
    ]
    e = spark.createDataFrame(rows, "event_id int, key string, seq int, ts long, type string")
    parked = spans.parked_spans(e.withColumnRenamed("seq", "cond_seq"))
    assert {r.event_id: r.parked_ms for r in parked.collect()} == {1: 40, 2: 10}
    assert {r.event_id: r.gap_ms for r in spans.retry_gaps(e).collect()} == {5: 15, 9: None}


def test_differs(spark):
    items = lambda *k: spark.createDataFrame([(x,) for x in k], "id int")
    added, removed, state = differ.by_id(items(1), items(1, 2, 2), "id")
    assert (ids(added, "id"), ids(removed, "id"), ids(state, "id")) == ([2, 2], [], [1, 2])
    for given, mark, want, after in (((1, 2), None, [1, 2], 2), ((1, 2, 3), 1, [2, 3], 3), ((3, 1, 2), None, [1, 2, 3], 3), ((1, 2, 3), 3, [], 3), ((1,), 2, [], 2)):
        added, new = differ.by_cursor(items(*given), "id", mark)
        assert (sorted(ids(added, "id")), new) == (want, after)


def test_schema_issues(spark):
    shape = schema.obj({"a": schema.integer(low=1), "b": schema.string(pattern="^x", optional=True), "c": schema.enum("u", "v", nullable=True)})
    cases = {
        '{"a": 1, "c": "u"}': None,
        '{"a": 1, "c": null}': None,
        '{"a": 0, "c": "u"}': "$.a: too small",
        '{"c": "u"}': "$.a: required",
        '{"a": 1, "b": "y", "c": "u"}': "$.b: does not match",
        '{"a": 1, "c": "w"}': "$.c: not one of the values",
        '{"a": "1", "c": "u"}': "$.a: expected a number",
        "[1]": "$: expected an object",
        "{": "$: not JSON",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.i for r in df.select("t", schema.first_issue(F.col("t"), shape).alias("i")).collect()}
    assert got == cases
    assert shape.json_schema()["required"] == ["a", "c"]


def outcome(spark, texts, column):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", column.alias("c")).collect()
    return {r.t: r.c for r in rows}


def test_schema_of_lists_records_and_unions(spark):
    shape = schema.obj(
        {
            "xs": schema.array(schema.integer(low=0), high=3),
            "by": schema.record(schema.boolean(), optional=True),
            "u": schema.union(schema.literal("on"), schema.literal(7), schema.obj({"z": schema.string()}), optional=True),
            "d": schema.defaulted(schema.number(), 1.5),
        }
    )
    cases = {
        '{"xs": []}': None,
        '{"xs": [1, 2], "by": {"a": true}, "u": 7, "d": 2}': None,
        '{"xs": [1, -1, -2]}': "$.xs[1]: too small",
        '{"xs": [1, null]}': "$.xs[1]: expected a number",
        '{"xs": [1, 1, 1, 1]}': "$.xs: too many",
        '{"xs": {"a": 1}}': "$.xs: expected an array",
        '{"xs": [], "by": {"a": true, "b": 1}}': "$.by.b: expected a boolean",
        '{"xs": [], "by": {"a": null}}': "$.by.a: expected a boolean",
        '{"xs": [], "u": 8}': "$.u: fits none of the branches",
        '{"xs": [], "u": {"z": "s", "more": 1}}': None,
        '{"xs": [], "d": null}': "$.d: expected a number",
    }
    assert outcome(spark, cases, schema.first_issue(F.col("t"), shape)) == cases
    read = {
        '{"xs": [], "other": 1}': '{"xs":[],"d":1.5}',
        '{"u": {"z": "q\\"", "more": 1}, "xs": [3], "by": {"b\\"": true, "a": false}, "d": 2}':
            '{"xs":[3],"by":{"a":false,"b\\"":true},"u":{"z":"q\\""},"d":2}',
        '{"xs": [-1]}': None,
    }
    assert outcome(spark, read, schema.shaped(F.col("t"), shape)) == read
    assert set(outcome(spark, [*read, *cases], schema.round_trip_problem(F.col("t"), shape)).values()) == {None}
    assert shape.json_schema()["required"] == ["xs"]
    assert shape.json_schema()["properties"]["d"]["default"] == 1.5


def test_a_round_trip_parses_each_text_once(spark):
    shape = schema.obj({k: schema.union(schema.integer(), schema.array(schema.integer(), high=3)) for k in "abcd"})
    column = schema.round_trip_problem(F.col("json"), shape)
    rows = spark.createDataFrame([('{"a":1,"b":[1,2],"c":3,"d":[]}',), ('{"a":1}',), ("{",), (None,)], "json string")
    df = rows.select(column.alias("problem"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 2
    assert [r.problem for r in df.collect()] == [None] * 4
    assert one(spark, schema.shaped(F.lit('{"a":1,"b":[1,2],"c":3,"d":[]}'), shape)) == '{"a":1,"b":[1,2],"c":3,"d":[]}'


def test_undeclared_keys_inside_lists(spark):
    shape = schema.obj(
        {"a": schema.array(schema.obj({"b": schema.array(schema.obj({"c": schema.unknown()}))})), "r": schema.record(schema.obj({}))}
    )
    cases = {
        '{"a": [{"b": []}, {"b": [{"c": 1}, {"c": 1, "d": 2}], "e": 3}], "f": 4}': ["$.a[1].b[1].d", "$.a[1].e", "$.f"],
        '{"a": 1, "r": {"x": {"any": 1}}}': [],
        "[1]": [],
        "{": [],
    }
    assert outcome(spark, cases, schema.strict_problems(F.col("t"), shape)) == cases


def test_names(spark):
    assert one(spark, text.id_suffix(F.lit("greeter-12"))) == 12
    assert one(spark, text.id_suffix(F.lit("greeter"))) is None
    assert [one(spark, text.is_power_of_two(F.lit(n))) for n in (1, 2, 3, 4, 6)] == [True, True, False, True, False]


def test_torn_log_ends_at_the_first_bad_line(spark, tmp_path):
    d = tmp_path / "executions" / "w"
    d.mkdir(parents=True)
    (d / "meta.json").write_text('{"workflowId": "w", "name": "n",\n "status": "running"}')
    (d / "events.jsonl").write_text('{"type": "a"}\n{"type": "b"}\n{"typ\n{"type": "c"}\n')
    got = files.read_events(spark, str(tmp_path / "executions"))
    assert [(r.folder, r.pos) for r in got.orderBy("pos").collect()] == [("w", 0), ("w", 1)]
    meta = files.read_meta(spark, str(tmp_path / "executions")).first()
    assert (meta.workflow_id, meta.task_queue, meta.task_failures) == ("w", "default", 0)
