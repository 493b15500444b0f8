"""Queries by name over the bridge tables, and the DuckDB SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import calendar, schema, temporal, text
from chronolith.operators import differ, dispatch, grouping, lineage, listing, liveness, pending, spans
from chronolith.operators.listing import ExecutionFilter
from chronolith.plans import describe
from chronolith.sources import bridge, files
from chronolith.sources.bridge import CTE
from chronolith.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

X, H = bridge.executions, bridge.history
LOW, HIGH = 820_454_400_000, 915_148_800_000  # 1996 up to 1999
CUTOFF = 900_000_000_000




def query(sql: str | None = None, recursive: bool = False):
    """Register a function under its name, with SQL behind the bridge's tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"with {'recursive ' if recursive else ''}{CTE}{sql}"
        return f

    return add


# -- listing ------------------------------------------------------------------

PAGE = """
, p as (select * from x where {where} order by created_at desc, workflow_id desc limit {limit})
select p.workflow_id, p.run_id, p.name, p.status, (select count(*) from h where h.workflow_id = p.workflow_id) history_length,
  p.task_queue, p.created_at, p.closed_at, p.task_failures
from p
"""


def listed(spark, d, limit=None, cursor=None, **f):
    return describe.list_page(X(spark, d), lambda ids: H(spark, d, ids), ExecutionFilter(**f), limit, cursor)


@query(PAGE.format(where=f"status = 'running' and created_at >= {LOW} and created_at < {HIGH}", limit=200))
def list_page1(spark, d):
    return listed(spark, d, status="running", created_after=LOW, created_before=HIGH)


@query(PAGE.format(where="created_at < 899424000000 or (created_at = 899424000000 and workflow_id < 'order-5')", limit=50))
def list_page2_keyset(spark, d):
    return listed(spark, d, limit=50, cursor="000899424000000|order-5")


@query(
    "select row_number() over (order by created_at desc, workflow_id desc) as rank, workflow_id, created_at,"
    " lpad(created_at::varchar, 15, '0') || '|' || workflow_id cursor from x where name = 'BUILDING'"
    " order by created_at desc, workflow_id desc limit 200"
)
def list_ranked(spark, d):
    """A page with each row's place and cursor, so that the order itself is checked."""
    from pyspark.sql import Window

    rows = listing.page(X(spark, d), ExecutionFilter(name="BUILDING"))
    order = Window.orderBy(F.desc("created_at"), F.desc("workflow_id"))
    return rows.select(
        F.row_number().over(order).alias("rank"), "workflow_id", "created_at",
        listing.cursor_key(F.col("created_at"), F.col("workflow_id")).alias("cursor"),
    )


def _filter(name: str, where: str, **f) -> None:
    columns = ["workflow_id", "name", "status", "task_queue", "created_at"]

    def run(spark, d):
        return listing.filtered(X(spark, d), ExecutionFilter(**f)).select(*columns)

    run.__name__ = name
    query(f"select {', '.join(columns)} from x where {where}")(run)


_filter("list_by_status", "status = 'failed'", status="failed")
_filter("list_by_queue", "task_queue = '1-URGENT'", task_queue="1-URGENT")
_filter("list_by_prefix", "starts_with(workflow_id, 'order-12')", workflow_id_prefix="order-12")
_filter("list_stuck", "status = 'running' and task_failures > 0", stuck=True)
_filter("list_not_stuck", "not (status = 'running' and task_failures > 0)", stuck=False)
_filter(
    "list_window_half_open", f"created_at >= {LOW} and created_at < {HIGH}", created_after=LOW, created_before=HIGH
)
_filter("list_children", "parent_id = 'order-7'", parent_id="order-7")
_filter(
    "list_combined",
    f"status = 'running' and task_queue = '2-HIGH' and task_failures > 0 and created_at >= {LOW}",
    status="running", task_queue="2-HIGH", stuck=True, created_after=LOW,
)

# -- groups -------------------------------------------------------------------

COUNTS = """count(*) total, count(*) filter (status = 'running') running, count(*) filter (status = 'completed') completed,
  count(*) filter (status = 'failed') failed, count(*) filter (status = 'terminated') as "terminated",
  count(*) filter (status = 'running' and task_failures > 0) stuck"""


@query(f"select task_queue, {COUNTS} from x group by 1")
def groups_by_queue(spark, d):
    return grouping.by(X(spark, d), "task_queue")


@query(f"select name, {COUNTS} from x group by 1")
def groups_by_name(spark, d):
    return grouping.by(X(spark, d), "name")


@query(
    f"select 'task_queue' as grouping, task_queue as key, {COUNTS} from x group by task_queue"
    f" union all select 'name', name, {COUNTS} from x group by name"
)
def groups_both_grouping_sets(spark, d):
    return grouping.both(X(spark, d))


RETRYING = """select a.name, count(*) retrying, sum(attempts)::bigint attempts, min(next_attempt_at) next_attempt_at,
  arg_max(last_error, (workflow_id, seq)) filter (last_error is not null) last_error from a {join}
  where a.name is not null group by 1"""


@query(RETRYING.format(join="join (select workflow_id, status from x) x using (workflow_id)").replace("where", "where status = 'running' and"))
def retrying_activities(spark, d):
    """Of running executions only."""
    return grouping.retrying(bridge.attempts(spark, d), X(spark, d))


@query(RETRYING.format(join=""))
def retrying_activities_all(spark, d):
    """Whatever the execution's status."""
    return grouping.retrying(bridge.attempts(spark, d))


# -- pending work and detail --------------------------------------------------

PENDING = """select workflow_id, seq, pos, ts since{more} from (select * from h where type = '{marker}') m
  anti join (select workflow_id, seq from h where type in ({done})) c using (workflow_id, seq)"""


@query(PENDING.format(marker="activityScheduled", done="'activityCompleted', 'activityFailed'", more=""))
def pending_activities(spark, d):
    return pending.pending(H(spark, d), "activity").select("workflow_id", "seq", "pos", "since")


@query(PENDING.format(marker="timerStarted", done="'timerFired'", more=""))
def pending_timers(spark, d):
    return pending.pending(H(spark, d), "timer").select("workflow_id", "seq", "pos", "since")


@query(PENDING.format(marker="childStarted", done="'childCompleted', 'childFailed'", more=", child_id"))
def pending_children(spark, d):
    return pending.pending(H(spark, d), "child").select("workflow_id", "seq", "pos", "since", "child_id")


@query(
    "select distinct workflow_id, case when type like 'activity%' then 'activity' when type = 'timerFired' then 'timer'"
    " else 'child' end kind, seq from h where type in ('activityCompleted', 'activityFailed', 'timerFired',"
    " 'childCompleted', 'childFailed')"
)
def completed_seqs(spark, d):
    return pending.completed(H(spark, d)).select("workflow_id", "kind", "seq")


@query(
    f", p as ({PENDING.format(marker='activityScheduled', done=repr('activityCompleted') + ', ' + repr('activityFailed'), more='')})"
    " select p.workflow_id, p.seq, a.name, coalesce(a.attempts, 0) + 1 attempt, a.last_error, a.next_attempt_at"
    " from p left join a using (workflow_id, seq)"
)
def pending_with_retry_state(spark, d):
    rows = pending.with_retry_state(pending.pending(H(spark, d), "activity"), bridge.attempts(spark, d))
    return rows.select("workflow_id", "seq", "name", "attempt", "last_error", "next_attempt_at")


@query(
    """, p as (select distinct workflow_id, seq from h where type = 'activityScheduled'),
  c as (select distinct workflow_id, seq from h where type in ('activityCompleted', 'activityFailed')),
  g as (select p.workflow_id, p.seq, coalesce(a.attempts, 0) + 1 attempt from p anti join c using (workflow_id, seq)
    left join a using (workflow_id, seq)),
  b as (select 'order-' || key workflow_id, event_id % 3 seq, event_id % 4 + 1 attempt, arg_max(value, (ts, event_id)) checkpoint,
    max(ts) checkpoint_at from e group by 1, 2, 3)
  select g.workflow_id, g.seq, g.attempt, checkpoint, checkpoint_at from g left join b using (workflow_id, seq, attempt)"""
)
def pending_with_checkpoint(spark, d):
    """Events stand for heartbeats: of the third steps and fourth attempts by number."""
    rows = pending.with_retry_state(pending.pending(H(spark, d), "activity"), bridge.attempts(spark, d))
    beats = bridge.stream_events(spark, d).select(
        bridge.workflow_id(F.col("key")).alias("workflow_id"), (F.col("event_id") % 3).alias("seq"),
        (F.col("event_id") % 4 + 1).alias("attempt"), "ts", "event_id", "value",
    )
    return pending.with_checkpoint(rows, beats).select("workflow_id", "seq", "attempt", "checkpoint", "checkpoint_at")


WINDOW = """, n as (select *, row_number() over (partition by workflow_id order by pos) - 1 as index,
  count(*) over (partition by workflow_id) total from h)
select workflow_id, pos, type, index from n where """


@query(WINDOW + "index >= greatest(0, total - 5)")
def describe_tail_page(spark, d):
    """The last five events of every history."""
    return pending.history_window(H(spark, d), limit=5).select("workflow_id", "pos", "type", "index")


@query(WINDOW + "index >= least(3, total) and index < least(3, total) + 4")
def describe_offset_page(spark, d):
    return pending.history_window(H(spark, d), offset=3, limit=4).select("workflow_id", "pos", "type", "index")


@query(
    """, m as (select workflow_id, case when type = 'activityScheduled' then 'activity' when type = 'timerStarted' then 'timer' else 'child' end kind, seq
    from h where type in ('activityScheduled', 'timerStarted', 'childStarted')),
  c as (select distinct workflow_id, case when type like 'activity%' then 'activity' when type = 'timerFired' then 'timer' else 'child' end kind, seq
    from h where type in ('activityCompleted', 'activityFailed', 'timerFired', 'childCompleted', 'childFailed')),
  q as (select workflow_id, count(*) filter (kind = 'activity') pa, count(*) filter (kind = 'timer') pt,
    count(*) filter (kind = 'child') pc from m anti join c using (workflow_id, kind, seq) group by 1),
  l as (select workflow_id, count(*) n, arg_max(error, pos) filter (error is not null) err from h group by 1)
  select x.workflow_id, x.run_id, x.name, x.status, x.task_queue, x.parent_id, coalesce(n, 0) history_length,
    case when status = 'running' then coalesce(pa, 0) else 0 end pending_activity,
    case when status = 'running' then coalesce(pt, 0) else 0 end pending_timer,
    case when status = 'running' then coalesce(pc, 0) else 0 end pending_child,
    case when status in ('failed', 'terminated') then err end failure
  from x left join l using (workflow_id) left join q using (workflow_id)"""
)
def describe_detail(spark, d):
    return pending.detail(X(spark, d), H(spark, d))


@query(
    ", i as (select distinct 'order-' || (l_orderkey * 2) workflow_id from lineitem)"
    " select workflow_id, coalesce(status, 'running') status, closed_at from i left join x using (workflow_id)"
)
def outcome_by_id(spark, d):
    """Half of the asked ids are unknown."""
    ids = bridge.read(spark, d, "lineitem").select(bridge.workflow_id(F.col("l_orderkey") * 2).alias("workflow_id"))
    return pending.outcomes(ids.distinct(), X(spark, d)).select("workflow_id", "status", "closed_at")


@query(
    """select p.workflow_id parent_id, p.seq, p.child_id workflow_id,
    case when x.status = 'completed' then 'childCompleted' else 'childFailed' end as type
  from h p join x on x.workflow_id = p.child_id
  where p.type = 'childStarted' and x.status <> 'running' and not exists (
    select 1 from h c where c.workflow_id = p.workflow_id and c.seq = p.seq and c.type in ('childCompleted', 'childFailed'))"""
)
def outcomes_to_deliver(spark, d):
    return describe.outcomes_to_deliver(X(spark, d), H(spark, d))


# -- retention and lineage ----------------------------------------------------

RETENTION = f""", l as (select workflow_id, arg_max(ts, pos) last_ts from h where ts is not null group by 1),
r as (select x.*, coalesce(x.closed_at, l.last_ts, x.created_at) closed from x left join l using (workflow_id) where status <> 'running'),
b as (select r.*, exists (select 1 from x p where p.workflow_id = r.parent_id and p.status = 'running')
  and not exists (select 1 from h o where o.workflow_id = r.parent_id and o.seq = r.parent_seq
    and o.type in ('childCompleted', 'childFailed')) blocked from r where closed <= {CUTOFF})
"""


@query(RETENTION + "select workflow_id, status, closed from b where not blocked")
def retention_expired(spark, d):
    rows = lineage.retention(X(spark, d), H(spark, d), CUTOFF)
    return rows.where("not blocked").select("workflow_id", "status", "closed")


@query(RETENTION + "select workflow_id, parent_id, parent_seq, closed from b where blocked")
def retention_blocked_children(spark, d):
    rows = lineage.retention(X(spark, d), H(spark, d), CUTOFF)
    return rows.where("blocked").select("workflow_id", "parent_id", "parent_seq", "closed")


@query(
    ", t as (select workflow_id root, workflow_id, 0 depth from x where parent_id is null union all"
    " select t.root, x.workflow_id, t.depth + 1 from t join x on x.parent_id = t.workflow_id)"
    " select root, workflow_id, depth from t where depth > 0",
    recursive=True,
)
def lineage_descendants_recursive(spark, d):
    x = X(spark, d)
    roots = x.where("parent_id is null").select("workflow_id")
    return lineage.descend(roots, x.where("parent_id is not null").select("parent_id", "workflow_id"))


@query(
    ", t as (select workflow_id, 0 depth from x where status = 'running' and task_failures = 2 union all"
    " select x.workflow_id, t.depth + 1 from t join x on x.parent_id = t.workflow_id where x.status = 'running')"
    " select workflow_id, min(depth) depth from t group by 1",
    recursive=True,
)
def cancel_cascade(spark, d):
    """Cancels every execution that has failed twice."""
    x = X(spark, d)
    return lineage.cancel_cascade(x, x.where("task_failures = 2"))


@query(
    "select c.workflow_id, c.parent_id, case c.k % 4 when 0 then 'terminate' when 1 then 'cancel' else 'abandon' end effect"
    " from x c join x p on p.workflow_id = c.parent_id where c.status = 'running' and p.status <> 'running'"
)
def parent_close_effects(spark, d):
    x = X(spark, d)
    k = F.col("k") % 4
    policies = x.select("workflow_id", F.when(k == 0, "terminate").when(k == 1, "cancel").alias("policy"))
    return lineage.close_effects(x, policies.where("policy is not null"))


@query(
    """, c as (select *, case k % 4 when 0 then 'terminate' when 1 then 'cancel' when 2 then 'terminate' else 'abandon' end as policy,
    k % 7 = 0 cancelling from x),
  t as (select workflow_id, 'close' effect from c where task_failures = 2
    union select c.workflow_id, case when t.effect = 'cancel' or c.policy = 'cancel' then 'cancel' else 'terminate' end
    from t join c on c.parent_id = t.workflow_id
    where c.status = 'running' and (t.effect = 'cancel' or c.policy = 'cancel' or (c.policy = 'terminate' and not c.cancelling)))
  select workflow_id, arg_min(effect, case effect when 'close' then 0 when 'terminate' then 1 else 2 end) effect from t group by 1""",
    recursive=True,
)
def parent_close_cascade(spark, d):
    x = X(spark, d)
    k = F.col("k") % 4
    policy = F.when(k == 1, "cancel").when(k == 3, "abandon").otherwise("terminate")
    x = x.withColumns({"policy": policy, "cancelling": F.col("k") % 7 == 0})
    return lineage.close_cascade(x, x.where("task_failures = 2"))


# -- changes to executions and histories --------------------------------------


@query("select workflow_id, pos, type from h where pos < 6")
def history_truncated(spark, d):
    return files.truncated(H(spark, d), 6).select("workflow_id", "pos", "type")


@query("select workflow_id from x where k % 3 <> 0")
def executions_deleted(spark, d):
    x = X(spark, d)
    return files.without(x, x.where("k % 3 = 0")).select("workflow_id")


@query("select workflow_id, case when k % 5 = 0 then 'terminated' else status end status from x union all select 'new-' || k, status from x where k % 97 = 0")
def metadata_upsert(spark, d):
    x = X(spark, d).select("workflow_id", "status", "k")
    first = x.where("k % 5 = 0").withColumns({"status": F.lit("failed"), "at": F.lit(1)})
    second = x.where("k % 5 = 0").withColumns({"status": F.lit("terminated"), "at": F.lit(2)})
    new = x.where("k % 97 = 0").withColumns({"workflow_id": F.concat(F.lit("new-"), F.col("k")), "at": F.lit(1)})
    return files.upserted(x, first.union(second).union(new), "at").select("workflow_id", "status")


@query(
    """, n as (select workflow_id, count(*) history_length from h group by 1)
  select workflow_id, run_id + case when history_length >= 20 then 1 else 0 end run_id,
    case when history_length >= 20 then 0 else coalesce(history_length, 0) end history_length from x left join n using (workflow_id)"""
)
def rollover(spark, d):
    """Executions with 20 events go on as a new run."""
    h = H(spark, d)
    parts = bridge.parts(spark, d)
    x, left = files.rolled_over(X(spark, d).repartition(parts, "workflow_id"), h, files.suggested(h, 20))
    n = left.groupBy("workflow_id").agg(F.count("*").alias("history_length"))
    return x.join(n, "workflow_id", "left").select("workflow_id", "run_id", F.coalesce("history_length", F.lit(0)).alias("history_length"))


@query(
    """, n as (select h.workflow_id, row_number() over (partition by h.workflow_id order by pos) nth, k from h join x using (workflow_id)),
  c as (select workflow_id, count(*) events from n where k % 4 <> 0 or nth <= k % 6 group by 1)
  select workflow_id, case when k % 4 = 0 then 'running' else status end status, case when k % 4 = 0 then 0 else task_failures end task_failures,
    case when k % 4 <> 0 then closed_at end closed_at, coalesce(events, 0) events from x left join c using (workflow_id)"""
)
def execution_reset(spark, d):
    rows, parts = X(spark, d), bridge.parts(spark, d)
    points = rows.where("k % 4 = 0").select("workflow_id", (F.col("k") % 6).alias("keep"))
    x, h = files.reset(rows.repartition(parts, "workflow_id"), H(spark, d), points, parts)
    n = h.groupBy("workflow_id").agg(F.count("*").alias("events"))
    return x.join(n, "workflow_id", "left").select(
        "workflow_id", "status", "task_failures", "closed_at", F.coalesce("events", F.lit(0)).alias("events")
    )


# -- workers and queues -------------------------------------------------------

LATEST = """, v as (select task_queue, role, identity, arg_max({t: polled_at, busy: busy, serves: serves}, (polled_at, event_id)) l
  from w where identity is not null group by all),
u as (select task_queue, role, identity, l.t polled_at, l.busy busy, l.serves serves from v)
"""
NOW_SQL = "(select max(polled_at) from w)"


def poll_now(polls: DataFrame) -> int:
    """The last poll stands for the clock."""
    return polls.agg(F.max("polled_at")).first()[0] or 0


@query(
    LATEST
    + f""", q as (select distinct task_queue, role from w where task_queue <> '*'),
  g as (select task_queue, role, max(polled_at) >= {NOW_SQL} - 10000 live from w group by 1, 2
    union all select task_queue, role, true from u where busy)
  select task_queue, role, coalesce(bool_or(live), false) served
  from q left join g on g.role = q.role and g.task_queue in (q.task_queue, '*') group by q.task_queue, q.role""".replace(
        "select task_queue, role, coalesce", "select q.task_queue, q.role, coalesce"
    )
)
def queue_liveness(spark, d):
    polls = bridge.polls(spark, d)
    asked = polls.where("task_queue <> '*'").select("task_queue", "role").distinct()
    return liveness.queue_served(asked, polls, poll_now(polls))


ASKED = """, n as (select distinct task_queue, 'name-' || i as name from w, range(8) t(i) where task_queue <> '*')"""


@query(
    LATEST + ASKED + """select n.task_queue, n.name,
    case when count(u.identity) = 0 then null when bool_or(u.identity is not null and u.serves is null) then null
      else coalesce(bool_or(list_contains(u.serves, n.name)), false) end served
  from n left join u on u.role = 'workflow' and u.task_queue in (n.task_queue, '*') group by 1, 2"""
)
def name_served_three_valued(spark, d):
    polls = bridge.polls(spark, d)
    names = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit("name-"), i.cast("string"))))
    asked = polls.where("task_queue <> '*'").select("task_queue").distinct().select("task_queue", names.alias("name"))
    return liveness.name_served(asked, liveness.latest(polls))


@query(
    LATEST + """select task_queue, role, identity, polled_at, busy,
    row_number() over (partition by task_queue order by polled_at desc, identity, role) as rank
  from u where busy or polled_at >= (select max(polled_at) from w) - 600000"""
)
def workers_latest_poll(spark, d):
    polls = bridge.polls(spark, d)
    rows = liveness.newest_workers(liveness.latest(polls), poll_now(polls))
    return rows.select("task_queue", "role", "identity", "polled_at", "busy", "rank")


@query(
    """, p as (select x.task_queue from h m join x using (workflow_id) where m.type = 'activityScheduled' and not exists (
    select 1 from h c where c.workflow_id = m.workflow_id and c.seq = m.seq and c.type in ('activityCompleted', 'activityFailed'))),
  n as (select task_queue, count(*) waiting from p group by 1),
  q as (select distinct task_queue from w union select distinct task_queue from x)
  select task_queue, case when task_queue = '*' then 0 else coalesce(waiting, 0) end waiting
  from q full join n using (task_queue)"""
)
def queue_backlog(spark, d):
    x = X(spark, d).select("workflow_id", "task_queue")
    waiting = pending.pending(H(spark, d), "activity").select("workflow_id").join(x, "workflow_id")
    queues = bridge.polls(spark, d).select("task_queue").union(x.select("task_queue"))
    return liveness.backlog(waiting, queues)


REPORTS = """, r as (select name, task_queue, identity, 'takes ' || (event_id % 3) description, polled_at * 1000000 + event_id order_key
  from (select *, unnest(serves) as name from w where serves is not null and identity is not null))
"""


def reports(spark, d):
    polls = bridge.polls(spark, d).where("serves is not null and identity is not null")
    return polls.select(
        F.explode("serves").alias("name"), "task_queue", "identity",
        F.concat(F.lit("takes "), F.col("event_id") % 3).alias("description"),
        (F.col("polled_at") * 1_000_000 + F.col("event_id")).alias("order_key"),
    )


@query(
    REPORTS + "select name, arg_min(description, order_key) description, array_to_string(list_sort(list(distinct task_queue)), ',') queues,"
    " count(distinct description) > 1 conflicting from r group by 1"
)
def catalogue_merge(spark, d):
    return liveness.catalogue(reports(spark, d)).withColumn("queues", F.array_join("queues", ","))


@query(
    REPORTS + LATEST + f"""select distinct r.name, r.task_queue, r.identity from r where exists (select 1 from u
    where u.role = 'workflow' and u.serves is not null and (u.busy or u.polled_at >= {NOW_SQL} - 10000)
      and u.task_queue = r.task_queue and u.identity = r.identity)"""
)
def report_current(spark, d):
    polls = bridge.polls(spark, d)
    rows = liveness.current_reports(reports(spark, d), liveness.latest(polls), poll_now(polls))
    return rows.select("name", "task_queue", "identity").distinct()


@query(
    LATEST + """, o as (select task_queue, identity, list_sort(list_distinct(serves)) own from u where role = 'workflow'),
  r as (select task_queue, identity, list_sort(list(distinct name)) names
    from (select task_queue, identity, unnest(serves) as name from w where serves is not null and identity is not null) group by 1, 2)
  select o.task_queue, o.identity, array_to_string(r.names, ',') served from o left join r
    on o.task_queue = r.task_queue and o.identity = r.identity and o.own = r.names"""
)
def report_resolution(spark, d):
    workers = liveness.latest(bridge.polls(spark, d)).where("role = 'workflow'")
    digest = F.when(F.col("serves").isNotNull(), liveness.report_digest(F.array_distinct("serves")))
    workers = workers.select("task_queue", "identity", digest.alias("digest"))
    told = reports(spark, d).groupBy("task_queue", "identity").agg(F.array_sort(F.collect_set("name")).alias("names"))
    rows = liveness.resolved(workers, told.withColumn("digest", liveness.report_digest(F.col("names"))))
    return rows.select("task_queue", "identity", F.array_join("names", ",").alias("served"))


# -- times --------------------------------------------------------------------


@query(
    """, t as (select k, created_at - 900000000000 as after, (k % 50 + 1) * 60000 every, (k % 7) * 1000 off,
    case when k % 3 = 0 then created_at - 899000000000 end nb, case when k % 4 = 0 then created_at - 898999000000 end na from x),
  f as (select k, na, greatest(after, coalesce(nb - 1, after)) st, every, off from t),
  g as (select k, na, st - (((st - off) % every) + every) % every + every fire from f)
  select k, case when na is null or fire < na then fire end fire from g"""
)
def interval_next_fire(spark, d):
    x, k = X(spark, d), F.col("k")
    at = F.col("created_at")
    fire = temporal.next_fire(
        at - 900_000_000_000, (k % 50 + 1) * 60_000, (k % 7) * 1000,
        F.when(k % 3 == 0, at - 899_000_000_000), F.when(k % 4 == 0, at - 898_999_000_000),
    )
    return x.select("k", fire.alias("fire"))


@query(
    """, t as (select k, created_at + 77777 as now, (k % 50 + 1) * 60000 every, case when k % 3 <> 0 then created_at - k * 1000 end handled from x),
  f as (select k, now, every, case when handled is null then now else greatest(handled, now - every) end st from t),
  g as (select k, now, st - (st % every + every) % every + every nominal from f)
  select k, nominal, greatest(0, nominal - now) delay from g"""
)
def interval_catch_up(spark, d):
    k, now = F.col("k"), F.col("created_at") + 77_777
    nominal, delay = temporal.catch_up(
        F.when(k % 3 != 0, F.col("created_at") - k * 1000), now, (k % 50 + 1) * 60_000, F.lit(0)
    )
    return X(spark, d).select("k", nominal.alias("nominal"), delay.alias("delay"))


WORKDAYS = calendar.Rule(minute=(0, 30), hour=(9, 17), day_of_week=(1, 2, 3, 4, 5))


@query(
    """, t as (select distinct created_at as after from x),
  c as (select after, d * 86400000 + m * 60000 fire from t, (select unnest([540, 570, 1020, 1050]) m) mm,
    lateral (select unnest(range(after // 86400000, after // 86400000 + 8)) d) dd
    where (d + 4) % 7 between 1 and 5)
  select after, min(fire) fire from c where fire > after group by 1"""
)
def calendar_next_fire_utc(spark, d):
    at = X(spark, d).select(F.col("created_at").alias("after")).distinct()
    return at.select("after", calendar.next_fire(WORKDAYS, F.col("after")).alias("fire"))


@query(
    """, t as (select distinct created_at as after from x),
  c as (select after, epoch_ms((make_timestamp(d * 86400000000) + interval 9 hour) at time zone 'America/Chicago') fire
    from t, lateral (select unnest(range(after // 86400000 - 1, after // 86400000 + 9)) d) dd where (d + 4) % 7 between 1 and 5)
  select after, min(fire) fire from c where fire > after group by 1"""
)
def calendar_next_fire_tz(spark, d):
    """Nine in the morning on workdays in Chicago: no reading that the zone skips."""
    rule = calendar.Rule(hour=(9,), day_of_week=(1, 2, 3, 4, 5), tz="America/Chicago")
    at = X(spark, d).select(F.col("created_at").alias("after")).distinct()
    return at.select("after", calendar.next_fire(rule, F.col("after")).alias("fire"))


@query(
    """, t as (select distinct created_at as known from x),
  c as (select known, epoch_ms(make_timestamp(d * 86400000000 + m::bigint * 60000000) at time zone 'America/Chicago') fire
    from t, (select unnest([375, 1080]) m) mm, lateral (select unnest(range(known // 86400000 - 40, known // 86400000 + 2)) d) dd
    where day(make_timestamp(d * 86400000000)) in (1, 15))
  select known, max(fire) fire from c where fire <= known group by 1"""
)
def calendar_previous_fire(spark, d):
    """A quarter past six and six in the evening on the first and fifteenth in Chicago."""
    at = X(spark, d).select(F.col("created_at").alias("known")).distinct()
    fires = [calendar.Rule((m,), (h,), (1, 15), tz="America/Chicago") for h, m in ((6, 15), (18, 0))]
    return at.select("known", F.greatest(*[calendar.previous_fire(r, F.col("known")) for r in fires]).alias("fire"))


@query(
    """, t as (select k, (k % 40) || 'h ' || (k % 60) || ' minutes ' || (k % 9) || '.5s' as text from x where k % 5 <> 0
    union all select k, k || ' fortnights' from x where k % 5 = 0)
  select k, text, case when k % 5 <> 0 then (k % 40) * 3600000 + (k % 60) * 60000 + (k % 9) * 1000 + 500 end ms from t"""
)
def duration_parse(spark, d):
    k = F.col("k")
    written = F.when(k % 5 == 0, F.concat(k, F.lit(" fortnights"))).otherwise(
        F.concat(k % 40, F.lit("h "), k % 60, F.lit(" minutes "), k % 9, F.lit(".5s"))
    )
    return X(spark, d).select("k", written.alias("text")).withColumn("ms", temporal.duration_ms(F.col("text")))


@query(
    """select workflow_id, seq, least(1000 * pow(2.0, attempts - 1), case when seq % 2 = 0 then 3000.0 end) backoff,
    attempts < case when seq % 4 > 0 then seq % 4 else 1 end again from a"""
)
def backoff_schedule(spark, d):
    wait = temporal.backoff_ms(
        F.col("attempts"), F.lit(1000), F.lit(2.0), F.when(F.col("seq") % 2 == 0, F.lit(3000.0))
    )
    again = temporal.should_retry(F.col("attempts"), F.col("seq") % 4)
    return bridge.attempts(spark, d).select("workflow_id", "seq", wait.alias("backoff"), again.alias("again"))


@query(
    """select k, case when k % 5 > 1 then (k % 5) * 1000 when k % 5 = 0 then null when k % 3 > 0 then null else 600000 end deadline
  from x"""
)
def effective_timeout(spark, d):
    k = F.col("k")
    given = F.when(k % 5 != 1, (k % 5) * 1000)
    return X(spark, d).select("k", temporal.effective_timeout(given, (k % 3) * 1000).alias("deadline"))


# -- spans --------------------------------------------------------------------


@query(
    """select workflow_id, seq, min(ts) filter (type = 'activityStarted') - min(ts) filter (type = 'activityScheduled') queue_ms,
    min(ts) filter (type in ('activityCompleted', 'activityFailed')) - max(ts) filter (type = 'activityStarted') run_ms
  from h where type like 'activity%' group by 1, 2"""
)
def span_queue_vs_run(spark, d):
    return spans.activity_spans(H(spark, d)).select("workflow_id", "seq", "queue_ms", "run_ms")


@query(
    """, p as (select *, event_id % 2 cond_seq, lead(type) over q next_type, lead(ts) over q next_ts from e
    where type in ('conditionParked', 'conditionUnparked') window q as (partition by key, event_id % 2 order by ts, event_id))
  select key, cond_seq, event_id, ts, case when next_type = 'conditionUnparked' then next_ts - ts end parked_ms
  from p where type = 'conditionParked'"""
)
def span_parked(spark, d):
    events = bridge.stream_events(spark, d)
    return spans.parked_spans(events.withColumn("cond_seq", F.col("event_id") % 2))


@query(
    """, p as (select *, lead(type) over q next_type, lead(ts) over q next_ts from e
    where type in ('conditionParked', 'conditionUnparked') window q as (partition by key, event_id % 2 order by ts, event_id))
  select key, event_id % 2 cond_seq, event_id, ts, case when next_type = 'conditionUnparked' then next_ts - ts end parked_ms
  from p where type = 'conditionParked' and event_id % 3 = 0"""
)
def span_approval(spark, d):
    """Every third park waits for an approval."""
    events = bridge.stream_events(spark, d).withColumns(
        {"cond_seq": F.col("event_id") % 2, "awaiting": F.when(F.col("event_id") % 3 == 0, "approval").otherwise("signal")}
    )
    return spans.approval_waits(events)


@query(
    """, u as (select *, row_number() over (partition by key order by ts, event_id) nth from e where type = 'conditionParked'),
  g as (select *, row_number() over (partition by key order by ts, event_id) nth from e where type = 'signal')
  select u.key, u.nth, u.event_id wait_id, g.event_id signal_id, g.value,
    case when g.event_id is not null then greatest(u.ts, g.ts) end taken_at
  from u left join g using (key, nth)"""
)
def signals_answered(spark, d):
    """Parks stand for waits."""
    events = bridge.stream_events(spark, d)
    return spans.answered(events.where("type = 'conditionParked'"), events.where("type = 'signal'"))


@query(
    """, r as (select *, row_number() over (partition by key order by ts, event_id) n from e where type = 'signal')
  select key, event_id, ts, value from r where n = 1"""
)
def first_decision(spark, d):
    return spans.first_decision(bridge.stream_events(spark, d), "signal")


@query(
    """, r as (select key, event_id % 2 seq, event_id, ts, type from e)
  select key, seq, event_id, (select min(s.ts) from r s where s.type = 'signal' and s.key = r.key and s.seq = r.seq
    and (s.ts, s.event_id) > (r.ts, r.event_id)) - ts gap_ms
  from r where type = 'activityRetryScheduled'"""
)
def span_retry_gap(spark, d):
    """Signals stand for starts, which the stream has none of."""
    events = bridge.stream_events(spark, d).withColumns(
        {"seq": F.col("event_id") % 2, "type": F.when(F.col("type") == "signal", "activityStarted").otherwise(F.col("type"))}
    )
    return spans.retry_gaps(events)


# -- differences and duplicates -----------------------------------------------


@query("select event_id, key, (select max(event_id) from e) as mark from e where event_id > 4000")
def differ_by_cursor(spark, d):
    added, mark = differ.by_cursor(bridge.stream_events(spark, d), "event_id", 4000)
    return added.select("event_id", "key", F.lit(mark).cast("long").alias("mark"))


@query(
    """, b as (select distinct workflow_id from x where k % 3 <> 0), n as (select distinct workflow_id from x where k % 4 <> 0)
  select 'added' change, workflow_id from n anti join b using (workflow_id)
  union all select 'removed', workflow_id from b anti join n using (workflow_id)"""
)
def differ_by_id(spark, d):
    x = X(spark, d)
    added, removed, _ = differ.by_id(x.where("k % 3 <> 0"), x.where("k % 4 <> 0"), "workflow_id")
    return added.select(F.lit("added").alias("change"), "workflow_id").union(
        removed.select(F.lit("removed"), "workflow_id")
    )


@query(
    """, r as (select *, row_number() over (partition by key, event_id // 10 order by ts, event_id) n from e where type = 'signal')
  select key, event_id // 10 as source, event_id, value from r where n = 1"""
)
def signal_dedup(spark, d):
    rows = bridge.stream_events(spark, d).where("type = 'signal'")
    rows = rows.select("key", F.expr("event_id div 10").alias("source"), "event_id", "ts", "value")
    first = differ.first_of(rows, ["key", "source"], ["ts", "event_id"])
    return first.select("key", "source", "event_id", "value")


@query(
    """, r as (select *, row_number() over (partition by workflow_id, seq % 3 order by pos) nth from h
    where type in ('activityCompleted', 'activityFailed'))
  select workflow_id, seq % 3 as slot, pos, nth from r where nth > 1"""
)
def late_completion_drop(spark, d):
    """Completions behind the first of their slot."""
    rows = H(spark, d).where(F.col("type").isin("activityCompleted", "activityFailed"))
    late = differ.dropped(rows.withColumn("slot", F.col("seq") % 3), ["workflow_id", "slot"], ["pos"])
    return late.select("workflow_id", "slot", "pos", "nth")


@query(
    """, b as (select distinct key, event_id % 50 site from e where type = 'conditionParked'),
  n as (select distinct key, event_id % 50 site from e where type = 'conditionUnparked')
  select key, site, 'conditionUnparked' change, 0 step from b anti join n using (key, site)
  union all select key, site, 'conditionParked', 1 from n anti join b using (key, site)"""
)
def parked_transition(spark, d):
    e = bridge.stream_events(spark, d).withColumn("site", F.col("event_id") % 50)
    stored, now = (e.where(F.col("type") == t).select("key", "site") for t in ("conditionParked", "conditionUnparked"))
    return differ.parked_transition(stored, now, ["key", "site"])


@query(
    """, p as (select key, event_id, ts % 1000 item, lag(ts % 1000) over (partition by key order by event_id) previous from e)
  select key, event_id, item, previous from p where previous >= item"""
)
def trigger_order_problems(spark, d):
    e = bridge.stream_events(spark, d).select(
        "key", "event_id", F.col("event_id").alias("position"), (F.col("ts") % 1000).alias("item")
    )
    return differ.trigger_problems(e, "key", "item").select("key", "event_id", "item", "previous")


@query("select key, event_id // 100 as batch, count(*) deliveries from e group by 1, 2 having count(*) > 1")
def retry_safety(spark, d):
    e = bridge.stream_events(spark, d).select("key", F.expr("event_id div 100").alias("batch"))
    return differ.effects(e, ["key", "batch"])


# -- validation, names --------------------------------------------------------


def dealt_events(spark, d):
    """The events, dealt out to all cores: one file feeds few tasks, and the expressions below are costly."""
    return bridge.stream_events(spark, d).repartition(spark.sparkContext.defaultParallelism)


PROPS = schema.obj({"k": schema.integer(low=10, high=80)})


@query(
    """select event_id, case when (props::json->>'$.k')::int < 10 then '$.k: too small'
    when (props::json->>'$.k')::int > 80 then '$.k: too large' end issue from e"""
)
def schema_validate_rows(spark, d):
    e = dealt_events(spark, d)
    return e.select("event_id", schema.first_issue(F.col("props"), PROPS).alias("issue"))


@query(
    """select event_id, case when event_id % 2 = 0 then '$.extra,$.inner.z' else '$.inner.z' end problems from e"""
)
def json_schema_strict_problems(spark, d):
    shape = schema.obj({"k": schema.integer(), "inner": schema.obj({"a": schema.integer(optional=True)})})
    e = dealt_events(spark, d)
    inner = F.lit(', "inner": {"a": 1, "z": 2}')
    more = F.when(F.col("event_id") % 2 == 0, F.lit(', "extra": true')).otherwise(F.lit(""))
    made = F.concat(F.expr("rtrim('}', props)"), inner, more, F.lit("}"))
    return e.select("event_id", F.array_join(schema.strict_problems(made, shape), ",").alias("problems"))


LISTS = schema.obj(
    {
        "xs": schema.array(schema.integer(low=1, high=4)),
        "u": schema.union(schema.literal("on"), schema.integer(low=5)),
        "d": schema.defaulted(schema.integer(), 9),
    }
)


def lists(spark, d):
    """JSON with lists of which some elements are too small or large, and a union."""
    i = F.col("event_id")
    u = F.when(i % 2 == 0, F.lit('"on"')).otherwise((i % 11).cast("string"))
    made = F.concat(F.lit('{"z": 0, "xs": ['), i % 5, F.lit(", "), i % 7, F.lit('], "u": '), u, F.lit("}"))
    return dealt_events(spark, d).select("event_id", made.alias("json"))


@query(
    """select event_id, case when event_id % 5 < 1 then '$.xs[0]: too small' when event_id % 7 < 1 then '$.xs[1]: too small'
    when event_id % 7 > 4 then '$.xs[1]: too large' when event_id % 2 = 1 and event_id % 11 < 5 then '$.u: fits none of the branches' end issue from e"""
)
def schema_list_issues(spark, d):
    return lists(spark, d).select("event_id", schema.first_issue(F.col("json"), LISTS).alias("issue"))


@query(
    """select event_id, case when event_id % 5 >= 1 and event_id % 7 between 1 and 4 and (event_id % 2 = 0 or event_id % 11 >= 5) then
    '{"xs":[' || (event_id % 5) || ',' || (event_id % 7) || '],"u":' || case when event_id % 2 = 0 then '"on"' else (event_id % 11)::varchar end || ',"d":9}'
    end shaped from e"""
)
def schema_shaped(spark, d):
    return lists(spark, d).select("event_id", schema.shaped(F.col("json"), LISTS).alias("shaped"))


@query("select event_id, null::varchar problem from e")
def schema_round_trip(spark, d):
    return lists(spark, d).select("event_id", schema.round_trip_problem(F.col("json"), LISTS).alias("problem"))


@query("select event_id, case when event_id % 3 = 0 then '$.xs[1].b' else '' end problems from e")
def schema_strict_lists(spark, d):
    shape = schema.obj({"xs": schema.array(schema.obj({"a": schema.unknown()}))})
    name = F.when(F.col("event_id") % 3 == 0, "b").otherwise("a")
    made = F.concat(F.lit('{"xs": [{"a": 1}, {"'), name, F.lit('": 2}]}'))
    e = dealt_events(spark, d)
    return e.select("event_id", F.array_join(schema.strict_problems(made, shape), ",").alias("problems"))


@query(
    """select k, case k % 6 when 0 then k * 1 when 1 then k * 1000 when 2 then k * 60000 when 3 then k * 3600000 end ms from x"""
)
def connector_durations(spark, d):
    k = F.col("k")
    units = F.array(*map(F.lit, ("ms", " secs", "minutes ", "  hour", "d", "MS")))
    text_ = F.concat(k.cast("string"), F.get(units, (k % 6).cast("int")))
    return X(spark, d).select("k", temporal.connector_ms(text_).alias("ms"))


@query("select k, k % 8 in (4, 5, 7) again from x")
def connector_retryable(spark, d):
    k = F.col("k")
    kinds = F.array(*map(F.lit, ("invalid", "notFound", "conflict", "denied", "unavailable", "upstream", "drift", "other")))
    return X(spark, d).select("k", text.retryable(F.get(kinds, (k % 8).cast("int"))).alias("again"))


@query("select coalesce(max(try_cast(regexp_extract(workflow_id, '-(\\d+)$', 1) as bigint)), 0) top from x where status <> 'running'")
def highest_id_suffix(spark, d):
    rows = X(spark, d).where("status <> 'running'")
    return rows.agg(F.coalesce(F.max(text.id_suffix(F.col("workflow_id"))), F.lit(0)).alias("top"))


@query("select k, regexp_replace(task_queue || '/' || workflow_id, '[^a-zA-Z0-9._-]', '_', 'g')[:64] || '-' || sha1(task_queue || '/' || workflow_id)[:8] file from x")
def file_names(spark, d):
    return X(spark, d).select("k", text.file_name(F.concat_ws("/", "task_queue", "workflow_id")).alias("file"))


@query(
    """, sc as (select distinct 'order-' || (k // 100) as schedule from x)
  select schedule, workflow_id from sc join x on starts_with(workflow_id, schedule || '-') or workflow_id = schedule"""
)
def schedule_runs(spark, d):
    """Runs of a schedule: its own id here; a prefix match without a cross join."""
    x = X(spark, d)
    schedules = x.select(F.concat(F.lit("order-"), F.expr("k div 100")).alias("schedule")).distinct()
    # every prefix of an id that ends before a dash, and the id itself, is a schedule's candidate
    parts = F.split("workflow_id", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    return x.select("workflow_id", F.explode(prefixes).alias("schedule")).join(schedules, "schedule").select(
        "schedule", "workflow_id"
    )


# -- queues, claims, commands -------------------------------------------------


@query(
    """, q as (select event_id, 'req-' || (user_id // 2) workflow_id, event_type as name, props, epoch_us(ts) order_key from events),
  f as (select workflow_id, arg_min({n: name, p: props}, order_key) h, min(order_key) k from q group by 1)
  select event_id, order_key = k created, name = h.n and props = h.p same_request from q join f using (workflow_id)"""
)
def start_claims(spark, d):
    e = bridge.read(spark, d, "events")
    rows = e.select(
        "event_id",
        F.concat(F.lit("req-"), F.expr("user_id div 2")).alias("workflow_id"),
        F.col("event_type").alias("name"),
        "props",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("order_key"),
    )
    return dispatch.start_claims(rows).select("event_id", "created", "same_request")


ITEMS = f""", i as (select x.task_queue, s.k * 1000 + s.seq item, s.ts enqueued, 'worker-' || (s.part_key % 40) as holder,
    case when s.quantity % 3 = 0 then s.ts + s.quantity * {bridge.DAY_MS} end deadline from s join x using (k) where s.flag = 'N')
"""


def items(spark, d):
    x = X(spark, d).select("k", "task_queue")
    rows = bridge.steps(spark, d).where("flag = 'N'").join(x, "k")
    held = F.when(F.col("quantity") % 3 == 0, F.col("ts") + F.col("quantity") * bridge.DAY_MS)
    return rows.select(
        "task_queue", (F.col("k") * 1000 + F.col("seq")).alias("item"), F.col("ts").alias("enqueued"),
        F.concat(F.lit("worker-"), F.col("part_key") % 40).alias("holder"), held.alias("deadline"),
    )


@query(
    ITEMS + f""", r as (select *, row_number() over (partition by task_queue order by deadline is null, enqueued, item) n
    from i where deadline is null or deadline <= {CUTOFF})
  select task_queue, item, enqueued, deadline is not null lapsed from r where n = 1"""
)
def queue_heads(spark, d):
    return dispatch.queue_heads(items(spark, d), CUTOFF)


@query(ITEMS + f"select task_queue, count(*) waiting from i where deadline is null or deadline <= {CUTOFF} group by 1")
def lease_backlog(spark, d):
    return dispatch.backlog(items(spark, d), CUTOFF)


@query(ITEMS + f"select distinct holder from i where deadline > {CUTOFF}")
def lease_holders(spark, d):
    return dispatch.holders(items(spark, d), CUTOFF)


@query(
    LATEST + ITEMS + f""", g as (select distinct holder from i where deadline > {CUTOFF})
  select task_queue, role, identity, polled_at from u where polled_at < {NOW_SQL} - 3600000 and identity not in (select holder from g)"""
)
def forgotten_workers(spark, d):
    polls = bridge.polls(spark, d)
    rows = dispatch.forgotten(liveness.latest(polls), dispatch.holders(items(spark, d), CUTOFF), poll_now(polls), 3_600_000)
    return rows.select("task_queue", "role", "identity", "polled_at")


def commands(spark, d):
    """What a changed workflow would ask for: other kinds at some numbers, nothing at others."""
    s = bridge.steps(spark, d).where("seq % 7 <> 6")
    kind = F.when(F.col("seq") % 5 == 4, "timer").otherwise(F.col("kind"))
    return s.select(bridge.workflow_id(F.col("k")).alias("workflow_id"), "seq", kind.alias("kind"))


@query("select 'order-' || k workflow_id, seq, kind, 'timer' wanted from s where seq % 7 <> 6 and seq % 5 = 4 and kind <> 'timer'")
def command_mismatches(spark, d):
    history = H(spark, d).where(F.col("type").isin("activityScheduled", "timerStarted"))
    return dispatch.mismatches(pending.markers(history), commands(spark, d))


@query(
    "select 'order-' || k workflow_id, min(seq) seq, min(seq) * 4 pos from s where seq % 7 = 6 and flag = 'N' group by 1"
)
def never_issued(spark, d):
    waiting = pending.pending(H(spark, d)).where("kind <> 'child'")
    return dispatch.never_issued(waiting, commands(spark, d))


@query(
    """, r as (select key, event_id, row_number() over (partition by key order by ts desc, event_id desc) n from e)
  select key, array_to_string(list(event_id order by n), ',') newest from r where n <= 20 group by 1"""
)
def newest_runs(spark, d):
    rows = dispatch.newest(bridge.stream_events(spark, d), "key", ["ts", "event_id"], "event_id")
    return rows.withColumn("newest", F.array_join(F.col("newest").cast("array<string>"), ","))


@query(
    "select key, sum(length(props))::bigint size, arg_max(event_id, (length(props), event_id)) largest from e group by 1 having sum(length(props)) > 500"
)
def carryover_oversize(spark, d):
    return dispatch.oversize(bridge.stream_events(spark, d), "key", "event_id", "props", cap=500)


@query(
    """, o as (select p_brand || '/' || p_type operation, p_size from part)
  select distinct operation from o where p_size % 5 <> 0 and operation not in (select operation from o where p_size > 45)"""
)
def uncovered_operations(spark, d):
    p = bridge.read(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("operation"), "p_size")
    return dispatch.uncovered(p.withColumn("unsafe", F.col("p_size") % 5 == 0), p.where("p_size > 45"))


@query(
    """, g as (select *, row_number() over (partition by key order by ts, event_id) n from e where type = 'activityRetryScheduled')
  select key, event_id, n from g where n & (n - 1) = 0"""
)
def reported_failures(spark, d):
    """Of a key's failures the 1st, 2nd, 4th, 8th and so on are reported."""
    from pyspark.sql import Window

    rows = bridge.stream_events(spark, d).where("type = 'activityRetryScheduled'")
    n = F.row_number().over(Window.partitionBy("key").orderBy("ts", "event_id"))
    return rows.withColumn("n", n.cast("long")).where(text.is_power_of_two(F.col("n"))).select("key", "event_id", "n")


@query(
    """select k, case when every < 1 and nb >= na then 'every must be at least 1 ms; the bounds leave no time'
    when every < 1 then 'every must be at least 1 ms' when nb >= na then 'the bounds leave no time' else '' end problems
  from (select k, k % 3 every, k % 11 nb, k % 7 na from x)"""
)
def schedule_spec_problems(spark, d):
    k = F.col("k")
    return X(spark, d).select("k", F.array_join(temporal.spec_problems(k % 3, k % 11, k % 7), "; ").alias("problems"))


@query(
    REPORTS + "select task_queue, identity, sha256(to_json(list_sort(list(distinct name))))[:16] digest from r group by 1, 2"
)
def report_digests(spark, d):
    rows = reports(spark, d).groupBy("task_queue", "identity").agg(F.collect_set("name").alias("names"))
    return rows.select("task_queue", "identity", liveness.report_digest(F.col("names")).alias("digest"))


@query(
    """select k, case when c in (401, 403) then 'auth' when c = 404 then 'not_found' when c = 409 then 'conflict'
    when c = 429 then 'rate_limited' when c >= 500 then 'unavailable' else 'invalid' end kind from (select k, 400 + k % 120 c from x)"""
)
def http_status_kinds(spark, d):
    return X(spark, d).select("k", text.status_kind(400 + F.col("k") % 120).alias("kind"))


@query("select k, coalesce(case when k % 3 = 0 then 'own' end, case when k % 2 = 0 then task_queue end, 'default') queue from x")
def inherited_queue(spark, d):
    own, execution = F.when(F.col("k") % 3 == 0, "own"), F.when(F.col("k") % 2 == 0, F.col("task_queue"))
    return X(spark, d).select("k", dispatch.queue_of(own, execution).alias("queue"))


# -- streams ------------------------------------------------------------------


def _events(spark, d):
    """``events`` as a stream in the shape of the bridge."""
    schema_ = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema_).option("pathGlobFilter", "events.parquet").parquet(d)
    kinds = {"signup": "signal", "view": "conditionParked", "click": "conditionUnparked", "purchase": "activityCompleted"}
    kind = F.lit("activityRetryScheduled")
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    return rows.select(
        "event_id", F.col("user_id").alias("key"), bridge.millis(F.col("ts")).alias("ts"), kind.alias("type"), "value"
    )


@query("select distinct key, event_id, ts, value from e where type = 'signal'")
def stream_signals(spark, d):
    return jobs.drained(jobs.signals(_events(spark, d)))


@query("select event_id, key, type from e where event_id > 4000")
def stream_watcher(spark, d):
    return jobs.drained(_events(spark, d).where("event_id > 4000").select("event_id", "key", "type"))


@query(
    """, g as (select *, count(*) filter (type = 'activityCompleted') over (partition by key order by ts, event_id) run
    from e where type in ('activityCompleted', 'activityRetryScheduled')),
  n as (select *, row_number() over (partition by key, run order by ts, event_id) attempt from g where type = 'activityRetryScheduled')
  select key, event_id, attempt, least(100 * pow(2, least(attempt - 1, 60)), 30000)::bigint wait_ms,
    ts + least(100 * pow(2, least(attempt - 1, 60)), 30000)::bigint fire_at from n"""
)
def stream_retry_timers(spark, d):
    return jobs.drained(jobs.retry_timers(_events(spark, d)))


@query(
    """, m as (select *, max(ts) over (partition by key order by event_id % 3 range between unbounded preceding and 1 preceding) mark from e)
  select event_id, key, ts from m where mark is null or ts > mark"""
)
def stream_beyond_mark(spark, d):
    """The events come in three runs of a watcher, each of which goes on from the last one's marks."""
    base, rows = jobs.folder(spark), bridge.stream_events(spark, d).select("event_id", "key", "ts")
    for n in range(3):
        rows.where(F.col("event_id") % 3 == n).write.mode("append").parquet(f"{base}/in")
        new = jobs.beyond_mark(jobs.stream(spark, f"{base}/in", files_at_once=1_000_000), "ts")  # a run is one batch
        out = jobs.drained(new, base=base)
    return out


@query(
    f""", g as (select key, ts, lag(ts) over (partition by key order by ts) before from e),
  n as (select *, count(*) filter (before is null or ts - before > {bridge.DAY_MS}) over (partition by key order by ts rows unbounded preceding) nth from g),
  r as (select key, count(*) beats, max(ts) last_beat from n group by key, nth)
  select key, beats, last_beat, last_beat + {bridge.DAY_MS} expired_at from r where last_beat + {bridge.DAY_MS} <= (select max(ts) from e)"""
)
def stream_silences(spark, d):
    """Keys that are silent for a day."""
    return jobs.drained(jobs.silences(_events(spark, d), bridge.DAY_MS))


@query(
    f""", t as (select event_id // 3 timer, ts, case when event_id % 3 < 2 then 'timerStarted' else 'timerCanceled' end as type,
    ts + event_id % 40 * {bridge.DAY_MS} fire_at from e where event_id % 3 < 2 or event_id % 5 = 0),
  f as (select timer, arg_min(fire_at, (ts, fire_at)) filter (type = 'timerStarted') fire_at,
    min(ts) filter (type = 'timerCanceled') canceled from t group by 1)
  select timer, fire_at from f where (canceled is null or canceled >= fire_at) and fire_at < (select max(ts) from t)"""
)
def stream_timers_fired(spark, d):
    """Three events to a timer: two starts and, in every fifth place, a cancellation."""
    n = F.col("event_id")
    rows = _events(spark, d).where((n % 3 < 2) | (n % 5 == 0)).select(
        F.expr("event_id div 3").alias("timer"), "ts",
        F.when(n % 3 < 2, "timerStarted").otherwise("timerCanceled").alias("type"),
        (F.col("ts") + n % 40 * bridge.DAY_MS).alias("fire_at"),
    )
    return jobs.drained(jobs.fired(rows))
