"""Execution, history and worker tables made from the test tables.

The bridge renames columns of ``orders``, ``customer``, ``lineitem``, ``part`` and
``events`` into the shape of executions and their event histories.  It is a
fixture of this repository; operators take any tables of that shape.  ``CTE`` is
the same in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed instants that queries use in place of a clock (epoch milliseconds).
NOW_MS = 1_000_000_000_000
HOUR_MS, DAY_MS = 3_600_000, 86_400_000
#: Steps that a task numbers at a time, about, whatever the size of the input.
PART_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for work on whole histories: so many that a task sorts about ``PART_ROWS`` steps at a time."""
    # a count without conditions reads the files' footers only
    return max(spark.sparkContext.defaultParallelism, read(spark, sf_dir, "lineitem").count() // PART_ROWS + 1)


def millis(column: Column) -> Column:
    """Epoch milliseconds of a time without zone, taken as UTC."""
    return F.unix_millis(column.cast("timestamp"))


def workflow_id(key: Column) -> Column:
    return F.concat(F.lit("order-"), key.cast("string"))


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per execution: identity, status, times, failures, parent."""
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "running")
        .when(k % 4 == 0, "terminated")
        .otherwise("failed")
    )
    child = (k >= 10) & (k % 10 != 0)
    x = o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("k"),
        workflow_id(k).alias("workflow_id"),
        F.lit(0).alias("run_id"),
        F.col("c_mktsegment").alias("name"),
        F.col("o_orderpriority").alias("task_queue"),
        status.alias("status"),
        millis(F.col("o_orderdate")).alias("created_at"),
        (k % 3).cast("int").alias("task_failures"),
        F.when(child, workflow_id(F.floor(k / 10))).alias("parent_id"),
        F.when(child, k % 10).alias("parent_seq"),
    )
    closed = (F.col("status") != "running") & (F.col("k") % 5 != 0)
    return x.withColumn(
        "closed_at", F.when(closed, F.col("created_at") + (F.col("k") % 30 + 1) * DAY_MS)
    )


def steps(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """One row per dispatched step of an execution, in a total order (seq from 0).

    With ``of`` only the steps of its executions are numbered.
    """
    order = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    ]
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    # the key has its final name before it is numbered, so that conditions on it reach the scan
    line = line.withColumnRenamed("l_orderkey", "k")
    if of is not None:
        line = line.join(of, workflow_id(F.col("k")) == of.workflow_id, "left_semi")
    else:
        line = line.repartition(parts(spark, sf_dir), "k")
    seq = F.row_number().over(Window.partitionBy("k").orderBy(*order)) - 1
    return line.select(
        "k",
        seq.cast("long").alias("seq"),
        F.when(F.col("l_linestatus") == "O", "activity").otherwise("timer").alias("kind"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_partkey").alias("part_key"),
        F.floor("l_quantity").cast("long").alias("quantity"),
        millis(F.col("l_shipdate")).alias("ts"),
    )


def history(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(workflow_id, run_id, pos, ts, type, seq, child_id, error): all events of all executions.

    Steps give a dispatch marker, a start (activities), and a completion unless
    they are pending; children give a marker and, mostly, an outcome.  ``of``, ids
    of executions, keeps others out before anything is shuffled.
    """
    s = steps(spark, sf_dir, of)
    activity, done = F.col("kind") == "activity", F.col("flag") != "N"
    end = F.col("ts") + F.col("quantity") * 60_000 + 1000
    failed = activity & (F.col("flag") == "A")

    def event(offset: int, ts: Column, kind: Column, error: Column = F.lit(None)) -> Column:
        return F.struct(
            (F.col("seq") * 4 + offset).alias("pos"),
            ts.cast("long").alias("ts"),
            kind.alias("type"),
            error.cast("string").alias("error"),
        )

    none = F.array().cast("array<struct<pos:bigint,ts:bigint,type:string,error:string>>")
    outcome = F.when(failed, "activityFailed").when(activity, "activityCompleted").otherwise("timerFired")
    error = F.when(failed, F.concat(F.lit("error "), F.col("part_key") % 7))
    # arrays without nulls: a filter behind explode would keep conditions above the window
    events = F.concat(
        F.array(event(0, F.col("ts"), F.when(activity, "activityScheduled").otherwise("timerStarted"))),
        F.when(
            activity, F.array(event(1, F.col("ts") + F.col("seq") * 500 + 250, F.lit("activityStarted")))
        ).otherwise(none),
        F.when(done, F.array(event(3, end, outcome, error))).otherwise(none),
    )
    own = s.select("k", "seq", F.explode(events).alias("e"))
    own = own.select(
        workflow_id(F.col("k")).alias("workflow_id"),
        F.lit(0).alias("run_id"),
        "e.pos",
        "e.ts",
        "e.type",
        "seq",
        F.lit(None).cast("string").alias("child_id"),
        "e.error",
    )
    c = executions(spark, sf_dir).where("parent_id is not null")
    if of is not None:
        c = c.join(of, c.parent_id == of.workflow_id, "left_semi")
    settled = (F.col("status") != "running") & (F.col("k") % 3 != 0)
    parts = F.array(
        F.struct(
            (F.lit(1_000_000) + F.col("parent_seq") * 2).alias("pos"),
            F.col("created_at").alias("ts"),
            F.lit("childStarted").alias("type"),
        ),
        F.when(
            settled,
            F.struct(
                (F.lit(1_000_001) + F.col("parent_seq") * 2).alias("pos"),
                F.coalesce("closed_at", "created_at").alias("ts"),
                F.when(F.col("status") == "completed", "childCompleted").otherwise("childFailed").alias("type"),
            ),
        ),
    )
    children = (
        c.select("parent_id", "parent_seq", "workflow_id", F.explode(parts).alias("e"))
        .where("e is not null")
        .select(
            F.col("parent_id").alias("workflow_id"),
            F.lit(0).alias("run_id"),
            "e.pos",
            "e.ts",
            "e.type",
            F.col("parent_seq").alias("seq"),
            F.col("workflow_id").alias("child_id"),
            F.lit(None).cast("string").alias("error"),
        )
    )
    return own.unionByName(children)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retry state of activities that have not settled: name, attempts, last error, next attempt."""
    s = steps(spark, sf_dir).where("kind = 'activity' and flag = 'N'")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    q = F.col("quantity")
    return s.join(p, s.part_key == p.p_partkey, "left").select(
        workflow_id(F.col("k")).alias("workflow_id"),
        "seq",
        F.col("p_type").alias("name"),
        (1 + q % 3).cast("int").alias("attempts"),
        F.when(q % 4 != 0, F.concat(F.lit("error "), F.col("part_key") % 5)).alias("last_error"),
        F.when(q % 2 == 0, F.col("ts") + q * 1000).alias("next_attempt_at"),
    )


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker polls from ``events``: (polled_at, task_queue, role, identity, busy, serves)."""
    e = read(spark, sf_dir, "events")
    user = F.col("user_id")
    return e.select(
        "event_id",
        millis(F.col("ts")).alias("polled_at"),
        F.when(user % 11 == 0, "*").otherwise(F.concat(F.lit("queue-"), user % 7)).alias("task_queue"),
        F.when(F.col("event_type").isin("view", "click"), "workflow").otherwise("activity").alias("role"),
        F.when(user % 13 != 0, F.concat(F.lit("worker-"), user)).alias("identity"),
        (F.col("event_id") % 3 == 0).alias("busy"),
        F.when(user % 5 != 0, F.array(F.concat(F.lit("name-"), user % 4), F.concat(F.lit("name-"), user % 6))).alias("serves"),
    )


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a keyed event stream: (event_id, key, ts, type, value)."""
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("key"),
        millis(F.col("ts")).alias("ts"),
        F.when(F.col("event_type") == "signup", "signal")
        .when(F.col("event_type") == "view", "conditionParked")
        .when(F.col("event_type") == "click", "conditionUnparked")
        .when(F.col("event_type") == "purchase", "activityCompleted")
        .otherwise("activityRetryScheduled")
        .alias("type"),
        "value",
        "props",
    )


CTE = f"""
x as (
  select k, workflow_id, run_id, name, task_queue, status, created_at, task_failures, parent_id, parent_seq,
    case when status <> 'running' and k % 5 <> 0 then created_at + (k % 30 + 1) * {DAY_MS} end closed_at
  from (
    select o_orderkey k, 'order-' || o_orderkey workflow_id, 0 run_id, c_mktsegment as name,
      o_orderpriority task_queue,
      case when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'O' then 'running'
           when o_orderkey % 4 = 0 then 'terminated' else 'failed' end status,
      epoch_ms(o_orderdate) created_at, (o_orderkey % 3)::int task_failures,
      case when o_orderkey >= 10 and o_orderkey % 10 <> 0 then 'order-' || (o_orderkey // 10) end parent_id,
      case when o_orderkey >= 10 and o_orderkey % 10 <> 0 then o_orderkey % 10 end parent_seq
    from orders join customer on o_custkey = c_custkey)
), s as (
  select l_orderkey k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
      l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 seq,
    case when l_linestatus = 'O' then 'activity' else 'timer' end kind, l_returnflag flag,
    l_partkey part_key, floor(l_quantity)::bigint quantity, epoch_ms(l_shipdate) ts
  from lineitem
), h as (
  select 'order-' || k workflow_id, 0 run_id, seq * 4 pos, ts,
    case when kind = 'activity' then 'activityScheduled' else 'timerStarted' end as type, seq,
    null::varchar child_id, null::varchar error from s
  union all
  select 'order-' || k, 0, seq * 4 + 1, ts + seq * 500 + 250, 'activityStarted', seq, null, null
  from s where kind = 'activity'
  union all
  select 'order-' || k, 0, seq * 4 + 3, ts + quantity * 60000 + 1000,
    case when kind = 'activity' and flag = 'A' then 'activityFailed' when kind = 'activity' then 'activityCompleted'
         else 'timerFired' end, seq, null,
    case when kind = 'activity' and flag = 'A' then 'error ' || (part_key % 7) end
  from s where flag <> 'N'
  union all
  select parent_id, 0, 1000000 + parent_seq * 2, created_at, 'childStarted', parent_seq, workflow_id, null
  from x where parent_id is not null
  union all
  select parent_id, 0, 1000001 + parent_seq * 2, coalesce(closed_at, created_at),
    case when status = 'completed' then 'childCompleted' else 'childFailed' end, parent_seq, workflow_id, null
  from x where parent_id is not null and status <> 'running' and k % 3 <> 0
), a as (
  select 'order-' || k workflow_id, seq, p_type as name, (1 + quantity % 3)::int attempts,
    case when quantity % 4 <> 0 then 'error ' || (part_key % 5) end last_error,
    case when quantity % 2 = 0 then ts + quantity * 1000 end next_attempt_at
  from s left join part on part_key = p_partkey where kind = 'activity' and flag = 'N'
), w as (
  select event_id, epoch_us(ts) // 1000 polled_at, case when user_id % 11 = 0 then '*' else 'queue-' || (user_id % 7) end task_queue,
    case when event_type in ('view', 'click') then 'workflow' else 'activity' end as role,
    case when user_id % 13 <> 0 then 'worker-' || user_id end as identity,
    event_id % 3 = 0 busy,
    case when user_id % 5 <> 0 then ['name-' || (user_id % 4), 'name-' || (user_id % 6)] end serves
  from events
), e as (
  select event_id, user_id as key, epoch_us(ts) // 1000 ts,
    case event_type when 'signup' then 'signal' when 'view' then 'conditionParked' when 'click' then 'conditionUnparked'
      when 'purchase' then 'activityCompleted' else 'activityRetryScheduled' end as type, value, props
  from events
)
"""
