"""Work that has been dispatched and not completed, and the detail of an execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of work: the event that dispatches it and those that complete it.
MARKERS = {"activityScheduled": "activity", "timerStarted": "timer", "childStarted": "child"}
COMPLETIONS = {
    "activityCompleted": "activity", "activityFailed": "activity", "timerFired": "timer",
    "childCompleted": "child", "childFailed": "child",
}
HISTORY_CAP = 500
KEY = ["workflow_id", "run_id", "kind", "seq"]


def kind_of(kinds: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for event, kind in kinds.items():
        out = F.when(F.col("type") == event, kind).otherwise(out)
    return out


def markers(history: DataFrame) -> DataFrame:
    return history.where(F.col("type").isin(*MARKERS)).withColumn("kind", kind_of(MARKERS))


def completed(history: DataFrame) -> DataFrame:
    """Distinct (workflow_id, run_id, kind, seq) that have completed."""
    return history.where(F.col("type").isin(*COMPLETIONS)).withColumn("kind", kind_of(COMPLETIONS)).select(*KEY).distinct()


def pending(history: DataFrame, kind: str | None = None) -> DataFrame:
    """Markers without a completion of the same kind and number.

    One grouping instead of an anti-join: both sides are the same scan, so the
    history is shuffled once.
    """
    rows = history.where(F.col("type").isin(*MARKERS, *COMPLETIONS)).withColumn("kind", kind_of(MARKERS | COMPLETIONS))
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    marker = F.col("type").isin(*MARKERS)
    return (
        rows.groupBy(*KEY)
        .agg(
            F.count_if(~marker).alias("_done"),
            F.count_if(marker).alias("_sent"),
            F.min(F.when(marker, F.col("pos"))).alias("pos"),
            F.min(F.when(marker, F.col("ts"))).alias("since"),
            F.min(F.when(marker, F.col("child_id"))).alias("child_id"),
        )
        .where("_done = 0 and _sent > 0")
        .select(*KEY, "pos", "since", "child_id")
    )


def with_retry_state(pending_activities: DataFrame, attempts: DataFrame) -> DataFrame:
    """Pending activities with their attempt number (from 1), last error and next attempt."""
    state = attempts.select("workflow_id", "seq", "name", "attempts", "last_error", "next_attempt_at")
    return pending_activities.join(state, ["workflow_id", "seq"], "left").withColumn(
        "attempt", F.coalesce("attempts", F.lit(0)) + 1
    )


def with_checkpoint(pending_activities: DataFrame, beats: DataFrame) -> DataFrame:
    """Pending activities with the last value their current attempt left, and when.

    ``beats`` is (workflow_id, seq, attempt, ts, event_id, value).  A value goes with
    its attempt; of equal times the highest event id counts.
    """
    last = beats.groupBy("workflow_id", "seq", "attempt").agg(
        F.max_by(F.struct("value", "ts"), F.struct("ts", "event_id")).alias("_last")
    )
    rows = pending_activities.join(last, ["workflow_id", "seq", "attempt"], "left")
    return rows.withColumns({"checkpoint": F.col("_last.value"), "checkpoint_at": F.col("_last.ts")}).drop("_last")


def history_window(history: DataFrame, offset: int | None = None, limit: int = HISTORY_CAP) -> DataFrame:
    """Each execution's events ``offset`` to ``offset + limit``; the tail without an offset.

    The offset is clamped to the length, the limit to ``HISTORY_CAP``.
    """
    limit = min(limit, HISTORY_CAP)
    w = Window.partitionBy("workflow_id", "run_id")
    rows = history.withColumns(
        {"index": F.row_number().over(w.orderBy("pos")) - 1, "total": F.count("*").over(w)}
    )
    start = F.greatest(F.lit(0), F.col("total") - limit) if offset is None else F.least(F.lit(max(0, offset)), F.col("total"))
    return rows.where((F.col("index") >= start) & (F.col("index") < start + limit))


def detail(executions: DataFrame, history: DataFrame) -> DataFrame:
    """One row per execution: summary, pending counts while running, outcome once settled.

    The history is read once: events are grouped by the work they belong to, then by execution.
    """
    kinds = ("activity", "timer", "child")
    work = history.withColumn("kind", kind_of(MARKERS | COMPLETIONS)).groupBy(*KEY).agg(
        F.count("*").alias("_events"),
        F.count_if(F.col("type").isin(*MARKERS)).alias("_sent"),
        F.count_if(F.col("type").isin(*COMPLETIONS)).alias("_done"),
        F.max(F.when(F.col("error").isNotNull(), F.struct("pos", "error"))).alias("_last"),
    )
    waiting = (F.col("_sent") > 0) & (F.col("_done") == 0)
    mine = work.groupBy("workflow_id", "run_id").agg(
        F.sum("_events").alias("history_length"),
        F.max("_last").alias("_last"),
        *[F.count_if(waiting & (F.col("kind") == k)).alias(f"pending_{k}") for k in kinds],
    )
    rows = executions.join(mine, ["workflow_id", "run_id"], "left")
    running = F.col("status") == "running"
    shown = [
        F.when(running, F.coalesce(f"pending_{k}", F.lit(0))).otherwise(0).alias(f"pending_{k}")
        for k in kinds
    ]
    return rows.select(
        "workflow_id", "run_id", "name", "status", "task_queue", "parent_id",
        F.coalesce("history_length", F.lit(0)).alias("history_length"),
        *shown,
        F.when(F.col("status").isin("failed", "terminated"), F.col("_last.error")).alias("failure"),
    )


def outcomes(ids: DataFrame, executions: DataFrame) -> DataFrame:
    """The status of each asked id; an unknown one is running."""
    known = executions.select("workflow_id", "status", "closed_at")
    return ids.join(known, "workflow_id", "left").withColumn("status", F.coalesce("status", F.lit("running")))
