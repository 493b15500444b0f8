"""Spans between events: waiting, running, parked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def activity_spans(history: DataFrame) -> DataFrame:
    """Per activity: time from scheduled to first start, and from last start to completion."""
    kinds = ("activityScheduled", "activityStarted", "activityCompleted", "activityFailed")
    at = lambda *t, f=F.min: f(F.when(F.col("type").isin(*t), F.col("ts")))
    rows = history.where(F.col("type").isin(*kinds)).groupBy("workflow_id", "run_id", "seq").agg(
        at("activityScheduled").alias("scheduled"),
        at("activityStarted").alias("first"),
        at("activityStarted", f=F.max).alias("last"),
        at("activityCompleted", "activityFailed").alias("done"),
    )
    return rows.select(
        "workflow_id", "run_id", "seq",
        (F.col("first") - F.col("scheduled")).alias("queue_ms"),
        (F.col("done") - F.col("last")).alias("run_ms"),
    )


def parked_spans(
    events: DataFrame, keys: tuple[str, ...] = ("key", "cond_seq"), keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per park: the time until the next event of the same condition that ends it; null while
    parked.  A condition may park again under its number.  ``keep`` are columns of the park."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    rows = events.where(F.col("type").isin("conditionParked", "conditionUnparked")).withColumns(
        {"next_type": F.lead("type").over(w), "next_ts": F.lead("ts").over(w)}
    )
    ended = F.when(F.col("next_type") == "conditionUnparked", F.col("next_ts") - F.col("ts"))
    return rows.where("type = 'conditionParked'").select(*keys, *keep, "event_id", "ts", ended.alias("parked_ms"))


def approval_waits(events: DataFrame, keys: tuple[str, ...] = ("key", "cond_seq")) -> DataFrame:
    """Parks that wait for an approval, by the park's ``awaiting``."""
    return parked_spans(events, keys, ("awaiting",)).where("awaiting = 'approval'").drop("awaiting")


def answered(waits: DataFrame, signals: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Signals kept until they are asked for: a key's n-th wait takes its n-th signal.

    Gives each wait the signal's event_id and value and the instant at which both
    are there; null while it waits.
    """
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    nth = F.row_number().over(w)
    asked = waits.select(*keys, F.col("event_id").alias("wait_id"), F.col("ts").alias("_asked"), nth.alias("nth"))
    given = signals.select(*keys, F.col("event_id").alias("signal_id"), F.col("ts").alias("_given"), "value", nth.alias("nth"))
    at = F.when(F.col("signal_id").isNotNull(), F.greatest("_asked", "_given"))
    rows = asked.join(given, [*keys, "nth"], "left")
    return rows.select(*keys, "nth", "wait_id", "signal_id", "value", at.alias("taken_at"))


def first_decision(events: DataFrame, kind: str) -> DataFrame:
    """The first event of a kind of each key: the writer that wins."""
    rows = events.where(F.col("type") == kind)
    return rows.groupBy("key").agg(F.min_by(F.struct("event_id", "ts", "value"), F.struct("ts", "event_id")).alias("f")).select(
        "key", "f.event_id", "f.ts", "f.value"
    )


def retry_gaps(events: DataFrame, keys: tuple[str, ...] = ("key", "seq")) -> DataFrame:
    """Per retry: the time until the activity starts next; null where it doesn't."""
    # from the back, so that a frame only grows
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.last(F.when(F.col("type") == "activityStarted", F.col("ts")), ignorenulls=True).over(w)
    rows = events.where(F.col("type").isin("activityRetryScheduled", "activityStarted"))
    rows = rows.withColumn("gap_ms", start - F.col("ts"))
    return rows.where("type = 'activityRetryScheduled'").select(*keys, "event_id", "gap_ms")
