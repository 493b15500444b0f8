"""Structured Streaming jobs over event streams, run until their input is used up."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder (the warehouse where it is unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, oldest files first.

    The files of a batch bound what one key can bring at a time.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def drained(df: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run a stream over all input that there is, and read what it wrote.

    Given the folder of an earlier run, the stream goes on from that run's state.
    """
    spark = df.sparkSession
    base = base or folder(spark)
    query = (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def signals(
    events: DataFrame, name: str = "signal", since: int | None = None, until: int | None = None
) -> DataFrame:
    """Each signal once: (key, event_id, ts, value); the source triple removes repeats.

    ``since`` is the first instant that counts, ``until`` the first that doesn't.
    """
    rows = events.where(F.col("type") == name)
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    if until is not None:
        rows = rows.where(F.col("ts") < until)
    return rows.select("key", "event_id", "ts", "value").dropDuplicates(["key", "event_id"])


def retry_timers(events: DataFrame) -> DataFrame:
    """Keyed state: each retry of a key doubles its wait, a completion resets it.

    Emits (key, event_id, attempt, wait_ms, fire_at) per retry.  A key's events are
    applied one by one in order, so the result does not depend on how they were
    batched as long as batches come in order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (count,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for e in rows.itertuples():
            if e.type == "activityCompleted":
                count = 0
            elif e.type == "activityRetryScheduled":
                count += 1
                wait = int(min(100 * 2.0 ** min(count - 1, 60), 30_000))
                out.append((key[0], e.event_id, count, wait, e.ts + wait))
        state.update((count,))
        yield pd.DataFrame(out, columns=["key", "event_id", "attempt", "wait_ms", "fire_at"])

    return (
        events.where(F.col("type").isin("activityCompleted", "activityRetryScheduled"))
        .select("key", "event_id", "ts", "type")
        .groupBy("key")
        .applyInPandasWithState(
            run, "key long, event_id long, attempt long, wait_ms long, fire_at long", "count long", "append",
            GroupStateTimeout.NoTimeout,
        )
    )


def watch(spark: SparkSession, path: str, key: str, mark: int | None) -> DataFrame:
    """Items beyond a mark, as a watcher emits them; items at or below it are dropped."""
    rows = stream(spark, path)
    return rows if mark is None else rows.where(F.col(key) > mark)


def beyond_mark(items: DataFrame, cursor: str) -> DataFrame:
    """Keyed state: items above the highest ``cursor`` (a number) that their ``key`` had in earlier batches.

    The mark is state of the stream, so a restarted watcher goes on where it
    stopped.  Items of one batch don't hide each other; a null cursor is late.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (mark,) = state.get if state.exists else (None,)
        top = mark
        for rows in batches:  # one Arrow batch at a time, however many items a key has
            rows = rows[rows[cursor].notna()]
            if mark is not None:
                rows = rows[rows[cursor] > mark]
            if len(rows):
                top = int(rows[cursor].max()) if top is None else max(top, int(rows[cursor].max()))
                yield rows
        if top is not None:
            state.update((top,))

    return items.groupBy("key").applyInPandasWithState(
        run, items.schema, "mark long", "append", GroupStateTimeout.NoTimeout
    )


def silences(beats: DataFrame, timeout_ms: int, late_ms: int = 0) -> DataFrame:
    """Heartbeat deadlines that passed: (key, beats, last_beat, expired_at).

    ``beats`` has a ``key`` and ``ts`` in milliseconds.  Each beat moves the
    deadline to ``timeout_ms`` behind it; one at the deadline is still in time.
    An expiry comes out once event time, less ``late_ms``, is past it, so a key
    whose deadline may yet move gives nothing.  Sessions are built-in state:
    they merge in part before the shuffle.
    """
    gap = f"{timeout_ms} milliseconds"
    at = F.timestamp_millis("ts")
    return (
        beats.select("key", at.alias("at"))
        .withWatermark("at", f"{late_ms} milliseconds")
        .groupBy("key", F.session_window("at", gap).alias("alive"))
        .agg(F.count("*").alias("beats"))
        .select(
            "key", "beats",
            (F.unix_millis("alive.end") - timeout_ms).alias("last_beat"),
            F.unix_millis("alive.end").alias("expired_at"),
        )
    )


#: Groups that the state of timers is kept in, and a timer there; ``NEVER`` stands for no such time.
GROUPS, NEVER = 4096, np.iinfo(np.int64).max
TIMER = np.dtype([("timer", np.int64), ("fire_at", np.int64), ("canceled", np.int64), ("done", np.bool_)])


def _firsts(timer: np.ndarray, start: np.ndarray, fire_at: np.ndarray, canceled: np.ndarray) -> tuple:
    """The earliest start of each timer, with its ``fire_at``, and its earliest cancellation; by timer."""
    order = np.lexsort((fire_at, start, timer))
    timer = timer[order]
    first = np.flatnonzero(np.r_[True, timer[1:] != timer[:-1]])
    return timer[first], start[order][first], fire_at[order][first], np.minimum.reduceat(canceled[order], first)


def fired(timers: DataFrame, late_ms: int = 0, groups: int = GROUPS) -> DataFrame:
    """Keyed state: durable timers that fire once event time is past them: (timer, fire_at).

    ``timers`` has ``timer``, ``ts``, ``type`` (timerStarted or timerCanceled) and
    ``fire_at``, in milliseconds.  The earliest start of a batch sets the time and
    later ones change nothing; one that is past already fires at once.  A timer that
    is cancelled at an instant before its time never fires, so the result depends
    on event time and not on the batches.  Rows without ``ts``, and starts without
    ``fire_at``, are left out.  What a timer did is kept, so that it fires once.

    The state holds timers by hash in ``groups`` groups, each an array of ``TIMER``, so that
    Python is called for a group and not for a timer.  A batch rewrites the groups that it
    has timers of, so a stream of many timers and small batches wants more of them; a
    checkpoint belongs to its number of groups.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = np.frombuffer(state.get[0], TIMER) if state.exists else np.empty(0, TIMER)
        parts = [_firsts(*rows[columns].to_numpy(np.int64).T) for rows in batches if len(rows)]
        now = kept.copy()
        if parts:
            timer, start, fire_at, canceled = _firsts(*map(np.concatenate, zip(*parts, strict=True)))
            known = np.union1d(kept["timer"], timer)
            now = np.full(len(known), np.array((0, NEVER, NEVER, False), TIMER))
            now["timer"] = known
            now[np.searchsorted(known, kept["timer"])] = kept
            at = np.searchsorted(known, timer)
            new = (now["fire_at"][at] == NEVER) & (start != NEVER)
            now["fire_at"][at[new]] = fire_at[new]
            now["canceled"][at] = np.minimum(now["canceled"][at], canceled)
        waits = ~now["done"] & (now["fire_at"] != NEVER) & (now["canceled"] >= now["fire_at"])
        due = waits & (now["fire_at"] < state.getCurrentWatermarkMs())
        if due.any():
            now["done"] |= due
            out = pd.DataFrame({"timer": now["timer"][due], "fire_at": now["fire_at"][due]})
            yield out if key[0] >= 0 else out.assign(timer=None)
        waits &= ~due
        if waits.any():
            state.setTimeoutTimestamp(max(1, int(now["fire_at"][waits].min())))
        state.update((now.tobytes(),))

    columns = ["timer", "start", "fire_at", "canceled"]
    starts, timer, never = F.col("type") == "timerStarted", F.col("timer").cast("long"), F.lit(NEVER)
    return (
        timers.where("ts is not null and (type = 'timerCanceled' or type = 'timerStarted' and fire_at is not null)")
        .select(
            # a null id is a timer too, in a group of its own; no column that goes to Python has nulls
            F.when(timer.isNull(), -1).otherwise(F.pmod(F.xxhash64(timer), F.lit(groups))).alias("part"),
            F.coalesce(timer, F.lit(0)).alias("timer"),
            F.when(starts, F.col("ts")).otherwise(never).alias("start"),
            F.when(starts, F.col("fire_at")).otherwise(never).alias("fire_at"),
            F.when(starts, never).otherwise(F.col("ts")).alias("canceled"),
            F.timestamp_millis("ts").alias("at"),
        )
        .withWatermark("at", f"{late_ms} milliseconds")
        .groupBy("part")
        .applyInPandasWithState(
            run, "timer long, fire_at long", "timers binary", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
