"""Workers, queues and the catalogue of workflows, from polls and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A queue or worker is fresh for so long after a poll, and forgotten after that.
FRESH_MS, FORGET_MS = 10_000, 600_000
WORKER = ["task_queue", "role", "identity"]


def latest(polls: DataFrame) -> DataFrame:
    """The last poll of each worker; polls without an identity count for their queue only."""
    last = F.max_by(F.struct("polled_at", "busy", "serves"), F.struct("polled_at", "event_id")).alias("last")
    rows = polls.where("identity is not null").groupBy(*WORKER).agg(last)
    return rows.select(*WORKER, "last.polled_at", "last.busy", "last.serves")


def queues(polls: DataFrame) -> DataFrame:
    """Per queue and role, the last poll of anyone."""
    return polls.groupBy("task_queue", "role").agg(F.max("polled_at").alias("polled_at"))


def newest_workers(workers: DataFrame, now: int) -> DataFrame:
    """Workers not yet forgotten, ranked in their queue by last poll, then identity."""
    w = Window.partitionBy("task_queue").orderBy(F.desc("polled_at"), "identity", "role")
    return workers.where(F.col("busy") | (F.col("polled_at") >= now - FORGET_MS)).withColumn("rank", F.row_number().over(w))


def queue_served(asked: DataFrame, polls: DataFrame, now: int) -> DataFrame:
    """Whether each asked (task_queue, role) is served: a fresh poll or a busy worker, by
    its own queue or by the one that stands for all."""
    fresh = queues(polls).select("task_queue", "role", (F.col("polled_at") >= now - FRESH_MS).alias("live"))
    busy = latest(polls).where("busy").select("task_queue", "role", F.lit(True).alias("live"))
    live = fresh.union(busy).groupBy("task_queue", "role").agg(F.bool_or("live").alias("live"))
    # served by its own queue or by '*': two rows for each asked one, and an equal join
    wanted = asked.withColumn("by", F.explode(F.array(F.col("task_queue"), F.lit("*"))))
    live = live.withColumnRenamed("task_queue", "by")
    return (
        wanted.join(live, ["by", "role"], "left")
        .groupBy("task_queue", "role")
        .agg(F.coalesce(F.bool_or("live"), F.lit(False)).alias("served"))
    )


def name_served(asked: DataFrame, workers: DataFrame, role: str = "workflow") -> DataFrame:
    """Whether each asked (task_queue, name) is served: true, false, or null where unknown.

    Unknown: no worker at all, or one that does not say what it serves.
    """
    wanted = asked.withColumn("by", F.explode(F.array(F.col("task_queue"), F.lit("*"))))
    mine = workers.where(F.col("role") == role).select(F.col("task_queue").alias("by"), "identity", "serves")
    rows = wanted.join(mine, "by", "left").groupBy("task_queue", "name").agg(
        F.count("identity").alias("n"),
        F.bool_or(F.col("identity").isNotNull() & F.col("serves").isNull()).alias("silent"),
        F.bool_or(F.array_contains("serves", F.col("name"))).alias("has"),
    )
    return rows.select("task_queue", "name", served("n", "silent", "has").alias("served"))


def served(n: str, silent: str, has: str) -> Column:
    return F.when(F.col(n) == 0, F.lit(None)).when(F.col(silent), F.lit(None)).otherwise(F.coalesce(has, F.lit(False)))


def backlog(pending: DataFrame, queue_rows: DataFrame) -> DataFrame:
    """Queues with their number of waiting items; the queue for all has none of its own."""
    n = pending.groupBy("task_queue").agg(F.count("*").alias("waiting"))
    rows = queue_rows.select("task_queue").distinct().join(n, "task_queue", "full_outer")
    return rows.select(
        "task_queue", F.when(F.col("task_queue") == "*", 0).otherwise(F.coalesce("waiting", F.lit(0))).alias("waiting")
    )


def report_digest(workflows: Column) -> Column:
    """A short digest of a set of names, whatever their order."""
    return F.substring(F.sha2(F.to_json(F.array_sort(workflows)), 256), 1, 16)


def catalogue(reports: DataFrame) -> DataFrame:
    """One row per workflow name: the first description, its queues, and whether any differs.

    ``reports`` holds (name, task_queue, description, order_key).
    """
    return reports.groupBy("name").agg(
        F.min_by("description", "order_key").alias("description"),
        F.array_sort(F.collect_set("task_queue")).alias("queues"),
        (F.count_distinct("description") > 1).alias("conflicting"),
    )


def current_reports(reports: DataFrame, workers: DataFrame, now: int) -> DataFrame:
    """Reports that a live workflow worker of the same queue and identity vouches for."""
    live = workers.where("role = 'workflow' and serves is not null").where(
        F.col("busy") | (F.col("polled_at") >= now - FRESH_MS)
    )
    return reports.join(live.select("task_queue", "identity"), ["task_queue", "identity"], "left_semi")


def resolved(workers: DataFrame, reports: DataFrame) -> DataFrame:
    """Workers with the names that they serve: those of the report of the same identity and
    queue whose digest the worker's own polls carry; null where it has none or another.

    ``workers`` holds (task_queue, identity, digest), ``reports`` (task_queue, identity, digest, names).
    """
    keys = ["task_queue", "identity", "digest"]
    return workers.join(reports.select(*keys, "names"), keys, "left")
