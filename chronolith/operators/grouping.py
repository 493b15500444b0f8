"""Counting executions by queue and name, and activities that retry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.listing import is_stuck

STATUSES = ("running", "completed", "failed", "terminated")


def counts() -> list:
    """Total, each status, and stuck; a stuck execution also counts as running."""
    return [
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.count_if(is_stuck()).alias("stuck"),
    ]


def by(executions: DataFrame, key: str) -> DataFrame:
    """One row per key, those with most trouble first: stuck, failed, running, total, then key."""
    rows = executions.groupBy(key).agg(*counts())
    order = [F.desc(c) for c in ("stuck", "failed", "running", "total")]
    return rows.orderBy(*order, key)


def both(executions: DataFrame) -> DataFrame:
    """Groups by queue and by name in one pass: (grouping, key, counts)."""
    rows = executions.groupingSets([["task_queue"], ["name"]], "task_queue", "name").agg(
        F.grouping("task_queue").alias("_named"), *counts()
    )
    named = F.col("_named") == 1
    return rows.select(
        F.when(named, "name").otherwise("task_queue").alias("grouping"),
        F.when(named, F.col("name")).otherwise(F.col("task_queue")).alias("key"),
        "total", *STATUSES, "stuck",
    )


def retrying(attempts: DataFrame, executions: DataFrame | None = None) -> DataFrame:
    """Activities between attempts, by name: how many, attempts in all, next attempt, last error.

    With ``executions`` only those of running executions count.  The last error
    is that of the last activity in order of (workflow_id, seq) that has one.
    Activities without a name are left out.
    """
    rows = attempts.where("name is not null")
    if executions is not None:
        rows = rows.join(executions.where("status = 'running'").select("workflow_id"), "workflow_id", "left_semi")
    rows = rows.groupBy("name").agg(
        F.count("*").alias("retrying"),
        F.sum("attempts").alias("attempts"),
        F.min("next_attempt_at").alias("next_attempt_at"),
        F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.struct("workflow_id", "seq"))).alias("last_error"),
    )
    return rows.orderBy(F.desc("attempts"), F.desc("retrying"), "name")
