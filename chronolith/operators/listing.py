"""Listing executions: filters, order, keyset pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a page; larger limits are clamped, not refused.
PAGE_CAP = 200
SUMMARY = [
    "workflow_id", "run_id", "name", "status", "history_length", "task_queue",
    "created_at", "closed_at", "task_failures",
]


@dataclass(frozen=True)
class ExecutionFilter:
    """What to list; None asks for nothing."""

    status: str | None = None
    name: str | None = None
    task_queue: str | None = None
    workflow_id_prefix: str | None = None
    stuck: bool | None = None
    created_after: int | None = None  # inclusive
    created_before: int | None = None  # exclusive
    parent_id: str | None = None


def is_stuck() -> Column:
    """Running, with failed workflow tasks."""
    return (F.col("status") == "running") & (F.col("task_failures") > 0)


def filtered(executions: DataFrame, f: ExecutionFilter) -> DataFrame:
    """Rows that match every part of the filter; plain predicates, so they reach the scan."""
    for column, value in (
        ("status", f.status), ("name", f.name), ("task_queue", f.task_queue), ("parent_id", f.parent_id),
    ):
        if value is not None:
            executions = executions.where(F.col(column) == value)
    if f.workflow_id_prefix is not None:
        executions = executions.where(F.col("workflow_id").startswith(f.workflow_id_prefix))
    if f.stuck is not None:
        executions = executions.where(is_stuck() == f.stuck)
    if f.created_after is not None:
        executions = executions.where(F.col("created_at") >= f.created_after)
    if f.created_before is not None:
        executions = executions.where(F.col("created_at") < f.created_before)
    return executions


def with_history_length(executions: DataFrame, history: DataFrame) -> DataFrame:
    """Add the number of events of the listed run."""
    n = history.groupBy("workflow_id", "run_id").agg(F.count("*").alias("history_length"))
    return executions.join(n, ["workflow_id", "run_id"], "left").withColumn(
        "history_length", F.coalesce("history_length", F.lit(0))
    )


def cursor_key(created_at: Column, workflow_id: Column) -> Column:
    """The page cursor: creation time padded to 15 digits, then the id."""
    text = created_at.cast("string")
    padded = F.when(F.length(text) >= 15, text).otherwise(F.lpad(text, 15, "0"))
    return F.concat(padded, F.lit("|"), workflow_id)


def page(
    executions: DataFrame, f: ExecutionFilter = ExecutionFilter(), limit: int | None = None, cursor: str | None = None
) -> DataFrame:
    """One page, newest first and ids from Z to A within an instant.

    A cursor is the key of the last row seen; the page holds keys below it.  The
    two parts of a cursor are compared as columns, so the creation time still
    prunes the scan.  Asking for fewer than one row is an error.
    """
    limit = PAGE_CAP if limit is None else min(limit, PAGE_CAP)
    if limit < 1:
        raise ValueError("a page holds at least one row")
    rows = filtered(executions, f)
    if cursor is not None:
        created, _, ident = cursor.partition("|")
        at = int(created)
        rows = rows.where(
            (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("workflow_id") < ident))
        )
    return rows.orderBy(F.desc("created_at"), F.desc("workflow_id")).limit(limit)


def next_cursor(rows: DataFrame) -> str | None:
    """The cursor behind a page of one row more than asked for, or None."""
    last = rows.orderBy("created_at", "workflow_id").select(cursor_key(F.col("created_at"), F.col("workflow_id")).alias("k")).first()
    return last.k if last else None
