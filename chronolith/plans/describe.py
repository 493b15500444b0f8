"""Plans that join several operators: an execution's page, recovery of outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.listing import SUMMARY, ExecutionFilter, page, with_history_length
from chronolith.operators.pending import pending


def list_page(
    executions: DataFrame,
    history: DataFrame | Callable[[DataFrame], DataFrame],
    f: ExecutionFilter,
    limit=None,
    cursor=None,
) -> DataFrame:
    """A page with its history lengths; only the page's histories are counted.

    ``history`` may be a function of the page's ids, for a source that can look
    them up before it shuffles.
    """
    rows = page(executions, f, limit, cursor)
    ids = F.broadcast(rows.select("workflow_id"))  # at most a page
    mine = history(ids) if callable(history) else history.join(ids, "workflow_id", "left_semi")
    return with_history_length(rows, mine).select(*SUMMARY)


def outcomes_to_deliver(executions: DataFrame, history: DataFrame) -> DataFrame:
    """Pending children that have settled: what recovery tells their parents."""
    children = pending(history, "child").select(
        F.col("workflow_id").alias("parent_id"), "seq", F.col("child_id").alias("workflow_id")
    )
    settled = executions.where("status <> 'running'").select("workflow_id", "status")
    return children.join(settled, "workflow_id").select(
        "parent_id", "seq", "workflow_id",
        F.when(F.col("status") == "completed", "childCompleted").otherwise("childFailed").alias("type"),
    )
