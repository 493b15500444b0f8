"""Retention of closed executions, and what closing or cancelling does to descendants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_closed_at(executions: DataFrame, history: DataFrame) -> DataFrame:
    """Add ``closed``: closing time, else the last event's time, else the creation time."""
    last = (
        history.where("ts is not null").groupBy("workflow_id").agg(F.max_by("ts", "pos").alias("last_ts"))
    )
    return executions.join(last, "workflow_id", "left").withColumn(
        "closed", F.coalesce("closed_at", "last_ts", "created_at")
    )


def retention(executions: DataFrame, history: DataFrame, cutoff: int) -> DataFrame:
    """Settled executions closed at ``cutoff`` or before, each with ``blocked``: a child whose
    running parent does not hold the outcome of that child's number is kept."""
    rows = with_closed_at(executions.where("status <> 'running'"), history).where(F.col("closed") <= cutoff)
    parent = executions.where("status = 'running'").select(
        F.col("workflow_id").alias("parent_id"), F.lit(True).alias("parent_running")
    )
    outcome = (
        history.where(F.col("type").isin("childCompleted", "childFailed"))
        .select(F.col("workflow_id").alias("parent_id"), F.col("seq").alias("parent_seq"), F.lit(True).alias("told"))
        .distinct()
    )
    rows = rows.join(parent, "parent_id", "left").join(outcome, ["parent_id", "parent_seq"], "left")
    blocked = F.coalesce("parent_running", F.lit(False)) & F.col("told").isNull()
    return rows.withColumn("blocked", blocked).drop("parent_running", "told")


def descend(roots: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """Transitive children: (root, workflow_id, depth) from ``edges`` (parent_id, workflow_id).

    Levels are joined one after another and written through a checkpoint, so
    the plan does not grow with the depth; a level is a join on the parent.
    """
    spark = roots.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_work"
        spark.sparkContext.setCheckpointDir(base)
    level = roots.select(F.col("workflow_id").alias("root"), "workflow_id").withColumn("depth", F.lit(0))
    out = None
    for depth in range(1, most + 1):
        level = (
            level.select("root", F.col("workflow_id").alias("parent_id"))
            .join(edges, "parent_id")
            .select("root", "workflow_id", F.lit(depth).alias("depth"))
            .checkpoint()
        )
        if level.isEmpty():
            return level if out is None else out
        out = level if out is None else out.union(level)
    raise ValueError(f"executions nest more than {most} deep")


def cancel_cascade(executions: DataFrame, roots: DataFrame) -> DataFrame:
    """Running executions that cancelling ``roots`` reaches: through running ones only."""
    running = executions.where("status = 'running'")
    start = running.join(roots.select("workflow_id"), "workflow_id", "left_semi")
    edges = running.where("parent_id is not null").select("parent_id", "workflow_id")
    below = descend(start, edges)
    return start.select("workflow_id", F.lit(0).alias("depth")).union(below.select("workflow_id", "depth")).groupBy(
        "workflow_id"
    ).agg(F.min("depth").alias("depth"))


def close_effects(executions: DataFrame, policies: DataFrame) -> DataFrame:
    """What the end of a parent does to each running child: abandon (none), cancel or terminate.

    ``policies`` holds (workflow_id, policy); a child without a policy is abandoned.
    """
    child = executions.where("status = 'running' and parent_id is not null").select("workflow_id", "parent_id")
    closed = executions.where("status <> 'running'").select(F.col("workflow_id").alias("parent_id"))
    return (
        child.join(closed, "parent_id")
        .join(policies, "workflow_id", "left")
        .select("workflow_id", "parent_id", F.coalesce("policy", F.lit("abandon")).alias("effect"))
    )


def close_cascade(executions: DataFrame, roots: DataFrame) -> DataFrame:
    """What closing ``roots`` does to all running executions below: (workflow_id, effect).

    ``executions`` holds (workflow_id, parent_id, status, policy, cancelling).  A child that is
    terminated closes its own children in turn, unless it was being cancelled already; one
    that is cancelled has everything that runs below cancelled; an abandoned one and what is
    below it stay.  An execution reached in several ways has the strongest effect: close,
    terminate, cancel.  Levels are written, and what was reached before is not walked again, so
    a cycle ends.
    """
    spark = executions.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_work"
        spark.sparkContext.setCheckpointDir(base)
    child = executions.where("status = 'running' and parent_id is not null").select(
        "workflow_id", "parent_id", F.coalesce("policy", F.lit("abandon")).alias("policy"),
        F.coalesce("cancelling", F.lit(False)).alias("cancelling"),
    )
    child = child.checkpoint()
    level = roots.select("workflow_id", F.lit("close").alias("effect")).distinct().checkpoint()
    out = level
    while not level.isEmpty():
        met = level.select(F.col("workflow_id").alias("parent_id"), F.col("effect").alias("cause")).join(child, "parent_id")
        effect = F.when((F.col("cause") == "cancel") | (F.col("policy") == "cancel"), "cancel").when(
            (F.col("policy") == "terminate") & ~F.col("cancelling"), "terminate"
        )
        met = met.select("workflow_id", effect.alias("effect")).where("effect is not null").distinct()
        level = met.join(out, ["workflow_id", "effect"], "left_anti").checkpoint()
        out = out.union(level)
    rank = F.when(F.col("effect") == "close", 0).when(F.col("effect") == "terminate", 1).otherwise(2)
    return out.groupBy("workflow_id").agg(F.min_by("effect", rank).alias("effect"))
