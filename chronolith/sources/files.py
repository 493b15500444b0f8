"""Executions kept as files: a meta file and a log of events in each folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

META = (
    "workflowId string, runId int, name string, taskQueue string, status string, createdAt bigint, "
    "closedAt bigint, taskFailures int"
)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """``meta.json`` of every folder below ``path``, with the defaults of older files."""
    rows = spark.read.schema(META).json(f"{path}/*/meta.json", multiLine=True)
    return rows.select(
        F.col("workflowId").alias("workflow_id"),
        F.coalesce("runId", F.lit(0)).alias("run_id"),
        "name",
        F.coalesce("taskQueue", F.lit("default")).alias("task_queue"),
        "status",
        F.coalesce("createdAt", F.lit(0)).alias("created_at"),
        F.col("closedAt").alias("closed_at"),
        F.coalesce("taskFailures", F.lit(0)).alias("task_failures"),
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(folder, pos, line) of every ``events.jsonl``, up to the first line that is not JSON.

    A torn write ends a log; what stands behind it is not read.
    """
    files = spark.read.text(f"{path}/*/events.jsonl", wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("folder"), "value"
    )
    lines = files.select("folder", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where("line <> ''")
    good = F.try_parse_json("line").isNotNull()
    w = Window.partitionBy("folder").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("whole", F.every(good).over(w)).where("whole").drop("whole")


def append(events: DataFrame, path: str) -> None:
    """Append a batch of events."""
    events.write.mode("append").parquet(path)


def truncated(history: DataFrame, keep: int) -> DataFrame:
    """A history's first ``keep`` events."""
    return history.where(F.col("pos") < keep)


def without(executions: DataFrame, gone: DataFrame) -> DataFrame:
    """Executions less deleted ones."""
    return executions.join(gone.select("workflow_id"), "workflow_id", "left_anti")


def upserted(executions: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Executions with the latest change of each put in its place, new ones added.

    ``changes`` holds the same columns and ``order``, which tells its rows of one id apart.
    """
    columns = executions.columns
    rest = [c for c in columns if c != "workflow_id"]
    last = changes.groupBy("workflow_id").agg(F.max_by(F.struct(*rest), order).alias("_c"))
    last = last.select("workflow_id", *[F.col(f"_c.{c}").alias(c) for c in rest]).select(*columns)
    return executions.join(last, "workflow_id", "left_anti").select(*columns).union(last)


def rolled_over(executions: DataFrame, history: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(executions, history) once those of ``ids`` go on as a new run: the next run number, no
    events; what is kept across runs stays."""
    # ids are few beside events: they are hashed, so that no history is sorted for the join
    ids = ids.select("workflow_id").distinct().hint("shuffle_hash")
    mark = ids.withColumn("_rolled", F.lit(1)).hint("shuffle_hash")
    rows = executions.join(mark, "workflow_id", "left")
    rows = rows.withColumn("run_id", F.col("run_id") + F.coalesce("_rolled", F.lit(0))).select(*executions.columns)
    return rows, history.join(ids, "workflow_id", "left_anti")


def suggested(history: DataFrame, least: int = 4096) -> DataFrame:
    """Executions whose history has grown to where a new run is suggested, with its length."""
    n = history.groupBy("workflow_id").agg(F.count("*").alias("history_length"))
    return n.where(F.col("history_length") >= least)


def reset(
    executions: DataFrame, history: DataFrame, points: DataFrame, parts: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(executions, history) rewound to the first ``keep`` events of each of ``points`` (workflow_id, keep).

    A settled execution runs again, without its closing time, and failures count from none.
    ``parts`` is the number of partitions that histories are numbered in; the session's where not given.
    """
    # points are few beside events: they are hashed, so that no history is sorted for the join
    points = points.groupBy("workflow_id").agg(F.min("keep").alias("_keep")).hint("shuffle_hash")
    if parts is not None:
        history = history.repartition(parts, "workflow_id")
    rows = executions.join(points, "workflow_id", "left")
    back = F.col("_keep").isNotNull()
    changed = {
        "status": F.when(back, F.lit("running")).otherwise(F.col("status")),
        "closed_at": F.when(~back, F.col("closed_at")),
        "task_failures": F.when(back, F.lit(0)).otherwise(F.col("task_failures")),
    }
    w = Window.partitionBy("workflow_id").orderBy("pos")
    # only rewound histories are numbered
    cut = history.join(points, "workflow_id").withColumn("_nth", F.row_number().over(w)).where("_nth <= _keep")
    left = history.join(points, "workflow_id", "left_anti").select(*history.columns)
    return rows.withColumns(changed).select(*executions.columns), left.union(cut.select(*history.columns))
