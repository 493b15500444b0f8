"""Queues, leases, start claims, and commands held against history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that a carried-over value may have.
CARRYOVER_CAP = 16_384


def start_claims(requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Which start requests create an execution: the first of an id that does not exist yet.

    ``requests``: (workflow_id, name, props, order_key).  Every request gets
    ``created`` and ``same_request``: whether its name and the text of its props
    are those of the execution that has the id.
    """
    holder = F.min_by(F.struct("name", "props"), "order_key").alias("holder")
    first = requests.groupBy("workflow_id").agg(holder, F.min("order_key").alias("first_key"))
    if existing is not None:
        known = existing.select("workflow_id", F.struct("name", "props").alias("known"))
        first = first.join(known, "workflow_id", "left").select(
            "workflow_id",
            F.coalesce("known", "holder").alias("holder"),
            F.when(F.col("known").isNull(), F.col("first_key")).alias("first_key"),
        )
    same = F.col("name").eqNullSafe(F.col("holder.name")) & F.col("props").eqNullSafe(F.col("holder.props"))
    return requests.join(first, "workflow_id").select(
        *requests.columns,
        F.coalesce(F.col("order_key") == F.col("first_key"), F.lit(False)).alias("created"),
        same.alias("same_request"),
    )


def queue_heads(items: DataFrame, now: int) -> DataFrame:
    """The next item of each queue: items whose lease lapsed come first, then the oldest.

    ``items``: (task_queue, item, enqueued, deadline); a deadline in the future is held.
    An aggregate, so a long queue is reduced before the shuffle.
    """
    lapsed = F.col("deadline").isNotNull()
    open_ = items.where(F.col("deadline").isNull() | (F.col("deadline") <= now))
    order = F.struct((~lapsed).alias("fresh"), "enqueued", "item")
    head = F.min_by(F.struct("item", "enqueued", lapsed.alias("lapsed")), order).alias("h")
    return open_.groupBy("task_queue").agg(head).select("task_queue", "h.item", "h.enqueued", "h.lapsed")


def backlog(items: DataFrame, now: int) -> DataFrame:
    """Items per queue that wait or whose lease has lapsed; queues without any are left out."""
    rows = items.where(F.col("deadline").isNull() | (F.col("deadline") <= now))
    return rows.groupBy("task_queue").agg(F.count("*").alias("waiting"))


def holders(items: DataFrame, now: int) -> DataFrame:
    """Distinct holders of leases that have not expired."""
    return items.where(F.col("deadline") > now).select("holder").distinct()


def forgotten(workers: DataFrame, held: DataFrame, now: int, after: int) -> DataFrame:
    """Workers quiet for longer than ``after`` that hold no lease."""
    quiet = workers.where(F.col("polled_at") < now - after)
    return quiet.join(held.select(F.col("holder").alias("identity")), "identity", "left_anti")


def mismatches(markers: DataFrame, commands: DataFrame) -> DataFrame:
    """Where a command differs from the marker of its number: (workflow_id, seq, kind, wanted)."""
    return (
        markers.select("workflow_id", "seq", "kind")
        .join(commands.select("workflow_id", "seq", F.col("kind").alias("wanted")), ["workflow_id", "seq"])
        .where("kind <> wanted")
    )


def never_issued(pending: DataFrame, commands: DataFrame) -> DataFrame:
    """The first pending marker of each execution that no command asks for."""
    rows = pending.join(commands.select("workflow_id", "seq"), ["workflow_id", "seq"], "left_anti")
    return rows.groupBy("workflow_id").agg(F.min_by("seq", "pos").alias("seq"), F.min("pos").alias("pos"))


def newest(rows: DataFrame, key: str, order: list[str], value: str, n: int = 20) -> DataFrame:
    """Each key's newest ``n`` values, newest first."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    ranked = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    kept = F.array_sort(F.collect_list(F.struct("_n", value)))
    return ranked.groupBy(key).agg(F.transform(kept, lambda x: x[value]).alias("newest"))


def oversize(values: DataFrame, key: str, name: str, text: str, cap: int = CARRYOVER_CAP) -> DataFrame:
    """Keys whose carried-over text is longer than the cap, with the name of the longest value."""
    size = F.length(text)
    rows = values.groupBy(key).agg(F.sum(size).alias("size"), F.max_by(name, F.struct(size, name)).alias("largest"))
    return rows.where(F.col("size") > cap)


def uncovered(declared: DataFrame, covered: DataFrame) -> DataFrame:
    """Declared operations without a check; unsafe commands owe none."""
    owed = declared.where("not unsafe").select("operation").distinct()
    return owed.join(covered.select("operation"), "operation", "left_anti")


def queue_of(option: Column, execution: Column) -> Column:
    """The queue of a piece of work: its own, else its execution's, else the default."""
    return F.coalesce(option, execution, F.lit("default"))
