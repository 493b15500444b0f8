"""Differences between what was seen and what there is; duplicates and late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_cursor(items: DataFrame, key: str, mark: int | None) -> tuple[DataFrame, int | None]:
    """(items beyond the mark, new mark).  Items at or below it are dropped; without any
    new item the mark stays."""
    added = items if mark is None else items.where(F.col(key) > mark)
    top = added.agg(F.max(key)).first()[0]
    return added, mark if top is None else top


def by_id(before: DataFrame, now: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(added rows, removed ids, new state of sorted distinct ids).  Added rows keep duplicates."""
    added = now.join(before.select(key), key, "left_anti")
    removed = before.select(key).distinct().join(now.select(key), key, "left_anti")
    return added, removed, now.select(key).distinct().orderBy(key)


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: a repeated delivery or a late completion has no effect.

    An aggregate, so repeats vanish before the shuffle.
    """
    rest = [c for c in rows.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")
    return rows.groupBy(*key).agg(first).select(*key, *[F.col(f"_f.{c}").alias(c) for c in rest])


def dropped(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows that ``first_of`` leaves out."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth > 1")


def parked_transition(stored: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """Conditions that changed: unparked (stored, not now) before parked (now, not stored)."""
    gone = stored.select(*key).distinct().join(now, key, "left_anti").withColumns(
        {"change": F.lit("conditionUnparked"), "step": F.lit(0)}
    )
    new = now.select(*key).distinct().join(stored, key, "left_anti").withColumns(
        {"change": F.lit("conditionParked"), "step": F.lit(1)}
    )
    return gone.union(new)


def trigger_problems(polled: DataFrame, key: str, id_col: str) -> DataFrame:
    """Polled items whose id is not above the one before, per trigger."""
    w = Window.partitionBy(key).orderBy("position")
    return polled.withColumn("previous", F.lag(id_col).over(w)).where(F.col("previous") >= F.col(id_col))


def effects(deliveries: DataFrame, key: list[str]) -> DataFrame:
    """Keys delivered more than once, with how often: each must have had one effect."""
    return deliveries.groupBy(*key).agg(F.count("*").alias("deliveries")).where("deliveries > 1")
