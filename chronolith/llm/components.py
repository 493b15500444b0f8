"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import small, stored


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, 32) else df


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b): root is the
    smallest node that links reach.

    Each round hooks every node to its smallest neighbour, follows that hook
    once more, and renames the links' ends; links within a node vanish, equal
    ones merge.  Minima are taken before the shuffle and joins can be split, so
    a node with very many links is no hot spot.  Every round is written to the
    shared folder.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    links = stored(links.select(*ends).where("a < b").distinct())
    rounds = []
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select("b", "a"))
        hooks = stored(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
            .select("node", F.least("node", "least").alias("root"))
        )
        further = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
        hooks = stored(hooks.join(_small(further), "root").select("node", F.col("far").alias("root")))
        rounds.append(hooks)
        of_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = links.join(_small(of_a), "a").join(_small(of_b), "b")
        links = stored(
            links.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .where("a < b")
            .distinct()
        )
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0]
    for hooks in rounds[1:]:
        later = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
        out = out.join(_small(later), "root", "left").select(
            "node", F.coalesce("far", "root").alias("root")
        )
    return stored(out)
