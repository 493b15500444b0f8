"""Quality of documents: a classifier's evidence combined with site posteriors.

A logistic classifier over surface features (shares of characters, repetition
of words and lines) gives each document a likelihood ratio.  Sites are
described by two levels, host and path.  The expected number of good documents
of each host is a grouped sum of the classifier's probabilities; the hosts'
spread around the global rate gives the strength of a Beta prior, by moments, and
each host's rate is shrunk toward the global one by it.  Paths are shrunk in the
same way toward their host's posterior.  A document's posterior odds are its
path's odds times its likelihood ratio, so a sparse site is judged by the global
rate, a large one by its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import free_name, small, small_batches, stored, table, tidied

#: Most labelled rows that the classifier learns from (smallest id hashes first).
SAMPLE_ROWS = 20_000
#: Documents of at least this posterior probability of being good are kept.
KEEP = 0.3
#: Marks whose share among a text's bytes is a feature each.
MARKS = b"|%&$*#!?.,;:-_/\\<>{}[]()=+@\"'`~^"
#: Features of a text.
WIDTH = len(MARKS) + 11
#: Bytes from which on a table of site posteriors is joined by shuffle.
BYTES = 8 << 20


def features(text: str | None) -> list[float]:
    """Surface features of a whole text; all zero without words."""
    data = (text or "").encode("utf-8")
    words = data.split()
    if not words:
        return [0.0] * WIDTH
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, k = len(data), len(words)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    lines = data.split(b"\n")
    marks = (count[list(MARKS)] / n).tolist()
    return marks + [
        upper / max(1, upper + lower),
        int(count[48:58].sum()) / n,
        int(count[128:].sum()) / n,
        int(count[10]) / n,
        len(set(words)) / k,
        len(set(words)) / k**0.8,
        sum(map(eq, words, words[1:])) / max(1, k - 1),
        1 - len(set(lines)) / len(lines),
        (n - k) / k / 10,
        float(np.log1p(k)) / 10,
        1.0,
    ]


@dataclass
class Classifier:
    """A logistic classifier over standardised features, as evidence: its log odds
    less those of the labels it has seen."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weight + self.bias, -12, 12)


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Classifier:
    """Newton's method with a ridge; without both classes there is no evidence."""
    width = WIDTH
    if len(set(y.tolist())) < 2:
        return Classifier(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w, penalty = np.zeros(width + 1), np.r_[np.full(width, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    prior = np.log(y.mean() / (1 - y.mean()))
    return Classifier(mean, scale, w[:-1], float(w[-1] - prior))


def feature_column(text: Column) -> Column:
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    return F.pandas_udf(of, "array<double>")(text)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Classifier, float]:
    """(classifier, global rate of good documents) from labelled rows.

    Features are computed where the rows are; at most ``sample_rows`` feature
    rows reach the driver.  Rows with a null id or label are not learned from.
    Without labels the rate is one half.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)")
        .dropDuplicates()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample_rows)
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "quality", feature_column(F.col("text")).alias("x"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x")
        .limit(sample_rows)
        .toPandas()
    )
    y = rows["quality"].to_numpy(dtype=float)
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(y), WIDTH)
    return train(x, y), float((y.sum() + 1) / (len(y) + 2))


def evidence_column(spark: SparkSession, model: Classifier):
    """A function from a text column to its log likelihood ratio."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator) -> Iterator:
        for text in batches:
            x = np.array([features(t) for t in text]).reshape(len(text), WIDTH)
            yield pd.Series(shared.value.evidence(x))

    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(scored)(batches)

    return F.pandas_udf(evidence, "double")


def log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(groups: DataFrame, rate: Column, least: float = 1.0, most: float = 1e4) -> DataFrame:
    """One row (strength): the Beta prior's size from the spread of groups around ``rate``, by
    moments: rate (1 - rate) / variance between groups - 1.

    Groups have n documents, and sums of their probabilities (good) and of the squares of
    these (squares).  What the groups' means would differ by chance alone is taken from the
    variance within groups, pooled.
    """
    n, mean = F.col("n"), F.col("good") / F.col("n")
    spread = F.sum(n * (mean - rate) ** 2)
    pooled = F.sum(F.col("squares") - n * mean**2) / F.greatest(F.sum("n") - F.count("*"), F.lit(1.0))
    weight = F.sum("n") - F.sum(n * n) / F.sum("n")
    between = (spread - F.count("*") * pooled) / F.greatest(weight, F.lit(1.0))
    level = F.sum(n * rate * (1 - rate)) / F.sum("n")
    size = level / F.greatest(between, F.lit(1e-9)) - 1
    return groups.agg(F.greatest(F.lit(least), F.least(F.lit(most), size)).alias("strength"))


def site_posteriors(scored: DataFrame, rate: float) -> DataFrame:
    """(host, path, n, host_rate, path_rate) from rows (host, path, evidence).

    Sums are taken before the shuffle, so a host with a third of all rows is one
    partial row of each task.
    """
    good = 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(rate / (1 - rate))))))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "squares")]
    paths = scored.groupBy("host", "path").agg(
        F.count("*").cast("double").alias("n"), F.sum(good).alias("good"), F.sum(good * good).alias("squares")
    )
    paths = stored(paths)
    hosts = paths.groupBy("host").agg(*sums)
    share = hosts.crossJoin(F.broadcast(strength(hosts, F.lit(rate))))
    shrunk = (F.col("good") + F.col("strength") * rate) / (F.col("n") + F.col("strength"))
    hosts = share.select("host", shrunk.alias("host_rate"))
    paths = paths.join(hosts, "host")
    of_paths = strength(paths, F.col("host_rate"))
    shrunk = (F.col("good") + F.col("strength") * F.col("host_rate")) / (F.col("n") + F.col("strength"))
    paths = paths.crossJoin(F.broadcast(of_paths)).withColumn("path_rate", shrunk)
    return stored(paths.select("host", "path", "n", "host_rate", "path_rate"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``quality_evidence``, ``quality_host``, ``quality_path`` (posterior
    rates) and ``quality_score`` (posterior probability of being good) added.

    A null host or path is a site of its own.  A document counts in its own site's
    rates, as one of n.  Null and empty texts have the
    evidence of a text without words.  Rows repeat as they came; columns named
    like the added ones are replaced, all other names are free.  An empty table, or one
    without labels, gives prior scores.  Texts are read once; without ``keep_text`` they are
    dropped there, with it they are written beside their evidence.  They are never shuffled
    while the table of site posteriors, which holds a row for each host and path, is measured
    as small; else rows are joined with it by shuffle, where Spark splits hot hosts.
    """
    spark = docs.sparkSession
    model, rate = fit(docs.withColumn("text", F.col(text_col)), labels, sample_rows)
    evidence = evidence_column(spark, model)
    none = F.lit("\x00")
    docs = docs.drop("quality_evidence", "quality_host", "quality_path", "quality_score")
    host, path = free_name(docs, "_host"), free_name(docs, "_path")
    rows = docs.withColumns(
        {
            host: F.coalesce(F.col(host_col).cast("string"), none),
            path: F.coalesce(F.col(path_col).cast("string"), none),
            "quality_evidence": evidence(F.col(text_col)),
        }
    )
    rows = stored(rows if keep_text else rows.drop(text_col))
    scored = rows.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col("quality_evidence").alias("evidence"))
    sites = site_posteriors(scored, rate).select(
        F.col("host").alias(host),
        F.col("path").alias(path),
        F.col("host_rate").alias("quality_host"),
        F.col("path_rate").alias("quality_path"),
    )
    rows = rows.join(F.broadcast(sites) if small(sites, 128, BYTES) else sites, [host, path], "left")
    z = F.col("quality_evidence") + log_odds(F.col("quality_path"))
    return rows.withColumn("quality_score", 1 / (1 + F.exp(-z))).drop(host, path)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = classify(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return out.select(
        "doc_id",
        "quality_evidence",
        "quality_host",
        "quality_path",
        "quality_score",
        (F.col("quality_score") >= KEEP).cast("int").alias("keep"),
    )
