"""Toxicity scores from averaged subword embeddings and a linear softmax.

A word's vector is the mean of the embeddings of its character n-grams and of
itself, all hashed to a fixed number of rows; a text's vector is the mean of
its words' vectors; a linear softmax over it gives the class.  Embeddings and
softmax are trained jointly by Adam in numpy, on a bounded sample of labelled
rows, so a misspelling that no label shows is scored by the n-grams it shares.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import map_rows, table

WORD = re.compile(r"\w+")
#: Most characters of a word, and those that pieces of a longer run share: no n-gram
#: of up to one more character falls between two pieces.
PIECE, OVERLAP = 64, 16
#: Distinct words whose vectors a worker keeps before it starts anew.
CACHE_WORDS = 300_000


@dataclass(frozen=True)
class Settings:
    #: Most labelled rows to learn from (those with the smallest hash of their id).
    sample_rows: int = 5000
    rows: int = 1 << 17
    dim: int = 6
    shortest: int = 3
    longest: int = 5
    epochs: int = 80
    rate: float = 0.05
    decay: float = 3e-5
    #: The mean is multiplied by this before the softmax: one word in fifty decides a text.
    scale: float = 50.0
    #: Embedding rows seen in fewer texts stay zero, but for those of one class only, from 2 on.
    least: float = 3.0
    seed: int = 10


def subwords(word: str, s: Settings) -> list[int]:
    """Rows of a word and its character n-grams, within marked ends."""
    marked, mask = f"<{word}>", s.rows - 1
    grams = {
        marked[i : i + n]
        for n in range(s.shortest, s.longest + 1)
        for i in range(len(marked) - n + 1)
    }
    grams.add(f"={word}")
    return [zlib.crc32(g.encode("utf-8")) & mask for g in grams]


def words_of(text: str | None) -> list[str]:
    """Runs of word characters; a longer one than ``PIECE`` is cut into pieces that
    overlap, so that each of its n-grams is in one, and each counts as a word."""
    out = []
    for word in WORD.findall((text or "").lower()):
        if len(word) <= PIECE:
            out.append(word)
        else:
            out += [word[i : i + PIECE] for i in range(0, len(word) - OVERLAP, PIECE - OVERLAP)]
    return out


def bag(text: str | None) -> dict[str, int]:
    """The words of a text, with how often it has them."""
    return Counter(words_of(text))


#: Entries of a sparse product that are held at once.
BLOCK = 1 << 18


class Sparse:
    """A sparse matrix of rows of columns with weights; multiplies a dense one from
    either side, block by block, so that no more than ``BLOCK`` entries are expanded."""

    def __init__(self, size: np.ndarray, col: np.ndarray, weight: np.ndarray, width: int):
        self.n, self.width = len(size), width
        row = np.repeat(np.arange(self.n, dtype=np.int32), size)
        order = np.argsort(col, kind="stable")
        self.forth = (row, col, weight)
        self.back = (col[order], row[order], weight[order])

    @staticmethod
    def _product(triple, m: np.ndarray, n: int) -> np.ndarray:
        to, source, weight = triple
        out = np.zeros((n, m.shape[1]), np.float32)
        for i in range(0, len(to), BLOCK):
            index, part = to[i : i + BLOCK], m[source[i : i + BLOCK]]
            part *= weight[i : i + BLOCK, None]
            starts = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
            out[index[starts]] += np.add.reduceat(part, starts, axis=0)
        return out

    def dot(self, m: np.ndarray) -> np.ndarray:
        return self._product(self.forth, m, self.n)

    def t_dot(self, m: np.ndarray) -> np.ndarray:
        return self._product(self.back, m, self.width)


@dataclass
class Model:
    embedding: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    settings: Settings

    def score(self, mean: np.ndarray) -> np.ndarray:
        """Probability of class 1 for mean word vectors."""
        z = self.settings.scale * mean @ self.softmax + self.bias
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -60, 60)))


def train(texts: list[str | None], labels: np.ndarray, s: Settings) -> Model:
    """``train_bags`` of the texts' words."""
    return train_bags([bag(t) for t in texts], labels, s)


def train_bags(bags: list[dict[str, int]], labels: np.ndarray, s: Settings) -> Model:
    """Fit embeddings and softmax together; with one class only, its prior remains."""
    rng = np.random.default_rng(s.seed)
    embedding = np.zeros((s.rows, s.dim), np.float32)
    softmax = rng.normal(0, 1, (s.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    model = Model(embedding, softmax, bias, s)
    labels = np.asarray(labels, dtype=np.int64)
    if not len(labels):
        return model
    share = (np.bincount(labels, minlength=2) + 0.5) / (len(labels) + 1)
    bias[:] = np.log(share)
    index: dict[str, int] = {}
    cols, weights = [], []
    for b in bags:
        at = np.array([index.setdefault(w, len(index)) for w in b], dtype=np.int32)
        count = np.fromiter(b.values(), np.float64, len(b))
        order = np.argsort(at)
        cols.append(at[order])
        weights.append((count[order] / max(1, count.sum())).astype(np.float32))
    if not index or len(set(labels.tolist())) < 2:
        return model
    docs_size = np.array([len(c) for c in cols])
    cols = np.concatenate(cols)
    docs = Sparse(docs_size, cols, np.concatenate(weights), len(index))
    flat, size = array("i"), np.zeros(len(index), np.int64)
    for k, w in enumerate(index):
        rows = subwords(w, s)
        flat.extend(rows)
        size[k] = len(rows)
    flat = np.frombuffer(flat, dtype=np.int32)
    texts_with = np.bincount(cols, minlength=len(index))
    seen = np.bincount(flat, np.repeat(texts_with, size), minlength=s.rows)
    # texts of class 1 that a word, then that a row is in
    toxic_with = np.bincount(cols, np.repeat(labels, docs_size), minlength=len(index))
    toxic = np.bincount(flat, np.repeat(toxic_with, size), minlength=s.rows)
    often = (seen >= s.least) | (seen >= 2) & ((toxic == 0) | (toxic == seen))
    often = often[flat]
    kept = np.bincount(np.repeat(np.arange(len(size)), size)[often], minlength=len(size))
    words = Sparse(kept, flat[often], np.repeat((1 / size).astype(np.float32), kept), s.rows)
    del index
    target = np.eye(2, dtype=np.float32)[labels]
    params = [embedding, softmax, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, s.epochs + 1):
        mean = s.scale * docs.dot(words.dot(embedding))
        z = mean @ softmax + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) / len(labels)
        grads = [
            words.t_dot(docs.t_dot(s.scale * g @ softmax.T)) + s.decay * embedding,
            mean.T @ g + s.decay * softmax,
            g.sum(0),
        ]
        for value, grad, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


class WordVectors:
    """Mean subword embedding of each distinct word, computed once per worker."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.matrix = np.zeros((0, model.settings.dim), np.float32)

    def means(self, texts: list[str | None]) -> np.ndarray:
        """The mean word vector of each text; zero without words."""
        if len(self.index) > CACHE_WORDS:
            self.index, self.matrix = {}, self.matrix[:0]
        index, new, ids = self.index, [], []
        for t in texts:
            words = words_of(t)
            for w in words:
                if w not in index:
                    index[w] = len(index)
                    new.append(subwords(w, self.model.settings))
            ids.append([index[w] for w in words])
        if new:
            size = np.array([len(g) for g in new])
            rows = self.model.embedding[np.concatenate(new)]
            sums = np.add.reduceat(rows, np.cumsum(size) - size, axis=0)
            self.matrix = np.concatenate([self.matrix, sums / size[:, None].astype(np.float32)])
        out = np.zeros((len(texts), self.model.settings.dim), np.float32)
        for k, at in enumerate(ids):
            if at:
                out[k] = self.matrix[at].mean(0)
        return out


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id's text mod 5 is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Train on the labelled, not held-out rows with the smallest id hashes.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic.  Rows with a
    null id or label are not learned from; null texts count as empty.  The distinct words
    of the sample, at most ``s.sample_rows`` rows, with their counts are all that reaches
    the driver; texts stay where they are.
    """
    chosen = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & ~held_out())
        .dropDuplicates()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(s.sample_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bags = [bag(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "words": [list(b) for b in bags], "counts": [list(b.values()) for b in bags]}
            )

    rows = map_rows(rows, counted, f"doc_id {kind}, toxic int, words array<string>, counts array<int>")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "words").limit(s.sample_rows).toPandas()
    bags = [dict(zip(w, c, strict=True)) for w, c in zip(rows["words"], rows["counts"], strict=True)]
    return train_bags(bags, rows["toxic"].to_numpy(), s)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) for every whole text.

    Null and empty texts score as the model's prior.  Null ids and repeated
    rows stay, other columns are ignored, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = WordVectors(shared.value)
        for pdf in batches:
            p = shared.value.score(vectors.means(pdf["_text"].tolist()))
            yield pd.DataFrame({"_id": pdf["_id"], "score": p.astype(float)})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_rows(rows, run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
