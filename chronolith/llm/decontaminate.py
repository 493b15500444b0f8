"""Benchmark decontamination by CGK embeddings, bit sampling and edit verification.

A CGK walk reads words with a random bit for each (step, word): after each step it
moves to the next word or stays.  Two stretches of words that differ by few edits
come into step again behind an edit, so their walks, read step by step, differ in
few places: edit distance becomes Hamming distance.  A sample is a few steps of a walk;
stretches that are near agree in all of them with a good chance.

A window of an item's size is embedded as a row of short walks, one from each
second word of the item (from each word of a short one), so samples cover all of it
and an edited or missing head spoils only the walks that start there.  Several walks
with several samples each are the repetitions that give the recall: tests hold it
against exhaustive search with a fifth of an item's words edited, spread, in front or
missing.  In texts a walk starts at every word.

All walks of many texts step at once; a bit table drops nearly all samples.  Where
samples agree, the exact edit distance between the item and the words around the
place decides.  Items that are too short for an edit are looked up as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import small_batches, table, tidied

#: Edits, as a share of an item's words, within which a passage counts as the item.
SHARE = 0.2
#: Items that one scan of the documents carries; more items take more scans.
BLOCK = 5_000
#: Walks, their steps, samples of each walk, and steps in a sample.
WALKS, STEPS, SAMPLES, BITS = 6, 11, 4, 3
#: Items of fewer words have a walk from each word; others from each second one.
SHORT = 12
#: Words of texts that are worked on at once.
CHUNK = 1 << 17

_U = np.uint64
#: ASCII letters in lower case and digits stay, other ASCII becomes a space; other bytes stay.
_PLAIN = bytes(
    c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in (ord(chr(i).lower()) if i < 0x80 else i for i in range(256))
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_PLAIN).split()


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each row of some columns of word numbers."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out + c.view(np.uint64)) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return out


def walked(ids: np.ndarray, bits: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A walk from every word: places and words at each step.  ``bits`` (steps, words)
    tells which words a step moves on from."""
    ids = np.concatenate([ids, np.zeros(len(bits), ids.dtype)])
    at, places, words = np.arange(len(ids) - len(bits)), [], []
    for step in bits:
        x = ids.take(at)
        places.append(at)
        words.append(x)
        at = at + step.take(x)
    return places, words


class Lookup:
    """Items and places in them, by key."""

    def __init__(self, key: np.ndarray, item: np.ndarray, place: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order], place[order]
        self.shift = _U(64 - max(16, min(26, len(key).bit_length() + 4)))
        self.known = np.zeros(1 << int(64 - self.shift), bool)
        self.known[self.key >> self.shift] = True

    def hits(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of a key, item, place) for each key that is known."""
        at = np.flatnonzero(self.known[key >> self.shift])
        low, high = (np.searchsorted(self.key, key[at], side) for side in ("left", "right"))
        n = high - low
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
        return np.repeat(at, n), self.item[row], self.place[row]


class Index:
    """Benchmark items under the samples of their walks; finds them in texts."""

    def __init__(self, items: list[tuple[int, str]], share: float = SHARE, seed: int = 4):
        self.share = share
        self.items = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        self.sets = [frozenset(ws) for _, ws in self.items]
        self.vocabulary: dict[bytes, int] = {}
        for _, ws in self.items:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        rng = np.random.default_rng(seed)
        self.bits = rng.integers(0, 2, (WALKS, STEPS, len(self.vocabulary) + 1))
        # the first step, which all walks from a word share, and later ones
        self.steps = [
            [[0, *sorted(rng.choice(np.arange(2, STEPS), BITS - 1, replace=False).tolist())] for _ in range(SAMPLES)]
            for _ in range(WALKS)
        ]
        rows = [[self.vocabulary[w] for w in ws] for _, ws in self.items]
        size = np.array([len(r) for r in rows], dtype=np.int64)
        begin = np.cumsum(size + 1) - size - 1
        ids = np.array([x for r in rows for x in (*r, 0)] or [0])
        item = np.repeat(np.arange(len(rows)), size + 1)[: len(ids)]
        exact = size * share < 1
        # places where walks start: not the 0 behind an item
        place = np.arange(len(ids))[: len(item)] - begin[item]
        start = (place < size[item]) & ~exact[item] & ((size[item] < SHORT) | (place % 2 == 0))
        start, end = np.flatnonzero(start), (begin + size)[item]
        self.lookups: list[list[Lookup]] = []
        for bits, samples in zip(self.bits, self.steps, strict=True):
            places, words = walked(ids, bits)
            made = []
            for steps in samples:
                p = [places[j][start] for j in steps]
                inside = p[-1] < end[start]
                for a, b in zip(p, p[1:], strict=False):  # different words
                    inside &= a < b
                at = start[inside]
                made.append(Lookup(_hashed([words[j][at] for j in steps]), item[at], place[at]))
            self.lookups.append(made)
        # items without room for an edit, by their number of words
        self.exact = {}
        for n in sorted(set(size[exact].tolist())):
            at = begin[exact & (size == n)]
            key = _hashed([ids[at + k] for k in range(n)])
            self.exact[n] = Lookup(key, item[at], np.zeros(len(at), np.int64))

    def most(self, item: int) -> int:
        """Most edits within which a passage is the item."""
        return int(self.share * len(self.items[item][1]))

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word where samples agree, (item, place where it would begin)), distinct, in order."""
        found = []
        for bits, samples, lookups in zip(self.bits, self.steps, self.lookups, strict=True):
            _, words = walked(ids, bits)
            for steps, lookup in zip(samples, lookups, strict=True):
                found.append(lookup.hits(_hashed([words[j] for j in steps])))
        for n, lookup in self.exact.items():
            if len(ids) >= n:
                found.append(lookup.hits(_hashed([ids[k : len(ids) - n + 1 + k] for k in range(n)])))
        at, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
        both = np.unique(np.stack([at, item, at - place], axis=1), axis=0)
        return both[:, 0], both[:, 1:]

    def find(self, texts: list[list[bytes]], ids: np.ndarray) -> list[list[dict]]:
        """For each text its passages: item, edits, and the place of the last word.

        ``ids`` holds vocabulary numbers (0: in no item); a 0 separates texts.
        """
        size = np.array([len(t) + 1 for t in texts])
        begin = np.cumsum(size) - size
        starts: dict[tuple[int, int], set[int]] = {}
        at, rest = self.candidates(ids)
        of = np.searchsorted(begin, at, "right") - 1
        for t, item, start in zip(of.tolist(), rest[:, 0].tolist(), (rest[:, 1] - begin[of]).tolist(), strict=True):
            starts.setdefault((t, item), set()).add(start)
        out: list[list[dict]] = [[] for _ in texts]
        for (t, item), places in sorted(starts.items()):
            if (got := self.verify(texts[t], sorted(places), item)) is not None:
                name, own = self.items[item]
                out[t].append({"item": name, "edits": got[0], "words": len(own), "end": got[1]})
        return out

    def verify(self, words: list[bytes], starts: list[int], item: int) -> tuple[int, int] | None:
        """(edits, last word) of the item's best place around its possible starts, if near enough.

        Starts whose surroundings overlap are looked at as one stretch.
        """
        own, most, known = self.items[item][1], self.most(item), self.sets[item].__contains__
        best, k = None, 0
        while k < len(starts):
            first, end = max(0, starts[k] - most), starts[k] + len(own) + most
            while k + 1 < len(starts) and starts[k + 1] - most <= end:
                k += 1
                end = starts[k] + len(own) + most
            part = words[first:end]
            # all but the edited words are in it; else there is no need to look closer
            if sum(map(known, part)) < len(own) - most:
                got = None
            else:
                got = nearest(own, part, most, first)
            if got is not None and (best is None or got < best):
                best = got
            k += 1
        return best


def nearest(own: list[bytes], text: list[bytes], most: int, offset: int = 0) -> tuple[int, int] | None:
    """(edits, end) of the stretch of ``text`` nearest to ``own``, if within ``most`` edits.

    Myers' bit-parallel columns on whole-number bit sets; a stretch may begin anywhere.
    """
    m = len(own)
    where: dict[bytes, int] = {}
    for i, w in enumerate(own):
        where[w] = where.get(w, 0) | 1 << i
    vp, vn, score, top, full = (1 << m) - 1, 0, m, 1 << (m - 1), (1 << m) - 1
    best = None
    for j, w in enumerate(text, 1):
        eq = where.get(w, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp) & full, d0 & vp
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1 & full, hn << 1 & full
        vp, vn = hn | ~(d0 | hp) & full, hp & d0
        if score <= most and (best is None or score < best[0]):
            best = score, offset + j
    return best


class Finder:
    """Finds an index's items in texts, so many at once as make up a chunk of words."""

    def __init__(self, index: Index):
        self.index = index

    def __call__(self, texts: list[str | None]) -> list[list[dict]]:
        out: list[list[dict]] = []
        part, held = [], 0
        for t in texts:
            part.append(words_of(t))
            held += len(part[-1])
            if held >= CHUNK:
                out += self._part(part)
                part, held = [], 0
        return out + (self._part(part) if part else [])

    def _part(self, texts: list[list[bytes]]) -> list[list[dict]]:
        number, pad = self.index.vocabulary.get, np.zeros(1, np.int64)
        rows = []
        for words in texts:
            rows += [np.fromiter(map(number, words, repeat(0)), np.int64, len(words)), pad]
        return self.index.find(texts, np.concatenate(rows))


LEAKS = "array<struct<item: long, edits: int, words: int, end: int>>"


def _leaks(shared):
    def found(batches: Iterator) -> Iterator:
        finder = Finder(shared.value)
        for texts in batches:
            yield pd.Series(finder(texts.tolist()), index=texts.index, dtype=object)

    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(found)(batches)

    return F.pandas_udf(leaks, LEAKS)


def with_leaks(
    docs: DataFrame,
    items: DataFrame,
    out: str = "leaks",
    share: float = SHARE,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` with ``out``: the benchmark items found in each whole text.

    An item is found where some stretch of words is within ``share`` of its
    words in edits; ``end`` is the place behind the stretch's last word.  Words
    are runs of letters and digits, in lower case; items without any are left
    out, null texts hold none.  Items are carried in blocks of ``BLOCK``; each
    block is a pass over the rows, without a shuffle.  A column named ``out`` is
    replaced, other columns and repeated rows pass through.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = items.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("i"), F.coalesce(item_text, F.lit("")).alias("t")
    )
    blocks = max(1, -(-items.count() // BLOCK))
    parts = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        shared = spark.sparkContext.broadcast(Index([(r.i, r.t) for r in rows], share))
        parts.append(_leaks(shared)(F.col(text_col)))
    return docs.withColumn(out, parts[0] if blocks == 1 else F.concat(*parts))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id",
        F.col("leak.item").alias("item_id"),
        F.col("leak.edits").cast("long").alias("edits"),
        F.col("leak.words").cast("long").alias("n_words"),
        F.col("leak.end").cast("long").alias("end_word"),
    )
