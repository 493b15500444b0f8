"""Jaccard join of word shingle sets under several global token orders.

Two sets whose similarity reaches the threshold share a token among their
first n - ceil(t n) + 1 tokens under every global order.  So prefixes are taken
under several orders and candidates intersected: pairs meet in the buckets of the
first order (rare tokens first), which alone is sent through a shuffle; the others
(hashes upwards and downwards) are checked where the two sets of a pair are at hand,
in front of the exact comparison.  The first token that two sets share leaves room
for the overlap that their sizes ask for; entries whose place and bucket show that
they can't be such a token of any pair go at once.

Documents with equal sets are one class from the start.  In a bucket (the
classes that share a prefix token) each class is first compared with a hub, the
smallest class of the bucket; classes found linked need no comparison with
each other.  In buckets of many classes those outside the bucket's largest component
are compared with some members of it, from round to round with more, as long as these
find links; a class that has found one leaves.  Then every pair of a bucket that is
still in different components is a candidate, without a limit.  So no link between
components is lost, and a group of near copies makes a few pairs for each member, not
their square: a member that links with one in twenty others needs about twenty of them.
A member whose own words fill its prefix meets nobody there; it can't link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import forget, map_rows, semi_by_key, small, stored, table
from chronolith.llm.components import components

WORDS, PERCENT = 5, 75
#: Most tokens in the table that puts frequent tokens last; it steers the order, never the result.
FREQUENT = 1 << 18
#: Counts of a token within so many tokens of a task that make it worth counting.
CHUNK, SEEN = 1 << 20, 2
#: Parts that the bucket of a frequent token is dealt into, and how its tokens show them.
SALTS, SALTED, PART = 64, 2, 0xFC
#: Share of a document's prefix tokens whose bucket has one hub, from which on that pair is
#: compared early; it saves work, the pairs left over are compared in any case.
STAR = 0.1
#: Documents from which on a bucket's outsiders are compared with more members; rounds at most, those
#: which are run even if one before found no link, and the factor by which members grow.
WIDE, ROUNDS, TRIED, GROWTH = 32, 8, 3, 4
#: Words whose hashes a worker keeps.
CACHE_WORDS = 100_000

_U = np.uint64
_MIX = (_U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of 64-bit values (the finalizer of MurmurHash3)."""
    x = x ^ _U((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> _U(33))) * _MIX[0]
    x = (x ^ (x >> _U(33))) * _MIX[1]
    return x ^ (x >> _U(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


class Shingler:
    """Sorted arrays of the 64-bit hashes of a text's distinct word shingles."""

    def __init__(self, n: int = WORDS):
        self.n, self.hashes = n, _Hashes()
        self.factors = mixed(np.arange(1, n + 1, dtype=np.uint64), 7) | _U(1)

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower and bytes.split know ASCII letters and ASCII white space only
        words = (text or "").encode("utf-8").lower().split()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        if not n:
            return h
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            out += h[i : len(h) - n + 1 + i] * self.factors[i]
        return np.unique(mixed(out))


def set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets reach the threshold, in whole numbers."""
    n, m = len(x), len(y)
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (n + m - shared)


def agreed(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int = PERCENT) -> bool:
    """Whether sets of ``n`` and ``m`` share enough tokens of their prefixes ``x`` and ``y`` under one order.

    Up to the nearer end of the two prefixes all shared tokens are in both;
    behind it at most one set's rest is shared.  Together they must reach the
    overlap that the threshold asks for.
    """
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    overlap = -(-percent * (n + m) // (100 + percent))
    least = max(1, overlap + 1 - -(-percent * max(n, m) // 100))
    return (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum() >= least


def _last_place(size: Column, other: Column, percent: int) -> Column:
    """The last place, in a set of ``size``, of the first token that it shares with one of ``other`` where they link."""
    return size - F.ceil(percent * (size + other) / (100 + percent)) + 1


def _scan(rows: DataFrame, n: int) -> DataFrame:
    """A row for each document (_id, size, key), and rows (token, count) of tokens
    that a task saw in several documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, held, total = Shingler(n), [], 0

        def counted() -> pd.DataFrame:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= SEEN
            return pd.DataFrame(
                {"_id": None, "size": None, "key": None, "token": token[often].view(np.int64), "count": count[often]}
            )

        for pdf in batches:
            sets = [shingler(t) for t in pdf["_text"]]
            yield pd.DataFrame(
                {"_id": pdf["_id"], "size": [len(x) for x in sets], "key": [set_key(x) for x in sets]}
            ).assign(token=None, count=None)
            held += sets
            total += sum(map(len, sets))
            if total >= CHUNK:
                yield counted()
                held, total = [], 0
        if held:
            yield counted()

    kind = rows.schema["_id"].dataType.simpleString()
    return map_rows(rows, run, f"_id {kind}, size long, key long, token long, count long")


def _frequent(scan: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in many documents, sorted, with the magnitude of their counts; at most ``most``."""
    counts = stored(
        scan.where("token is not null")
        .groupBy("token")
        .agg(F.sum("count").alias("count"))
        .select("token", F.floor(F.log2("count")).cast("int").alias("level"))
    )
    levels = {r["level"]: r["count"] for r in counts.groupBy("level").count().collect()}
    least, total = 64, 0
    for level in sorted(levels, reverse=True):
        if (total := total + levels[level]) > most:
            break
        least = level
    top = counts.where(F.col("level") >= least).toPandas()
    token = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["level"].to_numpy(dtype=np.uint64)[order]


def _entries(rows: DataFrame, n: int, percent: int, frequent: tuple) -> DataFrame:
    """(token, node, spot): the prefix tokens of a task's distinct sets.

    The bucket of a frequent token is dealt into parts, which the bits ``PART`` of
    the token tell, below ``SALTED``.  ``spot`` holds the place in the order (from 1) above the set's size.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, seen = Shingler(n), set()
        known, level = shared.value
        for pdf in batches:
            out = []
            for node, text in zip(pdf["_id"], pdf["_text"], strict=True):
                x = shingler(text)
                if not len(x) or (key := set_key(x)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                high = np.zeros(len(x), np.uint64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    hit = known[at] == x
                    high[hit] = level[at[hit]] + _U(1)
                p = prefix_size(len(x), percent)
                place = (high << _U(57)) | (mixed(x, 1) >> _U(7))
                first = np.argpartition(place, p - 1)[:p] if p < len(x) else np.arange(p)
                first = first[np.argsort(place[first])]
                x_first = x[first]
                part = _U(SALTED | (hash(node) % SALTS) << 2)
                token = np.where(high[first] > 0, (x_first & ~_U(PART | 3)) | part, x_first & ~_U(3))
                out.append((token.view(np.int64), node, len(x)))
            if out:
                size = [len(t) for t, *_ in out]
                place = np.concatenate([np.arange(1, k + 1) for k in size])
                yield pd.DataFrame(
                    {
                        "token": np.concatenate([t for t, *_ in out]),
                        "node": np.repeat(np.array([o[1] for o in out]), size),
                        "spot": np.repeat(np.array([o[2] for o in out]), size) | place << 32,
                    }
                )

    return map_rows(rows, run, "token long, node long, spot long")


def _compared(pairs: DataFrame, values: DataFrame, make: Callable[[], Callable], test: Callable) -> DataFrame:
    """The pairs (a, b) that pass ``test``, called with what ``make()`` makes of the values of a
    and b; ``pairs`` and ``values`` (node, value) are stored.

    Pairs are dealt out by b, those of one b in up to ``SALTS`` parts; in front of a part
    stands b itself.  So a value is sent once for a pair and once for a part, not twice for a
    pair, and a task holds one set besides that at hand.
    """
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    values = semi_by_key(values.toDF("node", "value"), nodes, "node")
    dealt = pairs.select("b", F.pmod(F.xxhash64("a"), F.lit(SALTS)).alias("salt"), "a")
    heads = dealt.select("b", "salt").distinct()
    heads = heads.join(values.toDF("b", "value"), "b").select("b", "salt", F.col("b").alias("a"), "value", F.lit(0).alias("kind"))
    rows = dealt.join(values.toDF("a", "value"), "a").select("b", "salt", "a", "value", F.lit(1).alias("kind"))
    rows = heads.union(rows).repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, held = make(), None
        for pdf in batches:
            found = []
            for a, b, kind, value in zip(pdf["a"], pdf["b"], pdf["kind"], pdf["value"], strict=True):
                if kind == 0:
                    held = made(value)
                elif test(made(value), held):
                    found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return map_rows(rows.select("b", "a", "kind", "value"), run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose documents' sets share enough of their prefixes with the highest hashes
    and reach the threshold; ``texts`` (node, text) is stored."""

    def test(x: np.ndarray, y: np.ndarray) -> bool:
        p, q = prefix_size(len(x), percent), prefix_size(len(y), percent)
        return agreed(x[-p:], y[-q:], len(x), len(y), percent) and linked(x, y, percent)

    return _compared(pairs, texts, lambda: Shingler(n), test)


def _upwards(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose documents' sets share enough of their prefixes with the lowest hashes.

    A document is sent as its size and the upper halves of that prefix's hashes.  Equal
    halves of different hashes can let a pair in, but keep none out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        for pdf in batches:
            sets = [shingler(t) for t in pdf["text"]]
            lows = [(x[: prefix_size(len(x), percent)] >> _U(32)).astype(np.uint32) for x in sets]
            value = [np.uint32(len(x)).tobytes() + low.tobytes() for x, low in zip(sets, lows, strict=True)]
            yield pd.DataFrame({"node": pdf["node"], "value": value})

    def test(x: np.ndarray, y: np.ndarray) -> bool:
        return agreed(x[1:], y[1:], int(x[0]), int(y[0]), percent)

    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    lows = stored(map_rows(semi_by_key(texts, nodes, "node"), run, "node long, value binary"))
    return _compared(pairs, lows, lambda: lambda value: np.frombuffer(value, np.uint32), test)


def _stars(entries: DataFrame, node: str, hub: str, percent: int) -> DataFrame:
    """Pairs (a, b) of a node and a hub that share a good part of the node's prefix,
    with the number of tokens n."""
    return (
        entries.where(F.col(node) != F.col(hub))
        .groupBy(F.col(node).alias("a"), F.col(hub).alias("b"))
        .agg(F.count("*").alias("n"), F.min("size").alias("size"))
        .where(F.col("n") >= STAR * (F.col("size") * (100 - percent) / 100))
        .select("a", "b", "n")
    )


def _met(entries: DataFrame, percent: int) -> DataFrame:
    """Entries (token, node, hub, size, place) that can be the first token shared with another
    document; hub is the smallest node of the bucket, or of the part of a frequent token's bucket.

    A part doesn't show the whole bucket, so all of it stays.  Of two documents each sees the
    other's size and place; of more, it is held against the smallest size, which leaves most room.
    """
    bucket = Window.partitionBy("token")
    size, place = F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("spot", 32)
    over = entries.withColumns({
        "hub": F.min("node").over(bucket),
        "top": F.max("node").over(bucket),
        "n": F.count("*").over(bucket),
        "least": F.min(size).over(bucket),
        "low": F.min("spot").over(bucket),
        "high": F.max("spot").over(bucket),
    }).where((F.col("token").bitwiseAND(F.lit(SALTED)) != 0) | (F.col("hub") < F.col("top")))
    other = F.when(F.col("spot") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    other_size, other_place = other.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(other, 32)
    least = F.greatest("least", F.ceil(percent * size / 100))
    return over.where(
        F.when(F.col("token").bitwiseAND(F.lit(SALTED)) != 0, True)
        .when(
            F.col("n") == 2,
            (place <= _last_place(size, other_size, percent))
            & (other_place <= _last_place(other_size, size, percent)),
        )
        .otherwise(place <= _last_place(size, least, percent))
    ).select("token", "node", "hub", size.cast("int").alias("size"), place.cast("int").alias("place"))


def _mixed(entries: DataFrame, near: DataFrame) -> DataFrame:
    """Entries with their component, in buckets that hold more than one; stored."""
    near = F.broadcast(near) if small(near, 32, 16 << 20) else near
    placed = entries.join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return stored(placed.join(several.where("low < high").select("token"), "token"))


def _pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: documents in different components that share one of the tokens which can
    be the first that they share."""
    return _meeting(entries, entries, F.col("x.node") < F.col("y.node"), percent)


def _meeting(left: DataFrame, right: DataFrame, which: Column, percent: int) -> DataFrame:
    """(a, b): documents x of ``left`` and y of ``right`` in different components that share a token
    which can be the first that they share."""
    x, y = left.alias("x"), right.alias("y")
    return x.join(
        y,
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.root") != F.col("y.root"))
        & which
        # the first token that they share leaves room for the overlap asked for
        & (F.col("x.place") <= _last_place(F.col("x.size"), F.col("y.size"), percent))
        & (F.col("y.place") <= _last_place(F.col("y.size"), F.col("x.size"), percent)),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _outside(part: DataFrame, most: int, seed: int, percent: int) -> DataFrame:
    """(a, b): documents a outside the largest component of a bucket, with up to ``most`` of its
    members b for each bucket; ``part``, of ``_mixed``, is stored.

    Members that share most of their prefix come first; those of like standing differ from
    bucket to bucket, so that a document meets many of them.
    """
    roots = part.groupBy("token", "root").agg(F.count("*").alias("n"), F.max("central").alias("central"))
    largest = F.struct("n", "central", F.xxhash64("root", F.lit(seed)))
    part = part.join(roots.groupBy("token").agg(F.max_by("root", largest).alias("main")), "token")
    best = Window.partitionBy("token").orderBy(F.desc("central"), F.xxhash64("node", "token"), "node")
    members = part.where("root = main").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most)
    return _meeting(part.where("root <> main"), members, F.lit(True), percent)


def _wide(placed: DataFrame) -> DataFrame:
    """Tokens whose bucket holds at least ``WIDE`` documents."""
    return placed.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= WIDE).select("token")


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (smallest id that links reach).

    Documents link when 100 * shared >= percent * united shingles.  A text
    with fewer than ``n`` words has one shingle, all its words.  Null and empty
    texts have no shingles and link with nothing.  A row with a null id has a
    count and a null component.  Rows of one id are one document in the
    components, with the smallest of its texts where it links with others.
    Equal texts are linked whatever their number.  Other columns are ignored;
    an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    scan = stored(_scan(rows, n))
    # the count of a token row is never null, that of a document's row is
    found = scan.where("size is not null")
    classes = stored(
        found.where("_id is not null and size > 0").groupBy("key", "size").agg(F.min("_id").alias("rep"))
    )
    entries = _entries(rows.where("_id is not null"), n, percent, _frequent(scan))
    hubs = _met(entries, percent)
    # documents with equal sets stand for each other
    member = found.where("_id is not null and size > 0").join(classes, ["key", "size"])
    member = stored(member.groupBy(F.col("_id").alias("node")).agg(F.min("rep").alias("rep")))
    of = F.broadcast(member) if small(member, 32, 16 << 20) else member
    salted = F.col("token").bitwiseAND(F.lit(SALTED)) != 0
    # rows are still dealt out by token, so equal ones are told apart without a shuffle
    hubs = hubs.join(of, "node").join(of.toDF("hub", "hub_rep"), "hub").select(
        "token", F.col("rep").alias("node"), F.col("hub_rep").alias("hub"), "size", "place"
    )
    hubs = stored(
        hubs.distinct().select(
            F.when(salted, F.col("token").bitwiseAND(F.lit(~PART))).otherwise(F.col("token")).alias("token"),
            salted.alias("salted"), "node", "hub", "size", "place",
        )
    )
    top = hubs.where("salted").groupBy("token").agg(F.min("hub").alias("top"))
    parts = hubs.where("salted").select("token", "hub", "size").distinct().join(top, "token")
    stars = _stars(hubs, "node", "hub", percent).union(_stars(parts, "hub", "top", percent))
    stars = stored(stars.select("a", "b").distinct())
    texts = semi_by_key(rows, stored(hubs.select(F.explode(F.array("node", "hub")).alias("_id")).distinct()), "_id")
    texts = stored(texts.groupBy(F.col("_id").alias("node")).agg(F.min("_text").alias("text")))
    links = stored(_verified(stars, texts, n, percent))
    near = components(links).toDF("node", "root")
    columns = ["token", "node", "size", "place"]
    entries = hubs.where("not salted").select(*columns)
    placed = _mixed(entries.union(hubs.where("salted").select(*columns).distinct()), near)
    # the buckets with many documents, which are few, are tried from outside while this finds links
    wide = stored(placed.join(_wide(placed), "token").drop("root"))
    # those are best that share most of their prefix: in eighths of the prefix's size
    own = F.count("*") / (F.min("size") - F.ceil(F.min("size") * percent / 100) + 1)
    wide = stored(wide.join(wide.groupBy("node").agg(F.floor(8 * own).alias("central")), "node"))
    for r in range(0 if wide.isEmpty() else ROUNDS):
        more = _outside(_mixed(wide, near), GROWTH**r, r, percent)
        more = stored(more.join(stars, ["a", "b"], "left_anti"))
        new = stored(_verified(more, texts, n, percent))
        stars = stored(stars.union(more))
        if not new.isEmpty():
            links = stored(links.union(new))
            near = components(links).toDF("node", "root")
        elif r + 1 >= TRIED:
            break
    # what is left: every pair of a bucket in different components
    placed = _mixed(placed.drop("root"), near)
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = _pairs(placed, percent)
    pairs = stored(pairs.join(done, ["a", "b"], "left_anti"))
    pairs = stored(_upwards(pairs, texts, n, percent))
    links = links.union(_verified(pairs, texts, n, percent))
    joined = components(links).toDF("rep", "root")
    forget(hubs, texts, placed, wide, stars)
    out = (
        found.join(classes, ["key", "size"], "left")
        .join(F.broadcast(joined) if small(joined, 32, 16 << 20) else joined, "rep", "left")
        .select(
            F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col),
            F.col("size").alias("n_shingles"),
            F.when(F.col("_id").isNotNull(), F.coalesce("root", "rep", "_id")).alias("component_id"),
        )
    )
    return out


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = rf"""
with recursive w as (
  select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[\x20\x09-\x0D]+') if x <> ''] ws
  from documents
), s as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < {WORDS} then [array_to_string(ws, ' ')]
    else [array_to_string(ws[i:i + {WORDS - 1}], ' ') for i in range(1, len(ws) - {WORDS} + 2)] end) g
  from w
), t as (select doc_id, len(g) n, unnest(g) g from s),
e as (
  select a.doc_id x, b.doc_id y from t a join t b on a.g = b.g and a.doc_id < b.doc_id
  group by all having 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))
), l as (select x, y from e union select y, x from e),
r(k, root) as (
  select distinct x, x from l
  union
  select l.y, r.root from r join l on l.x = r.k where r.root < l.y
)
select s.doc_id, len(s.g)::bigint n_shingles,
  case when s.doc_id is not null then coalesce((select min(root) from r where r.k = s.doc_id), s.doc_id) end component_id
from s
"""
