"""Bottom-k sketches of documents' word shingles, with DataFrame functions only.

A sketch holds the k smallest 64-bit hashes of a document's distinct five-word
shingles, in order.  The sketch of a union is the k smallest of two sketches'
union, so sketches of parts merge; from two sketches resemblance, containment
and distinct counts are estimated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import small, stored, table

#: Hashes in a sketch, and words in a shingle.
K, WORDS = 128, 5
#: Neighbouring ids kept together when documents are put in order.
BUCKET, SUPER = 256, 1024
#: An ordering table measured below this is broadcast.
ORDER_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Lower-cased words of a text, split at ASCII white space."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), "")


def add_sketch(df: DataFrame, text_col: str, out: str, k: int = K, n: int = WORDS) -> DataFrame:
    """Add ``out``: array<bigint>, the bottom-k sketch of ``text_col``.

    A text with fewer than ``n`` words has one shingle, all its words; a null
    text or one without words has an empty sketch.
    """
    w, size = f"_{out}_words", f"_{out}_size"
    df = df.withColumn(w, F.transform(words(F.col(text_col)), lambda x: F.xxhash64(x)))
    df = df.withColumn(size, F.size(w))
    at = F.sequence(F.lit(1), F.greatest(F.col(size) - (n - 1), F.lit(1)))
    shingles = F.transform(
        at, lambda i: F.xxhash64(*[F.get(F.col(w), i + (j - 1)) for j in range(n)])
    )
    none = F.array().cast("array<bigint>")
    sketch = F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)
    return df.withColumn(out, F.when(F.col(size) == 0, none).otherwise(sketch)).drop(w, size)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, key: str, sketch: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch for each ``key``: ``key``, ``sketch``.

    The k smallest distinct hashes are taken first within salted parts of a
    group, before and after the shuffle, so that a hot group is never in one
    task.  Null keys form a group; empty and null sketches add nothing.
    """
    hashes = df.select(key, F.explode(sketch).alias("_h"))

    def least(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("_h")
        return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")

    # equal hashes meet in one salt, so each hash is counted once
    salted = hashes.withColumn("_salt", F.pmod(F.col("_h"), F.lit(salts))).distinct()
    top = least(least(salted, key, "_salt"), key)
    return top.groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact while the sketch isn't full."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    j = resemblance(a, b, k)
    shared = j * (distinct_count(a, k) + distinct_count(b, k)) / (1 + j)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), shared / distinct_count(a, k))
    )


def shown(sketch: Column) -> Column:
    """A sketch as text: hexadecimal hashes, joined."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ",")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K
) -> DataFrame:
    """``id_col``, ``sketch`` and ``n_shingles`` (estimated) of every whole text.

    Null texts count as empty, null ids and repeated rows stay, other columns
    are ignored, an empty table gives an empty result.  No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = add_sketch(rows, "_text", "sketch", k)
    return out.select(
        F.col("_id").alias(id_col), "sketch", distinct_count(F.col("sketch"), k).alias("n_shingles")
    )


def previous_buckets(ids: DataFrame) -> DataFrame:
    """(_id, _before): each bucket's smallest id, and the bucket in front of it;
    in front of the first bucket stands the last one.

    Buckets are put in order within ranges of ``SUPER`` buckets; only one row
    for each such range is ordered in one place.
    """
    heads = ids.groupBy(F.expr(f"_id div {BUCKET}").alias("_bucket")).agg(F.min("_id").alias("_id"))
    heads = stored(heads.withColumn("_range", F.expr(f"_bucket div {SUPER}")))
    ranges = heads.groupBy("_range").agg(F.max("_bucket").alias("_last"))
    every = Window.orderBy("_range")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "_range", F.coalesce(F.lag("_last").over(every), F.last("_last").over(whole)).alias("_far")
    )
    near = F.lag("_bucket").over(Window.partitionBy("_range").orderBy("_bucket"))
    return (
        heads.withColumn("_near", near)
        .join(ranges, "_range")
        .select("_id", F.coalesce("_near", "_far").alias("_before"))
    )


def with_next(rows: DataFrame, text: str = "_text", derive=lambda df: df) -> DataFrame:
    """Add ``_next``: the row with the next ``_id`` as a struct, the first row behind the last.

    Rows are dealt out by ranges of ids.  The first document of a range is
    also sent to the range before it, where it ends the order; so no task holds
    more than a range, and no text passes through one place.  Rows of equal ids
    stand in order of their text; rows without an id have no next row.
    ``derive`` adds columns after the rows are dealt out.
    """
    before = stored(previous_buckets(rows.where("_id is not null").select("_id")))
    if small(before, 32, ORDER_BYTES):
        before = F.broadcast(before)
    own = F.coalesce(F.expr(f"_id div {BUCKET}"), F.pmod(F.xxhash64(text), F.lit(1 << 20)))
    places = F.array(F.struct(own.alias("b"), F.lit(0).alias("copy")))
    both = F.array(
        F.struct(own.alias("b"), F.lit(0).alias("copy")),
        F.struct(F.col("_before").alias("b"), F.lit(1).alias("copy")),
    )
    dealt = (
        rows.join(before, "_id", "left")
        .withColumn("_at", F.explode(F.when(F.col("_before").isNull(), places).otherwise(both)))
        .select(*rows.columns, F.col("_id").isNull().alias("_no_id"), "_at.b", "_at.copy")
        .repartition("_no_id", "b")
    )
    dealt = derive(dealt)
    order = Window.partitionBy("_no_id", "b").orderBy("copy", "_id", text)
    here = F.struct(*[F.col(c) for c in dealt.columns if c not in ("_no_id", "b", "copy")])
    following = F.when(~F.col("_no_id"), F.lead(here).over(order))
    return dealt.withColumn("_next", following).where("copy = 0").drop("b", "copy", "_no_id")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")
    )
    rows = with_next(docs, derive=lambda df: add_sketch(df, "_text", "_sketch"))
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring("_text", F.lit(1), n - half),
        F.coalesce(F.substring(F.col("_next._text"), F.lit(1), half), F.lit("")),
    )
    rows = rows.select(
        "_id",
        n.cast("long").alias("n_chars"),
        edited.alias("_edited"),
        "_sketch",
        F.coalesce("_next._sketch", F.array().cast("array<bigint>")).alias("_next_sketch"),
    )
    rows = add_sketch(rows, "_edited", "_edited_sketch")
    return rows.select(
        F.col("_id").alias("doc_id"),
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        shown(F.col("_sketch")).alias("fingerprint"),
        shown(F.col("_edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_edited_sketch")).alias("near_edited"),
        resemblance(F.col("_sketch"), F.col("_next_sketch")).alias("near_next"),
        distinct_count(F.col("_sketch")).alias("n_shingles"),
        containment(F.col("_edited_sketch"), F.col("_sketch")).alias("edited_in_own"),
    )
