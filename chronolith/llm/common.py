"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to a Python worker at once; a longer row goes alone.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
#: A table joined as a broadcast must be measured below this many bytes; above it the join shuffles.
BROADCAST_BYTES = 8 << 20
#: Spark's setting that deletes shuffle files when their query ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only where ``spark.checkpoint.dir`` is unset (tests, a laptop) a folder
    below the SQL warehouse is used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    )
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and the files
    of its shuffles go at once."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table is proven to stay under ``limit`` bytes when broadcast."""
    return df.limit(limit // bytes_per_row + 1).count() * bytes_per_row <= limit


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def joined_hot(left: DataFrame, right: DataFrame, key: str, of: str, parts: int = 32) -> DataFrame:
    """Left join of ``left.key`` with the distinct ``right.of``, a stored table, where one key
    may have a large share of the left rows.

    A right table measured as small is broadcast; else each of its rows is sent to
    ``parts`` parts, over which the rows of a key are spread.
    """
    if small(right, 256):
        return left.join(F.broadcast(right), F.col(key) == F.col(of), "left")
    salt, part = free_name(left, "_salt"), free_name(left, "_part")
    left = left.withColumn(salt, F.pmod(F.xxhash64(*[c for c, k in left.dtypes if "map<" not in k]), F.lit(parts)))
    right = right.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).cast("long"))
    on = (F.col(key) == F.col(of)) & (F.col(salt) == F.col(part))
    return left.join(right, on, "left").drop(salt, part)


def semi_by_key(df: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Keep the rows of ``df`` whose ``key`` is in the stored, distinct ``keys``.

    A key table measured as small is broadcast, a larger one is joined by shuffle.
    """
    return df.join(F.broadcast(keys) if small(keys, 24) else keys, key, how)


def tidied(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``fn`` over a task's batches, giving unused memory back to the system when the
    task ends: Spark's Python workers live on and serve other operators."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers at most ``BATCH_ROWS`` rows or about ``BATCH_BYTES`` at once."""
    conf = spark.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_rows(
    df: DataFrame,
    fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """``mapInPandas`` with batches small enough for long documents."""
    small_batches(df.sparkSession)
    return df.mapInPandas(tidied(fn), schema)
