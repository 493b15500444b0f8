"""A training-data pipeline over ``documents``: five stages, each one operator.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written
as Parquet and read again as the next stage's docs.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.bpe import encode_decode
from chronolith.llm.common import small, stored, table
from chronolith.llm.decontaminate import with_leaks
from chronolith.llm.line_dedup import dedup_lines
from chronolith.llm.ngram_join import jaccard_components
from chronolith.llm.quality import KEEP, classify

#: Measured tables of ids below this are broadcast.
BYTES = 32 << 20


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = classify(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("quality_score") >= KEEP).select(*docs.columns)


def keep_first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly repeat an earlier one; those of which
    nothing is left go, those that were empty before stay."""
    rows = dedup_lines(docs)
    emptied = (F.size("dropped") > 0) & (F.trim("text") == "")
    rows = rows.where(~emptied)
    return rows.withColumn(
        "n_chars",
        F.when(F.size("dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
        .otherwise(F.col("n_chars")),
    ).select(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity links, that with the smallest id; rows without an id stay."""
    found = jaccard_components(docs)
    gone = stored(
        found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    )
    return docs.join(F.broadcast(gone) if small(gone, 24, BYTES) else gone, "doc_id", "left_anti").select(
        *docs.columns
    )


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = with_leaks(docs, table(spark, sf_dir, "benchmark"), out="_leaks")
    return rows.where(F.size("_leaks") == 0).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return encode_decode(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", keep_first_lines),
    ("n-gram Jaccard join", keep_one_of_group),
    ("benchmark decontamination", keep_uncontaminated),
    ("BPE encoding", encoded),
]

#: Classifier and tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
