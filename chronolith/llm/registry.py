"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm.bpe import op8_bpe
from chronolith.llm.decontaminate import op4_decontaminate
from chronolith.llm.fingerprints import op3_fingerprints
from chronolith.llm.line_dedup import ORACLE_SQL as LINES_SQL
from chronolith.llm.line_dedup import op2_line_dedup
from chronolith.llm.ngram_join import ORACLE_SQL as JOIN_SQL
from chronolith.llm.ngram_join import op7_ngram_join
from chronolith.llm.quality import op6_quality
from chronolith.llm.secrets import op1_secrets
from chronolith.llm.token_counts import op9_token_counts
from chronolith.llm.toxicity import op10_toxicity
from chronolith.llm.warc import ORACLE_SQL as WARC_SQL
from chronolith.llm.warc import op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_line_dedup": op2_line_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_ngram_join": op7_ngram_join,
    "op8_bpe": op8_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": LINES_SQL, "op5_warc": WARC_SQL, "op7_ngram_join": JOIN_SQL}
