"""Texts and tables that operators must stand."""

from pyspark.sql import functions as F

WEIRD = [
    "", None, " ", "\n\n", "a", "aaaa " * 200, "<|endoftext|> x <|endoftext|>", "it's  he'll 'S", "漢字 émoji 😀😀 1234567",
    "\x1c\x1d a\x85b　c", "x" * 5000, "one two three four five six", "one two three four five six", "Ünï\r\ncödé İ K ſ ½ ²",
    "token = 'abcdef123456'", "word " * 3000,
]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(spark, texts):
    """Documents with repeated rows, a null id, and columns named like an operator's own."""
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b c d e f"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns(
        {c: F.lit("clash") for c in ("ids", "decoded", "n_tokens", "_text", "_id", "token", "node", "key", "line", "leaks", "dropped")}
    )


def documents(spark, texts, null_ids=True):
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    if null_ids:
        rows += [(None, "left alone by what needs an id", None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
