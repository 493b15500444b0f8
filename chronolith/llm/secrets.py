"""Secret scan: fixed patterns, and a battery of randomness tests.

Runs of key characters are candidates.  From its characters a candidate's
encoding is inferred (hexadecimal, base 32, base 36, base 62 or base 64).  Under
the hypothesis "text or an identifier, not a key", four tests each give a
p-value that is small for keys:

* the chi-squared statistic of alphabet uniformity, which for text is
  noncentral, by as much as letter frequencies depart from uniform;
* the number of runs of one character class (lower, upper, digit, sign),
  which in text is small for the length;
* the serial correlation of neighbouring symbol values, which in counters
  and alphabets is near one;
* the likelihood of the candidate as uniform symbols of its encoding, over that
  as an identifier (letters by their frequency, classes by how they follow each
  other in names): by Markov's inequality a ratio of r has a p-value of 1 / r.  It
  keeps its power where alphabets are small and the others lose theirs.

Their Cauchy combination goes, for all candidates of a document, into a
Benjamini-Hochberg step with weights by length (short candidates carry little
evidence, so they get a smaller share of the error budget).  A candidate must
also be consistent with randomness itself: its uniformity must not be rejected.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import map_rows, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 24 and more: a match of ``+`` is maximal, so asking for 24 finds the same ones.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: False discovery rate, and the p-value under which a candidate is not random at all.
RATE, NOT_RANDOM = 1e-4, 1e-2
#: Chance that two letters of text are the same, and that neighbours differ in class.
SAME_LETTER, CLASS_CHANGE = 0.066, 0.2
#: Letters in identifiers a thousand, from a to z; a tenth goes to all letters alike.
_LETTERS = (70, 15, 44, 36, 131, 19, 19, 17, 63, 2, 9, 43, 29, 63, 60, 34, 3, 67, 82, 119, 27, 10, 10, 10, 14, 4)
LETTER = [math.log(0.9 * n / sum(_LETTERS) + 0.1 / 26) for n in _LETTERS]
#: How classes (lower, upper, digit, sign) follow each other in identifiers with digits.
FOLLOWS = [
    [math.log(p) for p in row]
    for row in (
        (0.797, 0.041, 0.041, 0.121),
        (0.226, 0.659, 0.048, 0.067),
        (0.104, 0.043, 0.768, 0.085),
        (0.701, 0.109, 0.179, 0.011),
    )
]

#: Encodings, narrowest first: name, alphabet in the order of its values.
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", _DIGITS + _LOWER[:6]),
    ("hex_upper", _DIGITS + _LOWER[:6].upper()),
    ("base32", _LOWER.upper() + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("base36_upper", _DIGITS + _LOWER.upper()),
    ("base62", _LOWER.upper() + _LOWER + _DIGITS),
    ("base64", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    ("base64url", _LOWER.upper() + _LOWER + _DIGITS + "-_"),
)
_VALUES = [(name, {c: i for i, c in enumerate(abc)}) for name, abc in ENCODINGS]


def infer(token: str) -> tuple[str, dict[str, int]] | None:
    """The narrowest encoding of a token that shows digits and letters."""
    used = set(token)
    if not (used & set(_DIGITS)) or not any(c.isalpha() for c in used):
        return None
    return next(((name, v) for name, v in _VALUES if used <= v.keys()), None)


def normal_tail(z: float) -> float:
    """P(Z >= z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def cube_root_z(x: float, df: float, noncentral: float = 0.0) -> float:
    """A normal deviate for a (noncentral) chi-squared value, by Sankaran's cube root form."""
    a = df + noncentral
    b = (df + 2 * noncentral) / (a * a)
    return ((max(x, 0.0) / a) ** (1 / 3) - (1 - 2 * b / 9)) / math.sqrt(2 * b / 9)


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def log_ratio(body: str, classes: list[int], size: int) -> float:
    """Logarithm of the likelihood as uniform symbols of ``size`` over that as an identifier."""
    text = -math.log(4)
    for c, kind in zip(body, classes, strict=True):
        text += LETTER[ord(c.lower()) - 97] if kind < 2 else -math.log(10) if kind == 2 else -math.log(2)
    text += sum(FOLLOWS[a][b] for a, b in zip(classes, classes[1:], strict=False))
    return -len(body) * math.log(size) - text


def battery(token: str) -> tuple[float, float] | None:
    """(p under "text", p under "random") of a candidate, or None without an encoding."""
    body = token.rstrip("=")
    found = infer(body)
    if found is None:
        return None
    values = found[1]
    n, k = len(body), len(values)
    x = k / n * sum(v * v for v in Counter(body).values()) - n
    # text uses letters with unequal chances: the noncentrality for each symbol
    away = n * max(k * max(SAME_LETTER, 1.5 / k) - 1, 0.25)
    p_uniform = normal_tail(-cube_root_z(x, k - 1, away))
    classes = [_class(c) for c in body]
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    mean, sd = (n - 1) * CLASS_CHANGE, math.sqrt((n - 1) * CLASS_CHANGE * (1 - CLASS_CHANGE))
    p_runs = normal_tail((changes - 0.5 - mean) / sd)
    v = [values[c] for c in body]
    m = sum(v) / n
    spread = sum((a - m) ** 2 for a in v)
    r = sum((a - m) * (b - m) for a, b in zip(v, v[1:], strict=False)) / spread if spread else 1.0
    # counters and alphabets: correlation of one half and more
    p_serial = normal_tail((0.5 - abs(r)) * math.sqrt(n))
    p_likely = min(0.5, math.exp(-log_ratio(body, classes, k)))
    # Cauchy combination: valid although the tests depend on each other
    tests = (p_uniform, p_runs, p_serial, p_likely)
    t = sum(math.tan((0.5 - min(max(p, 1e-15), 1 - 1e-9)) * math.pi) for p in tests) / len(tests)
    p_text = 0.5 - math.atan(t) / math.pi if t < 1e8 else 1 / (t * math.pi)
    z = cube_root_z(x, k - 1)
    p_random = min(1.0, 3 * min(normal_tail(z), 2 * normal_tail(abs(r) * math.sqrt(n)), 1.0))
    return p_text, p_random


def discoveries(found: list[tuple[int, int, float]], rate: float = RATE) -> list[tuple[int, int]]:
    """Spans (start, end, p) that a length-weighted Benjamini-Hochberg step keeps."""
    if not found:
        return []
    mean = sum(e - s for s, e, _ in found) / len(found)
    ranked = sorted((p * mean / (e - s), s, e) for s, e, p in found)
    last = 0
    for k, (p, _, _) in enumerate(ranked, 1):
        if p <= rate * k / len(ranked):
            last = k
    return [(s, e) for _, s, e in ranked[:last]]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns' matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the battery adds: those that no base span overlaps."""
    found = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if any(a < e and s < b for a, _, b in base):
            continue
        p = battery(m.group())
        if p is not None and p[1] >= NOT_RANDOM:
            found.append((s, e, p[0]))
    return [(s, 3, e) for s, e in discoveries(found)]


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text.

    Returns ``id_col``, ``base`` and ``added``: array<struct<kind, start, end>>
    in order of start, then kind; offsets are code points, ends exclusive.  A
    null text counts as empty and has no spans; null ids and repeated rows
    stay; other columns are ignored; an empty table gives an empty result.
    No shuffle: documents are scanned on their own, so a key that many share
    costs no more than others.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind: string, start: int, end: int>>"

    def rows(spans):
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            base = [base_spans(t or "") for t in pdf["_text"]]
            added = [random_spans(t or "", b) for t, b in zip(pdf["_text"], base, strict=True)]
            yield pd.DataFrame(
                {"_id": pdf["_id"], "base": map(rows, base), "added": map(rows, added)}
            )

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = map_rows(source, run, f"_id {kind}, base {span}, added {span}")
    return out.withColumnRenamed("_id", id_col)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    def order(x):
        rank = F.array_position(F.array(*map(F.lit, KINDS)), x.kind).cast("int")
        return F.struct(x.start.alias("start"), rank.alias("rank"), x.end.alias("end"), x.kind.alias("kind"))

    every = F.array_sort(F.transform(F.concat("base", "added"), order))
    kinds = F.transform("base", lambda x: x.kind)

    def count(k: str):
        return F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}")

    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )
