"""Exact token counts at every prefix of a text.

For a vocabulary that ends words with a marker, dynamic programming over a
word's characters finds the last token of the encoding of every prefix: the
one token ending there that may stand behind the last token of what precedes
it.  Two tokens may stand together when merging their joint symbols gives just
those two back.  The count of a prefix is one more than the count before that
token.  A batch's new words are taken in order, so that a word goes on from the
prefix that it has in common with the one before.  Word tables join to one array for a text, from which the count of any
prefix, and the longest prefix within a budget, are read without encoding again.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.bpe import Merges, Splitter, byte_alphabet, checked, merge_word
from chronolith.llm.common import map_rows, table

VOCABULARY = "word_bpe_49k.json"
#: Tokens that a training example may hold.
BUDGET = 2048
#: White space in front belongs to a piece, so that pieces cover the text.
PIECES = r"{S}*(?:'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|{O}+)"
#: Distinct words, and characters in them, that a worker keeps before starting anew.
CACHE_WORDS, CACHE_CHARS = 400_000, 6_000_000
#: Pairs of tokens whose compatibility a worker remembers.
CACHE_PAIRS = 500_000


#: Settings of vocabulary files whose tokens are counted here.
SETTINGS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer.pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
    "model.type": "BPE",
    "model.dropout": None,
}
#: Lower case of letters that came into Unicode behind version 15.1, as the
#: tokenizers library gives it: single letters, and ranges with their distance.
NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: How the UTF-8 forms of those letters begin: texts without them need no look at each letter.
NEWER_BYTES = sorted({chr(c).encode()[:2] if c < 0x10000 else chr(c).encode()[:3] for c in NEWER})


class _Index(dict):
    """piece -> its number, in the order of their coming."""

    def __missing__(self, piece: str) -> int:
        k = self[piece] = len(self)
        return k


class PrefixCounter:
    """Token counts of prefixes under one word-end vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f), SETTINGS)
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.byte_id = [vocab[alphabet[b]] for b in range(256)]
        self.end_id = [vocab[alphabet[b] + self.end] for b in range(256)]
        self.merges = Merges(vocab, spec["model"]["merges"])
        # a token, as bytes, inside words and at their end
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for s, i in vocab.items():
            at_end = s.endswith(self.end)
            raw = bytes(back[c] for c in (s[: -len(self.end)] if at_end else s))
            (self.final if at_end else self.inner)[raw] = i
        # a token that its own symbols do not merge to never stands in an encoding
        self.inner = {w: i for w, i in self.inner.items() if self._merged(w, False) == [i]}
        self.final = {w: i for w, i in self.final.items() if self._merged(w, True) == [i]}
        # every suffix of a token, with the tokens that it is inside and at the end of words, and
        # which tokens may stand before those (-1: none does), as far as known
        self.before = {i: {-1: True} for i in (*self.inner.values(), *self.final.values())}
        self.nodes = {
            w[k:]: (i := self.inner.get(w[k:], -1), self.before.get(i), f := self.final.get(w[k:], -1), self.before.get(f))
            for w in (*self.inner, *self.final)
            for k in range(len(w))
        }
        self.n_pairs = 0
        self.raw = {i: w for w, i in self.inner.items()} | {i: w for w, i in self.final.items()}
        self.finals = frozenset(self.final.values())
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        # runs of white space that are not a single space already
        self.space = regex.compile(r"[^\S ]\s*| \s+")
        self.pieces = Splitter(PIECES)
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.packed = self.chars = 0
        self.flat = self.len_of = self.start_of = self.total_of = np.zeros(0, np.int64)

    def _merged(self, raw: bytes, at_end: bool) -> list[int]:
        ids = [self.byte_id[b] for b in raw]
        if at_end:
            ids[-1] = self.end_id[raw[-1]]
        return merge_word(ids, self.merges)

    def together(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a`` in an encoding."""
        if self.n_pairs >= CACHE_PAIRS:
            self.n_pairs = 0
            for known in self.before.values():
                known.clear()
                known[-1] = True
        self.n_pairs += 1
        known = self.before[b][a] = self._merged(self.raw[a] + self.raw[b], b in self.finals) == [a, b]
        return known

    def words(self, words: list[str]) -> Iterator[list[int]]:
        """For each of sorted words, counts of its prefixes, from one character to all, each as a
        word of its own."""
        nodes, together = self.nodes.get, self.together
        held, last, count = b"", [-1], [0]  # of prefixes that go on
        whole = [0]  # counts of prefixes that end there
        for word in words:
            raw, c = word.encode("utf-8"), 0
            for x, y in zip(raw, held, strict=False):
                if x != y:
                    break
                c += 1
            held = raw
            del last[c + 1 :], count[c + 1 :], whole[c + 1 :]
            for j in range(c + 1, len(raw) + 1):
                at = n = w = -1
                for i in range(j - 1, -1, -1):
                    node = nodes(raw[i:j])
                    if node is None:
                        break
                    inner, inner_after, final, final_after = node
                    before = last[i]
                    if inner >= 0 and at < 0:
                        fits = inner_after.get(before)
                        if together(before, inner) if fits is None else fits:
                            at, n = inner, count[i] + 1
                            if w >= 0:
                                break
                    if final >= 0 and w < 0:
                        fits = final_after.get(before)
                        if together(before, final) if fits is None else fits:
                            w = count[i] + 1
                            if at >= 0:
                                break
                last.append(at)
                count.append(n)
                whole.append(w)
            if len(raw) == len(word):
                yield whole[1:]
            else:  # a character ends in front of each byte that begins one, and at the end
                yield [whole[j] for j in range(1, len(raw)) if raw[j] & 0xC0 != 0x80] + whole[-1:]

    def normal(self, text: str) -> str:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text)).lower()
        if not text.isascii():
            raw = text.encode("utf-8")
            if any(b in raw for b in NEWER_BYTES):
                text = text.translate(NEWER)
        return text

    def prefix_counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, ``out[k]`` tokens in the first ``k`` characters of its normal form.

        A special string counts as one token from its last character on.
        """
        if len(self.index) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.clear()
        plans = []
        for text in texts:
            plan = []
            for k, part in enumerate(self.split.split(text)):
                if k % 2:
                    plan.append((None, len(part)))
                    continue
                part = self.normal(part)
                pieces = self.pieces(part)
                plan.append((np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces)), len(part)))
            plans.append(plan)
        self._pack()
        return [self._joined(plan) for plan in plans]

    def _joined(self, plan: list) -> np.ndarray:
        parts, base = [np.zeros(1, np.int64)], 0
        for ids, n in plan:
            if ids is None:  # a special string
                parts.append(np.full(n, base))
                base += 1
                parts[-1][-1] = base
                continue
            size, total = self.len_of[ids], self.total_of[ids]
            covered = int(size.sum())
            before = base + np.cumsum(total) - total
            at = np.cumsum(size) - size
            within = np.arange(covered) - np.repeat(at - self.start_of[ids], size)
            parts.append(self.flat[within] + np.repeat(before, size))
            base += int(total.sum())
            parts.append(np.full(n - covered, base))
        return np.concatenate(parts)

    def _pack(self) -> None:
        """Append the tables of new pieces to the arrays."""
        new = list(islice(self.index, self.packed, None))
        if not new:
            return
        words = [p.lstrip(" ") for p in new]  # all white space is spaces by now
        order = sorted(range(len(new)), key=words.__getitem__)
        tables: list = [None] * len(new)
        for k, counts in zip(order, self.words([words[k] for k in order]), strict=True):
            tables[k] = [0] * (len(new[k]) - len(counts)) + counts
        size = np.fromiter(map(len, tables), np.int64, len(tables))
        flat = np.fromiter(chain.from_iterable(tables), np.int64, int(size.sum()))
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, flat])
        self.len_of = np.concatenate([self.len_of, size])
        self.start_of = np.concatenate([self.start_of, start])
        self.total_of = np.concatenate([self.total_of, self.flat[start + size - 1]])
        self.packed, self.chars = len(self.index), len(self.flat)


_loaded: dict[str, PrefixCounter] = {}


def loaded(path: str) -> PrefixCounter:
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def token_counts(
    docs: DataFrame,
    path: str | None = None,
    budget: int = BUDGET,
    keep_prefixes: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Token count of every whole text, and the longest prefix within ``budget``.

    Returns ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``budget_chars`` (the
    most characters of the normalised text whose count is within the budget)
    and, with ``keep_prefixes``, ``prefix_counts`` array<int> with the count of
    each prefix from 0 characters on.  A null text counts as empty: zeros.
    Null ids and repeated rows stay, other columns are ignored, an empty table
    gives an empty result.  No shuffle; memory is bounded by the longest text
    of a batch and the word caches.
    """
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_bytes long, n_tokens long, budget_chars long" + (
        ", prefix_counts array<int>" if keep_prefixes else ""
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = loaded(path)
        for pdf in batches:
            texts = [t or "" for t in pdf["_text"]]
            rows, kept = [], []
            for t, counts in zip(texts, counter.prefix_counts(texts), strict=True):
                n = int(counts[-1])
                fits = len(counts) - 1 if n <= budget else int(np.flatnonzero(counts <= budget)[-1])
                rows.append((len(t.encode("utf-8")), n, fits))
                if keep_prefixes:
                    kept.append(counts.astype(np.int32))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "budget_chars"], dtype="int64")
            out.insert(0, "_id", pdf["_id"].to_numpy())
            if keep_prefixes:
                out["prefix_counts"] = kept
            yield out
        counter.clear()  # the vocabulary stays with the worker, a task's words do not

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_rows(rows, run, schema).withColumnRenamed("_id", id_col)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > BUDGET).alias("over_limit"),
        "budget_chars",
    )
