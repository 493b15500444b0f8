"""Byte-level BPE encoding and decoding.

A word's bytes form a doubly linked list of symbols.  A heap holds the ranks
of the merges that neighbours allow; the lowest rank (leftmost on ties) is
applied, its new neighbours are pushed, and heap entries whose symbols have
changed meanwhile are skipped.  Decoding concatenates vocabulary strings.

The vocabulary is a public ``tokenizers`` JSON file, given by path.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import map_rows, table

#: Distinct words of a generation whose encodings a worker keeps; it keeps two of them.
CACHE_WORDS = 100_000
#: Words longer than this are encoded each time, so the cache holds short keys only.
CACHE_CHARS = 64

VOCABULARY = "byte_bpe_50k.json"


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 stands for itself, the
    other bytes take the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + b - sum(p < b for p in plain))
    return out


class Merges:
    """Merge rules of a vocabulary: the rank of a right symbol behind a left one, and what a rank makes."""

    def __init__(self, vocab: dict[str, int], merges: list):
        nothing: dict[int, int] = {}
        self.after = [nothing] * (1 + max(vocab.values()))
        for rank, (a, b) in enumerate(merges):
            if self.after[vocab[a]] is nothing:
                self.after[vocab[a]] = {}
            self.after[vocab[a]][vocab[b]] = rank
        self.made = [vocab[a + b] for a, b in merges]


#: A heap entry is a rank above a position: ordered by rank, then from the left.
SHIFT = 40
PLACES = (1 << SHIFT) - 1


def merge_word(ids: list[int], merges: Merges) -> list[int]:
    """Apply merges to a symbol list by rank, through a heap over linked symbols."""
    n, after, made = len(ids), merges.after, merges.made
    sym, heap, now = ids, [], [-1] * n  # now: the rank of the pair that starts at a symbol
    behind = after[sym[0]]
    for i in range(1, n):
        s = sym[i]
        r = behind.get(s)
        if r is not None:
            now[i - 1] = r
            heap.append(r << SHIFT | i - 1)
        behind = after[s]
    if not heap:
        return sym
    heapq.heapify(heap)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        r = pop(heap)
        i = r & PLACES
        r >>= SHIFT
        if now[i] != r:
            continue  # stale: one of the two was merged since
        j = nxt[i]
        sym[i] = new = made[r]
        sym[j] = now[j] = now[i] = -1
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
            r = after[new].get(sym[k])
            if r is not None:
                now[i] = r
                push(heap, r << SHIFT | i)
        h = prv[i]
        if h >= 0:
            r = after[sym[h]].get(new)
            if r is None:
                now[h] = -1
            else:
                now[h] = r
                push(heap, r << SHIFT | h)
    return [s for s in sym if s >= 0]


def unassigned_here() -> str:
    """Letters and numbers that ``regex`` knows and Unicode 15.1 does not; the
    pre-tokenizer of the vocabulary takes them as other characters."""
    known = regex.compile(r"[\p{L}\p{N}]")
    return "".join(
        c
        for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000)))
        if unicodedata.category(c) == "Cn" and known.match(c)
    )


def ranges(chars: str) -> str:
    """A character class body for sorted ``chars``."""
    out, points = [], [ord(c) for c in chars]
    for k, p in enumerate(points):
        if k and p == points[k - 1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)


class Splitter:
    """Finds pieces by a pattern over ``{L}`` letters, ``{N}`` numbers, ``{S}`` white
    space and ``{O}`` anything else; plain classes serve the texts that allow them."""

    def __init__(self, pattern: str):
        self.new = frozenset(unassigned_here())
        new = ranges("".join(sorted(self.new)))

        def made(engine, flags, letter, number, other):
            out = pattern.replace("{L}", letter).replace("{N}", number).replace("{O}", other)
            return engine.compile(out.replace("{S}", r"\s"), flags)

        self.ascii = made(re, re.ASCII, "[A-Za-z]", "[0-9]", r"[^\sA-Za-z0-9]")
        self.plain = made(regex, 0, r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")
        self.exact = made(
            regex,
            regex.V1,
            rf"[\p{{L}}--[{new}]]" if new else r"\p{L}",
            rf"[\p{{N}}--[{new}]]" if new else r"\p{N}",
            rf"(?:[^\s\p{{L}}\p{{N}}]|[{new}])" if new else r"[^\s\p{L}\p{N}]",
        )

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text)
        return (self.plain if self.new.isdisjoint(text) else self.exact).findall(text)


#: Contractions, words, numbers and other runs, each with one leading space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|{S}+(?!\S)|{S}+"


class _Words(dict):
    """word -> ids, filled on demand and bounded: a full generation is set aside as a whole, and
    what is used of it until the next is full stays."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, word: str):
        ids = self.before.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.before = dict(self)
                super().clear()
            self[word] = ids
        return ids

    def clear(self) -> None:
        super().clear()
        self.before = {}


def checked(spec: dict, expected: dict) -> dict:
    """``spec`` of a vocabulary file, if its settings are those that the code is written for."""
    for name, value in expected.items():
        found = spec
        for part in name.split("."):
            found = found.get(part)
        if found != value:
            raise ValueError(f"{name} of the vocabulary is {found!r}, not {value!r}")
    return spec


#: Settings of vocabulary files that are encoded here.
SETTINGS = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
    "model.type": "BPE",
    "model.dropout": None,
    "model.end_of_word_suffix": None,
    "model.ignore_merges": False,
}


class ByteBPE:
    """Encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f), SETTINGS)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.byte_id = [vocab[alphabet[b]] for b in range(256)]
        self.merges = Merges(vocab, spec["model"]["merges"])
        back = {c: b for b, c in alphabet.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.split = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.words = _Words(self._word)
        self.pieces = Splitter(PIECES)

    def _word(self, word: str) -> tuple[int, ...]:
        ids = list(map(self.byte_id.__getitem__, word.encode("utf-8")))
        return tuple(merge_word(ids, self.merges) if len(ids) > 1 else ids)

    def encode(self, text: str) -> list[int]:
        get, out = self.words.__getitem__, []
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out.extend(chain.from_iterable(map(get, self.pieces(part))))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """One encoder for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode_decode(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token ids of every whole text, and the text that those ids decode to.

    Returns ``id_col``, ``n_tokens`` long, ``ids`` array<int>, ``decoded``
    string, a row for each input row.  A null text counts as empty: no ids and
    an empty decoding.  Special strings inside a text become their special id.
    Null ids are kept, repeated rows stay repeated, other columns are ignored
    (whatever their names), an empty table gives an empty result.  Nothing is
    shuffled; a lost executor's part is encoded again from its input split.
    """
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for pdf in batches:
            ids = [bpe.encode(t or "") for t in pdf["_text"]]
            yield pd.DataFrame(
                {
                    "_id": pdf["_id"],
                    "n_tokens": [len(x) for x in ids],
                    "ids": [np.array(x, dtype=np.int32) for x in ids],
                    "decoded": [bpe.decode(x) for x in ids],
                }
            )
        bpe.words.clear()  # the vocabulary stays with the worker, a task's words do not

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = map_rows(rows, run, f"_id {kind}, n_tokens long, ids array<int>, decoded string")
    return out.withColumnRenamed("_id", id_col)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
