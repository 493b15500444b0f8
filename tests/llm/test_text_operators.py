"""Operators that work on a text at a time: secrets, BPE, token counts, toxicity, quality."""

import base64
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import bpe, quality, secrets, token_counts, toxicity
from tests.llm.fixtures import WEIRD, clashing, empty

tokenizers = pytest.importorskip("tokenizers")


def naive_base(text):
    """The contract's patterns, in plain steps."""
    found = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.I | re.A):
        if len(m.group(2)) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    kinds = ("assign", "access", "hex")
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets_against_plain_patterns(spark, sf_dir):
    rng = random.Random(1)
    parts = ["token=", 'API_KEY: "', "apikey :", "AKIA", "é", "0123456789abcdef", "x", " ", "ABCDEF0123456789", "secret='abc'", "\n"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(200)] + WEIRD
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in secrets.find_secrets(df).collect():
        got = ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.base)
        assert got == naive_base(made[r.doc_id] or ""), made[r.doc_id]
    out = secrets.op1_secrets(spark, sf_dir)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in out.collect():
        want = naive_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_battery_tells_keys_from_names():
    rng = random.Random(2)
    hits = 0
    for _ in range(100):
        key = base64.b64encode(bytes(rng.randrange(256) for _ in range(30))).decode()
        hits += bool(secrets.random_spans(f"see {key} here", []))
    assert hits >= 90
    for name in ("internationalization2024", "user_account_settings_v2", "MyVeryLongClassNameFactory2", "abcdefghijklmnopqrstuvwxyz", "a" * 30 + "1"):
        assert secrets.random_spans(name, []) == []


def test_battery_finds_keys_of_every_encoding():
    rng = random.Random(6)
    for name, alphabet in secrets.ENCODINGS:
        for length in (20, 24, 32, 40, 64):
            keys = ["".join(rng.choice(alphabet) for _ in range(length - 2)) + "b7" for _ in range(60)]
            if "b" not in alphabet:
                keys = [k.replace("b7", "B7") for k in keys]
            hits = sum(bool(secrets.random_spans(f"see {k} here", [])) for k in keys)
            assert hits >= 0.8 * len(keys), (name, length)
    for plain in ("test_with_continue_1_0", "MAPPINGS/VENDORS/MICSFT/WINDOWS/CP1252", "configuration2settings2024", "TOTALAMOUNTOFORDERS2024", "0b1010101010101010101010101010101"):
        assert secrets.random_spans(plain, []) == []


def test_bpe_is_the_library(spark, sf_dir):
    path = bpe.default_path()
    library, own = tokenizers.Tokenizer.from_file(path), bpe.loaded(path)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + WEIRD
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t or "") == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_keeps_words_in_use_when_its_cache_is_full(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 8)
    own, merged = bpe.ByteBPE(bpe.default_path()), []
    encode = own.words.encode
    own.words.encode = lambda word: merged.append(word) or encode(word)
    text = "".join(f" the w{'xyzuv'[k % 5]}{chr(97 + k % 26)}q" for k in range(200))
    assert own.decode(own.encode(text)) == text
    # a word in use is merged once, however many others pass; two generations are held at most
    assert merged.count(" the") == 1 and len(own.words) + len(own.words.before) <= 16
    own.words.clear()
    assert not own.words and not own.words.before


def test_bpe_operator_edges(spark):
    out = bpe.encode_decode(clashing(spark, WEIRD)).orderBy("doc_id").collect()
    assert [r.decoded for r in out if r.doc_id is not None] == [t or "" for t in WEIRD]
    assert all(r.n_tokens == len(r.ids) for r in out)
    assert bpe.encode_decode(empty(spark)).count() == 0


def test_token_counts_at_every_prefix(spark, sf_dir):
    path = token_counts.default_path()
    library, own = tokenizers.Tokenizer.from_file(path), token_counts.loaded(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + WEIRD
    for t, got in zip(texts, own.prefix_counts([t or "" for t in texts]), strict=True):
        assert got[-1] == count(t or "")
    for t in ("the unbelievable word's 12 end", "aab abab zz\n<|endoftext|> x", "naïve façade été"):
        (got,) = own.prefix_counts([t])
        whole = [k for k in range(len(t) + 1) if "<" not in t[:k] or ">" in t[:k]]  # not inside a special string
        assert [count(t[:k]) for k in whole] == [int(got[k]) for k in whole]


def test_counts_go_on_from_shared_prefixes():
    """Words that begin alike are counted from where they part, whatever else is in the batch."""

    class Counted(dict):
        looked = 0

        def get(self, key):
            self.looked += 1
            return super().get(key)

    path = token_counts.default_path()
    library, own = tokenizers.Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    own.nodes = Counted(own.nodes)
    stem = "tionanthereousinge" * 4
    words = [stem + a + b for a in "abcdefghij" for b in ("", "st", "né", "漢é")]
    texts = [" ".join(words), stem, f"  {stem}   {stem[:9]}\n{stem}ß", "\x1c\x1d" + stem, *words[::-1]]
    got = own.prefix_counts(texts)
    assert own.nodes.looked < len(words) * len(stem)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert [int(c[-1]) for c in got] == [count(t) for t in texts]
    for t, c in zip(texts[1:4], got[1:4], strict=True):
        t = own.normal(t)
        assert [int(n) for n in c] == [count(t[:k]) for k in range(len(t) + 1)]


def test_counts_know_newer_letters():
    path = token_counts.default_path()
    library, own = tokenizers.Tokenizer.from_file(path), token_counts.loaded(path)
    texts = [f"a{chr(c)}b {chr(c)}" for c in token_counts.NEWER] + ["ÀÉß İ ẞ Ω"]
    assert [own.normal(t) for t in texts] == [library.normalizer.normalize_str(t) for t in texts]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [int(c[-1]) for c in own.prefix_counts(texts)] == want


def test_other_vocabularies_are_refused():
    for load, other in ((bpe.ByteBPE, token_counts.default_path()), (token_counts.PrefixCounter, bpe.default_path())):
        with pytest.raises((ValueError, KeyError)):
            load(other)


def test_token_budget(spark):
    df = clashing(spark, ["a b c d e", "", None])
    out = token_counts.token_counts(df, budget=3, keep_prefixes=True).orderBy("doc_id").collect()
    rows = {r.doc_id: r for r in out if r.doc_id is not None}
    assert (rows[0].n_tokens, rows[0].budget_chars, rows[0].n_bytes) == (5, 6, 9)
    assert (rows[1].n_tokens, rows[2].n_tokens, rows[2].budget_chars) == (0, 0, 0)
    assert rows[0].prefix_counts[-1] == 5
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng, bad = random.Random(3), ["vileword", "nastything", "awfulness"]
    parts = ("ka", "lo", "mi", "ne", "pu", "ra", "se", "ti", "vo", "zu")
    plain = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(300)]
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(2):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((k, " ".join(words)))
        labels.append((k, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    df = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, df)
    got = toxicity.score(docs, model).join(df, "doc_id").toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    assert ((held.score >= 0.5) == (held.toxic == 1)).mean() > 0.95
    seen, unseen = (
        toxicity.score(spark.createDataFrame([(0, f"{plain[0]} {plain[1]} {w} {plain[2]}")], "doc_id long, text string"), model).first().score
        for w in (plain[3], "vilewordz")
    )
    assert unseen > seen


def toxic_texts(n, rate, bad, seed=4):
    rng, parts = random.Random(seed), [a + b for a in "klmnprstvz" for b in "aeiou"]
    plain = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(300)]
    texts, labels = [], []
    for _ in range(n):
        words = [rng.choice(plain) for _ in range(30)]
        labels.append(int(rng.random() < rate))
        if labels[-1]:
            for _ in range(2):
                words[rng.randrange(30)] = rng.choice(bad)
        texts.append(" ".join(words))
    return texts, np.array(labels)


@pytest.mark.parametrize("rate, lexicon", [(0.005, 3), (0.1, 200)])
def test_toxicity_learns_from_rare_rows(rate, lexicon):
    rng = random.Random(5)
    bad = ["".join(rng.choice("qxwyjgdb") for _ in range(7)) for _ in range(lexicon)]
    texts, labels = toxic_texts(4000, rate, bad)
    model = toxicity.train(texts, labels, toxicity.Settings())
    fresh, truth = toxic_texts(1000, 0.1, bad, seed=6)
    got = model.score(toxicity.WordVectors(model).means(fresh))
    above = (got[truth == 1][:, None] > got[truth == 0][None, :]).mean()
    assert above > 0.8


def test_toxicity_reads_behind_character_64():
    s = toxicity.Settings()
    run = "".join(random.Random(8).choice("abcdefgh") for _ in range(1000))
    rows = {r for w in toxicity.words_of(run) for r in toxicity.subwords(w, s)}
    for n in range(s.shortest, s.longest + 1):
        assert all(zlib.crc32(run[i : i + n].encode()) & s.rows - 1 in rows for i in range(len(run) - n + 1))
    texts, labels = toxic_texts(2000, 0.3, ["vileword", "nastything"])
    model = toxicity.train(texts, labels, s)
    glued = ["lakimo" * 20 + middle + "lakimo" * 5 for middle in ("vileword", "nemokalo")]
    bad, plain = model.score(toxicity.WordVectors(model).means(glued))
    assert bad > plain


def test_toxicity_edges(spark):
    docs = clashing(spark, WEIRD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(0, 1), (0, 1), (None, 0), (1, None), (99, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), none)).count() == 0


def test_quality_rejects_junk_and_shrinks_sites(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        words = [f"word{rng.randrange(500)}" for _ in range(50)]
        good = k % 4 != 0
        text = " ".join(words) if good else " | ".join(words) + " %%%"
        rows.append((k, text, f"host{k % 3}", "en" if k % 7 else None))
        labels.append((k, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = quality.classify(docs, spark.createDataFrame(labels[:300], "doc_id long, quality int"))
    got = {r.doc_id: r.quality_score >= quality.KEEP for r in out.collect()}
    assert all(got[k] == bool(y) for k, y in labels)
    scored = spark.createDataFrame([("big", "a", -6.0)] * 500 + [("one", "a", -6.0)], "host string, path string, evidence double")
    mixed = scored.union(spark.createDataFrame([("good", "a", 6.0)] * 500, scored.schema))
    rate = {r.host: r.path_rate for r in quality.site_posteriors(mixed, 0.5).collect()}
    assert rate["big"] < rate["one"] < rate["good"]


def plain_posteriors(rows, rate):
    """``site_posteriors`` in plain numpy: {(host, path): (host_rate, path_rate)}."""
    p = {}
    for host, path, evidence in rows:
        p.setdefault((host, path), []).append(1 / (1 + np.exp(-(evidence + np.log(rate / (1 - rate))))))

    def size(groups, rates):
        n, mean = np.array([len(g) for g in groups]), np.array([np.mean(g) for g in groups])
        within = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups) / max(n.sum() - len(n), 1)
        between = ((n * (mean - rates) ** 2).sum() - len(n) * within) / max(n.sum() - (n**2).sum() / n.sum(), 1)
        level = (n * rates * (1 - rates)).sum() / n.sum()
        return max(1.0, min(1e4, level / max(between, 1e-9) - 1))

    hosts = sorted({h for h, _ in p})
    by_host = [[x for (h, _), g in p.items() if h == host for x in g] for host in hosts]
    k = size(by_host, np.full(len(hosts), rate))
    host_rate = {h: (sum(g) + k * rate) / (len(g) + k) for h, g in zip(hosts, by_host, strict=True)}
    k = size(list(p.values()), np.array([host_rate[h] for h, _ in p]))
    return {(h, q): (host_rate[h], (sum(g) + k * host_rate[h]) / (len(g) + k)) for (h, q), g in p.items()}


def test_site_posteriors_are_those_of_numpy(spark):
    rng = random.Random(9)
    rows = []
    for h in range(12):
        centre = rng.gauss(0, 2)
        for p in range(rng.randint(1, 4)):
            rows += [(f"h{h}", f"p{p}", rng.gauss(centre + p / 2, 1.5)) for _ in range(rng.choice([1, 2, 30, 200]))]
    for rate in (0.2, 0.7):
        got = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"), rate)
        want = plain_posteriors(rows, rate)
        assert {(r.host, r.path): (r.host_rate, r.path_rate) for r in got.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    one = [("h", "p", 1.0)]
    (r,) = quality.site_posteriors(spark.createDataFrame(one, "host string, path string, evidence double"), 0.5).collect()
    assert (r.host_rate, r.path_rate) == pytest.approx(plain_posteriors(one, 0.5)["h", "p"])


def test_quality_edges(spark):
    docs = clashing(spark, WEIRD).withColumns({"source": F.lit(None).cast("string"), "lang": F.lit("en"), "quality_score": F.lit("x"), "_host": F.lit("kept"), "_path": F.lit("kept")})
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.classify(docs, none).collect()
    assert len(out) == docs.count() and all(0 < r.quality_score < 1 and r._host == r._path == "kept" for r in out)
    assert quality.classify(empty(spark), none).count() == 0
    assert np.allclose(quality.features(None), 0)
