"""Operators over the whole corpus, against brute force; and the pipeline."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolith.llm import common, components, decontaminate, fingerprints, line_dedup, ngram_join, registry, warc
from chronolith.llm.common import shared_dir
from tests.llm.fixtures import WEIRD, clashing, documents, empty
from tests.oracle import connect, same


def corpus(seed=5, groups=6, size=6, words=40):
    """Texts with groups of copies and near copies, some below the threshold."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for k in range(size):
            edited = list(base)
            for _ in range(k % 4):
                edited[rng.randrange(words)] = f"z{rng.randrange(999)}"
            out.append(" ".join(edited))
    rng.shuffle(out)
    return out + ["one two", "one two", "ONE two", "", "solo"]


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(a) for a in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("seed", [5, 6])
def test_jaccard_components(spark, seed):
    texts = corpus(seed, groups=5, size=8) + WEIRD
    want, sizes = brute_components(texts)
    out = {r.doc_id: r for r in ngram_join.jaccard_components(documents(spark, texts)).collect()}
    assert out.pop(None).component_id is None
    assert [out[k].component_id for k in range(len(texts))] == want
    assert [out[k].n_shingles for k in range(len(texts))] == sizes
    assert ngram_join.jaccard_components(empty(spark)).count() == 0
    assert ngram_join.jaccard_components(clashing(spark, WEIRD)).count() == len(WEIRD) + 2


def test_jaccard_of_wide_groups(spark, sf_dir):
    """Groups far above ``WIDE``: most members near the threshold, some a star around the
    first, some linked with none; and a passage that all of them share."""
    rng = random.Random(12)
    shared = [f"s{k}" for k in range(12)]
    texts = []
    for size, most in ((50, 4), (120, 7), (200, 10)):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, most)):
                words[rng.randrange(100)] = f"z{rng.randrange(99999)}"
            texts.append(" ".join(shared + words if rng.random() < 0.5 else words))
    texts += [" ".join(shared + [f"u{rng.randrange(99999)}" for _ in range(30)]) for _ in range(60)]
    rng.shuffle(texts)
    want, sizes = brute_components(texts)
    assert ngram_join.WIDE < 50 and 10 < len(set(want)) < 300
    out = {r.doc_id: r for r in ngram_join.jaccard_components(documents(spark, texts, null_ids=False)).collect()}
    assert [out[k].component_id for k in range(len(texts))] == want
    assert [out[k].n_shingles for k in range(len(texts))] == sizes
    same(ngram_join.op7_ngram_join(spark, sf_dir), connect(sf_dir), registry.ORACLE_SQL["op7_ngram_join"])


def test_jaccard_of_outsiders(spark, monkeypatch):
    """Members of a large group that link with few others find one of them without being
    held against all."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(500):
        words = list(base)
        for _ in range(4 if k % 8 == 0 else rng.randint(1, 2)):
            words[rng.randrange(5, 145)] = f"z{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    want, _ = brute_components(texts)
    left = []
    tapped = ngram_join._pairs
    monkeypatch.setattr(ngram_join, "_pairs", lambda *a: (left.append(tapped(*a).count()), tapped(*a))[1])
    out = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(documents(spark, texts, null_ids=False)).collect()}
    assert [out[k] for k in range(len(texts))] == want
    assert left[0] < 5 * len(texts)


def test_jaccard_entries_of_one_order(spark):
    """A set's prefix goes through the shuffle once, and what can't be a first shared token goes
    at once; a pair at the threshold still meets."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words[:52] + [f"z{k}" for k in range(4)])]
    texts += [" ".join(words[:5] + [f"u{i}_{k}" for k in range(300)]) for i in range(2)]
    df = documents(spark, texts, null_ids=False)
    rows = df.selectExpr("doc_id as _id", "text as _text")
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    entries = ngram_join._entries(rows, ngram_join.WORDS, ngram_join.PERCENT, none)
    sizes = [len(shingles(t)) for t in texts]
    assert entries.count() == sum(ngram_join.prefix_size(n) for n in sizes)
    met = ngram_join._met(entries, ngram_join.PERCENT).collect()
    overlap = -(-75 * (sizes[0] + sizes[1]) // 175)
    tokens = [r.token for r in met]
    two = [r for r in met if r.node in (0, 1) and tokens.count(r.token) == 2]
    assert two and all(r.place <= sizes[r.node] - overlap + 1 for r in two)
    want, _ = brute_components(texts)
    out = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df).collect()}
    assert [out[k] for k in range(len(texts))] == want


def test_stored_leaves_no_shuffle_files(spark):
    before = spark.conf.get(common.CLEANUP, None)
    out = common.stored(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    assert out.count() == 10 and spark.conf.get(common.CLEANUP, None) == before
    folder = out.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert os.path.isdir(folder)
    common.forget(out)
    assert not os.path.exists(folder)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (3, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == dict.fromkeys((1, 2, 3), 1) | dict.fromkeys((6, 7, 8, 9), 6) | dict.fromkeys(range(20, 25), 20)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance(spark):
    rng, rows = random.Random(7), []
    for _ in range(400):
        a = [rng.choice("abé") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
        rows.append((a, [c for c in b if c], levenshtein("".join(a), "".join(b))))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, d int")
    for tau in (1, 2, 3):
        assert df.where(line_dedup.within(F.col("a"), F.col("b"), tau) != (F.col("d") <= tau)).count() == 0


def brute_lines(texts, tau=2, least=24):
    lines = [(d, p, t.strip(" \t\r\x0b\x0c\x00")) for d, x in enumerate(texts) for p, t in enumerate((x or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    root = list(range(len(lines)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(lines)):
        for b in range(a):
            if abs(len(lines[a][2]) - len(lines[b][2])) <= tau and levenshtein(lines[a][2], lines[b][2]) <= tau:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    gone = {}
    for k, (d, p, _) in enumerate(lines):
        if find(k) != k:
            gone.setdefault(d, []).append(p)
    return gone


def test_line_dedup(spark, sf_dir):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 40))) for _ in range(8)]
    texts = []
    for _ in range(20):
        rows = []
        for _ in range(4):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice("abcxyz")
            rows.append("".join(line))
        texts.append("\n".join(rows))
    texts += WEIRD
    docs = documents(spark, texts).withColumn("dropped", F.lit("clash"))
    got = line_dedup.dedup_lines(docs).collect()
    want = brute_lines(texts)
    assert {r.doc_id: r.dropped for r in got if r.dropped} == want
    by = {r.doc_id: r.text for r in got}
    for d, t in enumerate(texts):
        left = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want.get(d, []))
        assert by[d] == left
    assert by[None] == "left alone by what needs an id"
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    # rows of one id are documents of their own; names that the operator uses itself are free
    long = "a line that is long enough to be compared"
    odd = spark.createDataFrame([(0, long), (1, f"x\n{long}"), (1, "y\nanother line, which nothing else repeats")], "doc_id long, text string")
    odd = odd.withColumns({c: F.lit("clash") for c in ("_drop", "_drop_doc", "_drop_text", "_drop_positions", "doc", "pos")})
    got = sorted(r.text for r in line_dedup.dedup_lines(odd).collect())
    assert got == sorted([long, "x", "y\nanother line, which nothing else repeats"])
    same(line_dedup.op2_line_dedup(spark, sf_dir), connect(sf_dir), registry.ORACLE_SQL["op2_line_dedup"])


def test_fingerprints(spark):
    texts = corpus(9) + WEIRD
    rows = documents(spark, texts)
    got = {r.doc_id: r for r in fingerprints.fingerprints(rows).collect()}
    for k, t in enumerate(texts):
        n = len(shingles((t or "").lower()))
        assert len(got[k].sketch) == min(n, fingerprints.K)
        if n < fingerprints.K:
            assert got[k].n_shingles == n
    # likeness of small sets is exact
    pairs = spark.createDataFrame([(got[a].sketch, got[b].sketch, a, b) for a in range(12) for b in range(12)], "x array<long>, y array<long>, a int, b int")
    for r in pairs.select("a", "b", fingerprints.resemblance(F.col("x"), F.col("y")).alias("j"), fingerprints.containment(F.col("x"), F.col("y")).alias("c")).collect():
        x, y = shingles(texts[r.a]), shingles(texts[r.b])
        assert r.j == pytest.approx(len(x & y) / len(x | y))
        assert r.c == pytest.approx(len(x & y) / len(x))
    # the sketch of all parts together is the merged one
    parts = fingerprints.fingerprints(rows).withColumn("g", F.col("doc_id") % 2)
    merged = {r.g: r.sketch for r in fingerprints.merge_groups(parts, "g", "sketch").collect()}
    for g in (0, 1):
        every = sorted({h for k, r in got.items() if k is not None and k % 2 == g for h in r.sketch})
        assert merged[g] == every[: fingerprints.K]


def test_next_document(spark, tmp_path):
    texts = ["alpha beta gamma", "", None, "x" * 11, "delta epsilon zeta eta theta"] * 3
    ids = [5, 300, 7, 1000, 262_144 * 3, 6, 301, 9, 1001, 262_144 * 3 + 1, -4, 302, 8, 1002, 0]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op3_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(zip(ids, texts, strict=True))
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].n_chars == len(t) and 0 <= got[i].near_next <= 1


def test_decontamination(spark):
    rng = random.Random(10)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "se", "ti", "vo", "zu", "x")] + ["the", "of"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [make(rng.randint(9, 50)) for _ in range(40)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, ""), (None, "x"), (98, None)], "item_id long, text string")
    texts, want = [], []
    for k in range(200):
        words = make(rng.randint(0, 150))
        if k % 2:
            item = rng.randrange(len(items))
            passage = list(items[item])
            for _ in range(len(passage) // 12):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = passage
            want.append((k, item))
        texts.append(" ".join(words).replace(" ", ", ", 3).upper() if k % 3 else "\n".join(words))
    docs = documents(spark, texts).withColumn("leaks", F.lit("clash"))
    rows = decontaminate.with_leaks(docs, bench).select("doc_id", F.explode("leaks").alias("l")).collect()
    found = {(r.doc_id, r.l.item): r.l.edits for r in rows}
    assert sum(p in found for p in want) >= 0.9 * len(want)
    for (d, item), edits in found.items():  # what is found is near, and as near as said
        own, text = items[item], decontaminate.words_of(texts[d])
        assert edits <= 0.2 * len(own)
        row = [0] * (len(text) + 1)
        for i, x in enumerate(own, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x.encode() != y)))
            row = new
        assert min(row) <= edits
    assert decontaminate.with_leaks(empty(spark), bench).count() == 0
    assert decontaminate.with_leaks(clashing(spark, WEIRD), bench.limit(0)).where("size(leaks) > 0").count() == 0


def test_decontamination_is_brute_force():
    """Edits of a fifth at an item's head, cut heads, or anywhere: what brute force finds."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [make(n) for n in (1, 4, 5, 9, 10, 19, 20, 31, 40, 59) for _ in range(4)]
    texts = []
    for words in items:
        most = len(words) // 5
        anywhere = list(words)
        for k in rng.sample(range(len(words)), most):
            anywhere[k] = "changed"
        passages = (["changed"] * most + words[most:], words[most:], words[: len(words) - most], anywhere)
        texts += [make(rng.randint(0, 30)) + p + make(rng.randint(0, 30)) for p in passages]
    index = decontaminate.Index([(k, " ".join(w)) for k, w in enumerate(items)])
    got = decontaminate.Finder(index)([" ".join(t) for t in texts])
    for k, t in enumerate(texts):
        text = [w.encode() for w in t]
        want = {}
        for i, (name, own) in enumerate(index.items):
            near = decontaminate.nearest(own, text, len(own) // 5)
            if near is not None:
                want[name] = near
        assert {r["item"]: (r["edits"], r["end"]) for r in got[k]} == want
        assert k // 4 in want


def test_decontamination_reaches_its_recall():
    """A fifth of an item's words edited: spread, at equal distances, in front, missing in front
    or behind.  Exhaustive search finds all of these."""
    rng = random.Random(14)
    vocabulary = [f"w{k}" for k in range(800)]
    make = lambda n: rng.choices(vocabulary, [1 / (k + 1) for k in range(800)], k=n)
    items = [make(n) for n in (5, 9, 12, 20, 31, 40, 59) for _ in range(12)]
    index = decontaminate.Index([(k, " ".join(w)) for k, w in enumerate(items)])
    finder = decontaminate.Finder(index)

    def mixed(words, k):
        for _ in range(k):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choice([[], ["changed"]])

    def even(words, k):
        for i in range(k):
            words[int((i + 0.5) * len(words) / k)] = "changed"

    def front(words, k):
        words[:k] = ["changed"] * k

    def beheaded(words, k):
        del words[:k]

    def cut(words, k):
        del words[len(words) - k :]

    for edit in (mixed, even, front, beheaded, cut):
        passages = []
        for words in items:
            passages.append(list(words))
            edit(passages[-1], len(words) // 5)
        texts = [make(rng.randint(0, 40)) + p + make(rng.randint(0, 60)) for p in passages]
        found = finder([" ".join(t) for t in texts])
        near = [decontaminate.nearest(index.items[k][1], [w.encode() for w in t], index.most(k)) for k, t in enumerate(texts)]
        assert all(near)
        hits = [any(r["item"] == k for r in rows) for k, rows in enumerate(found)]
        assert sum(hits) >= 0.95 * len(hits), edit
        for n in (20, 31, 40, 59):
            assert all(h for h, words in zip(hits, items, strict=True) if len(words) == n), (edit, n)


def test_warc_round_trip(spark, sf_dir, tmp_path):
    pages = spark.createDataFrame(
        [(3, "http://a/x?y", "<p>é</p>\r\n\r\nWARC/1.1"), (1, "http://b", "<p>é</p>\r\n\r\nWARC/1.1"), (2, None, None), (4, "u\nv", ""), (4, "u\nv", ""), (None, "n", "x"), (7, "z", "only")],
        "page_id long, url string, html string",
    )
    path = shared_dir(spark)
    warc.write_captures(pages.withColumn("value", F.lit("clash")), path)
    records = warc.read_records(spark, path)
    out = warc.assemble(records).select("*", F.try_element_at("metadata.fields", F.lit("page-id")).alias("page")).collect()
    by = {r.page: r for r in out}
    assert len(out) == 7  # a capture for each row, repeated ones too
    assert (by["1"].record_type, by["3"].record_type) == ("response", "revisit")
    assert by["3"].refers_to == by["1"].record_id
    assert by["3"].payload_bytes == len("<p>é</p>\r\n\r\nWARC/1.1".encode())
    assert bytes(by["1"].payload).decode() == "<p>é</p>\r\n\r\nWARC/1.1"
    assert by["2"].record_type == "response" and by["4"].record_type == "revisit"
    assert by["7"].request.fields[""].startswith("GET ")
    # a row without an id is a response only where no other row has its payload
    base = tmp_path / "in"
    rows = [(None, "a", "same"), (6, "b", "same"), (5, "c", "same"), (5, "c", "same"), (None, "d", "alone"), (8, "e", "é" * 200_000)]
    spark.createDataFrame(rows, pages.schema).write.parquet(f"{base}/pages.parquet")
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc.op5_warc(spark, str(base)).collect())
    assert got == sorted(
        [("5", "response", None, 4), ("5", "revisit", 5, 4), ("6", "revisit", 5, 4), ("8", "response", None, 400_000), ("None", "response", None, 5), ("None", "revisit", 5, 4)]
    )
    with pytest.raises(ValueError, match="ends early"):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort", True))
    empty_path = shared_dir(spark)
    warc.write_captures(pages.limit(0), empty_path)
    assert warc.assemble(warc.read_records(spark, empty_path)).count() == 0
    same(warc.op5_warc(spark, sf_dir), connect(sf_dir), registry.ORACLE_SQL["op5_warc"])


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = None
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = corpus_pipeline.stored(stage(spark, docs, sf_dir))
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            assert sum(d not in after for d, q in labels.items() if q == 1) == 0
        elif name == "line dedup":
            order = sorted(before)
            gone = brute_lines([before[d] for d in order])
            for k, d in enumerate(order):
                left = "\n".join(x for p, x in enumerate(before[d].split("\n")) if p not in gone.get(k, []))
                assert (after[d].text == left) if d in after else (k in gone and not left.strip())
        elif name == "n-gram Jaccard join":
            order = sorted(before)
            roots, _ = brute_components([before[d] for d in order])
            assert set(after) == {d for k, d in enumerate(order) if roots[k] == k}
        elif name == "benchmark decontamination":
            items = [" " + " ".join(w.decode() for w in decontaminate.words_of(r.text)) + " " for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            for d, t in before.items():
                text = " " + " ".join(w.decode() for w in decontaminate.words_of(t)) + " "
                if any(i in text for i in items):
                    assert d not in after
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs, kept = out, after
    assert kept and docs.columns == ["doc_id", "n_tokens", "ids"]


def test_stages_stand_edges(spark, sf_dir):
    for texts in (WEIRD, []):
        docs = documents(spark, texts, null_ids=bool(texts))
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, sf_dir))
            docs.count()
            if "text" not in docs.columns:
                break


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 11))
