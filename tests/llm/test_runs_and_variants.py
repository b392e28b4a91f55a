"""Periodic runs, SimHash links and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from halospark.llm import four_russians, periodic_runs, simhash_variants
from halospark.llm import queries as llm_queries


def plain_words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


# -- periodic runs ------------------------------------------------------------------------------------------------
def plain_runs(w):
    """(start, length, period) of all runs: every period is tried at every place."""
    found, n = set(), len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(12, 2 * q):
                s = w[i : i + size]
                if not any(s[: size - r] == s[r:] for r in range(1, q)):
                    found.add((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(w, runs):
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    return b" ".join(x for i, x in enumerate(w) if i not in drop)


def repetitive(rng):
    kind, n = rng.random(), rng.choice([0, 1, 11, 12, 13, 24, 40, 90, 150])
    if kind < 0.3:  # Fibonacci words have runs inside runs
        a, b = [0], [0, 1]
        while len(b) < n + 5:
            a, b = b, b + a
        k = rng.randrange(5)
        w = b[k : k + n]
        if n and rng.random() < 0.5:
            w[rng.randrange(n)] = 2
    elif kind < 0.7:
        some = lambda most: [rng.randrange(3) for _ in range(rng.randrange(1, most))] * 150
        w = (some(12)[: n // 2] + some(25))[:n]
        for _ in range(rng.choice([0, 0, 1, 3])):
            if n:
                w[rng.randrange(n)] = rng.randrange(3)
    else:
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(n)]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        texts = [repetitive(rng) for _ in range(rng.choice([1, 3]))]
        runs = periodic_runs.find_runs(np.array(sum(texts, []), np.int64), np.array([len(w) for w in texts]))
        for k, w in enumerate(texts):
            assert [tuple(r[1:]) for r in runs.tolist() if r[0] == k] == plain_runs(w), w


def test_collapse_cases(rows):
    rng = random.Random(6)
    docs = [(k, " ".join("abc"[x] for x in repetitive(rng))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, " \n\t"), (None, "x y " * 9), (103, "x y " * 9), (103, "x y " * 9), (104, "é X x " * 5)]
    docs += [(105, "same " * 120_000), (106, "\n".join(f"w{i}" for i in range(30_000)))]
    df = rows("doc_id long, text string, runs string, n_words string", [(*d, "mine", "mine") for d in docs]).repartition(3)
    got = periodic_runs.collapse(df).collect()
    assert len(got) == len(docs)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for d, text in docs[:-2]:
        w = plain_words(text)
        for r in by_id[d]:
            assert r.n_words == len(w)
            assert [(x.start, x.length, x.period) for x in r.runs] == plain_runs(w)
            assert r.collapsed.encode() == plain_collapse(w, plain_runs(w))
    assert len(by_id[103]) == 2
    assert [tuple(x) for x in by_id[105][0].runs] == [(0, 120_000, 1)] and by_id[105][0].collapsed == "same"
    assert by_id[106][0].runs == [] and len(by_id[106][0].collapsed.split()) == 30_000
    assert periodic_runs.collapse(df.limit(0)).count() == 0


def test_pieces_do_not_matter(rows, monkeypatch):
    rng = random.Random(7)
    df = rows("doc_id long, text string", [(k, " ".join("abc"[x] for x in repetitive(rng))) for k in range(40)]).coalesce(1)
    want = {r.doc_id: r for r in periodic_runs.collapse(df).collect()}
    monkeypatch.setattr(periodic_runs, "PIECE_BYTES", 50)
    assert {r.doc_id: r for r in periodic_runs.collapse(df).collect()} == want


def test_query_of_runs(spark):
    path = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in llm_queries.op13_periodic_runs(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for d, text in docs:
        w = plain_words(text)
        h, n = zlib.crc32(str(d).encode()), len(w)
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            planted += 1
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapse(w, runs)).hexdigest()
    assert planted > 5


# -- SimHash ------------------------------------------------------------------------------------------------------
def plain_fingerprint(text, width=3):
    w = [bytes(x + 32 if 65 <= x <= 90 else x for x in word) for word in plain_words(text)]
    s = [] if not w else [b" ".join(w)] if len(w) < width else [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), len(s)


def plain_classes(named):
    """Smallest doc_id reachable over fingerprints at distance two or less; every pair is looked at."""
    up = {d: d for d, _ in named}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (d, f) in enumerate(named):
        for e, g in named[:k]:
            if (f ^ g).bit_count() <= 2:
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return {d: root(d) for d in up}


def test_simhash_classes_equal_brute_force(rows):
    rng = random.Random(8)
    vocabulary = [f"V{i}é" if i % 9 == 0 else f"V{i}" for i in range(200)]
    docs = []
    for k in range(30):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 40, 400, 900]))]
        for j in range(rng.choice([1, 4, 8])):
            docs.append((100 * k + j, rng.choice([" ", "\n", " \t"]).join(w)))
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
    docs += [(9000, None), (9001, ""), (9002, "  "), (None, docs[0][1]), (9003, docs[5][1]), (9003, docs[5][1]), (9004, "x y z " * 60_000)]
    rng.shuffle(docs)
    df = rows("doc_id long, text string, fingerprint string, head string", [(*d, "mine", "mine") for d in docs]).repartition(4)
    got = simhash_variants.linked(df).select("doc_id", "n_shingles", simhash_variants.as_hex("fingerprint").alias("f"), "component_id").collect()
    assert len(got) == len(docs)
    prints = {d: plain_fingerprint(t) for d, t in docs}
    want = plain_classes([(d, prints[d][0]) for d, _ in docs if d is not None])
    for r in got:
        assert (int(r.f, 16), r.n_shingles) == prints[r.doc_id] and len(r.f) == 16
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
    assert want[9001] == want[9002] == want[9000] == 9000 or want[9000] < 9000
    assert len(set(want.values())) < len(want) - 20
    assert simhash_variants.linked(df.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [4, 512])
def test_variant_keys_lose_no_link(rows, monkeypatch, dense):
    """Fingerprints that crowd around a few segments, with refined keys and without."""
    monkeypatch.setattr(simhash_variants, "DENSE", dense)
    rng = np.random.default_rng(9)
    middle = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    prints = set()
    for k in range(900):
        f = int(middle[k % 3])
        if k % 3 == 0:  # a common lower segment
            f = f & 0xFFFFFFFF | int(rng.integers(0, 1 << 32)) << 32
        if k % 3 == 1:  # a common upper segment
            f = f >> 32 << 32 | int(rng.integers(0, 1 << 11))
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            f ^= 1 << int(b)
        prints.add(f)
    named = list(enumerate(sorted(prints)))
    spark_rows = [(d, 1, f - (1 << 64) if f >> 63 else f) for d, f in named]
    table = rows("doc_id long, n_shingles long, fingerprint long", spark_rows)
    monkeypatch.setattr(simhash_variants, "fingerprints", lambda docs, width: docs)
    got = {r.doc_id: r.component_id for r in simhash_variants.linked(table).collect()}
    assert got == plain_classes(named)
    assert 3 < len(set(got.values())) < len(got)


def test_large_groups_are_searched_by_flips():
    rng = np.random.default_rng(10)
    prints = np.unique(rng.integers(0, 1 << 17, 3000).astype(np.uint64))
    links = simhash_variants.Links(len(prints))
    simhash_variants._link_by_flips(prints, np.arange(len(prints)), links)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    a, b = np.nonzero(np.triu(near, 1))
    assert (links.labels() == simhash_variants.smallest_label(len(prints), a, b)).all()


def test_one_fingerprint_holds_a_third(rows):
    docs = [(k, "a b c d") for k in range(400)] + [(1000 + k, f"q{k} r{k} s{k} t{k}") for k in range(800)]
    got = simhash_variants.linked(rows("doc_id long, text string", docs)).collect()
    assert len(got) == 1200 and {r.component_id for r in got if r.doc_id < 1000} == {0}


# -- hard negatives -------------------------------------------------------------------------------------------------
def plain_negatives(vectors, anchor, label, positives=5, negatives=3):
    v = [
        (i, label(i, lab), [math.floor(256 * x) for x in e])
        for i, lab, e in vectors
        if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    for a, lab, q in v:
        if not anchor(a):
            continue
        s = sorted((-sum(x * y for x, y in zip(q, r)), i, same) for i, same, r in v if i != a)
        for sp, p, _ in [x for x in s if x[2] == lab][:positives]:
            ok = [x for x in s if x[2] != lab and 50 * -sp <= 100 * -x[0] <= 95 * -sp]
            out += [(a, p, k + 1, i, -sp, -sn) for k, (sn, i, _) in enumerate(ok[:negatives])]
    return sorted(out)


def mined(df, positives=5, negatives=3):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = four_russians.mine(df, F.col("vec_id") % 5 == 0, label, positives, negatives).drop("anchor")
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("dims,spread,block", [(64, 0.15, 4096), (13, 0.15, 16), (8, 300.0, 16), (3, 0.01, 7)])
def test_negatives_equal_brute_force(rows, monkeypatch, dims, spread, block):
    monkeypatch.setattr(four_russians, "CANDIDATES", block)
    monkeypatch.setattr(four_russians, "ANCHORS", max(2, block // 4))
    monkeypatch.setattr(four_russians, "SIDE", max(2, block // 8))
    rng = np.random.default_rng(dims)
    vectors = [(i, int(rng.integers(0, 4)), np.float32(rng.normal(0.05 * spread, spread, dims)).tolist()) for i in range(150)]
    vectors += [(200 + i, 2, vectors[5][2]) for i in range(60)]  # ties
    vectors += [(300, None, vectors[0][2]), (305, 1, None), (310, 1, [float("nan")] * dims), (315, 1, [None] * dims), (None, 1, vectors[1][2])]
    vectors += [(320, 1, [float("-inf")] * dims), (325, 9, vectors[3][2]), (330, 1, vectors[4][2][:2]), (335, 1, [])]
    df = rows("vec_id long, label int, embedding array<float>, ints string, block string", [(*v, "mine", "mine") for v in vectors]).repartition(3)
    move = lambda i, lab: (lab + 1) % 10 if i % 7 == 0 else lab
    got = mined(df)
    assert got == plain_negatives(vectors, lambda i: i % 5 == 0, move)
    assert len(got) > 20


def test_negatives_of_small_and_repeated_tables(rows):
    schema = "vec_id long, label int, embedding array<float>"
    assert mined(rows(schema, [])) == []
    assert mined(rows(schema, [(5, 1, [0.5]), (6, 2, [0.5])])) == []
    twice = [(5, 1, [0.5, 0.5]), (6, 1, [0.6, 0.5]), (6, 1, [0.6, 0.5]), (8, 2, [0.5, 0.3]), (8, 2, [0.5, 0.3])]
    got = mined(rows(schema, twice))
    assert [r[:4] for r in got] == [(5, 6, 1, 8)] * 2 + [(5, 6, 2, 8)] * 2
    with pytest.raises(Exception, match="too large"):
        mined(rows(schema, [(5, 1, [1e30]), (6, 1, [0.6])]))


def test_scores_are_exact():
    rng = np.random.default_rng(11)
    a, c = rng.integers(-300, 300, (9, 21)), rng.integers(-512, 512, (33, 21))
    got = four_russians.scores(four_russians.subset_sums(a, 3), four_russians.to_planes(c, 10))
    assert (got == c @ a.T).all()
