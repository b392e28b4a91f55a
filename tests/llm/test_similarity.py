"""Jaccard join, language model and nearest neighbours against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from halospark.llm import curve_ann, jaccard_tree, katz


def plain_words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


def plain_set(text, width):
    w = plain_words(text)
    if not w:
        return frozenset()
    return frozenset({tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})


def plain_classes(docs, width, percent):
    """Smallest doc_id reachable by links, per doc_id; every pair is looked at."""
    sets = [(d, plain_set(t, width)) for d, t in docs if d is not None]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, r in sets[:i]:
            both = len(s & r)
            if both and 100 * both >= percent * len(s | r):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in up}


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    docs, texts = [], []
    for _ in range(40):
        texts.append([rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 60, 150]))])
    passage = [f"p{i}" for i in range(50)]
    for k in range(260):
        w = list(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.15:
            w += passage
        docs.append((k, rng.choice([" ", "\n", "  "]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    # one long chain: every document a little different from the one before
    w = [rng.choice(vocabulary) for _ in range(120)]
    for k in range(80):
        docs.append((1000 + k, " ".join(w)))
        w[rng.randrange(len(w))] = f"c{k}"
    return docs


@pytest.mark.parametrize("width,percent,block", [(3, 90, 512), (5, 80, 512), (5, 80, 16)])
def test_classes_equal_brute_force(rows, monkeypatch, width, percent, block):
    monkeypatch.setattr(jaccard_tree, "BLOCK", block)
    docs = near_copies(width + block)
    docs += [(2000, None), (2001, ""), (2002, " \n"), (None, docs[0][1]), (2003, docs[5][1]), (2003, docs[5][1]), (2004, "x " * 30_000)]
    rng = random.Random(9)
    rng.shuffle(docs)
    df = rows("doc_id long, text string, h1 string, node string", [(*d, "mine", "mine") for d in docs]).repartition(4)
    got = jaccard_tree.linked(df, width, percent).collect()
    want = plain_classes(docs, width, percent)
    sizes = {d: len(plain_set(t, width)) for d, t in docs if d is not None}
    assert len(got) == len(docs)
    for r in got:
        assert r.component_id == want.get(r.doc_id), r.doc_id
        if r.doc_id is not None:
            assert r.n_shingles == sizes[r.doc_id]
    kept = jaccard_tree.one_of_each(df, width, percent)
    assert kept.schema == df.schema
    assert {r.doc_id for r in kept.collect()} == {*want.values(), None}


def test_classes_of_repeated_ids_and_empty_table(rows):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = rows("doc_id long, text string", [(5, a), (5, b), (7, b), (6, a + " x"), (8, "other")])
    assert {r.doc_id: r.component_id for r in jaccard_tree.linked(df, 3, 90).collect()} == {5: 5, 6: 5, 7: 5, 8: 8}
    assert jaccard_tree.linked(df.limit(0)).count() == 0 and jaccard_tree.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [512, 16])
def test_link_counts_equal_brute_force(rows, monkeypatch, block):
    monkeypatch.setattr(jaccard_tree, "BLOCK", block)
    monkeypatch.setattr(jaccard_tree, "TILE", 8)
    monkeypatch.setattr(jaccard_tree, "TILE_SHINGLES", 100)
    docs = near_copies(block) + [(2000, None), (2001, ""), (None, "a b c d"), (2002, "a b c d")]
    # one group of copies with a third of all rows, rows repeated under one doc_id, one doc_id with two texts
    docs += [(3000 + k, docs[7][1]) for k in range(len(docs) // 2)] + [docs[3], docs[3], (5, docs[9][1])]
    sets = [plain_set(t, 3) for _, t in docs]
    want = Counter()
    for i, (d, _) in enumerate(docs):
        like = [j for j, (e, _) in enumerate(docs) if j != i and e is not None and sets[i] and sets[j]]
        n = sum(100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]) for j in like)
        want[d, len(sets[i]), n if d is not None else 0] += 1
    got = jaccard_tree.linked(rows("doc_id long, text string", docs).repartition(3), 3, 90, counted=True).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == want
    assert max(n for _, _, n in want) > len(docs) // 4


def test_exact_overlaps_and_pruning_of_families(monkeypatch):
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(32):
        family = rng.integers(0, 1 << 63, rng.integers(180, 220)).astype(np.uint64)
        for _ in range(16):
            own = family[rng.random(len(family)) > 0.03]
            sets.append(np.unique(np.append(own, rng.integers(0, 1 << 63, 2).astype(np.uint64))))
    rng.shuffle(mixed := np.arange(len(sets)))
    sets = [sets[i] for i in sorted(mixed.tolist(), key=lambda i: int(jaccard_tree.scramble(sets[i]).min()))]
    tree = jaccard_tree.SignatureTree(sets, jaccard_tree._bits(sets))
    i, j = np.triu_indices(len(tree.maps[1]))
    # nodes of one level above the leaves: most pairs of different families go together
    assert jaccard_tree._possible(tree, 1, i, tree, 1, j, 80).mean() < 0.2
    x, y = jaccard_tree.leaf_pairs(tree, tree, 80)
    monkeypatch.setattr(jaccard_tree, "TILE_SHINGLES", 500)
    both = jaccard_tree.overlaps(sets, sets, x, y)
    assert both.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]
    assert len(x) >= 32 * 100 and len(jaccard_tree.overlaps(sets, sets, x[:0], y[:0])) == 0


def test_tree_bound_never_loses_a_pair():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(120):
        base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.6 else rng.integers(0, 1 << 63, rng.integers(1, 200)).astype(np.uint64)
        keep = base[rng.random(len(base)) > 0.05]
        sets.append(np.unique(np.append(keep, rng.integers(0, 1 << 63, 1).astype(np.uint64))))
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    want = jaccard_tree.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want.union(i, j)
    for bits in (64, 256, 4096):
        tree, got = jaccard_tree.SignatureTree(sets, bits), jaccard_tree.Forest(len(sets))
        jaccard_tree.join_trees(tree, sets, tree, sets, 80, got, 0)
        assert (got.roots() == want.roots()).all()
        half = len(sets) // 2
        left, right = jaccard_tree.SignatureTree(sets[:half], bits), jaccard_tree.SignatureTree(sets[half:], bits)
        split = jaccard_tree.Forest(len(sets))
        jaccard_tree.join_trees(left, sets[:half], right, sets[half:], 80, split, half)
        for part, own, shift in ((left, sets[:half], 0), (right, sets[half:], half)):
            inner = jaccard_tree.Forest(len(own))
            jaccard_tree.join_trees(part, own, part, own, 80, inner, 0)
            for i, r in enumerate(inner.roots().tolist()):
                split.union(i + shift, r + shift)
        assert (split.roots() == want.roots()).all()


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    level = rng.integers(0, 5, 1 << jaccard_tree.SKETCH_BITS).astype(np.uint8)
    for n in (1, 2, 5, 9, 10, 11, 50, 333):
        for percent in (80, 90):
            s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            lost = (100 - percent) * n // 100
            r = s[np.sort(rng.permutation(n)[lost:])]
            a, b = jaccard_tree.prefix(s, level, percent), jaccard_tree.prefix(r, level, percent)
            assert len(np.intersect1d(a, b)) > 0
            assert abs(jaccard_tree.size_level(len(s), percent) - jaccard_tree.size_level(len(r), percent)) <= 9


def test_chance_shingles_make_no_candidate_groups(rows, monkeypatch):
    """Where the order of shingles knows nothing (a full sketch), single common shingles do not chain documents."""
    monkeypatch.setattr(jaccard_tree, "rarity_levels", lambda known: bytes(1 << jaccard_tree.SKETCH_BITS))
    members = []
    monkeypatch.setattr(jaccard_tree, "placements", lambda member, *a, f=jaccard_tree.placements: members.append(member) or f(member, *a))
    own = lambda k, n=100: [f"w{k}x{i}" for i in range(n)]
    # each document has passages in common with the next ones: short of similar, but all would make one group
    docs = [(k, " ".join([*own(k), *(x for j in range(k, k + 4) for x in (*own(f"p{j}", 10), f"end{k}"))])) for k in range(150)]
    near = [(1000 + k, " ".join(own(f"n{k // 3}", 300)[k % 3 :])) for k in range(30)]
    found = {r.doc_id: r.component_id for r in jaccard_tree.linked(rows("doc_id long, text string", docs + near).repartition(3), 5, 80).collect()}
    assert found == {**{k: k for k, _ in docs}, **{1000 + k: 1000 + k - k % 3 for k in range(30)}}
    assert {r.node for r in members[0].collect()} == {k for k, _ in near}


def test_profiles_and_places_never_lose_a_pair():
    rng = np.random.default_rng(8)
    level = rng.integers(0, 3, 1 << jaccard_tree.SKETCH_BITS).astype(np.uint8)
    far = 0
    for n in (1, 2, 9, 40, 250, 300, 3000):
        for percent in (80, 90, 100):
            s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            both = -(-percent * n // 100)
            r = np.sort(rng.permutation(s)[:both])
            # half of the room for other shingles is on the other side
            if percent < 100 and n > 20:
                half = (n - both) // 3
                r = np.unique(np.concatenate([rng.permutation(s)[: n - half], rng.integers(0, 1 << 63, half).astype(np.uint64)]))
            common = len(np.intersect1d(s, r))
            assert 100 * common >= percent * (len(s) + len(r) - common)
            other = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            p = [pa.array([jaccard_tree.profile(x)], pa.binary()) for x in (s, r, other)]
            assert jaccard_tree.can_be_similar(p[0], p[1], percent).all() and jaccard_tree.can_be_similar(p[0], pa.nulls(1, pa.binary()), percent).all()
            far += not jaccard_tree.can_be_similar(p[0], p[2], percent).any()
            a, b = (jaccard_tree.in_order(jaccard_tree.prefix(x, level, percent), level).tolist() for x in (s, r))
            first = next(x for x in a if x in b)
            assert min(len(s) - a.index(first), len(r) - b.index(first)) >= jaccard_tree.least_overlap(len(s), len(r), percent)
            assert not {*a[: a.index(first)]} & {*b[: b.index(first)]}
    assert far >= 12


def test_components(rows):
    edges = [(1, 2), (2, 3), (7, 3), (10, 11), (11, 11), (2, 1), *((i, i + 1) for i in range(100, 160)), *((500, 501 + i) for i in range(40))]
    got = {r.node: r.component for r in jaccard_tree.components(rows("a long, b long", edges)).collect()}
    assert got[7] == got[1] == 1 and got[10] == got[11] == 10 and {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in range(500, 541)} == {500} and len(got) == 4 + 2 + 61 + 41
    assert jaccard_tree.components(rows("a long, b long", [])).count() == 0


END, START = b"</>", b"<>"


def plain_katz(docs):
    """Scores of every document, term by term, and the model's probability function."""
    tokens = [(d, plain_words(t) + [END]) for d, t in docs]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    u, b, c = Counter(), Counter(), Counter()
    for d, w in tokens:
        if not held(d):
            u.update(w)
            for h, x in zip([START, *w], w):
                b[h, x] += 1
                c[h] += 1
    n, v = sum(u.values()), len(u)
    of = lambda counts: [0, *[Counter(counts.values())[r] for r in range(1, 7)]]
    unigrams, d2 = katz.Unigrams(n, of(u)), katz.discounts(of(b))
    p1 = lambda x: float(unigrams.p(np.array([u[x]]))[0])
    after = defaultdict(dict)
    for (h, x), k in b.items():
        after[h][x] = k
    disc = lambda k: (d2[k] if k <= 5 else 1) * k
    below = {h: c[h] + all(k > 5 for k in x.values()) for h, x in after.items()}
    alpha = {h: (1 - sum(map(disc, x.values())) / below[h]) / (1 - sum(map(p1, x))) for h, x in after.items()}

    def p(h, x):
        if x in after[h]:
            return disc(after[h][x]) / below[h]
        return alpha[h] * p1(x) if h in alpha else p1(x)

    scores = []
    for d, w in tokens:
        base = sum(math.log10((u[x] + 1) / (n + v + 1)) for x in w)
        scores.append((d, held(d), len(w), sum(x in u for x in w), n, base, sum(math.log10(p(h, x)) for h, x in zip([START, *w], w))))
    return scores, p, u, unigrams, alpha, p1


def katz_docs(seed, hot=0.0):
    rng = random.Random(seed)
    docs = []
    for i in range(300):
        w = ["hot" if rng.random() < hot else f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(0, 60))]
        docs.append((i, " ".join(w)))
    return docs + [(1000, None), (1001, ""), (None, "w1 w2 new"), (5, docs[5][1]), (6, "another text of six"), (1002, "Long W1 " * 20_000)]


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_katz_equals_brute_force(rows, hot):
    docs = katz_docs(1, hot)
    want, p, u, unigrams, alpha, _ = plain_katz(docs)
    got = katz.score(rows("doc_id long, text string, words string", [(*d, "mine") for d in docs]).repartition(5)).collect()
    order = lambda x: (x[0] is None, x[0] or 0, round(x[6], 3))
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)
    # the distribution after any history adds up to one, unknown words included
    for h in [START, b"w1", b"hot", b"long", b"never seen"]:
        unknown = alpha.get(h, 1.0) * unigrams.unknown
        assert sum(p(h, x) for x in u) + unknown == pytest.approx(1.0, abs=1e-9)


def test_katz_helps_on_text_not_trained_on(rows):
    docs = [(i, f"a b c d e f {'x' if i % 3 else 'y'} g h i") for i in range(200)]
    got = katz.score(rows("doc_id long, text string", docs)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b / 2


def test_katz_buckets_hold_their_own_documents_only(rows):
    """With many buckets and documents, a bucket's arrays are bounded by its tokens, not by all documents."""
    docs = [(k, f"only{k} word{k}") for k in range(400)] + [(k, None) for k in range(400, 450)]
    got = katz.bigram_rows(rows("doc_id long, text string", docs).repartition(2), 16, {}, 1e9).collect()
    tokens = sum(sum(np.frombuffer(r.occurrences, "<u4").tolist()) for r in got)
    assert tokens == 3 * 400 + 50
    for r in got:
        named, n = len(r.versions) // 4, sum(np.frombuffer(r.occurrences, "<u4").tolist())
        assert named <= n and {*np.frombuffer(r.docs, "<u2").tolist()} == {*range(named)} and len(r.ids) == 8 * named
    assert {int(i) for r in got for i in np.cumsum(np.frombuffer(r.ids, "<i8"))} == {*range(450)}


def test_katz_without_training_or_rows(rows):
    only_held = [(i, "a b") for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = katz.score(rows("doc_id long, text string", only_held)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(3, 0, 0, 0.0, 0.0)}
    assert katz.score(rows("doc_id long, text string", [])).count() == 0


def test_many_short_texts_in_one_batch(spark, rows):
    """More rows in a batch than 16 bits can number: every one has its own score."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        docs = spark.range(0, 70_000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b"), F.col("id") % 7).alias("text"))
        got = katz.score(docs).groupBy("n_tokens").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [tuple(r) for r in got] == [(3, 70_000, 70_000)]


def test_discounts_are_inside_the_unit_interval():
    for n in ([0] * 7, [0, 100, 40, 20, 10, 6, 4], [0, 5, 9, 1, 0, 0, 0], [0, 49663, 12919, 5197, 2729, 2383, 1067], [0, 1, 0, 0, 0, 0, 0]):
        d = katz.discounts(n)
        assert ((d[1:] > 0) & (d[1:] < 1)).all()
    raw = katz.discounts([0, 1000, 300, 140, 80, 50, 34])
    assert raw[1] == pytest.approx((2 * 300 / 1000 - 6 * 34 / 1000) / (1 - 6 * 34 / 1000))


def plain_nearest(vectors, query, k):
    usable = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable.setdefault(i, np.array(v, float))
    out = {}
    for q, a in usable.items():
        if query(q):
            cos = [(-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 12), i) for i, b in usable.items() if i != q]
            out[q] = [i for _, i in sorted(cos)[:k]]
    return out


def test_nearest_recall_and_scores(rows):
    rng = np.random.default_rng(6)
    data = [(int(i), rng.standard_normal(16).astype(float).tolist()) for i in range(2000)]
    df = rows("vec_id long, embedding array<float>, rank string", [(*d, "mine") for d in data])
    got = curve_ann.nearest(df, F.col("vec_id") % 50 == 0, k=5).collect()
    want = plain_nearest([(i, np.float32(v).tolist()) for i, v in data], lambda q: q % 50 == 0, 5)
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert len(got) == 5 * 40 and hits >= 0.9 * 5 * 40
    assert sorted(r["rank"] for r in got) == sorted([1, 2, 3, 4, 5] * 40)


def test_nearest_in_clusters_with_small_windows(rows, monkeypatch):
    monkeypatch.setattr(curve_ann, "BLOCK", 32)
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 16))
    data = [(i, (centres[i % 60] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(3000)]
    df = rows("vec_id long, embedding array<double>", data)
    got = curve_ann.nearest(df, F.col("vec_id") % 50 == 0, k=5, window=0.1).collect()
    want = plain_nearest(data, lambda q: q % 50 == 0, 5)
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.9 * len(got)


@pytest.mark.parametrize("block", [64, 4096])
def test_windows_do_not_depend_on_blocks_and_beat_random_orderings(rows, monkeypatch, block):
    monkeypatch.setattr(curve_ann, "BLOCK", block)
    rng = np.random.default_rng(12)
    data = [(i, rng.standard_normal(8).tolist()) for i in range(1500)]
    df, query = rows("vec_id long, embedding array<double>", data), F.col("vec_id") % 50 == 0
    got = curve_ann.nearest(df, query, k=5, window=0.15).collect()
    want = plain_nearest(data, lambda q: q % 50 == 0, 5)
    hits = {(r.query_id, r.vec_id) for r in got if r.vec_id in want[r.query_id]}
    # four random orderings with the same windows hold a neighbour with probability 1 - 0.85^4 = 0.48
    assert len(hits) >= 0.7 * 5 * len(want)
    # the windows themselves, worked out here
    places = curve_ann.ordered(curve_ann.folded(curve_ann.usable(df), query, 5)[0]).collect()
    rank = {(r.curve, r.vec_id): r["rank"] for r in places}
    n, reach = 1500, math.ceil(1500 * 0.075)
    for q in want:
        seen = set()
        for c in range(curve_ann.CURVES):
            start = max(0, min(rank[c, q] - reach, n - 1 - 2 * reach))
            stop = min(n - 1, max(rank[c, q] + reach, 2 * reach))
            seen |= {i for i in range(n) if start <= rank[c, i] <= stop}
        assert sorted(r.vec_id for r in got if r.query_id == q) == sorted(
            sorted(seen - {q}, key=lambda i: -float(np.dot(data[q][1], data[i][1]) / np.linalg.norm(data[i][1])))[:5]
        )


def test_nearest_cases(rows):
    vectors = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]),
        (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (10, []), (None, [1.0, 0.0]), (1, [2.0, 0.0]), (11, [1e200, 1e200]), (12, [-1e-200, 0.0]),
    ]
    df = rows("vec_id long, embedding array<double>, query_id string", [(*v, "mine") for v in vectors])
    got = curve_ann.nearest(df, F.col("vec_id").isin(0, 4, 9), k=4).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 11), (0, 4, 3)]
    assert got[0].score == 1.0 and got[2].score == pytest.approx(math.sqrt(0.5)) and got[3].score == 0.0
    few = curve_ann.nearest(df.where("vec_id in (0, 3)"), F.col("vec_id") == 0, k=5).collect()
    assert [r.vec_id for r in few] == [3]
    assert curve_ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_nearest_with_a_third_of_all_rows_equal(rows, monkeypatch):
    monkeypatch.setattr(curve_ann, "BLOCK", 32)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16))
    data = [(i, (centres[0] if i % 3 == 0 else centres[i % 40] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(2400)]
    got = curve_ann.nearest(rows("vec_id long, embedding array<double>", data), F.col("vec_id") % 20 == 0, k=5, window=0.1).collect()
    want = plain_nearest(data, lambda q: q % 20 == 0, 5)
    by_query = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query[r.query_id].append(r.vec_id)
    assert len(got) == 5 * 120 and all(by_query[q] == want[q] for q in want if q % 3 == 0)
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.9 * len(got)


def test_hilbert_neighbours_are_next_to_each_other():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    keys = curve_ann.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_words_split_like_the_pattern():
    from halospark.llm.common import split_words

    texts = ["", " a\x0bb ", "x y z", "\x1c\x1d q", None, "é\tü\r\n"]
    counts, flat = split_words(pa.array(texts))
    want = [plain for t in texts for plain in re.findall("[^\x20\x09-\x0d]+", t or "")]
    assert flat.to_pylist() == want and counts.sum() == len(want)
