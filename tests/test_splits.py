"""Split generations: the two documented diagrams, and random logs against a particle-by-particle walk."""

import random

from pyspark.sql import functions as F

from halospark.operators.lineage import checkpoint_dir
from halospark.plans.history import gas_history
from halospark.plans import splits
from halospark.plans.splits import ancestor_spans, split_ancestors, split_table, with_parent_gen, with_split_gain

# PId, parentId, snapnext: 3 and 4 come from 12, 12 from 15; 3 split twice and 4 once on their own
EVENTS = [(101, 3, 107), (102, 3, 104), (3, 12, 103), (4, 12, 101), (12, 15, 99), (104, 4, 103)]


def _split_log(rows):
    data = [(p, q, 1.0 + s, s / 110.0, s) for p, q, s in EVENTS]
    return with_parent_gen(rows("PId long, parentId long, Mass double, atime double, snapnext int", data))


def test_checkpoint_dir_is_the_configured_one(spark):
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_parent_gen(rows):
    got = {r.PId: r.parentGen for r in _split_log(rows).collect()}
    assert got == {101: 1, 102: 2, 3: 1, 4: 2, 12: 1, 104: 1}


def test_parent_gen_ties_share_the_truncated_average_rank(rows):
    data = [(1, 9, 0.0, 0.5, 1), (2, 9, 0.0, 0.5, 1), (3, 9, 0.0, 0.2, 0), (4, 9, 0.0, 0.9, 2)]
    got = with_parent_gen(rows("PId long, parentId long, Mass double, atime double, snapnext int", data))
    # ranks from the latest: 1, (2 + 3) / 2, (2 + 3) / 2, 4
    assert {r.PId: r.parentGen for r in got.collect()} == {4: 1, 1: 2, 2: 2, 3: 4}


def _generations(rows, pid, per_snapshot):
    anc = split_ancestors(rows("PId long", [(pid,)]), _split_log(rows), per_snapshot=per_snapshot)
    spans = ancestor_spans(anc).collect()
    out = []
    for snap in range(108, 97, -1):
        hit = [(r.gen, r.parentId) for r in spans if r.first <= snap <= r.last]
        assert len(hit) <= 1
        out.append(hit[0] if hit else (0, pid))
    return out


def test_documented_diagrams(rows):
    for per_snapshot in (False, True):
        three = _generations(rows, 3, per_snapshot)
        assert [g for g, _ in three] == [0, 0, 1, 1, 1, 2, 3, 3, 4, 4, 5]
        assert [p for _, p in three] == [3, 3, 3, 3, 3, 3, 12, 12, 12, 12, 15]
        four = _generations(rows, 4, per_snapshot)
        assert [g for g, _ in four] == [0, 0, 0, 0, 0, 0, 1, 1, 2, 2, 3]
        assert [p for _, p in four] == [4, 4, 4, 4, 4, 4, 4, 4, 12, 12, 15]


def test_one_history_row_per_particle_and_snapshot(rows):
    gas = [(p, s, 64.0, 1) for p in (3, 4) for s in range(101, 109)]
    gas += [(12, s, 64.0, 2) for s in range(98, 109)] + [(15, s, 64.0, 3) for s in range(98, 109)]
    # 3 exists from 103 on only
    gas = [g for g in gas if not (g[0] == 3 and g[1] < 103)]
    ids = rows("PId long", [(3,), (4,)])
    anc = split_ancestors(ids, _split_log(rows))
    got = gas_history(ids, rows("PId long, snapnum int, Mass double, haloId int", gas), anc, 108).collect()
    assert len(got) == len({(r.PId, r.snapnum) for r in got}) == 22
    three = {r.snapnum: r for r in got if r.PId == 3}
    assert [three[s].Mass for s in range(98, 109)] == [64 / 2**g for g in (5, 4, 4, 3, 3, 2, 1, 1, 1, 0, 0)]
    assert [three[s].haloId for s in (98, 102, 108)] == [3, 2, 1]
    assert three[98].Mgain == 0.0 and three[99].Mgain == three[99].Mass - three[98].Mass


def _walk(events, pid, snap):
    """Generation and stand-in of one particle at one snapshot, by going back split by split."""
    current, gen, upper = pid, 0, 10**9
    while True:
        own = sorted((s for p, q, s in events if q == current and snap < s <= upper), reverse=True)
        birth = [(q, s) for p, q, s in events if p == current]
        if birth and birth[0][1] > snap:
            # splits of the current particle between its birth and where we came from, plus the birth itself
            gen += len([s for s in own if s > birth[0][1]]) + 1
            current, upper = birth[0][0], birth[0][1] - 1
        else:
            return gen + len(own), current


def test_random_logs_against_a_walk(rows):
    rng = random.Random(5)
    snaps = list(range(1, 60))
    rng.shuffle(snaps)
    events, alive = [], {0: 0, 1: 0}
    for new, snap in zip(range(2, 40), sorted(snaps[:38]), strict=True):
        parent = 0 if rng.random() < 0.35 else rng.choice(list(alive))
        events.append((new, parent, snap))
        alive[new] = snap
    data = [(p, q, 1.0, s / 100.0, s) for p, q, s in events]
    log = with_parent_gen(rows("PId long, parentId long, Mass double, atime double, snapnext int", data))
    tracked = [0, 5, 17, 30, 39]
    for per_snapshot in (False, True):
        spans = ancestor_spans(split_ancestors(rows("PId long", [(t,) for t in tracked]), log, per_snapshot)).collect()
        for t in tracked:
            for snap in range(60):
                hit = [(r.gen, r.parentId) for r in spans if r.PId == t and r.first <= snap <= r.last]
                assert (hit[0] if hit else (0, t)) == _walk(events, t, snap)


def test_a_long_line_of_parents_takes_few_rounds(rows, monkeypatch):
    """10 000 parents above one particle, 40 above another, none above a third: as many rows, in 15 rounds at most."""
    rounds = []
    real = splits._climbed
    monkeypatch.setattr(splits, "_climbed", lambda *a: rounds.append(1) or real(*a))
    n = 10_000
    log = [(k, k + 1, 8.0, n - k, 1 + k % 2) for k in range(n)] + [(20_000 + k, 20_001 + k, 4.0, 40 - k, 1) for k in range(40)]
    schema = "PId long, parentId long, Mass double, snapnext int, parentGen int"
    ids = rows("PId long", [(0,), (20_000,), (30_000,)])
    got = split_ancestors(ids, rows(schema, log)).where("parentId <> PId")
    lines = {r.PId: (r.n, r.top, r.low, r.high) for r in got.groupBy("PId").agg(
        F.count_distinct("parentId").alias("n"), F.max("parentId").alias("top"), F.min("gen").alias("low"), F.max("gen").alias("high")).collect()}
    # own splits of k: those of its one child; generations add own + 1 - parentGen of the step below
    gen, low, high = 0, None, 0
    for k in range(n):
        own = 1 + (k - 1) % 2 if k else 0
        gen = own + 1 if k == 0 else gen - (1 + (k - 1) % 2) + own + 1
        low, high = min(gen, low or gen), max(gen, high)
    assert lines == {0: (n, n, low, high), 20_000: (40, 20_040, 1, 40)}
    assert len(rounds) - splits.LEVELS_PER_ROUND + 1 <= 15


def test_cyclic_log_is_an_error(rows):
    import pytest

    log = rows("PId long, parentId long, Mass double, atime double, snapnext int, parentGen int",
               [(1, 2, 1.0, 0.1, 1, 1), (2, 1, 1.0, 0.2, 2, 1)])
    with pytest.raises(RuntimeError):
        split_ancestors(rows("PId long", [(1,)]), log)


def test_long_lines_of_parents_and_every_split_of_an_ancestor(rows):
    n = 40
    data = [(p + 1, p, 1.0, p / 100, p, 1) for p in range(n)]
    log = rows("PId long, parentId long, Mass double, atime double, snapnext int, parentGen int", data)
    lineage = split_ancestors(rows("PId long", [(n,)]), log).collect()
    assert {r.parentId: r.gen for r in lineage} == {p: n - p for p in range(n)}
    # three earlier splits of the parent between two snapshots: all listed, or the one of highest generation
    many = rows("PId long, parentId long, Mass double, atime double, snapnext int, parentGen int",
                [(10 + g, 1, float(g), 0.1, 2, g) for g in (4, 3, 2)] + [(9, 1, 1.0, 0.2, 3, 1)])
    tracked = rows("PId long", [(9,)])
    assert sorted(r.gen for r in split_ancestors(tracked, many).collect()) == [1, 2, 3, 4]
    assert sorted(r.gen for r in split_ancestors(tracked, many, per_snapshot=True).collect()) == [1, 4]


def test_split_table_places_events_on_the_grid(rows):
    grid = rows("snapnum int, a double", [(0, 0.1), (1, 0.5), (2, 1.0)])
    log = rows("PId long, parentId long, atime double, Mass double",
               [(5, 1, 0.05, 8.0), (6, 1, 0.5, 8.0), (7, 2, 0.99, 8.0)])
    got = {r.PId: (r.snapnext, r.parentGen) for r in split_table(log, grid).collect()}
    # an event at a grid time belongs to the next snapshot
    assert got == {5: (0, 2), 6: (2, 1), 7: (2, 1)}


def test_split_gain(rows):
    hist = rows("PId long, snapnum int, Mass double, Mgain double",
                [(1, 4, 10.0, 1.0), (1, 5, 6.0, -4.0), (2, 5, 6.0, 0.0), (3, 5, 2.0, 0.5)])
    log = rows("PId long, parentId long, Mass double, atime double, snapnext int, parentGen int", [(2, 1, 10.0, 0.5, 5, 1)])
    got = {(r.PId, r.snapnum): r.Mgain for r in with_split_gain(hist, log).collect()}
    assert got == {(1, 4): 1.0, (1, 5): 1.0, (2, 5): 1.0, (3, 5): 0.5}
