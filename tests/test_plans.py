import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from halospark.plans import galaxies, history, progenitors, winds

GRID = [(0, 0.2), (1, 0.4), (2, 0.6), (3, 0.8)]


@pytest.fixture
def grid(rows):
    return rows("snapnum int, a double", GRID)


def test_lifecycle_defaults(rows, grid):
    launches = rows(
        "PhEWKey long, PId long, Mass double, atime double",
        [(1, 11, 5.0, 0.1), (2, 12, 6.0, 0.4), (3, 13, 7.0, 0.5)],
    )
    rejoins = rows("PhEWKey long, Mass double, atime double", [(2, 2.5, 0.65)])
    gas = rows("PId long, snapnum int, haloId int", [(12, 1, 8), (12, 0, 9), (13, 2, 4)])
    got = [tuple(r) for r in winds.wind_lifecycle(launches, rejoins, gas, grid, 4).orderBy("PId").collect()]
    # 11 started before the first snapshot; 13 was in no halo at its launch and never rejoined
    assert got == [(12, 1, 6.0, 8, 3, 2.5), (13, 1, 7.0, 0, 4, 0.0)]


def test_wind_table_adds_launch_and_end(rows):
    gas = rows("PId long, snapnum int, Mass double, haloId int, Mc double", [(1, 1, 4.0, 7, 0.5), (1, 2, 3.0, 7, 0.5), (2, 1, 9.0, 7, 0.0)])
    life = rows("PId long, snapfirst int, minit double, birthId int, snaplast int, mlast double", [(1, 0, 5.0, 7, 3, 1.0)])
    got = [tuple(r) for r in winds.wind_table(gas, life).orderBy("snapnum").select("snapnum", "Mass", "haloId", "Mloss").collect()]
    assert got == [(0, 5.0, 0, 0.0), (1, 4.0, 7, -1.0), (2, 3.0, 7, -1.0), (3, 1.0, 0, -2.0)]


def test_partition_rules(rows):
    hist = rows(
        "PId long, snapnum int, haloId int, Mgain double",
        [(1, 1, 5, 8.0), (2, 1, 6, 3.0), (3, 1, 7, 2.0), (4, 1, 0, 1.0)],
    )
    loss = [
        (10, 1, 5, -1.0, "SELF"),
        (11, 1, 5, -3.0, "SAT"),
        (12, 1, 5, -9.0, None),  # unknown birth halo: no part
        (13, 1, 7, 2.0, "SELF"),
        (14, 1, 7, -2.0, "IGM"),  # losses add up to zero
    ]
    pp = rows("PId long, snapnum int, haloId int, Mloss double, birthTag string", loss)
    got = {(r.PId, r.birthTag): r.Mgain for r in winds.wind_mass_partition(hist, pp).collect()}
    assert got == {
        (1, "SELF"): 2.0,
        (1, "SAT"): 6.0,
        (2, "IGM"): 3.0,
        (3, "SELF"): 2.0,
        (3, "IGM"): 2.0,
        (4, "IGM"): 1.0,
    }


def test_shares_of_a_gain_add_up(rows):
    rng = random.Random(3)
    hist = [(p, s, rng.randint(0, 4), float(rng.randint(-5, 9))) for p in range(30) for s in range(4)]
    pp = [
        (100 + i, rng.randint(0, 3), rng.randint(1, 4), -float(rng.randint(1, 9)), rng.choice(["SELF", "PARENT", "SAT", "IGM"]))
        for i in range(60)
    ]
    out = winds.wind_mass_partition(
        rows("PId long, snapnum int, haloId int, Mgain double", hist),
        rows("PId long, snapnum int, haloId int, Mloss double, birthTag string", pp),
    )
    total = defaultdict(float)
    for r in out.collect():
        total[r.PId, r.snapnum] += r.Mgain
    for p, s, _, gain in hist:
        assert total[p, s] == pytest.approx(gain)


def test_long_tracks_continue_in_segments(spark, rows):
    data = [(7, i / 1000.0, float(i), 100 + i) for i in range(250)] + [(8, 0.5, 1.0, 5), (8, 0.25, 2.0, 6)]
    random.Random(1).shuffle(data)
    launches = rows("PhEWKey long, PID long, ainit double", [(7, 70, 0.0), (8, 80, 0.1)])
    records = rows("PhEWKey long, atime double, Mass double, Z_c int", data)
    tracks = winds.build_tracks(records, launches, segment=F.floor(F.col("atime") * 10))
    got = {(r.PhEWKey, r.segment): r for r in tracks.collect()}
    assert sorted(got) == [(7, 0), (7, 1), (7, 2), (8, 2), (8, 5)]
    assert got[8, 2].track.atime == [0.25] and got[8, 5].track.Mass == [1.0] and got[8, 5].PID == 80
    # the head is the first record's on every segment, though the field varies along the track
    assert {got[7, s].Z_c for s in range(3)} == {100} and got[8, 5].Z_c == 6 and got[8, 5].records == 2
    whole = {r.PhEWKey: r for r in winds.build_tracks(records, launches).collect()}
    assert whole[7].track.Mass == [float(i) for i in range(250)] and whole[7].segment == 0 and whole[7].Z_c == 100
    assert [m for s in range(3) for m in got[7, s].track.Mass] == [float(i) for i in range(250)]
    assert {got[7, s].records for s in range(3)} == {250}


def test_progenitors_and_relations(rows):
    dark = []
    dark += [(p, 2, 1) for p in range(6)] + [(p, 2, 2) for p in range(6, 9)]
    dark += [(p, 1, 4) for p in range(4)] + [(4, 1, 5), (5, 1, 0)] + [(p, 1, 5) for p in range(6, 9)]
    halos = rows("snapnum int, haloId int, logMvir double, logMsub double",
                 [(2, 1, 3.0, 3.0), (2, 2, 2.0, 2.0), (1, 4, 1.5, 1.5), (1, 5, 1.2, 1.2)])
    hosts = rows("snapnum int, haloId int, hostId int", [(2, 1, 1), (2, 2, 1), (1, 4, 5), (1, 5, 5), (1, 6, 5), (1, 7, 4), (1, 8, 8)])
    prog = progenitors.progenitor_table(rows("PId long, snapnum int, haloId int", dark), halos, hosts, 2)
    got = {(r.haloId, r.snapnum): (r.progId, r.hostId, r.logMvir) for r in prog.collect()}
    assert got == {
        (1, 2): (1, 1, 3.0),
        (1, 1): (4, 5, 1.5),
        (1, 0): (0, 0, None),
        (2, 2): (2, 1, 2.0),
        (2, 1): (5, 5, 1.2),
        (2, 0): (0, 0, None),
    }
    asked = rows("snapnum int, haloId int", [(1, h) for h in (4, 5, 6, 7, 8)] + [(0, 3), (9, 1)])
    rel = {(r.snapnum, r.haloId): r.relation for r in progenitors.halo_relations(1, asked, prog, hosts).collect()}
    assert rel == {(1, 4): "SELF", (1, 5): "PARENT", (1, 6): "SIB", (1, 7): "SAT", (1, 8): "IGM", (0, 3): "IGM", (9, 1): "IGM"}
    assert progenitors.halo_relation_of(1, 7, 1, prog, hosts).collect()[0].relation == "SAT"
    assert progenitors.halo_relation_of(1, 99, 1, prog, hosts).collect()[0].relation == "IGM"


def test_galaxy_tree(rows):
    stars = rows(
        "PId long, snapnum int, galId int, Mass double",
        [
            (1, 0, 1, 2.0), (2, 0, 1, 2.0), (3, 0, 2, 1.0),
            # 3 is stripped, 4 is new; galaxy 1 is now called 5
            (1, 1, 5, 2.0), (2, 1, 5, 2.0), (3, 1, 0, 1.0), (4, 1, 6, 3.0),
            # everything merges into 9; mainId of the heavier line wins
            (1, 2, 9, 2.0), (2, 2, 9, 2.0), (3, 2, 9, 1.0), (4, 2, 9, 3.0),
        ],
    )
    hosts = rows("snapnum int, haloId int, hostId int", [(0, 1, 1), (0, 2, 1), (1, 5, 5), (1, 6, 5), (2, 9, 9)])
    tree = galaxies.galaxy_tree(stars, hosts)
    got = {(r.snapnum, r.galId): (r.mainId, r.Mstar, r.mainIdNext) for r in tree.collect()}
    founder = 1 << 32
    assert got == {
        (0, 1): (1, 4.0, 1),
        (0, 2): (2, 1.0, 1),
        (1, 5): (1, 4.0, 1),
        (1, 6): (founder + 6, 3.0, 1),
        (2, 9): (1, 8.0, None),
    }
    assert galaxies.galaxy_main_ids(galaxies.star_flows(stars.where("galId = 0"))).count() == 0
    table = galaxies.star_table(stars, tree)
    row = {(r.PId, r.snapnum): (r.mainId, r.initId) for r in table.collect()}
    assert row[3, 1] == (2, 2) and row[3, 2] == (1, 2) and row[4, 1] == (founder + 6, 6)
    rel = {r.galId: (r.descId, r.fate, r.relation) for r in galaxies.galaxy_relations(stars, tree, hosts, 0, 2).collect()}
    assert rel == {1: (9, "SELF", "SELF"), 2: (9, "MERGE", "SAT")}


def test_accretion_modes(rows):
    hist = rows(
        "PId long, snapnum int, haloId int, Mass double, relation string",
        [
            (1, 0, 4, 1.0, "SAT"), (1, 1, 1, 2.0, "SELF"),
            (2, 0, 0, 1.0, "IGM"), (2, 1, 1, 5.0, "SELF"),
            (3, 0, 0, 3.0, "IGM"), (3, 1, 1, 3.0, "SELF"),
        ],
    )
    mw = rows(
        "PId long, snapnum int, birthTag string, Mgain double",
        [(1, 1, "SELF", 1.0), (2, 1, "SELF", 1.0), (2, 1, "PARENT", 0.5), (2, 1, "SAT", 0.25), (2, 1, "SIB", 0.25)],
    )
    tmax = rows("PId long, Tmax double", [(1, 9.0), (2, 6.0), (3, 4.0)])
    got = {(r.PId, r["mode"]): r.Mass for r in history.accretion_mode(hist, mw, tmax, 1).collect()}
    assert got == {
        (1, "Merger"): 2.0,
        (2, "Hot"): 3.0,
        (2, "Recycled-self"): 1.0,
        (2, "Recycled-central"): 0.5,
        (2, "Recycled-satellite"): 0.25,
        (2, "Recycled-IGM"): 0.25,
        (3, "Cold"): 3.0,
    }


def test_not_ready_tables_are_named(rows):
    a = rows("PId long, Mgain double", [])
    b = rows("PId long, birthTag string", [])
    assert history.missing_fields(a, b) == ["history.relation", "subset.Mloss"]


def test_recent_accretion(rows):
    gas = rows("PId long, snapnum int, galId int", [(1, 1, 5), (2, 1, 5), (1, 0, 5), (2, 0, 4)])
    assert [r.PId for r in history.recent_accretion(gas, 5, 1).collect()] == [2]
    assert history.star_history(gas, 5, 1).agg(F.count("*")).collect()[0][0] == 4


def test_tracks_are_cut_by_records(rows):
    """One particle has most records, all but two of them at one time: its rows are no larger than any other's."""
    start = 1_704_067_200
    data = [(1, start + (i > 0) + (i > 298), float(i)) for i in range(300)] + [(2, start + 86400 * i, float(i)) for i in range(3)]
    records = rows("PhEWKey long, s long, Mass double", data).selectExpr("PhEWKey", "timestamp_seconds(s) AS atime", "Mass").repartition(5)
    tracks = winds.build_tracks(records, fields=("Mass",), first=("Mass",), chunk=32).orderBy("PhEWKey", "segment").collect()
    assert [(r.PhEWKey, r.segment, len(r.track.Mass)) for r in tracks] == [(1, k, 32 if k < 9 else 12) for k in range(10)] + [(2, 0, 3)]
    assert [m for r in tracks for m in r.track.Mass] == [m for _, _, m in data]
    assert {(r.PhEWKey, r.Mass, r.records) for r in tracks} == {(1, 0.0, 300), (2, 0.0, 3)}
    launches = rows("PhEWKey long, Minit double", [(1, 7.0)])
    some = winds.build_tracks(records, launches, fields=("Mass",), first=("Minit",), chunk=100).collect()
    assert sorted(len(r.track.Mass) for r in some) == [100] * 3 and {(r.Minit, r.records) for r in some} == {(7.0, 300)}
    assert winds.build_tracks(records.limit(0), fields=("Mass",)).count() == 0


def test_star_table_does_not_broadcast_copies_of_the_lines(spark, tmp_path):
    """Lines that fit a broadcast once are repeated for the parts of the skewed join, and then do not."""
    spark.range(60_000).selectExpr("0 AS snapnum", "cast(id + 1 AS int) AS galId", "id AS mainId").write.parquet(str(tmp_path / "main"))
    stars = spark.createDataFrame([(i, s, i % 3) for i in range(50) for s in (0, 1)], "PId long, snapnum int, galId int")
    stars.write.parquet(str(tmp_path / "stars"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(4 << 20))
    try:
        table = galaxies.star_table(spark.read.parquet(str(tmp_path / "stars")), spark.read.parquet(str(tmp_path / "main")))
        assert {(r.PId, r.snapnum): r.mainId for r in table.collect()} == {(i, s): i % 3 - 1 if i % 3 else None for i in range(50) for s in (0, 1)}
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
