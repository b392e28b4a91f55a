"""Readers and writers on small files, including files cut into many input splits."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from halospark.plans.sightlines import sightlines
from halospark.sources import lake, schemas, store, text


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_group_file_positions_over_many_splits(spark, tmp_path, small_splits):
    n = 5000
    for snap in (7, 8):
        (tmp_path / f"gal_z{snap:03d}.grp").write_text("\n".join([str(n)] + [str(i * 3 - snap) for i in range(n)]) + "\n")
    df = text.read_grp(spark, str(tmp_path / "*.grp"))
    assert df.rdd.getNumPartitions() > 2
    assert df.count() == 2 * n
    assert df.where("galId <> idx * 3 - snapnum").count() == 0
    assert text.read_grp(spark, str(tmp_path / "*.grp"), n=100).where("snapnum = 7").count() == 100
    assert text.read_grp(spark, str(tmp_path / "*.grp"), abs_ids=True).where("galId < 0").count() == 0


def test_sogrp_is_comma_separated(spark, tmp_path):
    (tmp_path / "so_z001.sogrp").write_text("3\n5, 4\n\n0,0\n-2,1\n\n")
    got = text.read_sogrp(spark, str(tmp_path / "so_z001.sogrp")).orderBy("idx").collect()
    assert [(r.haloId, r.hostId, r.idx, r.snapnum) for r in got] == [(5, 4, 0, 1), (0, 0, 1, 1), (-2, 1, 2, 1)]
    assert text.rows_upto(1, 10, 5, 2) == 15 and text.rows_upto(4, 10, 5, 2) == 17


def test_sovcirc_skips_header_and_last_line(spark, tmp_path):
    line = "{} 1e3 2.5 3 4 50 900 6\n"
    (tmp_path / "so_z003.sovcirc").write_text("# head\n" + "".join("  " + line.format(i) for i in (1, 2, 3)))
    got = text.read_sovcirc(spark, str(tmp_path / "so_z003.sovcirc")).orderBy("haloId").collect()
    assert [(r.haloId, r.Mvir, r.Npart, r.snapnum) for r in got] == [(1, 1000.0, 50, 3), (2, 1000.0, 50, 3)]


def test_stat_par_and_small_tables(spark, tmp_path):
    (tmp_path / "gal_z002.stat").write_text(" ".join(str(i) for i in range(1, 23)) + "\n")
    row = text.read_stat(spark, str(tmp_path / "gal_z002.stat")).collect()[0]
    assert (row.galId, row.Npart, row.Mgal, row.Sfr) == (1, 2, 3.0, 22.0)
    (tmp_path / "so_z002.par").write_text("1 1\n2 1\n")
    assert sorted(tuple(r) for r in text.read_sopar(spark, str(tmp_path / "so_z002.par")).collect()) == [(1, 1, 2), (2, 1, 2)]
    (tmp_path / "redshift.txt").write_text("snapnum a zred\n  0 0.03226 29.99997\n108 1.0 0.0\n")
    grid = text.read_timegrid(spark, str(tmp_path / "redshift.txt")).orderBy("snapnum").collect()
    assert [tuple(r) for r in grid] == [(0, 0.03226, 29.99997), (108, 1.0, 0.0)]
    (tmp_path / "tcosmic.dat").write_text("Omega\n0.001 999.000 5.37780e+05\n")
    assert text.read_tcosmic(spark, str(tmp_path / "tcosmic.dat")).collect()[0].t == 537780.0
    (tmp_path / "plan.tab").write_text("/d/snapshot_076 1.1 1.0 1.2 m\n")
    assert text.read_zplan(spark, str(tmp_path / "plan.tab")).collect()[0].zhi == 1.2
    (tmp_path / "grid.csv").write_text("LogRho,LogT,count,Mass,Zmet\n-1.5,3,0,0,0\n1,4,2,100,0.5\n")
    got = text.read_phase_grid(spark, str(tmp_path / "grid.csv")).orderBy("LogRho").collect()
    assert got[0].LogM is None and got[1].LogM == 2.0


def test_fof_keeps_file_order(spark, tmp_path, small_splits):
    lines = [f"0 {i} 9.5 2 {-1 if i % 3 == 0 else i} 0 .1 .2 .3" for i in range(600)]
    (tmp_path / "fof").write_text("#head\n" + "\n".join(lines) + "\n")
    got = text.read_fof(spark, str(tmp_path / "fof")).orderBy("gid").collect()
    assert [r.gid for r in got] == list(range(400))
    assert [r.Mgal for r in got] == [float(i) for i in range(600) if i % 3]


def test_fof_numbers_every_file_on_its_own(spark, tmp_path, small_splits):
    (tmp_path / "m").mkdir()
    for snap, header in ((7, "#head"), (8, "0 0 1 2 5 0 .1 .2 .3")):
        lines = [f"0 {i} 9.5 2 {-1 if i % (snap - 4) == 0 else i} 0 .1 .2 .3" for i in range(500)]
        (tmp_path / "m" / f"fof_{snap:03d}.txt").write_text("\n".join([header, *lines]) + "\n")
    got = text.read_fof(spark, str(tmp_path / "m" / "fof_*"))
    for snap in (7, 8):
        rows = got.where(F.col("snapnum") == snap).orderBy("gid").collect()
        assert [(r.gid, r.Mgal) for r in rows] == list(enumerate(float(i) for i in range(500) if i % (snap - 4)))


def test_the_text_is_not_shuffled(spark, tmp_path, monkeypatch):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "g_004.grp").write_text("head\n" + "\n".join(map(str, range(100))) + "\n")
    path = str(tmp_path / "m" / "g_*")

    def plan():
        found = text.read_grp(spark, path)
        assert [r.galId for r in found.orderBy("idx").collect()] == list(range(100))
        return found._jdf.queryExecution().executedPlan().toString()

    sent = plan()
    assert "BroadcastHashJoin" in sent
    # what is dealt by key are the counts: no exchange has the lines below it but the one that sums them up
    for part in sent.split("Exchange hashpartitioning")[1:]:
        assert "HashAggregate" in part.split("Scan text")[0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(text, "MOST_SENT_SPLITS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_logs_skip_the_header_of_file_zero_only(spark, tmp_path):
    (tmp_path / "split.0").write_text("PId,parentId,atime,Mass\n1,2,0.5,3.5\n")
    (tmp_path / "split.1").write_text("4,5,0.6,7.5\n6,7,0.7,8.5\n")
    got = sorted(tuple(r) for r in text.read_split(spark, str(tmp_path / "split.*")).select("PId", "parentId", "Mass").collect())
    assert got == [(1, 2, 3.5), (4, 5, 7.5), (6, 7, 8.5)]

    values = ",".join(str(i) for i in range(19))
    (tmp_path / "initwinds.0").write_text("h," * 18 + "h\n" + values + "\n")
    row = text.read_initwinds(spark, str(tmp_path / "initwinds.*"), ["PhEWKey", "MinPotID", "PID"]).collect()
    assert [tuple(r) for r in row] == [(1, 17, 18)]
    (tmp_path / "old.0").write_text("h," * 17 + "h\n" + ",".join(str(i) for i in range(18)) + "\n")
    old = text.read_initwinds(spark, str(tmp_path / "old.*"), ["PID"], min_pot_id=False).collect()
    assert [tuple(r) for r in old] == [(17,)]

    (tmp_path / "rejoin.0").write_text(",".join("abcdefghijklmnop") + "\n" + ",".join(str(i) for i in range(16)) + "\n")
    assert [tuple(r) for r in text.read_rejoin(spark, str(tmp_path / "rejoin.*"), ["PhEWKey", "flag"]).collect()] == [(1, 15)]

    track = "  ".join(str(i) for i in range(30))
    (tmp_path / "phews.0").write_text(" ".join("h" * 30) + "\n" + track + "\n")
    (tmp_path / "phews.1").write_text(" " + track + "\n")
    got = text.read_phews(spark, str(tmp_path / "phews.*"), ["PhEWKey", "Mass", "dWork"]).collect()
    assert [tuple(r) for r in got] == [(1, 3.0, 29.0)] * 2
    (tmp_path / "one.0").write_text(" ".join(str(i) for i in range(30)) + "\n")
    assert text.read_phews(spark, str(tmp_path / "one.*"), ["dWork"], sep=" ").collect()[0].dWork == 29.0


def test_path_keys(spark):
    df = spark.createDataFrame(
        [("/d/l25/snapshot_098.hdf5",), ("/d/l25/gal_z108.stat",), ("/d/l25/readme",)], "p string"
    )
    got = [(r.model, r.snapnum, r.path_ok) for r in text.with_path_keys(df, "p").collect()]
    assert got == [("l25", 98, True), ("l25", 108, True), (None, None, False)]


def _landing(spark):
    return spark.range(20).select(
        F.lit(0).alias("ptype"),
        (F.col("id") % 2).cast("int").alias("snapnum"),
        F.col("id").alias("idx"),
        F.struct(F.col("id").cast("double").alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z")).alias("Coordinates"),
        (100 - F.col("id")).alias("ParticleIDs"),
        F.lit(1.5).alias("Masses"),
        F.lit(100.0).alias("InternalEnergy"),
        F.lit(1.0).alias("ElectronAbundance"),
        F.array(*[F.lit(i / 10) for i in range(11)]).alias("Metallicity"),
    )


def test_lake(spark, tmp_path):
    out = str(tmp_path / "lake")
    groups = spark.createDataFrame([(0, 0, 4, 9)], "ptype int, snapnum int, idx long, haloId int")
    lake.build_lake(_landing(spark), out, groups)
    gas = lake.particles(spark, out, "gas", ["PId", "x", "Mass", "Z", "haloId"], snapnum=0)
    got = {r.idx: r for r in gas.collect()}
    assert len(got) == 10 and got[4].haloId == 9 and got[2].haloId == 0 and got[4].x == 4.0 and got[4].PId == 96
    plan = gas._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "InternalEnergy" not in plan
    assert lake.n_snaps(spark.read.parquet(out)) == 2
    assert lake.particles(spark, out, "star", ["PId"]).count() == 0
    with pytest.raises(KeyError):
        lake.particles(spark, out, "gaz")
    with pytest.raises(AnalysisException):
        lake.particles(spark, out, "gas", ["Nope"])
    with pytest.raises(ValueError):
        lake.particles(spark, out, "star", ["logT"])


def test_lake_with_all_metals_derives_temperature(spark, tmp_path):
    out = str(tmp_path / "lake")
    lake.build_lake(_landing(spark), out, total_metals=False)
    row = lake.particles(spark, out, "gas", ["PId", "O", "logT"]).collect()[0]
    assert abs(row.O - 0.4) < 1e-6 and 3 < row.logT < 8


def test_multipart_positions(spark, tmp_path):
    # part 10 comes after part 2, whatever the file names' order
    start = 0
    for part, n in ((0, 50), (2, 30), (10, 20)):
        target = tmp_path / f"w{part}"
        spark.range(start, start + n).select(F.col("id").alias("v")).coalesce(1).write.parquet(str(target))
        file = next(target.glob("part-*.parquet"))
        (tmp_path / f"snap.{part}.parquet").write_bytes(file.read_bytes())
        start += n
    df = lake.particles_multipart(spark, str(tmp_path / "snap.*.parquet"))
    assert df.count() == 100 and df.where("idx <> v").count() == 0
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "snap.2.parquet").write_bytes((tmp_path / "snap.2.parquet").read_bytes())
    with pytest.raises(Exception, match="one part number"):
        lake.particles_multipart(spark, [str(tmp_path / "snap.2.parquet"), str(tmp_path / "again" / "snap.2.parquet")]).collect()


def test_headers_defaults_and_constant_mass(spark, tmp_path):
    head = spark.createDataFrame(
        [(0, 10, 5, 1, -1e-9, 1.0000001, [0.0, 7.5, 0.0, 0.0, 0.0, 0.0])],
        "snapnum int, n_gas long, n_dark long, n_star long, redshift double, ascale double, mass_table array<double>",
    )
    head.write.parquet(str(tmp_path / "h"))
    snap = lake.snapshots(spark, str(tmp_path / "h"))
    row = snap.collect()[0]
    assert (row.redshift, row.ascale, row.n_tot) == (0.0, 1.0, 16)
    p = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "snapnum int, ptype int, Mass double")
    assert sorted(r.Mass for r in lake.with_mass(p, snap).collect()) == [1.0, 7.5]
    assert lake.with_default(p, "FractionH2").collect()[0].FractionH2 == 0.0
    assert lake.with_default(p, "Mass", 9.0).agg(F.sum("Mass")).collect()[0][0] == 3.0


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([(2, 5, 1.5, 0), (1, 5, 2.5, 3)], "snapnum int, PId int, Mass double, haloId int")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        store.save(df, path, fmt, schemas.TABLES["phewtable"], sort_by=["PId", "snapnum"])
        back = store.load(spark, path, fmt)
        assert back.columns == ["PId", "snapnum", "Mass", "haloId"]
        assert back.count() == 2
    with pytest.raises(ValueError):
        store.save(df, str(tmp_path / "x"), "xml")


def test_materialize_reuses_equal_parameters(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    base = str(tmp_path)
    for _ in range(2):
        assert store.materialize(spark, base, "t", {"snapnum": 5, "stars": True}, build).count() == 3
    assert len(calls) == 1
    store.materialize(spark, base, "t", {"snapnum": 6, "stars": True}, build)
    store.materialize(spark, base, "t", {"snapnum": 5, "stars": True}, build, overwrite=True)
    assert len(calls) == 3
    # a write that was never committed is not a table
    path = store.table_path(base, "t", {"snapnum": 5, "stars": True})
    assert store.is_complete(spark, path) and not store.is_complete(spark, path + "x")
    df = spark.range(2)
    assert store.ensure_column(df, "id", lambda d: 1 / 0) is df
    assert "y" in store.ensure_column(df, "y", lambda d: d.withColumn("y", F.lit(1))).columns


def test_sightline_files(spark, tmp_path):
    g = spark.createDataFrame(
        [(i, 12.1234567, 10.6234567, 0.4999, -0.1, 0.25) for i in range(1, 5)] + [(9, 9.0, 9.0, 0.0, 0.0, 0.0)],
        "galId int, logMsub double, logMstar double, x double, y double, z double",
    )
    lines = sightlines(g, 12, 2, 25000.0)
    assert lines.count() == 2 * 4 * 8
    out = str(tmp_path / "los")
    store.write_sightlines(lines, out)
    got = spark.read.text(out + "/dir=x+").collect()
    files = list((tmp_path / "los" / "dir=x+").glob("*.txt"))
    assert len(files) == 1 and len(got) == 16
    first = files[0].read_text().splitlines()[0]
    assert first == "-0.499700 -0.100000  0.250000 2 1_12.12_10.62.x+10kpc"
    back = text.read_sightlines(spark, str(files[0])).collect()[0]
    assert (back.x, back.axis, back.label) == (-0.4997, 2, "1_12.12_10.62.x+10kpc")


def test_group_ids_of_gas_dark_and_stars(spark, tmp_path):
    """Group files list gas, dark, star particles in this order; positions inside a type start at 0."""
    raw = None
    for ptype, n in ((0, 3), (1, 2), (4, 2)):
        part = spark.range(n).select(
            F.lit(ptype).alias("ptype"), F.lit(0).alias("snapnum"), F.col("id").alias("idx"),
            (F.col("id") + 100 * ptype).alias("ParticleIDs"), F.lit(1.0).alias("Masses"),
        )
        raw = part if raw is None else raw.unionByName(part)
    out = str(tmp_path / "lake")
    lake.build_lake(raw, out)
    (tmp_path / "so_z000.sogrp").write_text("7\n" + "".join(f"{i},{10 + i}\n" for i in range(1, 7)))
    (tmp_path / "gal_z000.grp").write_text("7\n" + "".join(f"{20 + i}\n" for i in range(7)))
    halos = text.read_sogrp(spark, str(tmp_path / "so_z000.sogrp"))
    gals = text.read_grp(spark, str(tmp_path / "gal_z000.grp"))
    head = spark.createDataFrame([(0, 3, 2, 2)], "snapnum int, n_gas long, n_dark long, n_star long")
    gas = {r.PId: (r.galId, r.haloId, r.hostId) for r in lake.gas(spark, out, ["PId"], 0, gals, halos).collect()}
    assert gas == {0: (20, 1, 11), 1: (21, 2, 12), 2: (22, 3, 13)}
    dark = {r.PId: (r.haloId, r.hostId) for r in lake.dark(spark, out, head, halos).collect()}
    assert dark == {100: (4, 14), 101: (5, 15)}
    stars = {r.PId: (r.galId, r.haloId) for r in lake.stars(spark, out, ["PId", "Mass"], head, 0, gals, halos).collect()}
    # the halo file is one line short: the last star is in no halo
    assert stars == {400: (25, 6), 401: (26, 0)}


def test_bucketed_lake_joins_snapshots_without_shuffle(spark, tmp_path):
    from halospark.operators.aggregates import main_progenitor

    groups = _landing(spark).select("ptype", "snapnum", "idx", F.lit(3).alias("haloId"))
    raw = _landing(spark).withColumn("ParticleIDs", F.col("idx") - F.col("snapnum"))
    lake.build_lake(raw, str(tmp_path / "b"), groups, table="lake_b", buckets=4)
    df = spark.table("lake_b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = main_progenitor(df, 1)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in got.collect()] == [(3, 0, 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE lake_b")
    # both exchanges serve the two aggregates after the join
    assert "SortMergeJoin" in plan and "hashpartitioning(PId" not in plan and plan.count("Exchange hash") == 2


def test_catalogue_views(spark):
    from halospark.sources import catalogues

    so = spark.createDataFrame([(1, 7.0, 7.0, 5.0), (2, 70.0, 7.0, 6.0)], "haloId int, Mvir double, Msub double, Rvir double")
    st = spark.createDataFrame([(2, 1.5, 0.1, 0.2, 0.3), (3, 2.5, 0.4, 0.5, 0.6)], "galId int, Mgal double, x double, y double, z double")
    got = {r.haloId: (r.logMvir, r.Rvir, r.x) for r in catalogues.halos(so, st, ["Mvir", "Rvir", "x"]).collect()}
    assert got == {1: (1.0, 5.0, None), 2: (2.0, 6.0, 0.1), 3: (None, None, 0.4)}
    with pytest.warns(UserWarning, match="Nope"):
        out = catalogues.galaxies(st, 1.989e33, ["Mgal", "Nope"])
    assert out.columns == ["galId", "logMgal"]
    assert catalogues.galaxies(st, 1.0, log_mass=False).columns == st.columns


def test_halo_extract_is_stored_once(spark, tmp_path):
    from halospark.plans.progenitors import halo_extract

    gas = spark.createDataFrame(
        [(0, 1, 1.0, 1.0, 1.0, 0.0, 0.0, 5.0), (0, 2, 9.0, 9.0, 9.0, 0.0, 0.0, 5.0)],
        "snapnum int, haloId int, x double, y double, z double, Mc double, Sfr double, logT double",
    )
    halos = spark.createDataFrame([(0, 1, 1.5, 1.0, 1.0, 1.0)], "snapnum int, haloId int, Rvir double, x double, y double, z double")
    base = str(tmp_path / "x")
    assert halo_extract(gas, halos, 1, 0, base).count() == 1
    assert halo_extract(gas.limit(0), halos, 1, 0, base).count() == 1
    assert halo_extract(gas.limit(0), halos, 1, 0, base, overwrite=True).count() == 0
    assert [r.x for r in halo_extract(gas, halos, 2, 0, base, box=False).collect()] == [9.0]


def _bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_added_columns_are_kept_beside_the_rows(spark, tmp_path):
    base, buckets = str(tmp_path), (4, ["PId", "snapnum"])
    rows = spark.range(20_000).select((F.col("id") % 5000).alias("PId"), F.floor(F.col("id") / 5000).cast("int").alias("snapnum"), *[F.rand(k).alias(f"c{k}") for k in range(6)])
    stored = store.materialize(spark, base, "pp", {"run": 1}, lambda: rows, buckets=buckets)
    before, built = _bytes(tmp_path), []
    tag = lambda df: built.append(1) or df.withColumn("birthTag", F.concat(F.lit("t"), F.col("PId") % 3))
    got = store.add_column(spark, base, "pp", {"run": 1}, "birthTag", tag, buckets)
    added = _bytes(tmp_path) - before
    assert 0 < added < before / 4
    again = store.add_column(spark, base, "pp", {"run": 1}, "birthTag", tag, buckets)
    assert built == [1] and _bytes(tmp_path) == before + added
    assert got.columns == [*stored.columns, "birthTag"] == again.columns
    assert got.where("birthTag = concat('t', PId % 3)").count() == 20_000
    second = store.add_column(spark, base, "pp", {"run": 1}, "twice", lambda df: df.withColumn("twice", F.col("c0") * 2), buckets)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.materialize(spark, base, "pp", {"run": 1}, lambda: 1 / 0, buckets=buckets)
        text_ = plan._jdf.queryExecution().executedPlan().toString()
        assert text_.count("SortMergeJoin") == 2 and "Exchange" not in text_
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.columns == second.columns == [*stored.columns, "birthTag", "twice"] and plan.where("twice = c0 * 2").count() == 20_000
    # a session that knows nothing of the tables finds the same rows
    for t in spark.catalog.listTables():
        if t.name.startswith("stored_"):
            spark.sql(f"DROP TABLE {t.name}")
    assert store.materialize(spark, base, "pp", {"run": 1}, lambda: 1 / 0, buckets=buckets).where("twice = c0 * 2").count() == 20_000
    fresh = store.materialize(spark, base, "pp", {"run": 1}, lambda: rows, overwrite=True, buckets=buckets)
    assert "birthTag" not in fresh.columns
    with pytest.raises(ValueError, match="several rows"):
        store.add_column(spark, base, "pp", {"run": 1}, "bad", lambda df: df.withColumn("bad", F.lit(1)).union(df.withColumn("bad", F.lit(2))), buckets)


def test_stored_tables_know_their_inputs(spark, tmp_path, monkeypatch):
    """A new split log rebuilds the splits and nothing else; a new halo catalogue the progenitors only."""
    from halospark.plans import history

    def put(name, schema, data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    def sim():
        return history.Simulation(**{n: spark.read.parquet(str(tmp_path / n)) for n in ("gas", "dark", "halos", "hosts", "grid", "splits", "launches", "rejoins")}, n_snaps=2)

    particle = "PId long, snapnum int, haloId int, galId int, Mass double, Mc double, Sfr double"
    put("gas", particle, [(1, s, 1, 1, 2.0, 0.0, 0.0) for s in (0, 1)] + [(2, 1, 1, 1, 2.0, 1.0, 0.0)])
    put("dark", particle, [(9, s, 1, 1, 2.0, 0.0, 0.0) for s in (0, 1)])
    put("halos", "snapnum int, haloId int, logMvir double, logMsub double", [(s, 1, 1.0, 1.0) for s in (0, 1)])
    put("hosts", "snapnum int, haloId int, hostId int", [(s, 1, 1) for s in (0, 1)])
    put("grid", "snapnum int, a double, zred double", [(0, 0.5, 1.0), (1, 1.0, 0.0)])
    split = "PId long, parentId long, atime double, Mass double"
    put("splits", split, [(2, 1, 0.6, 1.0)])
    put("launches", "PhEWKey long, PId long, Mass double, atime double", [(1, 2, 3.0, 0.7)])
    put("rejoins", "PhEWKey long, Mass double, atime double", [(1, 1.0, 0.8)])
    written = []
    real = store.save
    monkeypatch.setattr(store, "save", lambda df, path, *a: written.append(path.split("/")[-3]) or real(df, path, *a))
    base = str(tmp_path / "kept")
    history.stored_tables(sim(), base, {"run": 1}, 1)
    assert sorted(written) == ["hosts", "lifecycle", "progenitors", "splits", "winds"]
    written.clear()
    assert history.stored_tables(sim(), base, {"run": 1}, 1).splits.count() == 1 and written == []
    put("splits", split, [(2, 1, 0.6, 1.0), (3, 1, 0.7, 1.0)])
    assert history.stored_tables(sim(), base, {"run": 1}, 1).splits.count() == 2 and written == ["splits"]
    written.clear()
    put("halos", "snapnum int, haloId int, logMvir double, logMsub double", [(s, h, 1.0, 1.0) for s in (0, 1) for h in (1, 2)])
    assert history.stored_tables(sim(), base, {"run": 1}, 1).progenitors.count() == 4 and written == ["progenitors"]
    written.clear()
    put("launches", "PhEWKey long, PId long, Mass double, atime double", [(1, 2, 3.5, 0.7)])
    history.stored_tables(sim(), base, {"run": 1}, 1)
    assert sorted(written) == ["lifecycle", "winds"]
    in_memory = [spark.createDataFrame([(k,)], "a int") for k in (1, 1, 2)]
    keys = [store.inputs_version(df) for df in in_memory]
    assert keys[0] == keys[1] != keys[2]
