"""Particles stored by place: equal to a full scan, from fewer files."""

import random

import pytest
from pyspark.sql import functions as F

from halospark.plans import progenitors
from halospark.sources import cells


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(1)
    place = lambda: rng.choice([rng.uniform(0, 100), rng.uniform(40, 45)])
    data = [(s, s * 10_000 + i, i % 50, place(), place(), place()) for s in (0, 1) for i in range(6000)]
    # a third of a snapshot in one point, some outside the box, some nowhere
    data += [(1, 50_000 + i, 7, 12.5, 12.5, 12.5) for i in range(3000)]
    data += [(0, 60_000, 3, -5.0, 50.0, 120.0), (0, 60_001, 3, None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "snapnum int, PId long, haloId int, x double, y double, z double")
    out = str(tmp_path_factory.mktemp("cells"))
    return df, cells.build_cells(df, out, 0.0, 100.0, rows_per_file=250)


def _limits(low, high):
    return {f"{c}{side}": v for c, lo, hi in zip("xyz", low, high) for side, v in (("lo", lo), ("hi", hi))}


@pytest.mark.parametrize("low,high", [((41, 41, 41), (44, 44, 44)), ((12, 12, 12), (13, 13, 13)), ((-9, 40, 99), (1, 60, 200)), ((12.5,) * 3, (13,) * 3), ((0, 0, 0), (100, 100, 100))])
def test_cubes_equal_a_full_scan(stored, low, high):
    df, where = stored
    for snap in (0, 1):
        inside = [(F.col(c) > lo) & (F.col(c) < hi) for c, lo, hi in zip("xyz", low, high)]
        want = df.where(F.col("snapnum") == snap).where(inside[0] & inside[1] & inside[2]).select("PId").collect()
        got = where.in_cube(snap, _limits(low, high)).select(*df.columns)
        assert sorted(r.PId for r in got.collect()) == sorted(r.PId for r in want)


def test_small_cubes_read_few_files(stored):
    df, where = stored
    every = len(where.spark.read.parquet(f"{where.path}/rows").inputFiles())
    some = where.in_cube(0, _limits((41, 41, 41), (44, 44, 44)))
    assert every > 40 and 0 < len(some.inputFiles()) < every / 4
    assert "PushedFilters: [" in (plan := some._jdf.queryExecution().executedPlan().toString()) and "Or(Or(" in plan
    halo = where.of_halo(1, 7)
    assert halo.count() == df.where("snapnum = 1 AND haloId = 7").count()
    assert where.of_halo(1, 999).count() == 0 and where.in_cube(5, _limits((0,) * 3, (9,) * 3)).count() == 0


def test_cubes_of_several_snapshots(stored):
    df, where = stored
    cubes = where.spark.createDataFrame(
        [(0, 1, *[40.0, 42.0] * 3), (1, 2, *[12.0, 13.0] * 3), (1, 3, *[80.0, 90.0] * 3)],
        "snapnum int, progId int, " + ", ".join(f"{c}{s} double" for c in "xyz" for s in ("lo", "hi")),
    )
    got = where.in_cubes(cubes)
    joined = df.join(cubes, "snapnum").where(" AND ".join(f"{c} > {c}lo AND {c} < {c}hi" for c in "xyz"))
    assert sorted(map(tuple, got.select("PId", "progId").collect())) == sorted(map(tuple, joined.select("PId", "progId").collect()))
    assert len(where._read(where.files(cubes)).inputFiles()) < len(where.spark.read.parquet(f"{where.path}/rows").inputFiles()) / 2


def test_extracts_are_kept(stored, tmp_path):
    df, where = stored
    gas = cells.build_cells(df.withColumns({c: F.lit(1.0) for c in ("Mc", "Sfr", "logT")}), str(tmp_path / "lake"), 0.0, 100.0, 500)
    halos = where.spark.createDataFrame([(1, 7, 2.0, 12.0, 12.0, 12.0)], "snapnum int, haloId int, Rvir double, x double, y double, z double")
    box = progenitors.halo_extract(gas, halos, 7, 1, str(tmp_path / "kept"), rlim=1.0)
    assert box.count() == df.where("snapnum = 1 AND x > 10 AND x < 14 AND y > 10 AND y < 14 AND z > 10 AND z < 14").count() >= 3000
    assert progenitors.halo_extract(gas, halos, 7, 1, str(tmp_path / "kept"), box=False).count() == df.where("snapnum = 1 AND haloId = 7").count()
    with pytest.raises(ValueError, match="no halo"):
        progenitors.halo_extract(gas, halos, 8, 1, str(tmp_path / "kept"))


def test_cell_numbers_are_short_code(spark):
    """Each place is worked out once: bit by bit, the code was too large for Java's compiler."""
    rng = random.Random(3)
    data = [tuple(rng.uniform(-20, 120) for _ in range(3)) for _ in range(200)] + [(None, 1.0, 1.0), (0.0, 100.0, 50.0)]
    df = spark.createDataFrame(data, "x double, y double, z double").withColumn("cell", cells.cell_number(0.0, 100.0))
    for x, y, z, cell in df.collect():
        at = None if x is None else [max(0, min(1023, int(v / 100.0 * 1024 // 1))) for v in (x, y, z)]
        assert cell == (None if at is None else sum((v >> b & 1) << 3 * b + k for k, v in enumerate(at) for b in range(cells.BITS)))
    assert df._jdf.queryExecution().optimizedPlan().toString().upper().count("FLOOR(") == 3


def test_files_are_bounded(stored, tmp_path, monkeypatch):
    """A table of many files gets larger ones, not ever more of them."""
    df, where = stored
    monkeypatch.setattr(cells, "FILES", 10, raising=False)
    few = cells.build_cells(df, str(tmp_path / "few"), 0.0, 100.0, rows_per_file=100)
    assert len(few.spark.read.parquet(f"{few.path}/rows").inputFiles()) < 30
    for limits in (_limits((41, 41, 41), (44, 44, 44)), _limits((0, 0, 0), (100, 100, 100))):
        assert sorted(few.in_cube(1, limits).collect()) == sorted(where.in_cube(1, limits).collect())
    assert few.of_halo(1, 7).count() == where.of_halo(1, 7).count()


def test_halo_index_holds_numbers_of_files(stored):
    """File names, twenty times as long as a number, are neither grouped nor stored for every halo and file."""
    df, where = stored
    halos = where.spark.read.parquet(f"{where.path}/halos")
    files = where.spark.read.parquet(f"{where.path}/files")
    assert [kind for _, kind in halos.dtypes if kind == "string"] == []
    rows = where.spark.read.parquet(f"{where.path}/rows").withColumn("file", F.substring_index(F.col("_metadata.file_path"), "/rows/", -1))
    want = rows.where("haloId <> 0").groupBy("snapnum", "haloId", "file").count()
    got = halos.join(files.select("number", "file"), "number").select("snapnum", "haloId", "file", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert files.select("number").distinct().count() == files.count() == files.select("file").distinct().count()


def test_halo_index_with_names_is_still_read(stored, tmp_path):
    df, where = stored
    halos, files = (where.spark.read.parquet(f"{where.path}/{name}") for name in ("halos", "files"))
    old = cells.Cells(where.spark, str(tmp_path / "old"))
    halos.join(files.select("number", "file"), "number").drop("number").write.parquet(f"{old.path}/halos")
    (tmp_path / "old" / "rows").symlink_to(f"{where.path}/rows")
    assert sorted(old.of_halo(1, 7).select("PId").collect()) == sorted(where.of_halo(1, 7).select("PId").collect()) != []


def test_ranges_cover_the_box():
    rng = random.Random(2)
    for _ in range(30):
        low = [rng.randrange(1 << cells.BITS) for _ in range(3)]
        high = [min((1 << cells.BITS) - 1, v + rng.randrange(1, 60)) for v in low]
        ranges = cells.curve_ranges(low, high)
        assert len(ranges) <= 64 and all(a <= b < c for (a, b), (c, _) in zip(ranges, ranges[1:]))
        for _ in range(50):
            at = [rng.randint(a, b) for a, b in zip(low, high)]
            key = sum((v >> b & 1) << 3 * b + k for k, v in enumerate(at) for b in range(cells.BITS))
            assert any(a <= key <= b for a, b in ranges)
