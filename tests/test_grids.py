import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halospark.operators import aggregates, grids, joins


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    n = 800
    return pd.DataFrame(
        {
            "x": rng.normal(size=n),
            "y": rng.random(n) * 4,
            "Mass": rng.integers(1, 9, n).astype(float),
            "logT": rng.random(n) * 5 + 2.5,
            "LogRho": rng.random(n) * 10 - 2.5,
            "O": rng.random(n) * 1e-2,
        }
    )


def test_maps_match_pandas_cut(spark, cloud):
    df = spark.createDataFrame(cloud)
    binned = cloud.assign(xb=pd.cut(cloud.x, 9, labels=range(9)), yb=pd.cut(cloud.y, 7, labels=range(7)))
    mass = binned.groupby(["xb", "yb"], observed=False).Mass.sum()
    got = grids.density_map(df, 9, 7).toPandas().set_index(["xbin", "ybin"]).logMass
    assert len(got) == 63
    for (i, j), m in mass.items():
        assert (np.isnan(got[i, j]) and m == 0) or np.isclose(got[i, j], np.log10(m))
    binned["mt"] = binned.Mass * binned.logT
    t = binned.groupby(["xb", "yb"], observed=False)[["mt", "Mass"]].sum()
    want = (t.mt / t.Mass).fillna(0.0)
    temp = grids.temperature_map(df, 9, 7).toPandas().set_index(["xbin", "ybin"]).logT
    assert np.allclose([temp[k] for k in want.index], want.to_numpy())


def test_map_of_a_single_position(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 2.0, 4.0)], "x double, y double, Mass double")
    for n in (4, 5):
        codes = int(pd.cut(pd.Series([1.0, 1.0]), n, labels=range(n))[0])
        hit = grids.density_map(df, n, n).where("logMass is not null").collect()
        assert [(r.xbin, r.ybin) for r in hit] == [(codes, codes)]


def test_phase_diagram_counts_and_rejects(spark, cloud):
    df = spark.createDataFrame(cloud)
    got = grids.phase_diagram(df, 16, 8).toPandas()
    assert len(got) == 128
    ix = np.trunc((cloud.LogRho + 1.5) / 8.5 * 16)
    iy = np.trunc((cloud.logT - 3) / 5 * 8)
    ok = (ix > 0) & (ix < 16) & (iy > 0) & (iy < 8)
    assert got["count"].sum() == ok.sum() and 0 < ok.sum() < len(cloud)
    assert got.Mass.sum() == cloud.Mass[ok].sum()
    assert (got[(got.ix == 0) | (got.iy == 0)]["count"] == 0).all()


@pytest.mark.parametrize("bins", [7, [0.0, 0.5, 2.0, 4.0]])
@pytest.mark.parametrize("reverse", [False, True])
def test_cum_hist_matches_numpy(spark, cloud, bins, reverse):
    hist, edges = np.histogram(cloud.y, bins=bins, weights=cloud.Mass)
    want = np.concatenate([[0], np.cumsum(hist)])
    if reverse:
        want = want[-1] - want
    got = grids.cum_hist(spark.createDataFrame(cloud), "y", bins, "Mass", reverse).orderBy("i").toPandas()
    assert np.allclose(got.cum, want) and np.allclose(got.edge, edges)


def test_cum_hist_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    hist, edges = np.histogram([3.0, 3.0], bins=4)
    got = grids.cum_hist(df, "v", 4).orderBy("i").toPandas()
    assert np.allclose(got.edge, edges) and np.allclose(got.cum, np.concatenate([[0], np.cumsum(hist)]))


def test_matrix_and_range(spark):
    long = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 4.0)], "r int, c int, v double")
    assert [tuple(r) for r in grids.to_matrix(long, "r", "c", "v", 2).orderBy("r").collect()] == [(0, 1.0, None), (1, 3.0, 4.0)]
    assert tuple(grids.value_range(long, "v").collect()[0]) == (0.0, 4.0)


def test_ion_fractions_interpolate_and_extrapolate(spark):
    # a plane in the logs is reproduced exactly, also beyond the edge cells
    table = spark.createDataFrame(
        [("HI", i, j, 0.3 * i - 0.2 * j) for i in range(4) for j in range(3)], "ion string, ih int, it int, log_frac double"
    )
    pts = [(0.3, 0.9), (2.9, 1.5), (-1.0, 0.0), (9.0, 7.0)]
    df = spark.createDataFrame(pts, "lognH double, logT double")
    got = joins.with_ion_fractions(df, table, ["HI"], shape=(4, 3), origin=(0.0, 0.0), step=(1.0, 1.0)).toPandas()
    assert np.allclose(np.log10(got.fHI), 0.3 * got.lognH - 0.2 * got.logT)


def test_blend_of_ion_tables(spark):
    low = spark.createDataFrame([("HI", 0, 0, -1.0)], "ion string, ih int, it int, log_frac double")
    high = spark.createDataFrame([("HI", 0, 0, -3.0)], "ion string, ih int, it int, log_frac double")
    assert np.isclose(joins.blend_ion_tables(low, high, 0.25, 0.2, 0.4).collect()[0].log_frac, -1.5)


def test_tag_sums_have_total_rows(spark):
    df = spark.createDataFrame([(0, "SELF", 1.0), (0, "IGM", 2.0), (1, "SELF", 4.0)], "snapnum int, tag string, m double")
    got = {(r.snapnum, r.tag): r.m for r in aggregates.mass_by_tag(df, "tag", "m", total=True).collect()}
    assert got == {(0, "SELF"): 1.0, (0, "IGM"): 2.0, (0, "TOT"): 3.0, (1, "SELF"): 4.0, (1, "TOT"): 4.0}


def test_main_progenitor_tie_goes_to_the_larger_id(spark):
    dark = [(p, 1, 9) for p in range(4)] + [(0, 0, 5), (1, 0, 5), (2, 0, 6), (3, 0, 6), (4, 0, 7)]
    got = aggregates.main_progenitor(spark.createDataFrame(dark, "PId long, snapnum int, haloId int"), 1).collect()
    assert [tuple(r) for r in got] == [(9, 0, 6)]


def test_halo_components_leave_the_threshold_out(spark):
    gas = spark.createDataFrame(
        [(0, 1, 1.0, 0.0, 5.0), (0, 1, 2.0, 0.0, 5.5), (0, 1, 4.0, 0.0, 6.0), (0, 1, 8.0, 0.5, 6.0), (0, 0, 16.0, 0.0, 5.0)],
        "snapnum int, haloId int, Mass double, Sfr double, logT double",
    )
    stars = spark.createDataFrame([(0, 2, 32.0)], "snapnum int, haloId int, Mass double")
    halos = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "snapnum int, haloId int")
    got = {r.haloId: (r.Mcold, r.Mhot, r.Mism, r.Mstar) for r in aggregates.halo_components(gas, stars, halos).collect()}
    assert got == {1: (1.0, 4.0, 8.0, 0.0), 2: (0.0, 0.0, 0.0, 32.0), 3: (0.0, 0.0, 0.0, 0.0)}


def test_radial_profile_periodic(spark):
    p = spark.createDataFrame(
        [(1, 1.0, 0.0, 0.0, 2.0, 4.0), (1, 99.0, 0.0, 0.0, 2.0, 6.0), (1, 50.0, 0.0, 0.0, 5.0, 4.0)],
        "haloId int, x double, y double, z double, Mass double, logT double",
    )
    h = spark.createDataFrame([(1, 4.0, 0.0, 0.0, 0.0)], "haloId int, Rvir double, x double, y double, z double")
    got = aggregates.radial_profile(p, h, nbins=2, rmax=1.0, boxsize=100.0).collect()
    assert len(got) == 1 and got[0].bin == 0 and got[0].Mass == 4.0 and got[0].logT == 5.0
    assert np.isclose(got[0].rho, 4.0 / (4 / 3 * np.pi * 8))
    assert got[0].n == 2 and np.isclose(got[0].r, 0.25)
    assert aggregates.radial_profile(p, h, nbins=2).agg(F.sum("n")).collect()[0][0] == 1
