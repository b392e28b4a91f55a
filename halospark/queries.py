"""The registered queries: every operator on the whole test tables, next to equivalent DuckDB SQL.

Rounding happens here only, to compare floating point results of two engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import LAST_SNAP, N_SNAPS, SQL, STAR_ID_SHIFT, TARGET, Fixtures, with_views
from .functions import constants as C
from .functions import cosmology, physics, units
from .operators import aggregates, grids, joins, ordered, select
from .operators.lineage import new_path
from .plans import galaxies, history, progenitors, sightlines, splits, winds
from .sources import catalogues, cells, lake, schemas, store, text

Query = Callable[[Fixtures], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_CTES: dict[str, str] = dict(SQL)


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _ORACLES[fn.__name__] = sql
        return fn

    return add


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def duckdb_queries() -> dict[str, str]:
    return {name: with_views(sql, _CTES) for name, sql in _ORACLES.items()}


def no_null(df: DataFrame, *cols: str) -> DataFrame:
    """-1 for NULL in whole-number columns, which the engines hand to pandas in different forms."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(-1)) for c in cols})


def time_text(df: DataFrame, col: str = "atime") -> DataFrame:
    return df.withColumn(col, F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# == scans, joins by position, counts ======================================================================
_CTES["q_typed"] = """SELECT snapnum, 0 AS ptype, PId, Mass FROM fx_particles
    UNION ALL SELECT snapnum, 4 AS ptype, PId, Mass FROM fx_stars"""


def _typed(fx: Fixtures) -> DataFrame:
    cols = ("snapnum", "PId", "Mass")
    gas = fx.particles.select(*cols, F.lit(0).alias("ptype"))
    return gas.unionByName(fx.stars.select(*cols, F.lit(4).alias("ptype")))


@query("""SELECT snapnum, count(*) FILTER (ptype = 0) AS n_gas, count(*) FILTER (ptype = 1) AS n_dark,
    count(*) FILTER (ptype = 4) AS n_star, count(*) FILTER (ptype = 5) AS n_bh, count(*) AS n_tot
    FROM q_typed GROUP BY snapnum""")
def particle_counts(fx):
    return aggregates.particle_counts(_typed(fx))


@query("SELECT snapnum, count(*) AS n FROM fx_snap_galaxies GROUP BY snapnum")
def galaxy_counts(fx):
    return aggregates.catalogue_counts(fx.snap_galaxies)


_CTES["q_listed"] = """SELECT 0 AS snapnum, 4 AS ptype, p_partkey AS idx FROM part UNION ALL
    SELECT 0, 0, o_orderkey FROM orders"""


@query("""WITH g AS (SELECT l_orderkey AS pos, max(l_linenumber) AS haloId FROM lineitem GROUP BY l_orderkey),
    n AS (SELECT count(*) AS n FROM orders)
    SELECT q.ptype, q.idx, coalesce(g.haloId, 0) AS haloId FROM q_listed q CROSS JOIN n
    LEFT JOIN g ON g.pos = q.idx + CASE WHEN q.ptype = 4 THEN n.n ELSE 0 END""".replace("WITH g AS", "SELECT * FROM (WITH g AS") + ")")
def positional_join(fx):
    """J01: group rows by file position; orders play gas, parts play stars, the order key is the position."""
    gas = fx.table("orders").select(F.lit(0).alias("snapnum"), F.lit(0).alias("ptype"), F.col("o_orderkey").alias("idx"))
    stars = fx.table("part").select(F.lit(0).alias("snapnum"), F.lit(4).alias("ptype"), F.col("p_partkey").alias("idx"))
    groups = fx.table("lineitem").groupBy(F.col("l_orderkey").alias("idx")).agg(F.max("l_linenumber").alias("haloId"))
    header = fx.table("orders").agg(F.count("*").alias("n_gas")).select(
        F.lit(0).alias("snapnum"), "n_gas", F.lit(0).alias("n_dark")
    )
    placed = joins.attach_group_ids(gas.unionByName(stars), groups.withColumn("snapnum", F.lit(0)), header)
    return placed.select("ptype", "idx", "haloId")


# == columns ===============================================================================================
@query("""SELECT PId, x, y, z, round(CAST(log10(u * 1e10 * ((1 + 4 * O) / (1 + C + O)) * (1.6733e-24 / (1.5e0 * 1.380658e-16))) AS FLOAT), 4) AS logT
    FROM (SELECT *, Mass * 100.0e0 AS u FROM fx_points)""")
def gas_temperature(fx):
    df = physics.with_logT(fx.points.withColumn("u", F.col("Mass") * 100.0), "u", "C", "O", "logT")
    return df.select("PId", "x", "y", "z", F.round(F.col("logT"), 4).alias("logT"))


@query("""SELECT PId, x, y, z,
    round(CAST(log10(Mass * 1e-9 * (1.989e43 / 3.085678e21 ** 3 * 0.7 * 0.7) / (1.8791e-29 * 0.7 * 0.7 * 0.045)) AS FLOAT), 4) AS LogRho,
    round(CAST(log10(Mass * 100.0e0 * 1e10 * (2.0e0 / 3.0e0 * 1.6726e-24 / 1.3806e-16)
        * ((1 + 4 * (0.24e0 / 3.04e0)) / (1 + C + 0.24e0 / 3.04e0))) AS FLOAT), 4) AS LogT
    FROM fx_points""")
def phase_columns(fx):
    df = fx.points.withColumns({"Rho": F.col("Mass") * 1e-9, "U": F.col("Mass") * 100.0})
    return rounded(physics.with_phase(df, 0.7, ne="C").select("PId", "x", "y", "z", "LogRho", "LogT"), "LogRho", "LogT", digits=4)


@query("""SELECT galId, round(CASE WHEN Mgal > 0 THEN log10(Mgal * (2.0e40 / 1.989e33)) END, 6) AS logMgal,
    round(CASE WHEN Mgas > 0 THEN log10(Mgas * (2.0e40 / 1.989e33)) END, 6) AS logMgas,
    round(CASE WHEN Mstar > 0 THEN log10(Mstar * (2.0e40 / 1.989e33)) END, 6) AS logMstar FROM fx_galaxies""")
def galaxy_log_masses(fx):
    df = physics.with_log_galaxy_mass(fx.galaxies.select("galId", "Mgal", "Mgas", "Mstar"), 2.0e40)
    return rounded(df, "logMgal", "logMgas", "logMstar")


@query("""SELECT snapnum, haloId, round(log10(Mvir / 0.7e0), 6) AS logMvir, round(log10(Msub / 0.7e0), 6) AS logMsub FROM fx_halos""")
def halo_log_masses(fx):
    df = physics.with_log_halo_mass(fx.halos.select("snapnum", "haloId", "Mvir", "Msub"))
    return rounded(df, "logMvir", "logMsub")


@query("""SELECT galId, round((x + 0.5) * 25000, 6) AS x, round((y + 0.5) * 25000, 6) AS y, round((z + 0.5) * 25000, 6) AS z FROM fx_galaxies""")
def box_coordinates(fx):
    return rounded(physics.to_box(fx.galaxies.select("galId", "x", "y", "z"), 25000.0), "x", "y", "z")


@query("""SELECT snapnum, haloId, round(log10(Mvir * (1.989e43 / 0.7 / 1.989e33)), 6) AS log_mass,
    round(x * (3.085678e21 / 0.7 / 3.085678e21) * a, 4) AS x, round(y * (1.0e5 / 1.0e5) * sqrt(a), 4) AS y
    FROM fx_halos JOIN fx_timegrid USING (snapnum)""")
def unit_columns(fx):
    df = fx.halos.select("snapnum", "haloId", "Mvir", "x", "y").join(fx.timegrid.select("snapnum", "a"), "snapnum")
    kinds = {"Mvir": "mass", "x": "length", "y": "velocity"}
    out = units.to_units(df, kinds, units.code_units(0.7), units.display_units(), "a")
    return rounded(out.select("snapnum", "haloId", F.log10("Mvir").alias("log_mass"), F.col("x"), F.col("y")), "log_mass").transform(
        lambda d: rounded(d, "x", "y", digits=4)
    )


_CTES["q_virial"] = """SELECT snapnum, haloId, zred, Mvir * 1e7 * 1.989e33 AS m, sqrt(0.3 * (1 + zred) ** 3 + (1.0e0 - 0.3 - 0.7) * (1 + zred) ** 2 + 0.7) AS E,
    3.0e0 * (100.0e5 / 3.08567758e24) ** 2 / (8.0e0 * pi() * 6.67259e-8) AS rhobar
    FROM fx_halos JOIN fx_timegrid USING (snapnum)"""
_CTES["q_virial2"] = """SELECT *, 0.3 * (1 + zred) ** 3 / E ** 2 - 1 AS xx, E * 1.0e7 / 3.08567758e24 * 0.7 AS H FROM q_virial"""
_CTES["q_virial3"] = """SELECT *, (m / (4.18779 * (18.0 * pi() * pi() + 82.0 * xx - 39.0 * xx * xx) * rhobar * E * E)) ** (1.0e0 / 3) AS rv,
    (10.0 * m * 6.67259e-8 * H) ** (1.0e0 / 3) AS v FROM q_virial2"""


@query("""SELECT snapnum, haloId, round(E, 6) AS E, round(log10(H), 6) AS log_h,
    round(log10(rhobar * E * E), 6) AS log_rho_crit, round(18.0 * pi() * pi() + 82.0 * xx - 39.0 * xx * xx, 4) AS overdensity_vir,
    round(v / 1e5, 4) AS Vc, round(v / (10 * H) / 3.08567758e21, 4) AS r200, round(rv / 3.08567758e21, 4) AS rvir,
    round(sqrt(6.67259e-8 * m / rv) / 1e5, 4) AS vvir,
    round(log10(6.67259e-8 * m / rv * 0.60 * 1.6733e-24 / (2.0 * 1.380658e-16)), 6) AS log_tvir,
    round(log10(v * v / (4.0 * pi() * 6.67259e-8) / (0.1 * rv) ** 2 / (0.60 * 1.6733e-24)), 6) AS log_n_sis
    FROM q_virial3""")
def virial_columns(fx):
    df = fx.halos.select("snapnum", "haloId", (F.col("Mvir") * 1e7).alias("m")).join(fx.timegrid.select("snapnum", "zred"), "snapnum")
    v = cosmology.with_virial(df, "m", "zred").select(
        "snapnum",
        "haloId",
        "E",
        F.log10("H").alias("log_h"),
        F.log10("rho_crit").alias("log_rho_crit"),
        "overdensity_vir",
        "Vc",
        "r200",
        "rvir",
        "vvir",
        F.log10("Tvir").alias("log_tvir"),
        F.log10("n_sis").alias("log_n_sis"),
    )
    v = rounded(v, "E", "log_h", "log_rho_crit", "log_tvir", "log_n_sis")
    return rounded(v, "overdensity_vir", "Vc", "r200", "rvir", "vvir", digits=4)


_CTES["q_nodes"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({x!r}::DOUBLE, {w!r}::DOUBLE)"
    for x, w in zip(*(a.tolist() for a in cosmology.leggauss(cosmology.ANGULAR_NODES)), strict=True)
) + ") q(x, w)"


@query("""SELECT snapnum, haloId, zred, round(any_value(zred) / 2 * sum(w / sqrt(0.3 * (1 + zred * (0.5 + 0.5 * q_nodes.x)) ** 3 + 0.7))
    * 2.99792458e10 / (1.0e7 / 3.08567758e24 * 0.7) / (1 + zred) / 3.08567758e24, 4) AS d_mpc,
    round(18.0 * pi() * pi() * (1 + 0.4093 * (0.7 / (0.3 * (1 + zred) ** 3)) ** 0.9052), 4) AS vir_over_mean
    FROM fx_halos JOIN fx_timegrid USING (snapnum) CROSS JOIN q_nodes GROUP BY snapnum, haloId, zred""")
def angular_distance(fx):
    df = fx.halos.select("snapnum", "haloId").join(fx.timegrid.select("snapnum", "zred"), "snapnum")
    z = F.col("zred")
    return df.select(
        "snapnum",
        "haloId",
        "zred",
        F.round(cosmology.angular_distance(z) / C.MPC, 4).alias("d_mpc"),
        F.round(cosmology.virial_over_mean(z), 4).alias("vir_over_mean"),
    )


@query("""SELECT PId, x, y, z, CASE WHEN Mc > 0 THEN 'wind' WHEN Sfr > 0 THEN 'sfr' ELSE 'gas' END AS kind,
    round(CASE WHEN Mc > 0 THEN Mc WHEN Sfr > 0 THEN NULL ELSE greatest(0, least(1, (logT - 4.0e0) / 2.5e0)) END, 6) AS shade,
    round(CASE WHEN Mc > 0 THEN 20.0 * Mc * Mc ELSE 5.0 END, 6) AS size FROM fx_points""")
def markers(fx):
    return rounded(physics.with_marker(fx.points).select("PId", "x", "y", "z", "kind", "shade", "size"), "shade", "size")


@query("""SELECT PId, x, y, z, round(logT * sqrt(Mass * (1.0e10 / 0.7 / 1.0e5) / Mc), 4) AS Rc FROM fx_points WHERE Mc > 0""")
def cloud_radius(fx):
    df = physics.with_cloud_radius(fx.points.where("Mc > 0").withColumn("Rc", F.col("logT")))
    return rounded(df.select("PId", "x", "y", "z", "Rc"), "Rc", digits=4)


@query("""SELECT region, count(*) AS n, sum(Mass) AS Mass, round(min(nh), 5) AS min_nh FROM (
    SELECT Mass, log10(10.0e0 ** logRho * (1.879e-29 * 0.7 * 0.7 * 0.044 * 0.76 / 1.6733e-24)) AS nh,
        CASE WHEN logT >= 5 AND logRho < edge THEN 'WHIM' WHEN logT >= 5 THEN 'Hot' WHEN logRho < edge THEN 'Diffuse' ELSE 'Condensed' END AS region
    FROM (SELECT p.*, log10(6.0 * pi() * pi() * (1 + 0.4093 * (1 / f - 1) ** 0.9052)) AS edge
        FROM fx_points p JOIN (SELECT snapnum, 0.3 * (1 + zred) ** 3 / (0.3 * (1 + zred) ** 3 + 0.7) AS f FROM fx_timegrid) USING (snapnum)))
    GROUP BY region""")
def phase_regions(fx):
    df = fx.points.join(fx.timegrid.select("snapnum", "zred"), "snapnum")
    region = physics.phase_region(F.col("logRho"), F.col("logT"), F.col("zred"))
    return (
        df.select(region.alias("region"), "Mass", physics.log_nh(F.col("logRho")).alias("nh"))
        .groupBy("region")
        .agg(F.count("*").alias("n"), F.sum("Mass").alias("Mass"), F.round(F.min("nh"), 5).alias("min_nh"))
    )


# == filters ===============================================================================================
@query(f"SELECT PId FROM fx_particles WHERE snapnum = {LAST_SNAP} AND galId = {TARGET}")
def gas_in_galaxy(fx):
    return select.gas_in_galaxy(fx.particles, LAST_SNAP, TARGET)


@query(f"SELECT PId FROM fx_stars WHERE snapnum = {LAST_SNAP} AND galId = {TARGET}")
def stars_in_galaxy(fx):
    return select.stars_in_galaxy(fx.stars, LAST_SNAP, TARGET)


@query(f"SELECT PId FROM fx_particles WHERE snapnum = {LAST_SNAP} AND haloId = {TARGET} AND Sfr = 0")
def gas_in_halo(fx):
    return select.gas_in_halo(fx.particles, LAST_SNAP, TARGET)


@query("SELECT snapnum, haloId, round(logMsub, 6) AS logMsub FROM fx_log_halos WHERE logMsub BETWEEN 2.8 AND 3.4")
def halo_mass_select(fx):
    return rounded(select.halos_by_mass(fx.log_halos, 2.8, 3.4).select("snapnum", "haloId", "logMsub"), "logMsub")


@query("SELECT galId, Npart, Mgal, Mstar FROM fx_galaxies WHERE logMgal BETWEEN 10.2 AND 10.5")
def galaxy_mass_select(fx):
    return select.galaxies_by_mass(fx.galaxies, 10.2, 10.5).select("galId", "Npart", "Mgal", "Mstar")


@query("""SELECT galId, Npart, Mgal, Mstar FROM fx_galaxies
    WHERE Mgal >= (SELECT quantile_cont(Mgal, 0.9) FROM fx_galaxies) AND Mgal <= (SELECT quantile_cont(Mgal, 0.985) FROM fx_galaxies)""")
def percentile_select(fx):
    return select.galaxies_by_percentile(fx.galaxies, 0.9, 0.985, "Mgal").select("galId", "Npart", "Mgal", "Mstar")


@query("""SELECT p.haloId, p.snapnum, p.PId FROM fx_particles p JOIN (SELECT snapnum, haloId FROM fx_halos WHERE Npart >= 20) h
    USING (snapnum, haloId) WHERE Mc > 0 AND haloId > 0""")
def wind_in_halos(fx):
    return select.wind_in_halos(fx.particles, fx.halos.where("Npart >= 20"))


@query("SELECT PId, x, y, z, Mass FROM fx_points WHERE x > 4000 AND x < 9000 AND y > 2000 AND y < 12000 AND z > 3000 AND z < 15000")
def window_select(fx):
    return select.in_window(fx.points, (4000, 9000), (2000, 12000), (3000, 15000)).select("PId", "x", "y", "z", "Mass")


@query("SELECT PId, x, y, z FROM fx_points WHERE Mc > 0 AND z > 1000 AND z < 15000 AND y > 100 AND y < 9000")
def wind_layer(fx):
    return select.wind_layer(fx.points, (0, 5), (100, 9000), (1000, 15000)).select("PId", "x", "y", "z")


@query("SELECT snapnum, haloId, Rvir, x, y, z FROM fx_halos WHERE z > 5000 AND z < 15000 AND Rvir > 2150")
def halo_layer(fx):
    return select.halo_layer(fx.halos, (5000, 15000), 2150.0).select("snapnum", "haloId", "Rvir", "x", "y", "z")


@query(f"""SELECT p.PId, p.x, p.y, p.z, p.Mass FROM fx_points p, (SELECT * FROM fx_halos WHERE snapnum = {LAST_SNAP} AND haloId = {TARGET}) h
    WHERE p.snapnum = {LAST_SNAP} AND p.x > h.x - 2.5 * h.Rvir AND p.x < h.x + 2.5 * h.Rvir AND p.y > h.y - 2.5 * h.Rvir
    AND p.y < h.y + 2.5 * h.Rvir AND p.z > h.z - 2.5 * h.Rvir AND p.z < h.z + 2.5 * h.Rvir""")
def box_select(fx):
    return select.particles_in_box(fx.points, fx.halos, LAST_SNAP, TARGET, 2.5).select("PId", "x", "y", "z", "Mass")


@query(f"SELECT haloId, Rvir, round(logMvir, 6) AS logMvir, x, y, z FROM fx_log_halos WHERE snapnum = {LAST_SNAP} AND haloId = {TARGET}")
def halo_info(fx):
    return rounded(select.halo_info(fx.log_halos, LAST_SNAP, TARGET).drop("snapnum"), "logMvir")


@query(f"SELECT snapnum, PId, x, y, z, Mass FROM fx_points WHERE snapnum = {LAST_SNAP} AND haloId = {TARGET}")
def halo_particles(fx):
    return select.particles_of_halo(fx.points, LAST_SNAP, TARGET, ["snapnum", "PId", "x", "y", "z", "Mass"])


@query("""SELECT snapnum, haloId, x - 2 * Rvir AS xlo, x + 2 * Rvir AS xhi, y - 2 * Rvir AS ylo, y + 2 * Rvir AS yhi,
    z - 2 * Rvir AS zlo, z + 2 * Rvir AS zhi FROM fx_halos""")
def halo_boxes(fx):
    edges = [f"{c}{s}" for c in "xyz" for s in ("lo", "hi")]
    return physics.halo_box(fx.halos, 2.0).select("snapnum", "haloId", *edges)


_BIN = """CASE WHEN logMsub > 10.75 AND logMsub < 11.25 AND logMstar > 8.3 AND logMstar < 9.3 THEN 11
    WHEN logMsub > 11.75 AND logMsub < 12.25 AND logMstar > 9.7 AND logMstar < 10.75 THEN 12
    WHEN logMsub > 12.75 AND logMsub < 13.25 THEN 13 END"""


@query(f"SELECT galId, coalesce({_BIN}, -1) AS mbin FROM fx_galaxies")
def mass_bins(fx):
    return no_null(select.with_mass_bin(fx.galaxies).select("galId", "mbin"), "mbin")


@query("SELECT PhEWKey, PId, Mass, atime FROM fx_launch WHERE atime >= 0.25 AND atime < 0.5")
def launch_window(fx):
    return select.launched_between(fx.launch, 0.25, 0.5)


@query("SELECT snapnum, PId, round(logT, 6) AS Tmax FROM fx_particles WHERE logT > 5.5")
def hot_history(fx):
    hot = select.hot_history(fx.particles.withColumnRenamed("logT", "Tmax"))
    return rounded(hot.select("snapnum", "PId", "Tmax"), "Tmax")


@query("SELECT snapnum, haloId, Mvir FROM fx_halos ORDER BY Mvir DESC, snapnum, haloId LIMIT 5")
def top_halos(fx):
    return select.top_halos(fx.halos, 5).select("snapnum", "haloId", "Mvir")


@query("SELECT arg_min(snapnum, abs(zred - 0.9)) AS snapnum FROM fx_timegrid")
def find_snapnum(fx):
    return select.find_snapnum(fx.timegrid, 0.9)


@query("""SELECT z, arg_min(snapnum, abs(zred - z)) AS snapnum FROM fx_timegrid, (VALUES (0.1e0), (0.9e0), (2.2e0)) q(z) GROUP BY z""")
def find_snapnums(fx):
    return select.find_snapnums(fx.timegrid, [0.1, 0.9, 2.2])


@query("""SELECT coalesce(h.snapnum, g.snapnum) AS snapnum, coalesce(h.haloId, g.haloId) AS haloId, round(log10(h.Mvir / 0.7e0), 6) AS logMvir, g.x
    FROM (SELECT * FROM fx_halos WHERE Npart >= 20) h FULL JOIN (SELECT * FROM fx_halos WHERE x > 4000) g ON g.snapnum = h.snapnum AND g.haloId = h.haloId""")
def halo_positions(fx):
    stat = fx.halos.where("x > 4000").withColumnRenamed("haloId", "galId")
    found = catalogues.halos(fx.halos.where("Npart >= 20").drop("x", "y", "z"), stat, ["Mvir", "x"])
    return rounded(found, "logMvir")


# == ordered ===============================================================================================
@query("SELECT snapnum, PId, Mass, coalesce(Mass - lag(Mass) OVER (PARTITION BY PId ORDER BY snapnum), 0) AS Mgain FROM fx_particles")
def mgain_diff(fx):
    return ordered.with_diff(fx.particles, "PId", "snapnum", "Mass", "Mgain").select("snapnum", "PId", "Mass", "Mgain")


@query("""SELECT PhEWKey, strftime(atime, '%Y-%m-%d %H:%M:%S.%f') AS atime, Mass, round(coalesce(Mass - lag(Mass) OVER (PARTITION BY PhEWKey ORDER BY atime, Mass), 0), 4) AS dMass FROM fx_tracks""")
def track_diff(fx):
    """W03 on event records, cut into days so that a hot key spreads."""
    out = ordered.with_diff(
        fx.tracks, "PhEWKey", ["atime", "Mass"], "Mass", "dMass", block=F.to_date("atime")
    )
    return rounded(time_text(out.select("PhEWKey", "atime", "Mass", "dMass")), "dMass", digits=4)


@query("SELECT snapnum, PId, Mass, sum(Mass) OVER (PARTITION BY PId ORDER BY snapnum) AS Mcum FROM fx_particles")
def mass_cumsum(fx):
    return ordered.with_cumsum(fx.particles, ["PId"], "snapnum", "Mass", "Mcum").select("snapnum", "PId", "Mass", "Mcum")


@query("SELECT PId, atime, Mass FROM (SELECT *, row_number() OVER (ORDER BY PId) AS rn FROM fx_split) WHERE rn % 7 = 0")
def every_nth(fx):
    return ordered.every_nth(fx.split.select("PId", "atime", "Mass"), [F.col("PId")], 7)


@query("""SELECT galId, Mgal FROM (SELECT *, row_number() OVER (ORDER BY galId) AS rn, greatest(1, count(*) OVER () // 40) AS s FROM fx_galaxies)
    WHERE (rn - 1) % s = 0 AND rn - 1 < 40 * s""")
def stride_sample(fx):
    return ordered.stride_sample(fx.galaxies.select("galId", "Mgal"), 40, [F.col("galId")])


# == joins =================================================================================================
@query("""SELECT PhEWKey, CAST((SELECT count(*) FROM fx_timegrid g WHERE g.a <= l.atime) AS INT) AS snapnext,
    CAST((SELECT count(*) FROM fx_timegrid g WHERE g.a <= l.atime) - 1 AS INT) AS snapfirst FROM fx_launch l""")
def snap_asof(fx):
    return joins.with_snaps(fx.launch, "atime", fx.timegrid, after="snapnext", before="snapfirst").select("PhEWKey", "snapnext", "snapfirst")


@query("""SELECT l.PhEWKey, strftime(l.atime, '%Y-%m-%d %H:%M:%S.%f') AS atime, l.Mass, r.Mass AS before_mass FROM (SELECT * FROM fx_tracks WHERE tag = 'purchase') l
    ASOF LEFT JOIN (SELECT PhEWKey, atime, Mass FROM fx_tracks WHERE tag = 'click') r ON l.PhEWKey = r.PhEWKey AND l.atime >= r.atime""")
def asof_events(fx):
    left = fx.tracks.where("tag = 'purchase'").select("PhEWKey", "atime", "Mass")
    right = fx.tracks.where("tag = 'click'").select("PhEWKey", "atime", F.col("Mass").alias("before_mass"))
    return time_text(joins.asof_join(left, right, "atime", ["PhEWKey"], ["before_mass"], block=F.to_date("atime")))


@query("""SELECT l.PhEWKey, strftime(l.atime, '%Y-%m-%d %H:%M:%S.%f') AS atime, l.Mass, r.Mass AS after_mass FROM (SELECT * FROM fx_tracks WHERE tag = 'purchase') l
    ASOF LEFT JOIN (SELECT PhEWKey, atime, Mass FROM fx_tracks WHERE tag = 'click') r ON l.PhEWKey = r.PhEWKey AND l.atime < r.atime""")
def asof_events_forward(fx):
    left = fx.tracks.where("tag = 'purchase'").select("PhEWKey", "atime", "Mass")
    right = fx.tracks.where("tag = 'click'").select("PhEWKey", "atime", F.col("Mass").alias("after_mass"))
    out = joins.asof_join(
        left, right, "atime", ["PhEWKey"], ["after_mass"], direction="forward", allow_exact=False, block=F.to_date("atime")
    )
    return time_text(out)


@query("""SELECT PhEWKey, round(y0 + (atime - x0) * (y1 - y0) / (x1 - x0), 6) AS t FROM (
    SELECT l.PhEWKey, l.atime, max(k.a) FILTER (k.a <= l.atime) AS x0, max(k.t) FILTER (k.a <= l.atime) AS y0,
        min(k.a) FILTER (k.a > l.atime) AS x1, min(k.t) FILTER (k.a > l.atime) AS y1
    FROM fx_launch l CROSS JOIN fx_tcosmic k GROUP BY l.PhEWKey, l.atime)""")
def cosmic_time(fx):
    return rounded(joins.interpolate(fx.launch, "atime", fx.tcosmic, "a", "t", "t").select("PhEWKey", "t"), "t")


@query("""SELECT galId, coalesce(p.snapnum, -1) AS snapnum FROM (SELECT galId, (z + 0.5) * 4 AS zz FROM fx_galaxies) g
    LEFT JOIN (SELECT snapnum, zred - 0.125 AS zlo, zred + 0.125 AS zhi FROM fx_timegrid) p ON zz >= zlo AND zz < zhi""")
def redshift_intervals(fx):
    plan = fx.timegrid.select("snapnum", (F.col("zred") - 0.125).alias("zlo"), (F.col("zred") + 0.125).alias("zhi"))
    df = fx.galaxies.select("galId", ((F.col("z") + 0.5) * 4).alias("zz"))
    return no_null(joins.snapshot_for_redshift(df, "zz", plan).select("galId", "snapnum"), "snapnum")


def _ions(fx: Fixtures) -> DataFrame:
    return joins.with_ion_fractions(
        fx.points.withColumn("LogT", F.col("logT")),
        fx.iontab,
        ["HI", "CIV", "OVI", "NeVIII", "SiIV"],
        log_nh="logRho",
        logT="LogT",
        shape=(25, 25),
        origin=(-1.5, 3.0),
        step=(0.25, 0.2),
    )


_CTES["q_ioncell"] = """SELECT *, pt - ih AS t, pu - it AS u FROM (SELECT *, greatest(0, least(23, CAST(trunc(pt) AS INT))) AS ih,
    greatest(0, least(23, CAST(trunc(pu) AS INT))) AS it FROM (SELECT *, (logRho + 1.5) / 0.25 AS pt, (logT - 3.0) / 0.2 AS pu FROM fx_points))"""
_CTES["q_ionfrac"] = """SELECT c.*, a.ion, 10.0e0 ** ((1 - t) * (1 - u) * a.log_frac + t * (1 - u) * b.log_frac + t * u * d.log_frac + (1 - t) * u * e.log_frac) AS f
    FROM q_ioncell c JOIN fx_iontab a ON a.ih = c.ih AND a.it = c.it
    JOIN fx_iontab b ON b.ion = a.ion AND b.ih = c.ih + 1 AND b.it = c.it
    JOIN fx_iontab d ON d.ion = a.ion AND d.ih = c.ih + 1 AND d.it = c.it + 1
    JOIN fx_iontab e ON e.ion = a.ion AND e.ih = c.ih AND e.it = c.it + 1"""


@query("""SELECT haloId, round(log10(sum(Mass * 0.76 * f) FILTER (ion = 'HI')), 5) AS log_mhi,
    round(log10(sum(Mass * O * f) FILTER (ion = 'OVI')), 5) AS log_movi FROM q_ionfrac GROUP BY haloId""")
def ion_masses(fx):
    df = physics.with_ion_mass(_ions(fx)).groupBy("haloId").agg(
        F.sum("MHI").alias("h"), F.sum("MOVI").alias("o")
    )
    return df.select(
        "haloId", F.round(F.log10("h"), 5).alias("log_mhi"), F.round(physics.log10_or_null(F.col("o")), 5).alias("log_movi")
    )


@query("""SELECT ion, ih, it, round(0.75e0 * log_frac + 0.25e0 * (log_frac * 1.5e0 - 1), 9) AS log_frac FROM fx_iontab""")
def ion_table_at(fx):
    tables = [
        fx.iontab.withColumns({"zred": F.lit(z), "log_frac": F.col("log_frac") * slope - shift})
        for z, slope, shift in ((0.0, 1.0, 0.0), (2.0, 1.5, 1.0), (4.0, 2.0, 2.0))
    ]
    stacked = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return rounded(joins.ion_table_at(stacked, 0.5), "log_frac", digits=9)


@query("SELECT snapnum, PId, round(log10(10.0e0 ** logRho / 1.673e-24), 6) AS lognH FROM fx_points")
def log_nh_of_density(fx):
    nh = physics.log_nh_of_density(F.pow(F.lit(10.0), F.col("logRho")))
    return rounded(fx.points.select("snapnum", "PId", nh.alias("lognH")), "lognH")


_CELL = "trunc((logRho + 1.5) / 8.5 * 64) AS gx, trunc((logT - 3.0) / 5.0 * 64) AS gy"


@query(f"""SELECT CAST(gx AS INT) AS ix, CAST(gy AS INT) AS iy, round(sum(Mass * 0.76 * f) FILTER (ion = 'HI'), 5) AS MHI,
    round(sum(Mass * C * f) FILTER (ion = 'CIV'), 5) AS MCIV, round(sum(Mass * O * f) FILTER (ion = 'OVI'), 5) AS MOVI,
    round(sum(Mass * O / 8.65e-3 * 2.22e-3 * f) FILTER (ion = 'NeVIII'), 5) AS MNeVIII,
    round(sum(Mass * O / 8.65e-3 * 1.08e-3 * f) FILTER (ion = 'SiIV'), 5) AS MSiIV
    FROM (SELECT *, {_CELL} FROM q_ionfrac) WHERE gx > 0 AND gx < 64 AND gy > 0 AND gy < 64 GROUP BY 1, 2""")
def ion_phase(fx):
    ions = ("MHI", "MCIV", "MOVI", "MNeVIII", "MSiIV")
    grid = grids.phase_diagram(_ions(fx), 64, 64, "logRho", "LogT", ions=True)
    return rounded(grid.where("count > 0").select("ix", "iy", *ions), *ions, digits=5)


# == grids =================================================================================================
@query(f"""SELECT CAST(x.range AS INT) AS ix, CAST(y.range AS INT) AS iy, round(-1.5 + x.range * (8.5e0 / 64), 6) AS LogRho,
    round(3.0 + y.range * (5.0e0 / 64), 6) AS LogT, coalesce(c.n, 0) AS count, coalesce(c.m, 0) AS Mass, round(coalesce(c.zm, 0), 4) AS Zmet
    FROM range(64) x CROSS JOIN range(64) y LEFT JOIN (
        SELECT gx, gy, count(*) AS n, sum(Mass) AS m, sum(Mass * O / 8.65e-3 * 0.0122) AS zm FROM (SELECT *, {_CELL} FROM fx_points)
        WHERE gx > 0 AND gx < 64 AND gy > 0 AND gy < 64 GROUP BY gx, gy) c ON c.gx = x.range AND c.gy = y.range""")
def phase_diagram(fx):
    grid = grids.phase_diagram(fx.points.withColumn("LogT", F.col("logT")), 64, 64, "logRho", "LogT")
    return rounded(rounded(grid, "LogRho", "LogT"), "Zmet", digits=4)


_CTES["q_window"] = "SELECT * FROM fx_points WHERE z > 3000 AND z < 15000"
_CTES["q_cells"] = """SELECT p.*, CAST(greatest(ceil((x - xlo) / (xhi - xlo) * 32) - 1, 0) AS INT) AS xbin,
    CAST(greatest(ceil((y - ylo) / (yhi - ylo) * 32) - 1, 0) AS INT) AS ybin
    FROM q_window p, (SELECT min(x) AS xlo, max(x) AS xhi, min(y) AS ylo, max(y) AS yhi FROM q_window)"""
_CTES["q_map"] = """SELECT CAST(x.range AS INT) AS xbin, CAST(y.range AS INT) AS ybin, m, mt FROM range(32) x CROSS JOIN range(32) y
    LEFT JOIN (SELECT xbin, ybin, sum(Mass) AS m, sum(Mass * logT) AS mt FROM q_cells GROUP BY xbin, ybin) c ON c.xbin = x.range AND c.ybin = y.range"""


def _window(fx: Fixtures) -> DataFrame:
    return select.in_window(fx.points, zlim=(3000, 15000))


@query("SELECT xbin, ybin, round(log10(m), 6) AS logMass FROM q_map")
def density_map(fx):
    return rounded(grids.density_map(_window(fx), 32, 32), "logMass")


@query("SELECT xbin, ybin, round(coalesce(mt / m, 0), 9) AS logT FROM q_map")
def temperature_map(fx):
    return rounded(grids.temperature_map(_window(fx), 32, 32), "logT", digits=9)


@query("SELECT ybin, " + ", ".join(f"round(max(log10(m)) FILTER (xbin = {i}), 6) AS c{i}" for i in range(32)) + " FROM q_map GROUP BY ybin")
def map_matrix(fx):
    return grids.to_matrix(rounded(grids.density_map(_window(fx), 32, 32), "logMass"), "ybin", "xbin", "logMass", 32)


@query("SELECT round(min(coalesce(log10(m), 0)), 6) AS vmin, round(max(log10(m)), 6) AS vmax FROM q_map")
def map_range(fx):
    return rounded(grids.value_range(grids.density_map(_window(fx), 32, 32), "logMass"), "vmin", "vmax")


_CTES["q_hist"] = """SELECT least(CAST(floor((Mass - lo) / ((hi - lo) / 20)) AS INT), 19) AS bin, O FROM fx_points,
    (SELECT min(Mass) AS lo, max(Mass) AS hi FROM fx_points)"""
_CTES["q_edges"] = "SELECT CAST(range AS INT) AS i, lo + range * ((hi - lo) / 20) AS edge FROM range(21), (SELECT min(Mass) AS lo, max(Mass) AS hi FROM fx_points)"


@query("""SELECT i, round(edge, 6) AS edge, round(coalesce((SELECT sum(O) FROM q_hist h WHERE h.bin < e.i), 0), 4) AS cum FROM q_edges e""")
def cum_hist(fx):
    out = grids.cum_hist(fx.points, "Mass", 20, "O")
    return rounded(rounded(out, "edge"), "cum", digits=4)


@query("""SELECT i, round(edge, 6) AS edge, CAST((SELECT count(*) FROM q_hist h WHERE h.bin >= e.i) AS DOUBLE) AS cum FROM q_edges e""")
def cum_hist_reverse(fx):
    return rounded(grids.cum_hist(fx.points, "Mass", 20, reverse=True), "edge")


@query("""SELECT i, edge, CAST((SELECT count(*) FROM fx_points WHERE Mass >= 5 AND (Mass < edge OR (i = 3 AND Mass <= 50))) AS DOUBLE) AS cum
    FROM (VALUES (0, 5.0e0), (1, 10.0e0), (2, 20.0e0), (3, 50.0e0)) e(i, edge)""")
def cum_hist_edges(fx):
    return grids.cum_hist(fx.points, "Mass", [5.0, 10.0, 20.0, 50.0])


# == aggregates ============================================================================================
@query("""SELECT h.snapnum, h.haloId, round(h.logMsub, 6) AS logMsub, coalesce(g.Mcold, 0) AS Mcold, coalesce(g.Mhot, 0) AS Mhot,
    coalesce(g.Mism, 0) AS Mism, coalesce(s.Mstar, 0) AS Mstar FROM fx_log_halos h LEFT JOIN (
        SELECT snapnum, haloId, sum(CASE WHEN Sfr = 0 AND logT < 5.5 THEN Mass ELSE 0 END) AS Mcold,
            sum(CASE WHEN Sfr = 0 AND logT > 5.5 THEN Mass ELSE 0 END) AS Mhot, sum(CASE WHEN Sfr > 0 THEN Mass ELSE 0 END) AS Mism
        FROM fx_particles GROUP BY snapnum, haloId) g USING (snapnum, haloId)
    LEFT JOIN (SELECT snapnum, haloId, sum(Mass) AS Mstar FROM fx_stars GROUP BY snapnum, haloId) s USING (snapnum, haloId)""")
def halo_components(fx):
    halos = fx.log_halos.select("snapnum", "haloId", F.round("logMsub", 6).alias("logMsub"))
    return aggregates.halo_components(fx.particles, fx.stars, halos)


_CTES["q_snaplog"] = """SELECT snapnum, galId, Sfr, log10(Mgal) AS logMgal, CASE WHEN Mgas > 0 THEN log10(Mgas) END AS logMgas,
    CASE WHEN Mstar > 0 THEN log10(Mstar) END AS logMstar FROM fx_snap_galaxies"""


def _snaplog(fx: Fixtures) -> DataFrame:
    return physics.with_log_galaxy_mass(fx.snap_galaxies, C.SOLAR_MASS)


@query("""SELECT snapnum, galId, round(Zgal, 9) AS Zgal, round(logMgal, 6) AS logMgal, round(logMgas, 6) AS logMgas, round(logMstar, 6) AS logMstar, Sfr
    FROM q_snaplog JOIN (SELECT snapnum, galId, CASE WHEN sum(Sfr) <> 0 THEN sum(Sfr * Zmet) / sum(Sfr) END AS Zgal FROM fx_particles GROUP BY snapnum, galId) USING (snapnum, galId)""")
def galaxy_properties(fx):
    gas = fx.particles.withColumnRenamed("Zmet", "O")
    out = aggregates.galaxy_properties(gas, _snaplog(fx))
    return rounded(rounded(out, "Zgal", digits=9), "logMgal", "logMgas", "logMstar")


@query("""SELECT snapnum, galId, round(Zgal, 9) AS Zgal, round(logMgal, 6) AS logMgal, round(logMgas, 6) AS logMgas, round(logMstar, 6) AS logMstar, Sfr
    FROM q_snaplog JOIN (SELECT snapnum, galId, sum(Mass * Zmet) / sum(Mass) AS Zgal FROM fx_particles GROUP BY snapnum, galId) USING (snapnum, galId)""")
def galaxy_properties_by_mass(fx):
    gas = fx.particles.withColumnRenamed("Zmet", "Z")
    out = aggregates.galaxy_properties(gas, _snaplog(fx), oxygen=False, sfr_weighted=False)
    return rounded(rounded(out, "Zgal", digits=9), "logMgal", "logMgas", "logMstar")


@query("SELECT DISTINCT snapnum, haloId FROM fx_particles WHERE haloId <> 0")
def distinct_halos(fx):
    return aggregates.distinct_halos(fx.particles)


@query("""SELECT bin AS b, n, round(logM, 6) AS logM, round(log10(n) - log10(0.2 * (25000.0e0 / 1000 / 0.7) ** 3), 6) AS logPhi FROM (
    SELECT CAST(floor(logMstar / 0.2) AS BIGINT) AS bin, count(*) AS n, (floor(logMstar / 0.2) + 0.5) * 0.2 AS logM FROM fx_galaxies
    WHERE logMstar IS NOT NULL GROUP BY ALL)""")
def gsmf(fx):
    out = aggregates.gsmf(fx.galaxies, 25000.0)
    return rounded(out.withColumn("b", F.floor(F.col("logM") / 0.2)).select("b", "n", "logM", "logPhi"), "logM", "logPhi")


@query("""SELECT round((floor(logMsub / 0.2) + 0.5) * 0.2, 6) AS logMh, round(quantile_cont(logMstar - logMsub, 0.5), 6) AS median,
    round(quantile_cont(logMstar - logMsub, 0.16), 6) AS p16, round(quantile_cont(logMstar - logMsub, 0.84), 6) AS p84
    FROM fx_galaxies WHERE logMstar IS NOT NULL GROUP BY floor(logMsub / 0.2)""")
def smhm(fx):
    return rounded(aggregates.smhm(fx.galaxies), "logMh", "median", "p16", "p84")


@query("""SELECT snapnum, round((floor(logMsub / 0.2) + 0.5) * 0.2, 6) AS logMh, round(quantile_cont(logMstar - logMsub, 0.5), 6) AS median,
    round(quantile_cont(logMstar - logMsub, 0.16), 6) AS p16, round(quantile_cont(logMstar - logMsub, 0.84), 6) AS p84
    FROM q_snaplog g JOIN fx_log_halos h ON h.snapnum = g.snapnum AND h.haloId = g.galId
    JOIN fx_hosts o ON o.snapnum = g.snapnum AND o.haloId = g.galId AND o.hostId = o.haloId
    WHERE logMstar IS NOT NULL GROUP BY g.snapnum, floor(logMsub / 0.2)""".replace("SELECT snapnum, round", "SELECT g.snapnum, round"))
def smhm_centrals(fx):
    pairs = aggregates.central_pairs(_snaplog(fx).select("snapnum", "galId", "logMstar"), fx.log_halos, fx.hosts)
    return rounded(aggregates.smhm(pairs), "logMh", "median", "p16", "p84")


@query("""SELECT zred, snapnum, n, round((b + 0.5) * 0.2, 6) AS logM FROM (SELECT w.zred, g.snapnum, floor(g.logMstar / 0.2) AS b, count(*) AS n
    FROM (SELECT z.zred, arg_max(t.snapnum, (-abs(t.zred - z.zred), t.snapnum)) AS snapnum
        FROM (VALUES (0.0e0), (1.1e0), (3.0e0)) z(zred), fx_timegrid t GROUP BY z.zred) w
    JOIN q_snaplog g ON g.snapnum = w.snapnum WHERE g.logMstar IS NOT NULL GROUP BY ALL)""")
def gsmf_at_redshifts(fx):
    found = aggregates.for_redshifts(lambda g: aggregates.gsmf(g, 25000.0), _snaplog(fx), fx.timegrid, [0.0, 1.1, 3.0])
    return rounded(found.select("zred", "snapnum", "n", "logM"), "logM")


_CTES["q_props"] = """SELECT snapnum, galId, logMstar, Zgal FROM q_snaplog JOIN (
    SELECT snapnum, galId, CASE WHEN sum(Sfr) <> 0 THEN sum(Sfr * Zmet) / sum(Sfr) END AS Zgal FROM fx_particles GROUP BY snapnum, galId) USING (snapnum, galId)"""


@query("""SELECT snapnum, round(logMstar, 6) AS logMstar, round(Zgal, 9) AS Zgal, round(CASE WHEN Zgal > 0 THEN log10(Zgal / 8.65e-3) END, 5) AS OH FROM q_props""")
def mzr(fx):
    props = aggregates.galaxy_properties(fx.particles.withColumnRenamed("Zmet", "O"), _snaplog(fx))
    return rounded(rounded(rounded(aggregates.mzr(props), "logMstar"), "Zgal", digits=9), "OH", digits=5)


@query("""SELECT snapnum, round((floor(logMstar / 0.5) + 0.5) * 0.5, 6) AS logM, round(quantile_cont(log10(Zgal / 8.65e-3), 0.5), 5) AS median FROM q_props
    WHERE Zgal > 0 GROUP BY snapnum, floor(logMstar / 0.5)""")
def mzr_binned(fx):
    props = aggregates.galaxy_properties(fx.particles.withColumnRenamed("Zmet", "O"), _snaplog(fx))
    return rounded(rounded(aggregates.mzr(props, 0.5), "logM"), "median", digits=5)


@query("""SELECT snapnum, haloId, bin, n, Mass, round(Mass / (4.0 * pi() / 3.0 * (((bin + 1) * 0.5 * Rvir) ** 3 - (bin * 0.5 * Rvir) ** 3)) * 1e9, 5) AS rho, round(logT, 9) AS logT
    FROM (SELECT p.snapnum, p.haloId, h.Rvir, CAST(floor(sqrt(dx * dx + dy * dy + dz * dz) / h.Rvir * 2) AS BIGINT) AS bin, count(*) AS n, sum(p.Mass) AS Mass,
        sum(p.Mass * p.logT) / sum(p.Mass) AS logT
        FROM (SELECT p.snapnum, p.haloId, p.Mass, p.logT, least(abs(p.x - h.x), 22000 - abs(p.x - h.x)) AS dx,
            least(abs(p.y - h.y), 22000 - abs(p.y - h.y)) AS dy, least(abs(p.z - h.z), 22000 - abs(p.z - h.z)) AS dz
            FROM fx_points p JOIN fx_halos h USING (snapnum, haloId)) p JOIN fx_halos h USING (snapnum, haloId)
        WHERE sqrt(dx * dx + dy * dy + dz * dz) / h.Rvir < 5 GROUP BY ALL)""")
def radial_profile(fx):
    out = aggregates.radial_profile(fx.points, fx.halos, nbins=10, rmax=5.0, boxsize=22000.0)
    return out.select(
        "snapnum", "haloId", "bin", "n", "Mass", F.round(F.col("rho") * 1e9, 5).alias("rho"), F.round("logT", 9).alias("logT")
    )


@query("SELECT snapnum, haloId, round(sum(Mwind) / sum(Mass), 6) AS fwind FROM fx_particles WHERE haloId <> 0 GROUP BY snapnum, haloId")
def wind_fraction(fx):
    return rounded(aggregates.wind_fraction(fx.particles), "fwind")


@query("SELECT snapnum, haloId, round(sum(Mass * Zmet) / sum(Mass), 9) AS Zhalo FROM fx_particles WHERE haloId <> 0 GROUP BY snapnum, haloId")
def halo_metallicity(fx):
    return rounded(aggregates.halo_metallicity(fx.particles, "Zmet"), "Zhalo", digits=9)


# == splits and history ====================================================================================
_CTES["q_split"] = """SELECT PId, parentId, Mass, atime, CAST((SELECT count(*) FROM fx_timegrid g WHERE g.a <= s.atime) AS INT) AS snapnext,
    CAST(trunc(rank() OVER (PARTITION BY parentId ORDER BY atime DESC) + (count(*) OVER (PARTITION BY parentId, atime) - 1) / 2.0) AS INT) AS parentGen
    FROM fx_split s"""
_CTES["q_ids"] = f"SELECT DISTINCT PId FROM fx_particles WHERE snapnum = {LAST_SNAP} AND galId = {TARGET}"
_CTES["q_own"] = "SELECT parentId, max(parentGen) AS g FROM q_split GROUP BY parentId"
_CTES["q_line"] = """SELECT s.PId, s.parentId, s.Mass, s.snapnext, s.parentGen, coalesce(o.g, 0) + 1 AS gen FROM q_split s
    LEFT JOIN q_own o ON o.parentId = s.PId WHERE s.PId IN (SELECT PId FROM q_ids)
    UNION ALL SELECT l.PId, e.parentId, e.Mass, e.snapnext, e.parentGen, l.gen + coalesce(o.g, 0) - l.parentGen + 1 AS gen
    FROM q_line l JOIN q_split e ON e.PId = l.parentId LEFT JOIN q_own o ON o.parentId = l.parentId"""
_CTES["q_anc"] = """SELECT PId, parentId, Mass, snapnext, parentGen, gen FROM q_line UNION ALL
    SELECT l.PId, l.parentId, arg_max(e.Mass, (e.parentGen, e.Mass)), e.snapnext, l.parentGen, l.gen + max(e.parentGen) - l.parentGen
    FROM q_line l JOIN q_split e ON e.parentId = l.parentId WHERE e.parentGen > l.parentGen
    GROUP BY l.PId, l.parentId, l.snapnext, e.snapnext, l.parentGen, l.gen UNION ALL
    SELECT parentId, parentId, Mass, snapnext, parentGen, parentGen FROM q_split WHERE parentId IN (SELECT PId FROM q_ids)"""
_CTES["q_anc_all"] = """SELECT PId, parentId, Mass, snapnext, parentGen, gen FROM q_line UNION ALL
    SELECT l.PId, l.parentId, e.Mass, e.snapnext, l.parentGen, l.gen + e.parentGen - l.parentGen
    FROM q_line l JOIN q_split e ON e.parentId = l.parentId WHERE e.parentGen > l.parentGen UNION ALL
    SELECT parentId, parentId, Mass, snapnext, parentGen, parentGen FROM q_split WHERE parentId IN (SELECT PId FROM q_ids)"""
_CTES["q_best"] = f"""SELECT * FROM (SELECT a.PId, t.snapnum, a.parentId, a.gen,
    row_number() OVER (PARTITION BY a.PId, t.snapnum ORDER BY a.gen DESC, a.parentId) AS rn
    FROM q_anc a JOIN fx_timegrid t ON t.snapnum < a.snapnext AND t.snapnum <= {LAST_SNAP}) WHERE rn = 1"""
_CTES["q_stand"] = """SELECT b.PId, b.snapnum, p.Mass / power(2.0e0, b.gen) AS Mass, p.haloId, b.gen FROM q_best b
    JOIN fx_particles p ON p.snapnum = b.snapnum AND p.PId = b.parentId"""
_CTES["q_gas"] = """SELECT *, coalesce(Mass - lag(Mass) OVER (PARTITION BY PId ORDER BY snapnum), 0) AS Mgain FROM (
    SELECT PId, snapnum, Mass, haloId, gen FROM q_stand UNION ALL
    SELECT p.PId, p.snapnum, p.Mass, p.haloId, 0 FROM fx_particles p WHERE p.PId IN (SELECT PId FROM q_ids)
    AND NOT EXISTS (SELECT 1 FROM q_stand s WHERE s.PId = p.PId AND s.snapnum = p.snapnum))"""


def _ids(fx: Fixtures) -> DataFrame:
    return select.gas_in_galaxy(fx.particles, LAST_SNAP, TARGET)


def _splits(fx: Fixtures) -> DataFrame:
    return splits.split_table(fx.split, fx.timegrid)


@query("SELECT * FROM q_split")
def split_table(fx):
    return _splits(fx)


@query("SELECT * FROM q_anc_all")
def split_ancestors(fx):
    return splits.split_ancestors(_ids(fx), _splits(fx))


@query("SELECT * FROM q_anc")
def split_ancestors_by_snapshot(fx):
    return splits.split_ancestors(_ids(fx), _splits(fx), per_snapshot=True)


def _history(fx: Fixtures) -> DataFrame:
    seen = splits.split_ancestors(_ids(fx), _splits(fx), per_snapshot=True)
    return history.gas_history(_ids(fx), fx.particles, seen, LAST_SNAP)


@query("SELECT * FROM q_gas")
def gas_history(fx):
    return _history(fx)


@query("""SELECT g.PId, g.snapnum, g.Mass, CASE WHEN b.m IS NOT NULL THEN g.Mass - b.m / 2 ELSE g.Mgain + coalesce(s.m, 0) / 2 END AS Mgain FROM (
    SELECT PId, snapnum, Mass, coalesce(Mass - lag(Mass) OVER (PARTITION BY PId ORDER BY snapnum), 0) AS Mgain FROM fx_particles) g
    LEFT JOIN (SELECT PId, snapnext, sum(Mass) AS m FROM q_split GROUP BY ALL) b ON b.PId = g.PId AND b.snapnext = g.snapnum
    LEFT JOIN (SELECT parentId, snapnext, sum(Mass) AS m FROM q_split GROUP BY ALL) s ON s.parentId = g.PId AND s.snapnext = g.snapnum""")
def split_gain(fx):
    gains = ordered.with_diff(fx.particles.select("PId", "snapnum", "Mass"), "PId", "snapnum", "Mass", "Mgain")
    return splits.with_split_gain(gains, _splits(fx)).select("PId", "snapnum", "Mass", "Mgain")


# == progenitors and relations =============================================================================
_CTES["q_main"] = f"""SELECT haloId, snapnum, progId FROM (SELECT n.haloId, e.snapnum, e.haloId AS progId,
    row_number() OVER (PARTITION BY n.haloId, e.snapnum ORDER BY count(*) DESC, e.haloId DESC) AS rn
    FROM fx_particles n JOIN fx_particles e ON e.PId = n.PId AND e.snapnum < {LAST_SNAP} AND e.haloId > 0
    WHERE n.snapnum = {LAST_SNAP} AND n.haloId > 0 GROUP BY n.haloId, e.snapnum, e.haloId) WHERE rn = 1"""
_CTES["q_prog"] = f"""SELECT f.haloId, f.snapnum, f.progId, coalesce(h.hostId, CASE WHEN f.progId = 0 THEN 0 END) AS hostId,
    round(m.logMvir, 6) AS logMvir, round(m.logMsub, 6) AS logMsub FROM (
        SELECT h.haloId, t.snapnum, CASE WHEN t.snapnum = {LAST_SNAP} THEN h.haloId ELSE coalesce(p.progId, 0) END AS progId
        FROM (SELECT haloId FROM fx_halos WHERE snapnum = {LAST_SNAP}) h CROSS JOIN fx_timegrid t
        LEFT JOIN q_main p ON p.haloId = h.haloId AND p.snapnum = t.snapnum) f
    LEFT JOIN fx_hosts h ON h.snapnum = f.snapnum AND h.haloId = f.progId
    LEFT JOIN fx_log_halos m ON m.snapnum = f.snapnum AND m.haloId = f.progId"""


def _relation_sql(halos: str) -> str:
    return f"""SELECT x.snapnum, x.haloId, CASE WHEN l.progId = 0 THEN 'IGM' WHEN l.progId = x.haloId THEN 'SELF'
        WHEN l.hostId = x.haloId THEN 'PARENT' WHEN l.progId = h.hostId THEN 'SAT' WHEN l.hostId = h.hostId THEN 'SIB' ELSE 'IGM' END AS relation
        FROM ({halos}) x LEFT JOIN fx_hosts h ON h.snapnum = x.snapnum AND h.haloId = x.haloId
        LEFT JOIN q_prog l ON l.snapnum = x.snapnum AND l.haloId = {TARGET}"""


_CTES["q_gp"] = f"""SELECT g.*, coalesce(r.relation, 'IGM') AS relation FROM q_gas g
    LEFT JOIN ({_relation_sql('SELECT DISTINCT snapnum, haloId FROM q_gas WHERE haloId <> 0')}) r USING (snapnum, haloId)"""


@query("SELECT snapnum, haloId, hostId FROM fx_hosts")
def host_table(fx):
    return progenitors.host_table(fx.hosts)


@query("SELECT * FROM q_main")
def main_progenitor(fx):
    return aggregates.main_progenitor(fx.particles, LAST_SNAP)


def _prog(fx: Fixtures) -> DataFrame:
    return progenitors.progenitor_table(fx.particles, fx.log_halos, fx.hosts, LAST_SNAP)


@query("SELECT * FROM q_prog")
def progenitor_table(fx):
    return rounded(_prog(fx), "logMvir", "logMsub")


@query("""SELECT haloId, snapnum, progId, hostId, coalesce((SELECT Npart FROM fx_halos h WHERE h.snapnum = q_prog.snapnum AND h.haloId = progId), 0) AS Npart FROM q_prog""")
def progenitor_table_npart(fx):
    halos = fx.halos.select("snapnum", "haloId", "Npart")
    return progenitors.progenitor_table(fx.particles, halos, fx.hosts, LAST_SNAP)


@query(_relation_sql("SELECT snapnum, haloId FROM fx_halos"))
def halo_relations(fx):
    return progenitors.halo_relations(TARGET, fx.halos, _prog(fx), fx.hosts)


@query(f"""SELECT p.PId, p.snapnum, l.progId, p.x, p.y, p.z FROM fx_points p JOIN q_prog l ON l.snapnum = p.snapnum AND l.haloId = {TARGET} AND l.progId <> 0
    JOIN fx_halos h ON h.snapnum = l.snapnum AND h.haloId = l.progId
    WHERE abs(p.x - h.x) < 2 * h.Rvir AND abs(p.y - h.y) < 2 * h.Rvir AND abs(p.z - h.z) < 2 * h.Rvir""")
def progenitor_boxes(fx):
    points = fx.points.select("PId", "snapnum", "x", "y", "z")
    return progenitors.progenitor_boxes(_prog(fx), points, fx.halos, TARGET, 2.0)


# == winds =================================================================================================
_CTES["q_life"] = f"""SELECT b.PId, b.snapfirst, b.Mass AS minit, coalesce(p.haloId, 0) AS birthId, coalesce(r.snaplast, {N_SNAPS}) AS snaplast, coalesce(r.Mass, 0.0e0) AS mlast
    FROM (SELECT *, CAST((SELECT count(*) FROM fx_timegrid g WHERE g.a <= l.atime) - 1 AS INT) AS snapfirst FROM fx_launch l) b
    LEFT JOIN fx_particles p ON p.snapnum = b.snapfirst AND p.PId = b.PId
    LEFT JOIN (SELECT *, CAST((SELECT count(*) FROM fx_timegrid g WHERE g.a <= j.atime) AS INT) AS snaplast FROM fx_rejoin j) r ON r.PhEWKey = b.PhEWKey
    WHERE b.snapfirst >= 0"""
_CTES["q_wind"] = """SELECT *, coalesce(Mass - lag(Mass) OVER (PARTITION BY PId ORDER BY snapnum, Mass DESC, haloId), 0) AS Mloss FROM (
    SELECT PId, snapnum, Mass, haloId FROM fx_particles WHERE Mc > 0 UNION ALL SELECT PId, snapfirst, minit, 0 FROM q_life
    UNION ALL SELECT PId, snaplast, mlast, 0 FROM q_life)"""
_CTES["q_sub"] = """SELECT w.PId, w.snapnum, w.haloId, w.Mass, w.Mloss, l.snapfirst, l.birthId FROM q_wind w
    JOIN (SELECT DISTINCT snapnum, haloId FROM q_gas WHERE haloId <> 0) h USING (snapnum, haloId) LEFT JOIN q_life l ON l.PId = w.PId"""
_CTES["q_pp"] = f"""SELECT s.*, t.relation AS birthTag FROM q_sub s LEFT JOIN (
    {_relation_sql('SELECT DISTINCT snapfirst AS snapnum, birthId AS haloId FROM q_sub WHERE birthId <> 0')}) t ON t.snapnum = s.snapfirst AND t.haloId = s.birthId"""
_CTES["q_loss"] = "SELECT snapnum, haloId, birthTag, sum(Mloss) AS Mloss FROM q_pp WHERE birthTag IS NOT NULL GROUP BY ALL"
_CTES["q_mw"] = """SELECT PId, snapnum, birthTag, CASE WHEN tot = 0 THEN Mgain ELSE Mgain * (Mloss / tot) END AS Mgain FROM (
    SELECT g.PId, g.snapnum, coalesce(x.birthTag, 'IGM') AS birthTag, coalesce(x.Mloss, 0) AS Mloss, g.Mgain,
        sum(coalesce(x.Mloss, 0)) OVER (PARTITION BY g.PId, g.snapnum) AS tot
    FROM q_gp g LEFT JOIN q_loss x USING (snapnum, haloId))"""


def _life(fx: Fixtures) -> DataFrame:
    return winds.wind_lifecycle(fx.launch, fx.rejoin, fx.particles, fx.timegrid, N_SNAPS)


@query("SELECT * FROM q_life")
def wind_lifecycle(fx):
    return _life(fx)


@query("SELECT * FROM q_wind")
def wind_table(fx):
    return winds.wind_table(fx.particles, _life(fx))


@query("""SELECT *, coalesce(Mass - lag(Mass) OVER (PARTITION BY PId ORDER BY snapnum), 0) AS Mloss FROM (
    SELECT PId, snapnum, Mass, haloId FROM fx_particles WHERE Mc > 0 AND snapnum < 5)""")
def wind_table_plain(fx):
    return winds.wind_table(fx.particles, snaplast=5)


@query("SELECT * REPLACE (coalesce(snapfirst, -1) AS snapfirst, coalesce(birthId, -1) AS birthId) FROM q_sub")
def wind_subset(fx):
    life = _life(fx)
    return no_null(winds.wind_subset(winds.wind_table(fx.particles, life), _history(fx), life), "snapfirst", "birthId")


def _track(fx: Fixtures, **kw) -> history.Accretion:
    return history.track_accretion(fx.simulation, LAST_SNAP, TARGET, **kw)


@query("SELECT * FROM q_gp")
def tracked_gas(fx):
    """gptable: history with relation."""
    return _track(fx).history.select("PId", "snapnum", "Mass", "haloId", "gen", "Mgain", "relation")


@query("SELECT * REPLACE (coalesce(snapfirst, -1) AS snapfirst, coalesce(birthId, -1) AS birthId) FROM q_pp")
def tracked_winds(fx):
    """pptable: wind subset with birth tags."""
    cols = ("PId", "snapnum", "haloId", "Mass", "Mloss", "snapfirst", "birthId", "birthTag")
    return no_null(_track(fx).subset.select(*cols), "snapfirst", "birthId")


@query("SELECT snapnum, haloId, birthTag, Mloss FROM q_loss")
def wind_loss_by_tag(fx):
    return winds.loss_by_tag(_track(fx).subset)


@query("SELECT PId, snapnum, birthTag, round(Mgain, 9) AS Mgain FROM q_mw")
def wind_mass_partition(fx):
    return rounded(_track(fx).partition, "Mgain", digits=9)


@query("SELECT PId, snapnum, birthTag, round(Mgain, 9) AS Mgain FROM q_mw")
def accretion_from_stored(fx):
    """The permanent tables are stored for one run, then loaded for the target."""
    base = new_path(fx.particles.sparkSession)
    run = {"model": "fixture"}
    history.stored_tables(fx.simulation, base, run, LAST_SNAP)
    tables = history.stored_tables(fx.simulation, base, run, LAST_SNAP)
    return rounded(_track(fx, tables=tables).partition, "Mgain", digits=9)


@query("SELECT snapnum, coalesce(relation, 'TOT') AS relation, sum(Mass) AS Mass FROM q_gp GROUP BY GROUPING SETS ((snapnum, relation), (snapnum))")
def mass_by_relation_total(fx):
    return aggregates.mass_by_tag(_track(fx).history, "relation", "Mass", total=True)


@query("""SELECT snapnum, relation, Mgain, sum(Mgain) OVER (PARTITION BY relation ORDER BY snapnum) AS Mgain_cum FROM (
    SELECT snapnum, relation, sum(Mgain) AS Mgain FROM q_gp GROUP BY ALL)""")
def gain_by_relation(fx):
    return aggregates.accumulated_by_tag(_track(fx).history, "relation", "Mgain")


@query("""SELECT snapnum, coalesce(birthTag, 'TOT') AS birthTag, round(sum(m), 9) AS Mgain FROM (
    SELECT snapnum, birthTag, sum(Mgain) OVER (PARTITION BY PId, birthTag ORDER BY snapnum) AS m FROM q_mw)
    GROUP BY GROUPING SETS ((snapnum, birthTag), (snapnum))""")
def accumulated_wind(fx):
    return rounded(aggregates.accumulated_per_particle(_track(fx).partition), "Mgain", digits=9)


_CTES["q_tmax"] = f"SELECT PId, logT AS Tmax FROM fx_particles WHERE snapnum = {LAST_SNAP}"


@query("""SELECT snapnum, coalesce(relation, 'TOT') AS relation, sum(Mass) AS Mass FROM q_gp JOIN q_tmax USING (PId) WHERE Tmax > 5.5
    GROUP BY GROUPING SETS ((snapnum, relation), (snapnum))""")
def hot_mass_by_relation(fx):
    now = fx.particles.where(F.col("snapnum") == LAST_SNAP).select("PId", F.col("logT").alias("Tmax"))
    hot = select.hot_history(history.with_tmax(_track(fx).history, now))
    return aggregates.mass_by_tag(hot, "relation", "Mass", total=True)


_CTES["q_state"] = f"""SELECT PId, max(snapnum < {LAST_SNAP} AND haloId <> 0 AND relation <> 'SELF') AS merger,
    max(CASE WHEN snapnum = {LAST_SNAP} THEN Mass END) AS now FROM q_gp GROUP BY PId"""


@query("""SELECT PId, mode, round(Mass, 9) AS Mass FROM (
    SELECT s.PId, CASE WHEN merger THEN 'Merger' WHEN Tmax > 5.5 THEN 'Hot' ELSE 'Cold' END AS mode,
        CASE WHEN merger THEN now ELSE now - coalesce(g.m, 0) END AS Mass
    FROM q_state s LEFT JOIN (SELECT PId, sum(Mgain) AS m FROM q_mw GROUP BY PId) g USING (PId) LEFT JOIN q_tmax t USING (PId)
    UNION ALL SELECT PId, CASE birthTag WHEN 'SELF' THEN 'Recycled-self' WHEN 'PARENT' THEN 'Recycled-central' WHEN 'SAT' THEN 'Recycled-satellite' ELSE 'Recycled-IGM' END,
        sum(Mgain) FROM q_mw WHERE PId IN (SELECT PId FROM q_state WHERE NOT merger) GROUP BY ALL)""")
def accretion_mode(fx):
    t = _track(fx)
    now = fx.particles.where(F.col("snapnum") == LAST_SNAP).select("PId", F.col("logT").alias("Tmax"))
    return rounded(history.accretion_mode(t.history, t.partition, now, LAST_SNAP), "Mass", digits=9)


_CTES["q_star_gp"] = f"""SELECT * FROM q_gas UNION ALL
    SELECT PId, snapnum, Mass, haloId, 0 AS gen, coalesce(Mass - lag(Mass) OVER (PARTITION BY PId ORDER BY snapnum), 0) AS Mgain FROM fx_stars
    WHERE PId IN (SELECT PId FROM fx_stars WHERE snapnum = {LAST_SNAP} AND galId = {TARGET})"""


@query("SELECT * FROM q_star_gp")
def tracked_gas_and_stars(fx):
    t = _track(fx, include_stars=True).history
    return t.select("PId", "snapnum", "Mass", "haloId", "gen", "Mgain")


@query(f"""SELECT PId FROM fx_particles WHERE snapnum = {LAST_SNAP} AND galId = {TARGET}
    EXCEPT SELECT PId FROM fx_particles WHERE snapnum = {LAST_SNAP - 1} AND galId = {TARGET}""")
def recent_accretion(fx):
    return history.recent_accretion(fx.particles, TARGET, LAST_SNAP)


@query(f"SELECT PId, snapnum, Mass, haloId FROM fx_stars WHERE PId IN (SELECT PId FROM fx_stars WHERE snapnum = {LAST_SNAP} AND galId = {TARGET})")
def star_history(fx):
    return history.star_history(fx.stars, TARGET, LAST_SNAP).select("PId", "snapnum", "Mass", "haloId")


@query("""SELECT PhEWKey, segment, string_agg(CAST(CAST(round(Mass * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY atime, Mass) AS masses,
    max(records) AS records, max(first_mass) AS first_mass FROM (SELECT *, CAST((row_number() OVER (PARTITION BY PhEWKey ORDER BY atime, Mass) - 1) // 32 AS INT) AS segment,
        count(*) OVER (PARTITION BY PhEWKey) AS records, first_value(Mass) OVER (PARTITION BY PhEWKey ORDER BY atime, Mass) AS first_mass
        FROM fx_tracks) GROUP BY PhEWKey, segment""")
def wind_tracks(fx):
    """A row has 32 records at most, so that no particle's row grows with its track."""
    records = fx.tracks.withColumn("Minit", F.col("Mass"))
    tracks = winds.build_tracks(records, first=("Minit",), chunk=32)
    cents = F.transform("track.Mass", lambda m: F.round(m * 100).cast("long").cast("string"))
    return tracks.select("PhEWKey", "segment", F.concat_ws(",", cents).alias("masses"), "records", F.col("Minit").alias("first_mass"))


# == galaxy trees ==========================================================================================
_CTES["q_flow"] = """SELECT snapnum, galId, psnap, pgal, sum(Mass) AS Mass FROM (SELECT snapnum, galId, Mass,
    lag(snapnum) OVER w AS psnap, lag(galId) OVER w AS pgal FROM fx_stars WHERE galId <> 0 WINDOW w AS (PARTITION BY PId ORDER BY snapnum)) GROUP BY ALL"""
for _s in range(N_SNAPS):
    _known = " UNION ALL ".join(f"SELECT * FROM q_gal{i}" for i in range(_s)) or "SELECT NULL::INT AS snapnum, NULL::INT AS galId, NULL::BIGINT AS mainId"
    _CTES[f"q_gal{_s}"] = f"""SELECT g.snapnum, g.galId, coalesce(b.mainId, CAST({_s} AS BIGINT) * 4294967296 + g.galId) AS mainId
        FROM (SELECT DISTINCT snapnum, galId FROM q_flow WHERE snapnum = {_s}) g LEFT JOIN (
            SELECT galId, mainId FROM (SELECT f.galId, k.mainId, row_number() OVER (PARTITION BY f.galId ORDER BY sum(f.Mass) DESC, k.mainId) AS rn
                FROM q_flow f JOIN ({_known}) k ON k.snapnum = f.psnap AND k.galId = f.pgal WHERE f.snapnum = {_s} GROUP BY f.galId, k.mainId) WHERE rn = 1) b USING (galId)"""
_CTES["q_mainids"] = " UNION ALL ".join(f"SELECT * FROM q_gal{i}" for i in range(N_SNAPS))
_CTES["q_tree"] = """SELECT m.mainId, m.snapnum, m.galId, h.hostId, s.Mstar, t.Mgal AS Mtot, v.Mvir AS Mhost, n.mainId AS mainIdNext FROM q_mainids m
    JOIN (SELECT snapnum, galId, sum(Mass) AS Mstar FROM q_flow GROUP BY ALL) s USING (snapnum, galId)
    LEFT JOIN (SELECT psnap, pgal, mainId FROM (SELECT f.psnap, f.pgal, k.mainId, row_number() OVER (PARTITION BY f.psnap, f.pgal ORDER BY sum(f.Mass) DESC, k.mainId) AS rn
        FROM q_flow f JOIN q_mainids k ON k.snapnum = f.snapnum AND k.galId = f.galId WHERE f.psnap IS NOT NULL GROUP BY f.psnap, f.pgal, k.mainId) WHERE rn = 1) n
        ON n.psnap = m.snapnum AND n.pgal = m.galId
    LEFT JOIN fx_hosts h ON h.snapnum = m.snapnum AND h.haloId = m.galId
    LEFT JOIN fx_snap_galaxies t ON t.snapnum = m.snapnum AND t.galId = m.galId
    LEFT JOIN fx_halos v ON v.snapnum = m.snapnum AND v.haloId = h.hostId"""


def _tree(fx: Fixtures) -> DataFrame:
    return galaxies.galaxy_tree(fx.stars, fx.hosts, fx.snap_galaxies, fx.halos)


@query("SELECT * REPLACE (coalesce(hostId, -1) AS hostId, coalesce(mainIdNext, -1) AS mainIdNext) FROM q_tree")
def galaxy_tree(fx):
    return no_null(_tree(fx), "hostId", "mainIdNext")


@query("""SELECT s.PId, s.snapnum, s.galId, coalesce(last_value(m.mainId IGNORE NULLS) OVER (PARTITION BY PId ORDER BY s.snapnum), -1) AS mainId,
    coalesce(first_value(CASE WHEN s.galId <> 0 THEN s.galId END IGNORE NULLS) OVER (PARTITION BY PId ORDER BY s.snapnum ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), -1) AS initId
    FROM fx_stars s LEFT JOIN q_mainids m ON m.snapnum = s.snapnum AND m.galId = s.galId""")
def star_table(fx):
    main = galaxies.galaxy_main_ids(galaxies.star_flows(fx.stars))
    out = galaxies.star_table(fx.stars, main).select("PId", "snapnum", "galId", "mainId", "initId")
    return no_null(out, "mainId", "initId")


_CTES["q_desc"] = f"""SELECT galId, descId FROM (SELECT a.galId, b.galId AS descId, row_number() OVER (PARTITION BY a.galId ORDER BY sum(b.Mass) DESC, b.galId) AS rn
    FROM fx_stars a JOIN fx_stars b ON b.PId = a.PId WHERE a.snapnum = 2 AND b.snapnum = {LAST_SNAP} AND a.galId <> 0 AND b.galId <> 0 GROUP BY a.galId, b.galId) WHERE rn = 1"""
_CTES["q_line0"] = """SELECT mainId, galId AS backId, hostId AS backHost FROM (SELECT *, row_number() OVER (PARTITION BY mainId ORDER BY Mstar DESC, galId) AS rn
    FROM q_tree WHERE snapnum = 2) WHERE rn = 1"""


@query(f"""SELECT g.galId, g.mainId, coalesce(d.descId, -1) AS descId, coalesce(t.mainId, -1) AS descMainId, CASE WHEN d.descId IS NULL THEN NULL WHEN g.mainId = t.mainId THEN 'SELF' ELSE 'MERGE' END AS fate,
    CASE WHEN d.descId IS NULL THEN NULL WHEN l.backId IS NULL OR g.mainId = t.mainId THEN 'SELF' WHEN l.backId = g.hostId THEN 'SAT' WHEN l.backHost = g.galId THEN 'CEN'
        WHEN l.backHost = g.hostId AND g.hostId <> l.backId AND g.hostId <> g.galId THEN 'SIB' ELSE 'NGB' END AS relation
    FROM (SELECT * FROM q_tree WHERE snapnum = 2) g LEFT JOIN q_desc d USING (galId)
    LEFT JOIN (SELECT galId, mainId FROM q_tree WHERE snapnum = {LAST_SNAP}) t ON t.galId = d.descId LEFT JOIN q_line0 l ON l.mainId = t.mainId""")
def galaxy_relations(fx):
    return no_null(galaxies.galaxy_relations(fx.stars, _tree(fx), fx.hosts, 2, LAST_SNAP), "descId", "descMainId")


# == sight lines ===========================================================================================
_CTES["q_sightlines"] = f"""SELECT d.dir, CAST(b.range AS INT) AS b, rank, round(CASE WHEN xx < -0.5 THEN xx + 1 WHEN xx > 0.5 THEN xx - 1 ELSE xx END, 6) AS x,
    round(CASE WHEN yy < -0.5 THEN yy + 1 WHEN yy > 0.5 THEN yy - 1 ELSE yy END, 6) AS y, round(z, 6) AS z, 2 AS axis,
    galId || '_' || CAST(logMsub AS VARCHAR)[1:5] || '_' || CAST(logMstar AS VARCHAR)[1:5] || '.' || dir || b.range || 'kpc' AS label
    FROM (SELECT c.*, d.*, b.range, c.x + d.dx * b.range / 25000.0e0 AS xx, c.y + d.dy * b.range / 25000.0e0 AS yy FROM (
        SELECT *, (rn - 1) // s AS rank FROM (SELECT *, row_number() OVER (ORDER BY galId) AS rn, greatest(1, count(*) OVER () // 75) AS s
            FROM (SELECT *, {_BIN} AS mbin FROM fx_galaxies) WHERE mbin = 12) WHERE (rn - 1) % s = 0 AND rn - 1 < 75 * s) c,
        (VALUES ('x+', 1, 0), ('x-', -1, 0), ('y+', 0, 1), ('y-', 0, -1)) d(dir, dx, dy), range(10, 300, 40) b) d, (SELECT d.range) b"""


@query("SELECT * FROM q_sightlines")
def sightline_list(fx):
    return rounded(sightlines.sightlines(fx.galaxies, 12, 75, 25000.0), "x", "y", "z")


# == sources: domain tables landed in the shared folder and read back through the readers ==================
def _landed(fx: Fixtures, df: DataFrame, fmt: str, *by: str, **options) -> str:
    path = new_path(fx.particles.sparkSession)
    df.write.format(fmt).options(**options).partitionBy(*by).save(path)
    return path


@query("""SELECT PId, parentId, round(CAST(CAST(atime AS FLOAT) AS DOUBLE), 6) AS atime, Mass FROM fx_split""")
def read_split_log(fx):
    path = _landed(fx, fx.split.select("PId", "parentId", "atime", "Mass"), "csv")
    return rounded(text.read_split(fx.particles.sparkSession, path).withColumn("atime", F.col("atime").cast("double")), "atime")


@query("SELECT snapnum, round(a, 9) AS a, round(zred, 9) AS zred FROM fx_timegrid")
def read_timegrid(fx):
    path = _landed(fx, fx.timegrid.select("snapnum", "a", "zred"), "csv", header=True, sep=" ")
    return rounded(text.read_timegrid(fx.particles.sparkSession, path), "a", "zred", digits=9)


@query("SELECT round(a, 9) AS a, round(1 - a, 9) AS z, round(t, 9) AS t FROM fx_tcosmic")
def read_tcosmic(fx):
    knots = fx.tcosmic.select("a", (1 - F.col("a")).alias("z"), "t")
    path = _landed(fx, knots, "csv", header=True, sep=" ")
    return rounded(text.read_tcosmic(fx.particles.sparkSession, path), "a", "z", "t", digits=9)


@query("SELECT snapnum, PId, x, y, Mass FROM fx_points")
def lake_particles(fx):
    rows = fx.points.select("snapnum", F.lit(0).alias("ptype"), F.col("PId").alias("idx"), "PId", "Mass", F.struct("x", "y", "z").alias("Pos"))
    path = _landed(fx, rows, "parquet", "ptype", "snapnum")
    return lake.particles(fx.particles.sparkSession, path, "gas", ["PId", "x", "y", "Mass"]).drop("idx")


def _by_place(fx):
    cols = ["snapnum", "PId", "haloId", "x", "y", "z", "Mass", "Mc", "Sfr", "logT"]
    return cells.build_cells(fx.points.select(*cols), new_path(fx.particles.sparkSession), 0.0, 22000.0, rows_per_file=2000)


@query(f"""SELECT p.PId, p.x, p.y, p.z, p.Mass FROM fx_points p, (SELECT * FROM fx_halos WHERE snapnum = {LAST_SNAP} AND haloId = {TARGET}) h
    WHERE p.snapnum = {LAST_SNAP} AND p.x > h.x - 2.5 * h.Rvir AND p.x < h.x + 2.5 * h.Rvir AND p.y > h.y - 2.5 * h.Rvir
    AND p.y < h.y + 2.5 * h.Rvir AND p.z > h.z - 2.5 * h.Rvir AND p.z < h.z + 2.5 * h.Rvir""")
def stored_cube(fx):
    limits = physics.halo_box(fx.halos.where(f"snapnum = {LAST_SNAP} AND haloId = {TARGET}"), 2.5).first().asDict()
    return _by_place(fx).in_cube(LAST_SNAP, limits).select("PId", "x", "y", "z", "Mass")


@query(f"""SELECT p.PId, p.snapnum, l.progId, p.x, p.y, p.z FROM fx_points p JOIN q_prog l ON l.snapnum = p.snapnum AND l.haloId = {TARGET} AND l.progId <> 0
    JOIN fx_halos h ON h.snapnum = l.snapnum AND h.haloId = l.progId
    WHERE abs(p.x - h.x) < 2 * h.Rvir AND abs(p.y - h.y) < 2 * h.Rvir AND abs(p.z - h.z) < 2 * h.Rvir""")
def stored_progenitor_cubes(fx):
    found = progenitors.progenitor_boxes(_prog(fx), _by_place(fx), fx.halos, TARGET, 2.0)
    return found.select("PId", "snapnum", "progId", "x", "y", "z")


@query(f"""SELECT 'box' AS kind, p.x, p.y, p.z, Mc, Sfr, logT FROM fx_points p, (SELECT * FROM fx_halos WHERE snapnum = {LAST_SNAP} AND haloId = {TARGET}) h
    WHERE p.snapnum = {LAST_SNAP} AND p.x > h.x - 1.2 * h.Rvir AND p.x < h.x + 1.2 * h.Rvir AND p.y > h.y - 1.2 * h.Rvir
    AND p.y < h.y + 1.2 * h.Rvir AND p.z > h.z - 1.2 * h.Rvir AND p.z < h.z + 1.2 * h.Rvir
    UNION ALL SELECT 'halo', x, y, z, Mc, Sfr, logT FROM fx_points WHERE snapnum = {LAST_SNAP} AND haloId = {TARGET}""")
def stored_halo_extract(fx):
    """The cube around a halo and its members, extracted from particles stored by place and kept."""
    gas, base = _by_place(fx), new_path(fx.particles.sparkSession)
    both = [progenitors.halo_extract(gas, fx.halos, TARGET, LAST_SNAP, base, box=box).withColumn("kind", F.lit(kind)) for kind, box in (("box", True), ("halo", False))]
    return both[0].unionByName(both[1])


@query(f"SELECT snapnum, PId, Mass FROM fx_points WHERE snapnum IN ({LAST_SNAP}, 0)")
def lake_snapshots(fx):
    rows = fx.points.select("snapnum", F.lit(0).alias("ptype"), F.col("PId").alias("idx"), "PId", "Mass")
    path = _landed(fx, rows, "parquet", "ptype", "snapnum")
    return lake.particles(fx.particles.sparkSession, path, "gas", ["PId", "Mass"], [LAST_SNAP, 0]).drop("idx")


@query("""SELECT snapnum, ptype, PId, CASE WHEN ptype = 0 THEN Mass ELSE 10.0 + snapnum END AS Mass FROM q_typed""")
def header_masses(fx):
    heads = fx.timegrid.select("snapnum", F.array(F.lit(0.0), *[F.lit(0.0)] * 3, 10.0 + F.col("snapnum"), F.lit(0.0)).alias("mass_table"))
    return lake.with_mass(_typed(fx), heads).select("snapnum", "ptype", "PId", "Mass")


@query("SELECT snapnum, haloId, hostId FROM fx_hosts")
def stored_csv(fx):
    spark, path, schema = fx.particles.sparkSession, new_path(fx.particles.sparkSession), schemas.TABLES["hosttable"]
    store.save(progenitors.host_table(fx.hosts), path, "csv", schema, sort_by=["snapnum", "haloId"])
    return store.load(spark, path, "csv", schema)


@query("""SELECT PhEWKey, count(*) AS records, CAST(sum(CAST(round(Mass * 100) AS BIGINT)) AS BIGINT) AS cents FROM fx_tracks GROUP BY PhEWKey""")
def stored_tracks(fx):
    spark, path = fx.particles.sparkSession, new_path(fx.particles.sparkSession)
    store.write_tracks(winds.build_tracks(fx.tracks), path)
    cents = F.aggregate(F.col("track.Mass"), F.lit(0).cast("long"), lambda s, m: s + F.round(m * 100).cast("long"))
    return spark.read.parquet(path).groupBy("PhEWKey").agg(F.max("records").alias("records"), F.sum(cents).alias("cents"))


@query("""SELECT t.PhEWKey, count(*) AS records, max(l.Mass) AS Minit FROM fx_tracks t JOIN (SELECT * FROM fx_launch WHERE atime > 0.2 AND atime < 0.6) l
    ON l.PhEWKey = t.PhEWKey GROUP BY t.PhEWKey""")
def tracks_of_launches(fx):
    chosen = fx.launch.where("atime > 0.2 and atime < 0.6").select("PhEWKey", F.col("Mass").alias("Minit"))
    tracks = winds.build_tracks(fx.tracks, chosen, first=("Minit",), chunk=100)
    return tracks.groupBy("PhEWKey").agg(F.sum(F.size("track.Mass")).alias("records"), F.max("Minit").alias("Minit"))


# the queries of the sources register themselves
from . import reader_queries  # noqa: E402, F401
