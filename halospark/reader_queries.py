"""Registered queries of the sources: domain tables landed in the shared folder under the names and in the formats of a
run's own files, and read back through the readers."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixtures import TARGET, Fixtures
from .functions import constants as C
from .operators import aggregates
from .operators.lineage import new_path
from .operators.ordered import running_total, with_diff
from .plans import progenitors, sightlines
from .queries import _CTES, _history, _prog, _snaplog, no_null, query, rounded
from .sources import lake, schemas, store, text

_ATIME = "round(CAST(CAST(atime AS FLOAT) AS DOUBLE), 6) AS atime"


def _named_files(fx: Fixtures, rows: DataFrame, fmt: str = "text") -> str:
    """Write rows (name, at, ...) as one file for each name, in the order of ``at``, and give the files their names."""
    spark = fx.particles.sparkSession
    path = new_path(spark)
    dealt = rows.repartition("name").sortWithinPartitions("name", "at")
    dealt.drop("at").write.partitionBy("name").format(fmt).save(f"{path}/landed")
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.Path(f"{path}/run"))
    for folder in fs.listStatus(jvm.Path(f"{path}/landed")):
        if folder.isDirectory():
            (part,) = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            fs.rename(part, jvm.Path(f"{path}/run/{folder.getPath().getName().removeprefix('name=')}"))
    return f"{path}/run"


def _snap_file(prefix: str, suffix: str = "") -> Column:
    return F.format_string(f"{prefix}_%03d{suffix}", F.col("snapnum"))


def _line(sep: str, *cols: Column | str) -> Column:
    return F.concat_ws(sep, *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def _framed(rows: DataFrame, header: str | None = None, footer: str | None = None) -> DataFrame:
    """Rows (name, at, value) with a line before and after those of every file."""
    for line, at in ((header, -1), (footer, 1 << 60)):
        if line is not None:
            rows = rows.unionByName(rows.select("name").distinct().select("name", F.lit(at).cast("long").alias("at"), F.lit(line).alias("value")))
    return rows


def _catalogue(fx: Fixtures, df: DataFrame, prefix: str, order: str, schema: T.StructType, sep: str = " ", header: str | None = None, footer: str | None = None) -> str:
    """One file for each snapshot with the columns of ``schema``; columns that ``df`` lacks are zero."""
    cols = [F.col(f.name) if f.name in df.columns else F.lit(0) for f in schema.fields]
    rows = df.select(_snap_file(prefix).alias("name"), F.col(order).cast("long").alias("at"), _line(sep, *cols).alias("value"))
    return _named_files(fx, _framed(rows, header, footer)) + f"/{prefix}_*"


def _log(fx: Fixtures, df: DataFrame, prefix: str, key: str, schema: T.StructType, sep: str) -> str:
    """An event log in four files, with a header in the first."""
    cols = [F.col(f.name) if f.name in df.columns else F.lit(0) for f in schema.fields]
    rows = df.select(F.concat(F.lit(f"{prefix}."), F.pmod(key, F.lit(4)).cast("string")).alias("name"), F.col(key).cast("long").alias("at"), _line(sep, *cols).alias("value"))
    head = fx.table("region").agg(F.lit(f"{prefix}.0").alias("name"), F.lit(-1).cast("long").alias("at"), F.lit(sep.join(schema.fieldNames())).alias("value"))
    return _named_files(fx, rows.unionByName(head)) + f"/{prefix}.*"


def _as_double(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# == catalogues ==============================================================================================
@query("SELECT snapnum, haloId, CAST(Mvir AS DOUBLE) AS Mvir, Rvir, Npart, CAST(Msub AS DOUBLE) AS Msub FROM fx_halos")
def read_sovcirc(fx):
    path = _catalogue(fx, fx.halos, "sovcirc", "haloId", schemas.SOVCIRC, header="# haloId Mvir ...", footer="0 0 0 0 0 0 0 0")
    found = text.read_sovcirc(fx.particles.sparkSession, path)
    return _as_double(found.select("snapnum", "haloId", "Mvir", "Rvir", "Npart", "Msub"), "Mvir", "Rvir", "Msub")


@query("SELECT snapnum, CAST(galId AS INT) AS galId, CAST(Mgal AS DOUBLE) AS Mgal, CAST(Mgas AS DOUBLE) AS Mgas, CAST(Mstar AS DOUBLE) AS Mstar, CAST(Sfr AS DOUBLE) AS Sfr FROM fx_snap_galaxies")
def read_stat(fx):
    path = _catalogue(fx, fx.snap_galaxies, "stat", "galId", schemas.STAT)
    found = text.read_stat(fx.particles.sparkSession, path)
    return _as_double(found.select("snapnum", "galId", "Mgal", "Mgas", "Mstar", "Sfr"), "Mgal", "Mgas", "Mstar", "Sfr")


@query("SELECT snapnum, haloId, hostId FROM fx_hosts")
def read_sopar(fx):
    path = _catalogue(fx, fx.hosts, "sopar", "haloId", schemas.SOPAR)
    return text.read_sopar(fx.particles.sparkSession, path).select("snapnum", "haloId", "hostId")


_CTES["q_listed_gas"] = "SELECT *, row_number() OVER (PARTITION BY snapnum ORDER BY PId) - 1 AS idx FROM fx_particles"


def _group_files(fx: Fixtures) -> str:
    ids = fx.particles.withColumn("hostId", -F.col("haloId"))
    return _catalogue(fx, ids, "sogrp", "PId", schemas.SOGRP, sep=" , ", header="# haloId , hostId")


@query("SELECT snapnum, idx, haloId, -haloId AS hostId FROM q_listed_gas")
def read_sogrp(fx):
    return text.read_sogrp(fx.particles.sparkSession, _group_files(fx)).select("snapnum", "idx", "haloId", "hostId")


@query("SELECT snapnum, idx, haloId, haloId AS hostId FROM q_listed_gas WHERE idx < (SELECT count(*) FROM supplier)")
def read_sogrp_upto(fx):
    """Only the leading rows of a type code, ids without their sign."""
    n = text.rows_upto(1, 0, fx.table("supplier").count(), 1)
    return text.read_sogrp(fx.particles.sparkSession, _group_files(fx), n, abs_ids=True).select("snapnum", "idx", "haloId", "hostId")


@query("SELECT snapnum, idx, CAST(galId AS INT) AS galId FROM q_listed_gas")
def read_grp(fx):
    path = _catalogue(fx, fx.particles, "grp", "PId", schemas.GRP, header="# galId")
    return text.read_grp(fx.particles.sparkSession, path).select("snapnum", "idx", "galId")


@query("""SELECT snapnum, row_number() OVER (PARTITION BY snapnum ORDER BY galId) - 1 AS gid, CAST(Mgal AS DOUBLE) AS Mgal, CAST(Mstar AS DOUBLE) AS Mstar
    FROM fx_snap_galaxies WHERE Mgas > 0""")
def read_fof(fx):
    """Groups without gas stand for groups without a galaxy."""
    groups = fx.snap_galaxies.withColumn("Mgal", F.when(F.col("Mgas") > 0, F.col("Mgal")).otherwise(-1))
    path = _catalogue(fx, groups, "fof", "galId", schemas.FOF, header="# cpu group ...")
    return _as_double(text.read_fof(fx.particles.sparkSession, path).select("snapnum", "gid", "Mgal", "Mstar"), "Mgal", "Mstar")


@query("""SELECT '/data/run-a/snapshot_' || printf('%03d', snapnum) || '.hdf5' AS path, 'run-a' AS model, snapnum, true AS path_ok FROM fx_timegrid
    UNION ALL SELECT '/data/run-a/notes_' || snapnum || 'x', '', -1, false FROM fx_timegrid""")
def path_keys(fx):
    good = F.format_string("/data/run-a/snapshot_%03d.hdf5", F.col("snapnum"))
    bad = F.format_string("/data/run-a/notes_%dx", F.col("snapnum"))
    found = text.with_path_keys(fx.timegrid.select(F.explode(F.array(good, bad)).alias("path")), "path")
    return no_null(found.withColumn("model", F.coalesce("model", F.lit(""))), "snapnum")


@query("SELECT '/d/snapshot_' || snapnum AS path, round(zred, 9) AS zc, round(zred - 0.5, 9) AS zlo, round(zred + 0.5, 9) AS zhi, 'z' || snapnum AS name FROM fx_timegrid")
def read_zplan(fx):
    z = F.col("zred")
    line = _line(" ", F.concat(F.lit("/d/snapshot_"), "snapnum"), z, z - 0.5, z + 0.5, F.concat(F.lit("z"), "snapnum"))
    rows = fx.timegrid.select(F.lit("sample.tab").alias("name"), F.col("snapnum").cast("long").alias("at"), line.alias("value"))
    return rounded(text.read_zplan(fx.particles.sparkSession, _named_files(fx, rows) + "/sample.tab"), "zc", "zlo", "zhi", digits=9)


@query("""SELECT O AS LogRho, logT AS LogT, count(*) AS count, sum(Mass) AS Mass, sum(C) AS Zmet,
    round(CASE WHEN sum(Mass) > 0 THEN log10(sum(Mass)) END, 9) AS LogM FROM fx_points GROUP BY O, logT""")
def read_phase_grid(fx):
    grid = fx.points.groupBy(F.col("O").alias("LogRho"), F.col("logT").alias("LogT")).agg(
        F.count("*").alias("count"), F.sum("Mass").alias("Mass"), F.sum("C").alias("Zmet")
    )
    path = new_path(fx.particles.sparkSession)
    grid.write.option("header", True).csv(path)
    return rounded(text.read_phase_grid(fx.particles.sparkSession, path), "LogM", digits=9)


# == event logs ================================================================================================
@query(f"SELECT {_ATIME}, PhEWKey, Mass, PId AS PID, CAST(0 AS BIGINT) AS MinPotID FROM fx_launch")
def read_initwinds(fx):
    log = fx.launch.withColumnRenamed("PId", "PID")
    path = _log(fx, log, "initwinds", "PhEWKey", schemas.INITWINDS, ",")
    found = text.read_initwinds(fx.particles.sparkSession, path, ["atime", "PhEWKey", "Mass", "PID", "MinPotID"])
    return rounded(_as_double(found, "atime", "Mass"), "atime")


@query(f"SELECT {_ATIME}, PhEWKey, Mass, CAST(0 AS INT) AS flag FROM fx_rejoin")
def read_rejoin(fx):
    path = _log(fx, fx.rejoin, "rejoin", "PhEWKey", schemas.REJOIN, ",")
    found = text.read_rejoin(fx.particles.sparkSession, path, ["atime", "PhEWKey", "Mass", "flag"])
    return rounded(_as_double(found, "atime", "Mass"), "atime")


@query(f"SELECT {_ATIME}, PhEWKey, Mass, CAST(0.0 AS DOUBLE) AS dWork FROM fx_launch")
def read_phews(fx):
    """Records separated by runs of spaces."""
    path = _log(fx, fx.launch, "phews", "PhEWKey", schemas.PHEWS, "   ")
    found = text.read_phews(fx.particles.sparkSession, path, ["atime", "PhEWKey", "Mass", "dWork"])
    return rounded(_as_double(found, "atime", "Mass", "dWork"), "atime")


# == the lake ==================================================================================================
_CTES["q_headers"] = """SELECT snapnum, count(*) FILTER (ptype = 0) AS n_gas, count(*) FILTER (ptype = 1) AS n_dark,
    count(*) FILTER (ptype = 4) AS n_star FROM q_kinds GROUP BY snapnum"""
_CTES["q_kinds"] = """SELECT *, row_number() OVER (PARTITION BY snapnum, ptype ORDER BY PId) - 1 AS idx FROM (
    SELECT snapnum, 0 AS ptype, PId, Mass, haloId, galId, Zmet FROM fx_particles
    UNION ALL SELECT snapnum, 1, PId, Mass, haloId, galId, Zmet FROM fx_particles WHERE Mc > 0
    UNION ALL SELECT snapnum, 4, PId, Mass, haloId, galId, 0 FROM fx_stars)"""


def _kinds(fx: Fixtures) -> DataFrame:
    """Gas, dark matter (the wind particles stand for it) and stars, with positions in their type."""
    cols = ("snapnum", "PId", "Mass", "haloId", "galId", "Zmet")
    gas = fx.particles.select(*cols, F.lit(0).alias("ptype"), "Mc")
    dark = gas.where("Mc > 0").withColumn("ptype", F.lit(1))
    rows = gas.unionByName(dark).drop("Mc").unionByName(fx.stars.withColumn("Zmet", F.lit(0.0)).select(*cols, F.lit(4).alias("ptype")))
    # the ids of a snapshot and type are ranked in ranges
    return running_total(rows, ["snapnum", "ptype"], [F.col("PId")], F.lit(1), "_rn").withColumn("idx", F.col("_rn") - 1).drop("_rn")


def _raw(kinds: DataFrame) -> DataFrame:
    """The raw names and shapes of a snapshot file."""
    metals = F.array(*[F.col("Zmet") + k for k in range(len(C.ELEMENTS))])
    return kinds.select("snapnum", "ptype", "idx", F.col("PId").alias("ParticleIDs"), F.col("Mass").alias("Masses"), metals.alias("Metallicity"))


def _lake_of(fx: Fixtures, kinds: DataFrame, **options) -> str:
    path = new_path(fx.particles.sparkSession)
    lake.build_lake(_raw(kinds), path, **options)
    return path


def _headers(kinds: DataFrame) -> DataFrame:
    n = lambda code, name: F.count_if(F.col("ptype") == code).alias(name)
    return kinds.groupBy("snapnum").agg(n(0, "n_gas"), n(1, "n_dark"), n(4, "n_star"))


def _listed(kinds: DataFrame, *ids: str) -> DataFrame:
    """Group rows of all types by their position in a group file: gas, then dark matter, then stars."""
    heads = _headers(kinds)
    before = F.when(F.col("ptype") == 1, F.col("n_gas")).when(F.col("ptype") == 4, F.col("n_gas") + F.col("n_dark")).otherwise(0)
    return kinds.join(heads, "snapnum").select("snapnum", (F.col("idx") + before).alias("idx"), *ids)


@query("SELECT snapnum, n_gas, n_dark, n_star, n_gas + n_dark + n_star AS n_tot, CAST(greatest(1 - snapnum, 0) AS DOUBLE) AS redshift, CAST(least(snapnum / 2.0, 1) AS DOUBLE) AS ascale FROM q_headers")
def snapshot_headers(fx):
    heads = _headers(_kinds(fx)).withColumns({"redshift": (1 - F.col("snapnum")).cast("double"), "ascale": F.col("snapnum") / 2.0})
    path = new_path(fx.particles.sparkSession)
    heads.write.parquet(path)
    return lake.snapshots(fx.particles.sparkSession, path).select("snapnum", "n_gas", "n_dark", "n_star", "n_tot", "redshift", "ascale")


@query("SELECT count(DISTINCT snapnum) AS n FROM fx_particles")
def snapshot_count(fx):
    spark = fx.particles.sparkSession
    stored = spark.read.parquet(_lake_of(fx, _kinds(fx)))
    return fx.table("region").agg(F.lit(lake.n_snaps(stored)).cast("long").alias("n"))


@query("SELECT snapnum, ptype, idx, PId, Mass, CAST(Zmet AS DOUBLE) AS Z, haloId FROM q_kinds")
def built_lake(fx):
    """Raw fields renamed and cast, metals cut down to the total, halo ids by position."""
    kinds = _kinds(fx)
    path = _lake_of(fx, kinds, groups=kinds.select("snapnum", "ptype", "idx", "haloId"))
    return fx.particles.sparkSession.read.parquet(path).select("snapnum", "ptype", "idx", "PId", "Mass", F.col("Z").cast("double"), "haloId")


@query(f"SELECT snapnum, idx, PId, CAST(Zmet + {C.ELEMENTS.index('O')} AS DOUBLE) AS O, CAST(Zmet AS DOUBLE) AS Z, 0.0e0 AS FractionH2 FROM q_kinds WHERE ptype = 0")
def lake_metals(fx):
    """Elements of the metals vector by name, and a field that the run did not write."""
    path = _lake_of(fx, _kinds(fx), total_metals=False)
    gas = lake.particles(fx.particles.sparkSession, path, "gas", ["PId", "O", "Z"])
    return _as_double(lake.with_default(gas, "FractionH2"), "O", "Z")


@query("SELECT snapnum, idx, PId, Mass, CAST(galId AS INT) AS galId, haloId, -haloId AS hostId FROM q_kinds WHERE ptype = 0")
def gas_view(fx):
    kinds = _kinds(fx)
    halos = _listed(kinds.withColumn("hostId", -F.col("haloId")), "haloId", "hostId")
    return lake.gas(fx.particles.sparkSession, _lake_of(fx, kinds), ["PId", "Mass"], galaxies=_listed(kinds, "galId"), halos=halos)


@query("SELECT snapnum, idx, PId, Mass, CAST(galId AS INT) AS galId, haloId, -haloId AS hostId FROM q_kinds WHERE ptype = 4")
def stars_view(fx):
    kinds = _kinds(fx)
    halos = _listed(kinds.withColumn("hostId", -F.col("haloId")), "haloId", "hostId")
    stars = lake.stars(fx.particles.sparkSession, _lake_of(fx, kinds), ["PId", "Mass"], _headers(kinds), galaxies=_listed(kinds, "galId"), halos=halos)
    return stars.drop("ptype")


@query("SELECT snapnum, idx, PId, haloId, -haloId AS hostId FROM q_kinds WHERE ptype = 1")
def dark_view(fx):
    kinds = _kinds(fx)
    halos = _listed(kinds.withColumn("hostId", -F.col("haloId")), "haloId", "hostId")
    return lake.dark(fx.particles.sparkSession, _lake_of(fx, kinds), _headers(kinds), halos)


@query("SELECT snapnum, PId, Mass, row_number() OVER (ORDER BY snapnum, PId) - 1 AS idx FROM fx_particles")
def multipart_positions(fx):
    """Snapshots stand for the parts of one."""
    parts = fx.particles.select(F.concat(F.lit("snap."), "snapnum", F.lit(".parquet")).alias("name"), F.col("PId").alias("at"), "snapnum", "PId", "Mass")
    path = _named_files(fx, parts, "parquet")
    return lake.particles_multipart(fx.particles.sparkSession, f"{path}/snap.*.parquet").select("snapnum", "PId", "Mass", "idx")


def _bucketed(fx: Fixtures) -> DataFrame:
    """Particles as a catalogue table in buckets of PId."""
    spark, name = fx.particles.sparkSession, f"halospark_{uuid4().hex}"
    rows = fx.particles.select(F.lit(1).alias("ptype"), "snapnum", F.col("PId").alias("idx"), F.col("PId").alias("ParticleIDs"))
    ids = fx.particles.select(F.lit(1).alias("ptype"), "snapnum", F.col("PId").alias("idx"), "haloId")
    lake.build_lake(rows, new_path(spark), ids, table=name, buckets=8)
    return spark.table(name)


@query("SELECT * FROM q_main")
def main_progenitor_stored(fx):
    """Snapshots joined bucket by bucket: the particles are not shuffled for the join."""
    return aggregates.main_progenitor(_bucketed(fx), int(fx.timegrid.agg(F.max("snapnum")).first()[0]))


@query("SELECT * FROM q_prog")
def progenitor_table_stored(fx):
    last = int(fx.timegrid.agg(F.max("snapnum")).first()[0])
    return rounded(progenitors.progenitor_table(_bucketed(fx), fx.log_halos, fx.hosts, last), "logMvir", "logMsub")


# == stored tables ===============================================================================================
@query("""SELECT snapnum, galId, round(Zgal, 9) AS Zgal, round(logMgal, 6) AS logMgal, Sfr
    FROM q_snaplog JOIN (SELECT snapnum, galId, CASE WHEN sum(Sfr) <> 0 THEN sum(Sfr * Zmet) / sum(Sfr) END AS Zgal FROM fx_particles GROUP BY snapnum, galId) USING (snapnum, galId)""")
def stored_attributes(fx):
    """Galaxy attributes as CSV with a declared schema."""
    spark, path = fx.particles.sparkSession, new_path(fx.particles.sparkSession)
    schema = schemas.fields("int snapnum", "int galId", "double Zgal", "double logMgal", "double Sfr")
    store.save(aggregates.galaxy_properties(fx.particles.withColumnRenamed("Zmet", "O"), _snaplog(fx)), path, "csv", schema, sort_by=["snapnum", "galId"])
    return rounded(rounded(store.load(spark, path, "csv", schema), "Zgal", digits=9), "logMgal")


@query("SELECT x, y, z, axis, label FROM q_sightlines")
def stored_sightlines(fx):
    """Sight-line files by direction, read back."""
    path = new_path(fx.particles.sparkSession)
    store.write_sightlines(sightlines.sightlines(fx.galaxies, 12, 75, 25000.0), path)
    return rounded(text.read_sightlines(fx.particles.sparkSession, path).select("x", "y", "z", "axis", "label"), "x", "y", "z")


@query("SELECT * FROM q_gp")
def history_with_added_columns(fx):
    """Mgain and relation kept beside a stored history, each written on its own."""
    spark, base, run, buckets = fx.particles.sparkSession, new_path(fx.particles.sparkSession), {"gal": TARGET}, (8, ["PId", "snapnum"])
    store.materialize(spark, base, "gptable", run, lambda: _history(fx).drop("Mgain"), buckets=buckets)
    gained = lambda rows: with_diff(rows, "PId", "snapnum", "Mass", "Mgain")
    related = lambda rows: progenitors.with_relation(rows, TARGET, _prog(fx), fx.hosts)
    store.add_column(spark, base, "gptable", run, "Mgain", gained, buckets)
    return store.add_column(spark, base, "gptable", run, "relation", related, buckets)
