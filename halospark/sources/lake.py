"""The particle lake: one Parquet table of all snapshots, partitioned by ptype and snapnum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.physics import metal, with_logT
from ..operators.joins import attach_group_ids
from ..operators.ordered import running_total
from . import schemas

_KEYS = ("ptype", "snapnum", "idx")


def build_lake(
    raw: DataFrame,
    out: str,
    groups: DataFrame | None = None,
    total_metals: bool = True,
    table: str | None = None,
    buckets: int | None = None,
) -> None:
    """Write landed particles (raw field names plus ptype, snapnum, idx) as the lake.

    Fields become their short names and declared types, missing fields are left out, ``Metals`` is reduced to the
    total metallicity ``Z`` when ``total_metals``.  ``groups`` (snapnum, ptype, idx, haloId, ...) is joined by
    position.  Rows of a file are sorted by PId so that row-group statistics prune look-ups.

    With ``table`` and ``buckets`` the lake becomes a catalogue table bucketed by PId instead: joins of snapshots
    on PId (progenitors, histories) then need no shuffle of the particles.
    """
    present = set(raw.columns)
    cols = []
    for short, (name, kind) in schemas.PARTICLE_FIELDS.items():
        if name not in present:
            continue
        if short == "Metals" and total_metals:
            cols.append(F.get(F.col(name), F.lit(0)).cast("float").alias("Z"))
        else:
            cols.append(F.col(name).cast(kind).alias(short))
    df = raw.select(*_KEYS, *cols)
    if groups is not None:
        ids = [c for c in groups.columns if c not in _KEYS]
        df = df.join(groups, list(_KEYS), "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ids})
    if table is not None:
        (
            df.repartition(buckets, "PId")
            .write.mode("overwrite")
            .partitionBy("ptype", "snapnum")
            .bucketBy(buckets, "PId")
            .sortBy("PId")
            .option("path", out)
            .saveAsTable(table)
        )
        return
    (
        df.repartitionByRange("ptype", "snapnum", "PId")
        .sortWithinPartitions("ptype", "snapnum", "PId")
        .write.mode("overwrite")
        .partitionBy("ptype", "snapnum")
        .parquet(out)
    )


def particles(
    spark: SparkSession,
    lake: str,
    ptype: str,
    columns: list[str] | None = None,
    snapnum: int | list[int] | None = None,
) -> DataFrame:
    """Particles of one type; ``columns`` may name stored fields, x/y/z, elements of Metals, and logT (gas).

    A field the lake does not have is an AnalysisException, an unknown type a KeyError, a type without rows an
    empty table.
    """
    df = spark.read.parquet(lake).where(F.col("ptype") == C.PTYPE[ptype])
    if snapnum is not None:
        wanted = [snapnum] if isinstance(snapnum, int) else list(snapnum)
        df = df.where(F.col("snapnum").isin(wanted))
    if columns is None:
        return df
    stored = set(df.columns)
    if "logT" in columns and "logT" not in stored:
        if ptype != "gas":
            raise ValueError("logT is defined for gas only")
        helium = F.col("Y") if "Y" in stored else metal("Y")
        df = with_logT(df.withColumn("_helium", helium), helium="_helium")

    def column(name: str):
        if name in df.columns:
            return F.col(name)
        if name in ("x", "y", "z"):
            return F.col(f"Pos.{name}").alias(name)
        if name in C.ELEMENTS and "Metals" in stored:
            return metal(name).alias(name)
        return F.col(name)

    return df.select("snapnum", "idx", *[column(c) for c in columns if c not in ("snapnum", "idx")])


def _with_groups(df: DataFrame, groups: list[DataFrame | None], headers: DataFrame | None) -> DataFrame:
    """Attach each given group table by position; a lake built with group columns needs none."""
    for g in groups:
        if g is not None:
            df = attach_group_ids(df, g, headers)
    return df


def gas(
    spark: SparkSession,
    lake: str,
    columns: list[str],
    snapnum: int | list[int] | None = None,
    galaxies: DataFrame | None = None,
    halos: DataFrame | None = None,
) -> DataFrame:
    """Gas with galId (``galaxies``) and haloId, hostId (``halos``); 0 where a group file has no row."""
    return _with_groups(particles(spark, lake, "gas", columns, snapnum), [galaxies, halos], None)


def stars(
    spark: SparkSession,
    lake: str,
    columns: list[str],
    headers: DataFrame,
    snapnum: int | list[int] | None = None,
    galaxies: DataFrame | None = None,
    halos: DataFrame | None = None,
) -> DataFrame:
    """Stars like :func:`gas`; ``headers`` give the position of the first star in the group files."""
    rows = particles(spark, lake, "star", columns, snapnum).withColumn("ptype", F.lit(C.PTYPE["star"]))
    return _with_groups(rows, [galaxies, halos], headers)


def dark(
    spark: SparkSession,
    lake: str,
    headers: DataFrame,
    halos: DataFrame,
    snapnum: int | list[int] | None = None,
) -> DataFrame:
    """Dark matter particles: PId, haloId, hostId."""
    rows = particles(spark, lake, "dark", ["PId"], snapnum).withColumn("ptype", F.lit(C.PTYPE["dark"]))
    return _with_groups(rows, [halos], headers).select("snapnum", "idx", "PId", "haloId", "hostId")


def with_default(df: DataFrame, col: str, value: float = 0.0) -> DataFrame:
    """Add an optional field that this run did not write."""
    return df if col in df.columns else df.withColumn(col, F.lit(value))


def with_mass(df: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Particle masses, replaced by the header's constant mass of the type where that is not 0."""
    # a few rows per snapshot, so at most a time grid's worth of headers is broadcast
    heads = snapshots.groupBy("snapnum").agg(F.first("mass_table").alias("mass_table"))
    table = heads.select("snapnum", F.posexplode("mass_table").alias("ptype", "_m0"))
    return (
        df.join(F.broadcast(table), ["snapnum", "ptype"], "left")
        .withColumn("Mass", F.when(F.col("_m0") != 0, F.col("_m0")).otherwise(F.col("Mass")))
        .drop("_m0")
    )


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot headers with redshift and scale factor kept in their physical range, and the total count."""
    df = spark.read.parquet(path)
    return df.withColumns(
        {
            "redshift": F.greatest(F.col("redshift"), F.lit(0.0)),
            "ascale": F.least(F.col("ascale"), F.lit(1.0)),
            "n_tot": F.col("n_gas") + F.col("n_dark") + F.col("n_star"),
        }
    )


def n_snaps(lake: DataFrame) -> int:
    """Number of snapshots; on a lake this reads partition values and file footers, no particle column."""
    return lake.select("snapnum").distinct().count()


def particles_multipart(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One snapshot in part files ``name.K.parquet``: all rows with ``idx`` counting through the parts in order.

    The rows of the parts are counted and summed up in ranges of their numbers; rows meet the sums under the part's number,
    eight bytes, which Spark sends to the rows where the number of parts allows it.  Two files of one number are an error.
    """
    paths = [paths] if isinstance(paths, str) else paths
    part = F.regexp_extract(F.col("_metadata.file_name"), r"\.(\d+)(?:\.[^./]*)?$", 1).cast("long")
    files = spark.read.parquet(*paths)
    rows = files.select("*", part.alias("_part"), F.col("_metadata.row_index").alias("_row"))
    # from the files' footers: no column is read
    counts = files.select(part.alias("_part"), F.xxhash64(F.col("_metadata.file_path")).alias("_file")).groupBy("_part").agg(
        F.count("*").alias("_n"), F.min("_file").alias("_file"), F.max("_file").alias("_other")
    )
    one = F.when(F.col("_file") == F.col("_other"), F.col("_n")).otherwise(F.raise_error(F.lit("two files have one part number")))
    through = running_total(counts.select("_part", one.alias("_n")), [], [F.col("_part")], F.col("_n"), "_through")
    offsets = through.select("_part", (F.col("_through") - F.col("_n")).alias("_offset"))
    return rows.join(offsets, "_part").withColumn("idx", F.col("_offset") + F.col("_row")).drop("_part", "_row", "_offset")
