"""Filters and small selections.  Id lists are DataFrames, never Python lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from .joins import join_skewed
from .ordered import group_quantiles


def gas_in_galaxy(particles: DataFrame, snapnum: int, gal_id: int) -> DataFrame:
    return particles.where((F.col("snapnum") == snapnum) & (F.col("galId") == gal_id)).select("PId")


def stars_in_galaxy(stars: DataFrame, snapnum: int, gal_id: int) -> DataFrame:
    return gas_in_galaxy(stars, snapnum, gal_id)


def gas_in_halo(particles: DataFrame, snapnum: int, halo_id: int, include_ism: bool = False) -> DataFrame:
    """Ids of a halo's gas; star-forming gas only on request."""
    rows = particles.where((F.col("snapnum") == snapnum) & (F.col("haloId") == halo_id))
    return (rows if include_ism else rows.where("Sfr = 0")).select("PId")


def by_mass(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    if low > high:
        raise ValueError("low must not exceed high")
    return df.where(F.col(col).between(low, high))


def halos_by_mass(halos: DataFrame, low: float, high: float, central_only: bool = True, index_only: bool = False) -> DataFrame:
    rows = by_mass(halos, "logMsub" if central_only else "logMvir", low, high)
    return rows.select(*[c for c in ("snapnum", "haloId") if c in rows.columns]) if index_only else rows


def galaxies_by_mass(galaxies: DataFrame, low: float, high: float, index_only: bool = False) -> DataFrame:
    rows = by_mass(galaxies, "logMgal", low, high)
    return rows.select(*[c for c in ("snapnum", "galId") if c in rows.columns]) if index_only else rows


def galaxies_by_percentile(
    galaxies: DataFrame, low: float, high: float, col: str = "logMgal", index_only: bool = False
) -> DataFrame:
    """Galaxies between two exact mass quantiles of their snapshot, both ends included."""
    if low > high:
        raise ValueError("low must not exceed high")
    keys = [c for c in ("snapnum",) if c in galaxies.columns]
    edges = group_quantiles(galaxies, keys, col, {"_lo": low, "_hi": high})
    placed = galaxies.join(edges, keys) if keys else galaxies.withColumns({c: edges.select(c).scalar() for c in ("_lo", "_hi")})
    rows = placed.where((F.col(col) >= F.col("_lo")) & (F.col(col) <= F.col("_hi"))).select(*galaxies.columns)
    return rows.select(*[c for c in ("snapnum", "galId") if c in rows.columns]) if index_only else rows


def wind_in_halos(particles: DataFrame, halos: DataFrame) -> DataFrame:
    """Wind particles of the given (snapnum, haloId) rows; halos without wind drop out."""
    wanted = halos.where("haloId > 0").select("snapnum", "haloId")
    wind = particles.where("Mc > 0 and haloId > 0").select("haloId", "snapnum", "PId")
    return join_skewed(wind, wanted, ["snapnum", "haloId"], salt_on=["PId"]).select("haloId", "snapnum", "PId")


Limits = tuple[float, float]


def _inside(df: DataFrame, limits: dict[str, Limits | None]) -> DataFrame:
    for col, lim in limits.items():
        if lim is not None:
            df = df.where((F.col(col) > lim[0]) & (F.col(col) < lim[1]))
    return df


def in_window(df: DataFrame, xlim: Limits | None = None, ylim: Limits | None = None, zlim: Limits | None = None) -> DataFrame:
    """Open-interval window on positions."""
    return _inside(df, {"x": xlim, "y": ylim, "z": zlim})


def wind_layer(df: DataFrame, xlim: Limits, ylim: Limits, zlim: Limits) -> DataFrame:
    """Wind particles of a map; x and y limits count only when their lower end is positive."""
    return _inside(
        df.where("Mc > 0"),
        {"x": xlim if xlim[0] > 0 else None, "y": ylim if ylim[0] > 0 else None, "z": zlim},
    )


def halo_layer(halos: DataFrame, zlim: Limits, rmin: float = 100.0) -> DataFrame:
    return _inside(halos, {"z": zlim}).where(F.col("Rvir") > rmin)


def halo_info(halos: DataFrame, snapnum: int, halo_id: int) -> DataFrame:
    """Centre, radius and mass of one halo; evaluating it for an unknown (snapnum, haloId) is an error."""
    row = halos.where((F.col("snapnum") == snapnum) & (F.col("haloId") == halo_id))
    found = F.when(F.count("*") > 0, F.lit(halo_id)).otherwise(
        F.raise_error(F.lit(f"haloId {halo_id} not found at snapnum {snapnum}"))
    )
    cols = ["Rvir", "logMvir", "x", "y", "z"]
    return row.agg(F.lit(snapnum).alias("snapnum"), found.alias("haloId"), *[F.first(c).alias(c) for c in cols])


def particles_in_box(particles: DataFrame, halos: DataFrame, snapnum: int, halo_id: int, rlim: float) -> DataFrame:
    """Particles of a snapshot in the cube ``centre +- rlim * Rvir``; limits arrive as one scalar subquery."""
    half = F.col("Rvir") * rlim
    particles = particles.where(F.col("snapnum") == snapnum)
    box = (
        halos.where((F.col("snapnum") == snapnum) & (F.col("haloId") == halo_id))
        .agg(
            F.struct(
                *[F.first(F.col(c) - half).alias(f"{c}lo") for c in "xyz"],
                *[F.first(F.col(c) + half).alias(f"{c}hi") for c in "xyz"],
            )
        )
        .scalar()
    )
    for c in "xyz":
        particles = particles.where((F.col(c) > box[f"{c}lo"]) & (F.col(c) < box[f"{c}hi"]))
    return particles


def particles_of_halo(particles: DataFrame, snapnum: int, halo_id: int, cols: list[str] | None = None) -> DataFrame:
    rows = particles.where((F.col("snapnum") == snapnum) & (F.col("haloId") == halo_id))
    return rows.select(*cols) if cols else rows


def with_mass_bin(df: DataFrame, log_mh: str = "logMsub", log_ms: str = "logMstar", out: str = "mbin") -> DataFrame:
    """Sight-line target class 11, 12 or 13 from halo and stellar mass (all limits open)."""

    def between(col: str, low: float, high: float):
        return (F.col(col) > low) & (F.col(col) < high)

    # fixed values: mass windows of the three classes
    return df.withColumn(
        out,
        F.when(between(log_mh, 10.75, 11.25) & between(log_ms, 8.3, 9.3), 11)
        .when(between(log_mh, 11.75, 12.25) & between(log_ms, 9.7, 10.75), 12)
        .when(between(log_mh, 12.75, 13.25), 13),
    )


def launched_between(launches: DataFrame, amin: float, amax: float, col: str = "atime") -> DataFrame:
    return launches.where((F.col(col) >= amin) & (F.col(col) < amax))


def hot_history(df: DataFrame, threshold: float = C.LOGT_THRESHOLD, col: str = "Tmax") -> DataFrame:
    return df.where(F.col(col) > threshold)


def top_halos(halos: DataFrame, n: int = 5, col: str = "Mvir") -> DataFrame:
    """The n most massive halos; equal masses by id."""
    return halos.orderBy(F.desc(col), "snapnum", "haloId").limit(n)


def find_snapnum(grid: DataFrame, z: float) -> DataFrame:
    """The snapshot closest to redshift z (the earlier one on a tie)."""
    return grid.agg(
        F.min_by("snapnum", F.struct(F.abs(F.col("zred") - z).alias("d"), F.col("snapnum"))).alias("snapnum")
    )


def find_snapnums(grid: DataFrame, redshifts: list[float]) -> DataFrame:
    """(z, snapnum) for many redshifts at once; join it to a catalogue to analyse one epoch per redshift."""
    asked = F.explode(F.array(*[F.lit(float(z)) for z in redshifts]))
    return (
        grid.select("snapnum", "zred", asked.alias("z"))
        .groupBy("z")
        .agg(F.min_by("snapnum", F.struct(F.abs(F.col("zred") - F.col("z")).alias("d"), F.col("snapnum"))).alias("snapnum"))
    )
