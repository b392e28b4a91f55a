"""Aggregates over particles, halos and galaxies.

All are plain ``groupBy().agg()`` with map-side partial aggregation, so a hot halo costs no extra shuffle volume;
``haloId = 0`` (in no halo) is filtered before the shuffle wherever the result does not need it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from math import log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.physics import log10_or_null
from .joins import join_skewed
from .ordered import group_quantiles, with_cumsum


def main_progenitor(dark: DataFrame, snapnum: int) -> DataFrame:
    """(haloId, snapnum, progId): the earlier halo that holds most of a halo's dark particles.

    Only particles in a halo at both times count; on a tie the larger progId wins.
    """
    hosted = dark.where("haloId > 0").select("PId", "snapnum", "haloId")
    now = hosted.where(F.col("snapnum") == snapnum).select("PId", "haloId")
    early = hosted.where(F.col("snapnum") < snapnum).withColumnRenamed("haloId", "progId")
    shared = early.join(now, "PId").groupBy("snapnum", "haloId", "progId").agg(F.count("*").alias("n"))
    return shared.groupBy("haloId", "snapnum").agg(F.max_by("progId", F.struct("n", "progId")).alias("progId"))


def distinct_halos(df: DataFrame, snap: str = "snapnum", halo: str = "haloId") -> DataFrame:
    """The (snapnum, haloId) pairs a table touches, without 'no halo'."""
    return df.where(F.col(halo) != 0).select(F.col(snap).alias("snapnum"), F.col(halo).alias("haloId")).distinct()


def halo_components(
    gas: DataFrame, stars: DataFrame, halos: DataFrame, tcut: float = C.LOGT_THRESHOLD
) -> DataFrame:
    """Baryon budget of every catalogue halo: Mcold, Mhot, Mism, Mstar (0 where a phase is empty).

    Gas and stars go through one aggregation: the star mass is one more conditional sum of the same groupBy.
    """
    key = ["snapnum", "haloId"]
    g = gas.where("haloId <> 0").select(*key, "Mass", "Sfr", "logT", F.lit(False).alias("is_star"))
    s = stars.where("haloId <> 0").select(*key, "Mass", F.lit(True).alias("is_star"))
    quiet = ~F.col("is_star") & (F.col("Sfr") == 0)

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("Mass")).otherwise(0.0))

    parts = {
        "Mcold": total(quiet & (F.col("logT") < tcut)),
        "Mhot": total(quiet & (F.col("logT") > tcut)),
        "Mism": total(~F.col("is_star") & (F.col("Sfr") > 0)),
        "Mstar": total(F.col("is_star")),
    }
    budget = g.unionByName(s, allowMissingColumns=True).groupBy(*key).agg(*[e.alias(n) for n, e in parts.items()])
    return halos.join(budget, key, "left").withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in parts})


def galaxy_properties(
    gas: DataFrame, galaxies: DataFrame, oxygen: bool = True, sfr_weighted: bool = True
) -> DataFrame:
    """Gas metallicity of galaxies, weighted by star formation or mass, next to their masses."""
    key = [c for c in ("snapnum", "galId") if c in gas.columns and c in galaxies.columns]
    weight = F.col("Sfr" if sfr_weighted else "Mass")
    metals = F.col("O" if oxygen else "Z")
    z = gas.groupBy(*key).agg(F.try_divide(F.sum(weight * metals), F.sum(weight)).alias("Zgal"))
    keep = [c for c in ("logMgal", "logMgas", "logMstar", "Sfr") if c in galaxies.columns]
    return z.join(galaxies.select(*key, *keep), key)


def mass_by_tag(df: DataFrame, tag: str, value: str, total: bool = False) -> DataFrame:
    """Sum of ``value`` per (snapnum, tag), optionally with a ``TOT`` row per snapshot."""
    if not total:
        return df.groupBy("snapnum", tag).agg(F.sum(value).alias(value))
    sums = df.groupingSets([[F.col("snapnum"), F.col(tag)], [F.col("snapnum")]], "snapnum", tag).agg(
        F.sum(value).alias(value), F.grouping(tag).alias("_all")
    )
    return sums.withColumn(tag, F.when(F.col("_all") == 1, "TOT").otherwise(F.col(tag))).drop("_all")


def accumulated_by_tag(df: DataFrame, tag: str, value: str) -> DataFrame:
    """Running total per tag over the snapshots; summed per (snapnum, tag) first, so groups are tiny."""
    return with_cumsum(mass_by_tag(df, tag, value), [tag], "snapnum", value, f"{value}_cum")


def accumulated_per_particle(df: DataFrame, tag: str = "birthTag", value: str = "Mgain") -> DataFrame:
    """Σ over particles of their own running totals, per (snapnum, tag), with TOT rows."""
    filled = df.select(
        "PId", "snapnum", F.coalesce(F.col(tag), F.lit(C.IGM)).alias(tag), F.coalesce(F.col(value), F.lit(0.0)).alias(value)
    )
    return mass_by_tag(with_cumsum(filled, ["PId", tag], "snapnum", value, value), tag, value, total=True)


def wind_fraction(gas: DataFrame, wind: str = "Mwind", mass: str = "Mass") -> DataFrame:
    return gas.where("haloId <> 0").groupBy("snapnum", "haloId").agg(
        F.try_divide(F.sum(wind), F.sum(mass)).alias("fwind")
    )


def halo_metallicity(gas: DataFrame, metals: str = "Z", mass: str = "Mass") -> DataFrame:
    return gas.where("haloId <> 0").groupBy("snapnum", "haloId").agg(
        F.try_divide(F.sum(F.col(mass) * F.col(metals)), F.sum(mass)).alias("Zhalo")
    )


def particle_counts(particles: DataFrame) -> DataFrame:
    """Particles per type and in total for every snapshot."""
    return (
        particles.groupBy("snapnum", "ptype")
        .agg(F.count("*").alias("n"))
        .groupBy("snapnum")
        .agg(
            *[
                F.sum(F.when(F.col("ptype") == code, F.col("n")).otherwise(0)).alias(f"n_{name}")
                for name, code in C.PTYPE.items()
            ],
            F.sum("n").alias("n_tot"),
        )
    )


def catalogue_counts(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("snapnum").agg(F.count("*").alias("n"))


# -- statistics of galaxies and halos ---------------------------------------------------------------------
def _bin(col: str, width: float) -> Column:
    return F.floor(F.col(col) / width)


def gsmf(galaxies: DataFrame, box: float, h: float = C.HUBBLE, width: float = 0.2, mass: str = "logMstar") -> DataFrame:
    """Stellar mass function: log10 of the count per dex and Mpc^3, per mass bin; empty bins are absent."""
    key = [c for c in ("snapnum",) if c in galaxies.columns]
    volume = (box / 1000.0 / h) ** 3
    return (
        galaxies.where(F.col(mass).isNotNull())
        .groupBy(*key, _bin(mass, width).alias("bin"))
        .agg(F.count("*").alias("n"))
        .select(
            *key,
            ((F.col("bin") + 0.5) * width).alias("logM"),
            "n",
            (F.log10(F.col("n")) - log10(width * volume)).alias("logPhi"),
        )
    )


def central_pairs(galaxies: DataFrame, halos: DataFrame, hosts: DataFrame) -> DataFrame:
    """Galaxies joined with their halo's masses, central ones only: those whose halo is its own host.

    Galaxies and halos share their ids.
    """
    key = ["snapnum", "haloId"]
    central = hosts.where("hostId = haloId").select(*key)
    return galaxies.withColumnRenamed("galId", "haloId").join(halos, key).join(central, key, "left_semi")


def smhm(pairs: DataFrame, width: float = 0.2, halo_mass: str = "logMsub", star_mass: str = "logMstar") -> DataFrame:
    """Stellar-halo mass relation of centrals: median and 16/84 per cent of log(M*/Mh) per halo mass bin."""
    key = [c for c in ("snapnum",) if c in pairs.columns]
    ratio = pairs.select(
        *key, _bin(halo_mass, width).alias("bin"), (F.col(star_mass) - F.col(halo_mass)).alias("ratio")
    )
    found = group_quantiles(ratio, [*key, "bin"], "ratio", {"p16": 0.16, "median": 0.5, "p84": 0.84})
    return found.select(*key, ((F.col("bin") + 0.5) * width).alias("logMh"), "median", "p16", "p84")


def for_redshifts(
    statistic: Callable[[DataFrame], DataFrame], table: DataFrame, grid: DataFrame, redshifts: list[float]
) -> DataFrame:
    """A statistic keyed by snapnum for a list of redshifts at once: each stands for the snapshot nearest to it.

    Rows carry ``zred`` as asked for; of two equally near snapshots the later counts.
    """
    nearest = [
        F.struct(F.lit(float(z)).alias("zred"), F.max_by("snapnum", F.struct(-F.abs(F.col("zred") - z), "snapnum")).alias("snapnum"))
        for z in redshifts
    ]
    wanted = grid.agg(F.array(*nearest).alias("w")).select(F.inline("w"))
    chosen = table.join(wanted.select("snapnum").distinct(), "snapnum", "left_semi")
    return statistic(chosen).join(wanted, "snapnum")


def mzr(properties: DataFrame, width: float | None = None) -> DataFrame:
    """Mass-metallicity relation with [O/H]; with ``width`` the median per stellar mass bin."""
    key = [c for c in ("snapnum",) if c in properties.columns]
    points = properties.select(
        *key, "logMstar", "Zgal", log10_or_null(F.col("Zgal") / C.SOLAR["O"]).alias("OH")
    )
    if width is None:
        return points
    binned = points.select(*key, _bin("logMstar", width).alias("bin"), "OH")
    return group_quantiles(binned, [*key, "bin"], "OH", {"median": 0.5}).select(
        *key, ((F.col("bin") + 0.5) * width).alias("logM"), "median"
    )


def radial_profile(
    particles: DataFrame, halos: DataFrame, nbins: int = 20, rmax: float = 1.0, boxsize: float | None = None
) -> DataFrame:
    """Mass, density and mass-weighted logT in shells of r/Rvir around every halo.

    ``boxsize`` turns on the nearest periodic image.  A massive halo is spread over several tasks for the join and
    comes together again as partial sums per shell.
    """
    key = [c for c in ("snapnum", "haloId") if c in particles.columns and c in halos.columns]
    centres = halos.select(*key, "Rvir", *[F.col(c).alias(f"_{c}") for c in "xyz"])
    inside = particles.where("haloId <> 0").select(*key, "x", "y", "z", "Mass", "logT")
    near = join_skewed(inside, centres, key, salt_on=["x", "y", "z"])

    def offset(axis: str) -> Column:
        d = F.abs(F.col(axis) - F.col(f"_{axis}"))
        return d if boxsize is None else F.least(d, boxsize - d)

    r = F.sqrt(offset("x") * offset("x") + offset("y") * offset("y") + offset("z") * offset("z"))
    shells = (
        near.withColumn("_r", F.try_divide(r, F.col("Rvir")))
        .where(F.col("_r") < rmax)
        .groupBy(*key, "Rvir", F.floor(F.col("_r") * (nbins / rmax)).alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.sum("Mass").alias("Mass"),
            F.try_divide(F.sum(F.col("Mass") * F.col("logT")), F.sum("Mass")).alias("logT"),
        )
    )
    width = rmax / nbins
    inner, outer = F.col("bin") * width * F.col("Rvir"), (F.col("bin") + 1) * width * F.col("Rvir")
    shell = (4.0 * math.pi / 3.0) * (outer * outer * outer - inner * inner * inner)
    return shells.select(
        *key, "bin", ((F.col("bin") + 0.5) * width).alias("r"), "n", "Mass", (F.col("Mass") / shell).alias("rho"), "logT"
    )
