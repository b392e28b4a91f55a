"""Derived particle and halo columns.  Everything stays inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C


def log10_or_null(x: Column) -> Column:
    """log10 that is NULL for x <= 0 (no infinities are stored in tables)."""
    return F.when(x > 0, F.log10(x))


def metal(element: str, col: str = "Metals") -> Column:
    """One element of the metals vector; the name becomes an ordinal at plan time."""
    return F.get(F.col(col), F.lit(C.ELEMENTS.index(element)))


# -- temperature and density ------------------------------------------------------------------------------
def mean_weight(ne: Column, helium: Column | float) -> Column:
    helium = helium if isinstance(helium, Column) else F.lit(helium)
    return (1 + 4 * helium) / (1 + ne + helium)


def log_temperature(u: Column, ne: Column, helium: Column, u_unit: float = C.CODE_VELOCITY**2) -> Column:
    """log10(T) from specific internal energy u = 3/2 kT / (mu m_H)."""
    t = u.cast("double") * u_unit * mean_weight(ne.cast("double"), helium.cast("double")) * (
        C.HYDROGEN_MASS / (1.5 * C.BOLTZMANN)
    )
    return log10_or_null(t).cast("float")


def with_logT(df: DataFrame, u: str = "U", ne: str = "Ne", helium: str = "Y", out: str = "logT") -> DataFrame:
    return df.withColumn(out, log_temperature(F.col(u), F.col(ne), F.col(helium)))


def with_phase(
    df: DataFrame, h: float = C.HUBBLE, rho: str = "Rho", u: str = "U", ne: str = "Ne"
) -> DataFrame:
    """``LogRho`` (baryon overdensity) and ``LogT`` as the phase grid defines them (fixed hydrogen share)."""
    helium = (1.0 - C.HYDROGEN_FRACTION) / (4.0 * C.HYDROGEN_FRACTION)
    density = F.col(rho).cast("double") * (C.CODE_MASS / C.CODE_LENGTH**3 * h * h)
    t = (
        F.col(u).cast("double")
        * C.CODE_VELOCITY**2
        * (2.0 / 3.0 * C.GRID_PROTON_MASS / C.GRID_BOLTZMANN)
        * mean_weight(F.col(ne).cast("double"), helium)
    )
    return df.withColumns(
        {
            "LogRho": log10_or_null(density / (C.GRID_RHO_CRIT * h * h * C.OMEGA_B)).cast("float"),
            "LogT": log10_or_null(t).cast("float"),
        }
    )


def log_nh(log_overdensity: Column) -> Column:
    """Axis change of the phase diagram: log baryon overdensity -> log hydrogen number density."""
    # fixed values of this axis: critical density, h, baryon share
    shift = 1.879e-29 * 0.7 * 0.7 * 0.044 * 0.76 / C.HYDROGEN_MASS
    return F.log10(F.pow(F.lit(10.0), log_overdensity) * shift)


def log_nh_of_density(rho: Column) -> Column:
    """log10 of the hydrogen number density that the ion tables are laid out in, from a physical density in g/cm^3."""
    return log10_or_null(rho.cast("double") / C.ION_HYDROGEN_MASS)


def rho_thresh(z: Column, om: float = C.OMEGA_M, ol: float = C.OMEGA_L) -> Column:
    """Density threshold that separates bound from diffuse gas at redshift z."""
    matter = om * F.pow(1 + z, F.lit(3.0))
    f = matter / (matter + ol)
    return 6.0 * math.pi**2 * (1 + 0.4093 * F.pow(1 / f - 1, F.lit(0.9052))) - 1


def phase_region(log_rho: Column, logT: Column, z: Column) -> Column:
    """Label of the four regions drawn on the phase diagram."""
    edge = F.log10(rho_thresh(z) + 1)
    return (
        F.when((logT >= 5.0) & (log_rho < edge), "WHIM")
        .when(logT >= 5.0, "Hot")
        .when(log_rho < edge, "Diffuse")
        .otherwise("Condensed")
    )


# -- masses and positions ---------------------------------------------------------------------------------
def with_log_galaxy_mass(
    df: DataFrame, mass_unit: float, cols: tuple[str, ...] = ("Mgal", "Mgas", "Mstar")
) -> DataFrame:
    """Replace galaxy masses in simulation units by ``log<name>`` in solar masses."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns(
        {f"log{c}": log10_or_null(F.col(c) * (mass_unit / C.SOLAR_MASS)) for c in present}
    ).drop(*present)


def with_log_halo_mass(df: DataFrame, h: float = C.HUBBLE, cols: tuple[str, ...] = ("Mvir", "Msub")) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.withColumns({f"log{c}": log10_or_null(F.col(c) / h) for c in present}).drop(*present)


def to_box(df: DataFrame, boxsize: float, cols: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Box-normalized coordinates in [-0.5, 0.5] -> lengths in [0, boxsize]."""
    return df.withColumns({c: (F.col(c) + 0.5) * boxsize for c in cols})


def wrap_unit(x: Column) -> Column:
    """One periodic wrap of a box-normalized coordinate."""
    return F.when(x < -0.5, x + 1).when(x > 0.5, x - 1).otherwise(x)


def halo_box(df: DataFrame, rlim: float, radius: str = "Rvir") -> DataFrame:
    """Limits of the cube ``centre +- rlim * radius`` as xlo,xhi,ylo,yhi,zlo,zhi."""
    half = F.col(radius) * rlim
    return df.withColumns(
        {f"{axis}{side}": F.col(axis) + sign * half for axis in "xyz" for side, sign in (("lo", -1), ("hi", 1))}
    )


# -- drawing attributes -----------------------------------------------------------------------------------
def with_marker(df: DataFrame, logT: str = "logT", sfr: str = "Sfr", mc: str = "Mc") -> DataFrame:
    """Kind, colour value and size of a particle marker; wind beats star-forming beats plain gas."""
    wind, forming = F.col(mc) > 0, F.col(sfr) > 0
    shade = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(logT) - 4.0) / 2.5))
    return df.withColumns(
        {
            "kind": F.when(wind, "wind").when(forming, "sfr").otherwise("gas"),
            "shade": F.when(wind, F.col(mc).cast("double")).when(forming, F.lit(None)).otherwise(shade),
            "size": F.when(wind, 20.0 * F.col(mc) * F.col(mc)).otherwise(F.lit(5.0)),
        }
    )


def with_cloud_radius(df: DataFrame, h: float = C.HUBBLE, rc: str = "Rc", mass: str = "Mass", mc: str = "Mc") -> DataFrame:
    """Size of the whole cloud ensemble a wind particle stands for."""
    clouds = F.try_divide(F.col(mass) * (1.0e10 / h / 1.0e5), F.col(mc))
    return df.withColumn(rc, F.col(rc) * F.sqrt(clouds))


def with_ion_mass(df: DataFrame, mass: str = "Mass", carbon: str = "C", oxygen: str = "O") -> DataFrame:
    """Ion masses from the ion fractions ``fHI, fCIV, fOVI, fNeVIII, fSiIV``; Ne and Si scale with oxygen."""
    m, o = F.col(mass), F.col(oxygen) / C.SOLAR["O"]
    return df.withColumns(
        {
            "MHI": m * C.HYDROGEN_FRACTION * F.col("fHI"),
            "MCIV": m * F.col(carbon) * F.col("fCIV"),
            "MOVI": m * F.col(oxygen) * F.col("fOVI"),
            "MNeVIII": m * o * C.SOLAR["Ne"] * F.col("fNeVIII"),
            "MSiIV": m * o * C.SOLAR["Si"] * F.col("fSiIV"),
        }
    )


def relation(prog_id: Column, prog_host: Column, halo_id: Column, host_id: Column) -> Column:
    """How a halo relates to the target's progenitor; the order of the tests decides, NULLs fall to IGM."""
    return (
        F.when(prog_id == 0, C.IGM)
        .when(prog_id == halo_id, C.SELF)
        .when(prog_host == halo_id, C.PARENT)
        .when(prog_id == host_id, C.SAT)
        .when(prog_host == host_id, C.SIB)
        .otherwise(C.IGM)
    )
