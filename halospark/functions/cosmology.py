"""Cosmology columns: expansion rate, virial quantities of halos."""

from __future__ import annotations

from math import pi

from numpy.polynomial.legendre import leggauss
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C

# quadrature points of the distance integral: exact to ~1e-12 for z <= 30
ANGULAR_NODES = 32


def expansion(z: Column, om: float = C.OMEGA_M, ol: float = C.OMEGA_L) -> Column:
    """E(z) = H(z) / H0."""
    s = 1 + z
    return F.sqrt(om * s * s * s + (1.0 - om - ol) * s * s + ol)


def hubble(z: Column, h: float = C.HUBBLE, om: float = C.OMEGA_M, ol: float = C.OMEGA_L) -> Column:
    return expansion(z, om, ol) * (1.0e7 / C.MPC * h)


def virial_overdensity(z: Column, om: float = C.OMEGA_M, ol: float = C.OMEGA_L) -> Column:
    """Overdensity of a collapsed halo over the critical density (Bryan & Norman 1998 fit)."""
    s = 1 + z
    e = expansion(z, om, ol)
    x = om * s * s * s / (e * e) - 1
    return 18.0 * pi * pi + 82.0 * x - 39.0 * x * x


def virial_over_mean(z: Column, om: float = C.OMEGA_M) -> Column:
    """Virial density over the mean density for a flat universe with matter share ``om``."""
    if om == 1.0:
        return F.lit(178.0)
    matter = om * F.pow(1 + z, F.lit(3.0))
    w = (1.0 - om) / matter
    return 18.0 * pi * pi * (1 + 0.4093 * F.pow(w, F.lit(0.9052)))


def critical_density(z: Column, om: float = C.OMEGA_M, ol: float = C.OMEGA_L) -> Column:
    e = expansion(z, om, ol)
    return C.RHO_BAR * e * e


def circular_velocity(mass: Column, z: Column, h: float = C.HUBBLE) -> Column:
    return F.cbrt(10.0 * C.GRAVITY * mass * hubble(z, h))


def r200(mass: Column, z: Column, h: float = C.HUBBLE) -> Column:
    return circular_velocity(mass, z, h) / (10.0 * hubble(z, h))


def virial_radius(mass: Column, z: Column) -> Column:
    # 4.18779 is the rounded 4 pi / 3 of the definition in use
    return F.cbrt(mass / (4.18779 * virial_overdensity(z) * critical_density(z)))


def virial_velocity(mass: Column, z: Column) -> Column:
    return F.sqrt(F.try_divide(C.GRAVITY * mass, virial_radius(mass, z)))


def virial_temperature(mass: Column, z: Column) -> Column:
    v = virial_velocity(mass, z)
    return v * v * (0.60 * C.HYDROGEN_MASS / (2.0 * C.BOLTZMANN))


def isothermal_density(mass: Column, z: Column, r_over_rvir: float, h: float = C.HUBBLE) -> Column:
    """Number density of a singular isothermal sphere at a fraction of the virial radius."""
    v = circular_velocity(mass, z, h)
    r = virial_radius(mass, z) * r_over_rvir
    return F.try_divide(v * v, r * r) / (4.0 * pi * C.GRAVITY * 0.60 * C.HYDROGEN_MASS)


def with_virial(df: DataFrame, mass: str, z: str, astro: bool = True, h: float = C.HUBBLE) -> DataFrame:
    """Attach virial columns.  ``astro`` reads solar masses and writes kpc, km/s; otherwise all c.g.s."""
    m = F.col(mass) * (C.SOLAR_MASS if astro else 1.0)
    zz = F.col(z)
    length, speed = (C.KPC, 1.0e5) if astro else (1.0, 1.0)
    return df.withColumns(
        {
            "E": expansion(zz),
            "H": hubble(zz, h),
            "rho_crit": critical_density(zz),
            "overdensity_vir": virial_overdensity(zz),
            "Vc": circular_velocity(m, zz, h) / speed,
            "r200": r200(m, zz, h) / length,
            "rvir": virial_radius(m, zz) / length,
            "vvir": virial_velocity(m, zz) / speed,
            "Tvir": virial_temperature(m, zz),
            "n_sis": isothermal_density(m, zz, 0.1, h),
        }
    )


def angular_distance(z: Column, h: float = C.HUBBLE, om: float = C.OMEGA_M, ol: float = C.OMEGA_L) -> Column:
    """Angular diameter distance (c.g.s.): the integral of 1/E by Gauss-Legendre quadrature, inside the row."""
    nodes, weights = leggauss(ANGULAR_NODES)
    total = F.lit(0.0)
    for x, w in zip(nodes, weights, strict=True):
        total = total + float(w) / expansion(z * (0.5 + 0.5 * float(x)), om, ol)
    return total * z / 2 * (C.LIGHT_SPEED / (1.0e7 / C.MPC * h)) / (1 + z)
