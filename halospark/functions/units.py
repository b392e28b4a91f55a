"""Unit systems: code units, box-normalized units, display units; comoving <-> physical with the scale factor.

A unit system is a plain dict ``kind -> size in c.g.s.``; converting a column is one multiplication, and the
scale-factor part is a column so that one job covers all snapshots.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C

KINDS = ("length", "mass", "time", "velocity", "density", "energy", "magneticfield")
# power of the scale factor that turns a comoving value into a physical one
_A_POWER = {"length": 1.0, "velocity": 0.5, "density": -3.0}


def display_units() -> dict[str, float]:
    return dict(C.SYSTEM_UNITS)


def code_units(h: float) -> dict[str, float]:
    """Comoving units of the simulation outputs for Hubble parameter h."""
    length, mass, velocity = C.CODE_LENGTH, C.CODE_MASS, C.CODE_VELOCITY
    return {
        "length": length / h,
        "mass": mass / h,
        "time": length / velocity / h,
        "velocity": velocity,
        "density": mass / length**3 / h**2,
        "energy": velocity**2,
        "magneticfield": C.CODE_MAGNETIC,
    }


def box_units(lbox_mpc: float, h: float) -> dict[str, float]:
    """Comoving units in which the box has length 1 and its mean density is 1."""
    if lbox_mpc <= 0:
        raise ValueError("lbox_mpc must be positive")
    length = lbox_mpc * C.MPC / h
    time = 1.0 / sqrt(C.RHO_BAR * C.GRAVITY) / h**2
    velocity = length / time
    return {
        "length": length,
        "mass": C.RHO_BAR * length**3 * h**2,
        "time": time,
        "velocity": velocity,
        "density": C.RHO_BAR,
        "energy": velocity**2,
        "magneticfield": 1.0,
    }


def in_display_units(units: dict[str, float]) -> dict[str, float]:
    """A unit system measured in display units, e.g. the code length in kpc."""
    return {k: v / C.SYSTEM_UNITS[k] for k, v in units.items()}


def check_scale(a: float | None = None, z: float | None = None) -> float:
    """Scale factor from exactly one of ``a`` and ``z``, with range checks."""
    if (a is None) == (z is None):
        raise ValueError("give exactly one of a and z")
    if a is not None:
        if not 0.0 < a <= 1.0:
            raise ValueError(f"a = {a} is outside 0 < a <= 1")
        return float(a)
    if z < 0.0:
        raise ValueError(f"z = {z} is below 0")
    return 1.0 / (1.0 + z)


def physical(units: dict[str, float], a: float) -> dict[str, float]:
    """The same unit system in physical instead of comoving coordinates at scale factor ``a``."""
    return {k: v * a ** _A_POWER.get(k, 0.0) for k, v in units.items()}


def physical_factor(kind: str, a: Column) -> Column:
    power = _A_POWER.get(kind, 0.0)
    return F.lit(1.0) if power == 0.0 else F.pow(a, F.lit(power))


def to_units(
    df: DataFrame,
    kinds: dict[str, str],
    source: dict[str, float],
    target: dict[str, float],
    a: str | None = None,
) -> DataFrame:
    """Convert columns (``name -> kind``) from one unit system to another.

    With ``a`` (a scale-factor column) the source values are comoving and the result is physical.
    """
    unknown = set(kinds.values()) - set(KINDS)
    if unknown:
        raise KeyError(f"unknown unit kinds {sorted(unknown)}; supported: {KINDS}")

    def convert(name: str, kind: str) -> Column:
        value = F.col(name) * (source[kind] / target[kind])
        return value if a is None else value * physical_factor(kind, F.col(a))

    return df.withColumns({name: convert(name, kind) for name, kind in kinds.items()})
