"""Galaxy and halo catalogues as the analyses use them: chosen fields, log masses, positions of halos."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.physics import with_log_galaxy_mass, with_log_halo_mass

_POSITION = ("x", "y", "z")


def _chosen(df: DataFrame, keys: list[str], columns: list[str] | None, what: str) -> DataFrame:
    if columns is None:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        warnings.warn(f"not in the {what} catalogue: {missing}", stacklevel=3)
    return df.select(*keys, *[c for c in columns if c in df.columns and c not in keys])


def galaxies(
    stat: DataFrame, mass_unit: float, columns: list[str] | None = None, log_mass: bool = True
) -> DataFrame:
    """Galaxies with the chosen columns; Mgal, Mgas, Mstar become log solar masses (``mass_unit`` in grams)."""
    out = _chosen(stat, [k for k in ("snapnum", "galId") if k in stat.columns], columns, "galaxy")
    return with_log_galaxy_mass(out, mass_unit) if log_mass else out


def halos(
    sovcirc: DataFrame,
    stat: DataFrame | None = None,
    columns: list[str] | None = None,
    h: float = C.HUBBLE,
    log_mass: bool = True,
) -> DataFrame:
    """Halos with the chosen columns; x, y, z come from the galaxy of the same id.

    The catalogues are matched outer: an id in only one of them keeps its row, the other columns are NULL.
    """
    keys = [k for k in ("snapnum", "haloId") if k in sovcirc.columns]
    position = [c for c in _POSITION if columns is None or c in columns]
    own = None if columns is None else [c for c in columns if c not in _POSITION]
    out = _chosen(sovcirc, keys, own, "halo")
    if log_mass:
        out = with_log_halo_mass(out, h)
    if stat is None or not position:
        return out
    places = stat.select(*[F.col("galId").alias("haloId") if k == "haloId" else k for k in keys], *position)
    return out.join(places, keys, "full")
