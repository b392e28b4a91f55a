"""Declared schemas.  Column order is the file order; every field is nullable."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType()}


def fields(*specs: str) -> T.StructType:
    """``"int a b"``, ``"float c"`` -> a struct with the columns in the given order."""
    out = []
    for spec in specs:
        kind, *names = spec.split()
        out += [T.StructField(n, _TYPES[kind], True) for n in names]
    return T.StructType(out)


# --- fixed values: text catalogues ----------------------------------------------------------------------
SOVCIRC = fields("int haloId", "float Mvir Rvir R_vmax Vmax", "long Npart", "float Msub Rsub")
SOGRP = fields("int haloId hostId")
SOPAR = fields("int haloId hostId")
STAT = fields(
    "int galId Npart",
    "float Mgal Mgas Mstar Vc_max Vc_half Vc_rmax R_vmax R_half R_max sigma1d x y z vx vy vz xbound ybound zbound Sfr",
)
GRP = fields("int galId")
FOF = fields("int cpu group", "float Mfof Mstar Mgal Sfr", "double x y z")
TIMEGRID = fields("int snapnum", "double a zred")
TCOSMIC = fields("double a z t")
SIGHTLINE = fields("double x y z", "int axis", "string label")
ZPLAN = fields("string path", "double zc zlo zhi", "string name")
PHASE_GRID = fields("double LogRho LogT", "long count", "double Mass Zmet")

# --- fixed values: event logs ---------------------------------------------------------------------------
INITWINDS = fields(
    "float atime",
    "long PhEWKey",
    "float Mass Vinit Mstar rho_a T_a rho_c R_c L_c Z_c Sfr tclock tscale x y z",
    "long MinPotID PID",
)
REJOIN = fields(
    "float atime", "long PhEWKey", "float Mass tclock Vinit vrel cs_a T_c T_a rho_c rho_a R_c L_c Z_c M_c", "int flag"
)
PHEWS = fields(
    "float atime",
    "long PhEWKey",
    "int wind_flag",
    "float Mass M_c vrel Mach Mstar dr dv T_c T_a rho_c rho_a R_c L_c Hsml Z_c Z_a f_dis acc a_grav dtime tscale "
    "t_dis t_evap t_khi dUram dUmix dWork",
)
SPLIT = fields("long PId parentId", "float atime", "double Mass")

# --- fixed values: derived tables -----------------------------------------------------------------------
TABLES = {
    "gptable": fields("long PId", "int snapnum", "double Mass", "int haloId", "double Mgain", "string relation"),
    "pptable": fields(
        "long PId", "int haloId snapnum", "double Mloss", "int snapfirst birthId", "string birthTag"
    ),
    "progtable": fields("int haloId snapnum progId hostId", "float logMvir logMsub"),
    "phewtable": fields("long PId", "int snapnum", "double Mass", "int haloId", "double Mloss"),
    "inittable": fields("long PId", "int snapfirst", "double minit", "int birthId snaplast", "double mlast"),
    "splittable": fields("long PId parentId", "double Mass", "float atime", "int snapnext parentGen"),
    "hosttable": fields("int snapnum haloId hostId"),
}

# --- fixed values: particle fields, short name -> (raw name, type) --------------------------------------
PARTICLE_FIELDS = {
    "Pos": ("Coordinates", "struct<x:double,y:double,z:double>"),
    "Vel": ("Velocities", "struct<x:double,y:double,z:double>"),
    "PId": ("ParticleIDs", "bigint"),
    "Mass": ("Masses", "double"),
    "Rho": ("Density", "float"),
    "U": ("InternalEnergy", "float"),
    "Ne": ("ElectronAbundance", "float"),
    "Nh": ("NeutralHydrogenAbundance", "float"),
    "Hsml": ("SmoothingLength", "float"),
    "Sfr": ("StarFormationRate", "float"),
    "Tmax": ("TemperatureMax", "float"),
    "Age": ("StellarFormationTime", "float"),
    "Metals": ("Metallicity", "array<float>"),
    "Mc": ("PhEWMcloud", "float"),
    "Rc": ("PhEWRcloud", "float"),
    "MinPotId": ("PhEWMinPotID", "bigint"),
    "Mwind": ("PhEWWindMass", "double"),
}
