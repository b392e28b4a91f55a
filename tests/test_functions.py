import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halospark.functions import constants as C
from halospark.functions import cosmology, physics, units


def one(spark, col):
    return spark.range(1).select(col).collect()[0][0]


def test_documented_unit_values():
    box = units.box_units(50, 0.7)
    assert math.isclose(box["mass"], 9.857107042543447e49, rel_tol=1e-12)
    assert math.isclose(1e-12 * box["mass"] / units.display_units()["mass"], 49558.10478905705, rel_tol=1e-12)
    code = units.code_units(0.7)
    assert math.isclose(units.physical(code, 1.0)["length"], 4.408111428571429e21, rel_tol=1e-12)
    at_z1 = units.physical(code, units.check_scale(z=1.0))["length"]
    assert math.isclose(at_z1, 2.2040557142857144e21, rel_tol=1e-12)
    norm = units.in_display_units(units.box_units(25, 0.7))["length"]
    assert math.isclose(norm, 35714.285714285725, rel_tol=1e-6)


@pytest.mark.parametrize("kw", [{}, {"a": 0.5, "z": 1.0}, {"a": 0.0}, {"a": 1.5}, {"z": -0.1}])
def test_scale_checks(kw):
    with pytest.raises(ValueError):
        units.check_scale(**kw)


def test_to_units(spark):
    df = spark.createDataFrame([(2.0, 0.25)], "v double, a double")
    got = units.to_units(df, {"v": "velocity"}, units.code_units(0.7), units.display_units(), "a").collect()[0].v
    assert math.isclose(got, 1.0)
    with pytest.raises(KeyError):
        units.to_units(df, {"v": "speed"}, units.code_units(0.7), units.display_units())


def test_cosmology_values(spark):
    z = F.lit(1.0)
    e = math.sqrt(0.3 * 8 + 0.7)
    assert math.isclose(one(spark, cosmology.expansion(z)), e)
    x = 0.3 * 8 / e**2 - 1
    assert math.isclose(one(spark, cosmology.virial_overdensity(z)), 18 * math.pi**2 + 82 * x - 39 * x * x)
    m = 1e12 * C.SOLAR_MASS
    r = one(spark, cosmology.virial_radius(F.lit(m), F.lit(0.0)))
    delta = one(spark, cosmology.virial_overdensity(F.lit(0.0)))
    assert math.isclose(4.18779 * r**3 * delta * C.RHO_BAR, m, rel_tol=1e-9)
    v = one(spark, cosmology.virial_velocity(F.lit(m), F.lit(0.0)))
    assert math.isclose(v * v * r, C.GRAVITY * m, rel_tol=1e-9)
    assert one(spark, cosmology.virial_over_mean(z, 1.0)) == 178.0


@pytest.mark.parametrize("z", [0.0, 0.3, 2.0, 15.0])
def test_distance_against_fine_trapezoid(spark, z):
    grid = np.linspace(0, z, 200_001)
    want = np.trapezoid(1 / np.sqrt(0.3 * (1 + grid) ** 3 + 0.7), grid) * C.LIGHT_SPEED / (1e7 / C.MPC * 0.7) / (1 + z)
    assert math.isclose(one(spark, cosmology.angular_distance(F.lit(z))), want, rel_tol=1e-8, abs_tol=1e-9)


def test_massless_halo_has_no_virial_velocity(spark):
    df = spark.createDataFrame([(0.0, 0.5)], "m double, z double")
    row = cosmology.with_virial(df, "m", "z").collect()[0]
    assert row.rvir == 0.0 and row.vvir is None and row.n_sis is None


def test_relation_order(spark):
    cases = [
        ((0, 5, 0, 5), "IGM"),
        ((3, 5, 3, 5), "SELF"),
        ((3, 5, 5, 5), "PARENT"),
        ((3, 3, 4, 3), "SAT"),
        ((3, 5, 4, 5), "SIB"),
        ((3, 5, 4, 9), "IGM"),
        ((None, None, 4, 9), "IGM"),
        ((3, None, 4, None), "IGM"),
    ]
    df = spark.createDataFrame([(*c, w) for c, w in cases], "p int, ph int, h int, hh int, want string")
    got = df.withColumn("got", physics.relation(F.col("p"), F.col("ph"), F.col("h"), F.col("hh")))
    assert got.where("got <> want").count() == 0


def test_temperature_and_phase(spark):
    df = spark.createDataFrame([(100.0, 1.1, 0.25, 1e-8)], "U float, Ne float, Y float, Rho float")
    row = physics.with_logT(df).collect()[0]
    mu = (1 + 4 * 0.25) / (1 + 1.1 + 0.25)
    assert math.isclose(row.logT, math.log10(100 * 1e10 * mu * 1.6733e-24 / (1.5 * 1.380658e-16)), rel_tol=1e-6)
    p = physics.with_phase(df, 0.7).collect()[0]
    xhe = 0.24 / (4 * 0.76)
    t = 100 * 1e10 * (2 / 3) * 1.6726e-24 / 1.3806e-16 * (1 + 4 * xhe) / (1 + 1.1 + xhe)
    rho = 1e-8 * 1.989e43 / 3.085678e21**3 / (1.8791e-29 * 0.045)
    assert math.isclose(p.LogT, math.log10(t), rel_tol=1e-6) and math.isclose(p.LogRho, math.log10(rho), rel_tol=1e-5)


def test_metal_and_markers(spark):
    df = spark.createDataFrame([([float(i) for i in range(11)],)], "Metals array<float>")
    assert df.select(physics.metal("O")).collect()[0][0] == 4.0
    df = spark.createDataFrame([(7.0, 0.0, 0.0), (5.0, 1.0, 0.0), (5.0, 1.0, 0.5)], "logT double, Sfr double, Mc double")
    got = [(r.kind, r.shade, r.size) for r in physics.with_marker(df).collect()]
    assert got == [("gas", 1.0, 5.0), ("sfr", None, 5.0), ("wind", 0.5, 5.0)]


def test_zero_mass_gives_null_log(spark):
    df = spark.createDataFrame([(1, 0.0)], "galId int, Mgal double")
    assert physics.with_log_galaxy_mass(df, 1e40).collect()[0].logMgal is None
