"""Sight lines past galaxies at fixed impact distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.physics import wrap_unit
from ..operators.ordered import stride_sample
from ..operators.select import with_mass_bin

# fixed values: directions on the sky plane and impact distances in kpc
DIRECTIONS = (("x+", 1.0, 0.0), ("x-", -1.0, 0.0), ("y+", 0.0, 1.0), ("y-", 0.0, -1.0))
DISTANCES = tuple(range(10, 300, 40))


def sightlines(targets: DataFrame, mbin: int, n: int, unit_kpc: float) -> DataFrame:
    """One row per target, direction and distance: (dir, b, rank, x, y, z, axis, label).

    ``targets`` has galId, logMsub, logMstar and box-normalized x, y, z.  ``n`` targets of the mass class are
    taken evenly in galId order; positions wrap at the box edge.
    """
    chosen = stride_sample(with_mass_bin(targets).where(F.col("mbin") == mbin), n, [F.col("galId")], rank="rank")
    dirs = F.array(
        *[F.struct(F.lit(d).alias("dir"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for d, dx, dy in DIRECTIONS]
    )
    fan = chosen.withColumn("d", F.explode(dirs)).withColumn("b", F.explode(F.array(*[F.lit(b) for b in DISTANCES])))

    def short(c: str):
        return F.substring(F.col(c).cast("string"), 1, 5)

    return fan.select(
        F.col("d.dir").alias("dir"),
        "b",
        "rank",
        wrap_unit(F.col("x") + F.col("d.dx") * F.col("b") / unit_kpc).alias("x"),
        wrap_unit(F.col("y") + F.col("d.dy") * F.col("b") / unit_kpc).alias("y"),
        F.col("z").cast("double").alias("z"),
        F.lit(2).alias("axis"),
        F.concat(
            F.col("galId").cast("string"),
            F.lit("_"),
            short("logMsub"),
            F.lit("_"),
            short("logMstar"),
            F.lit("."),
            F.col("d.dir"),
            F.col("b").cast("string"),
            F.lit("kpc"),
        ).alias("label"),
    )
