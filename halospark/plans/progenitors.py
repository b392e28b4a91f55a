"""Halo progenitors, hosts and relations across snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.physics import halo_box, relation
from ..operators.aggregates import distinct_halos, main_progenitor
from ..operators.joins import join_skewed
from ..operators.lineage import cut_lineage
from ..operators.select import particles_in_box, particles_of_halo
from ..sources.cells import Cells
from ..sources.store import materialize

__all__ = [
    "distinct_halos",
    "halo_extract",
    "halo_relation_of",
    "halo_relations",
    "host_table",
    "progenitor_boxes",
    "progenitor_cubes",
    "progenitor_table",
]


def host_table(hosts: DataFrame) -> DataFrame:
    """(snapnum, haloId, hostId) of all snapshots."""
    return hosts.select("snapnum", "haloId", "hostId")


def progenitor_table(dark: DataFrame, halos: DataFrame, hosts: DataFrame, snapnum: int) -> DataFrame:
    """Main progenitor of every halo of ``snapnum`` at every snapshot up to it.

    progId is 0 where there is none and the halo itself at ``snapnum``.  hostId and the mass columns of ``halos``
    describe the progenitor; a missing Npart is 0, other missing masses stay NULL.
    """
    found = main_progenitor(dark.where(F.col("snapnum") <= snapnum), snapnum)
    # the snapshots up to now are a row-local explode of every halo of today
    frame = halos.where(F.col("snapnum") == snapnum).select(
        "haloId", F.explode(F.sequence(F.lit(0), F.lit(snapnum))).alias("snapnum")
    )
    prog = frame.join(found, ["haloId", "snapnum"], "left").withColumn(
        "progId",
        F.when(F.col("snapnum") == snapnum, F.col("haloId")).otherwise(F.coalesce(F.col("progId"), F.lit(0))),
    )
    masses = [c for c in ("logMvir", "logMsub", "Npart") if c in halos.columns]
    of_host = hosts.select("snapnum", F.col("haloId").alias("progId"), "hostId")
    of_halo = halos.select("snapnum", F.col("haloId").alias("progId"), *masses)
    out = (
        prog.join(of_host, ["snapnum", "progId"], "left")
        .join(of_halo, ["snapnum", "progId"], "left")
        .withColumn("hostId", F.coalesce(F.col("hostId"), F.when(F.col("progId") == 0, 0)))
    )
    if "Npart" in masses:
        out = out.withColumn("Npart", F.coalesce(F.col("Npart"), F.lit(0)))
    return out.select("haloId", "snapnum", "progId", "hostId", *masses)


def halo_relations(target: int, halos: DataFrame, progenitors: DataFrame, hosts: DataFrame) -> DataFrame:
    """(snapnum, haloId, relation) of the given halos to the target's progenitor of the same snapshot."""
    # one row per snapshot, so at most a time grid's worth of rows is broadcast
    line = (
        progenitors.where(F.col("haloId") == target)
        .groupBy("snapnum")
        .agg(F.first("progId").alias("progId"), F.first("hostId").alias("progHost"))
    )
    return (
        halos.select("snapnum", "haloId")
        .join(hosts, ["snapnum", "haloId"], "left")
        .join(F.broadcast(line), "snapnum", "left")
        .select(
            "snapnum",
            "haloId",
            relation(F.col("progId"), F.col("progHost"), F.col("haloId"), F.col("hostId")).alias("relation"),
        )
    )


def halo_relation_of(
    target: int, halo_id: int, snapnum: int, progenitors: DataFrame, hosts: DataFrame
) -> DataFrame:
    """The relation of one halo (a one-row result); IGM when the target has no row at that snapshot."""
    here = hosts.where((F.col("snapnum") == snapnum) & (F.col("haloId") == halo_id))
    # the aggregate yields one row even for a halo the host table does not list
    one = here.agg(F.first("hostId").alias("hostId")).select(
        F.lit(snapnum).alias("snapnum"), F.lit(halo_id).alias("haloId"), "hostId"
    )
    return halo_relations(target, one.drop("hostId"), progenitors, hosts)


def with_relation(df: DataFrame, target: int, progenitors: DataFrame, hosts: DataFrame) -> DataFrame:
    """Add ``relation`` to rows with (snapnum, haloId); rows in no halo are IGM."""
    labels = halo_relations(target, distinct_halos(df), progenitors, hosts)
    return join_skewed(df, labels, ["snapnum", "haloId"], "left").withColumn(
        "relation", F.coalesce(F.col("relation"), F.lit(C.IGM))
    )


def progenitor_cubes(progenitors: DataFrame, halos: DataFrame, halo_id: int, rlim: float) -> DataFrame:
    """(snapnum, progId, xlo, xhi, ...): the cube around the progenitor of one halo, for every snapshot that has one."""
    line = progenitors.where((F.col("haloId") == halo_id) & (F.col("progId") != 0)).select("snapnum", "progId")
    centres = halos.select("snapnum", F.col("haloId").alias("progId"), "Rvir", "x", "y", "z")
    edges = [f"{c}{side}" for c in "xyz" for side in ("lo", "hi")]
    boxes = halo_box(line.join(centres, ["snapnum", "progId"]), rlim)
    return boxes.groupBy("snapnum").agg(*[F.first(c).alias(c) for c in ("progId", *edges)])


def progenitor_boxes(
    progenitors: DataFrame, particles: DataFrame | Cells, halos: DataFrame, halo_id: int, rlim: float
) -> DataFrame:
    """Particles in the cube around the progenitor of one halo, for every snapshot that has one.

    Of particles stored by place only the files around the cubes are read.
    """
    limits = progenitor_cubes(progenitors, halos, halo_id, rlim)
    if isinstance(particles, Cells):
        return particles.in_cubes(cut_lineage(limits))
    edges = [f"{c}{side}" for c in "xyz" for side in ("lo", "hi")]
    # one row per snapshot, so at most a time grid's worth of rows is broadcast
    boxed = particles.join(F.broadcast(limits), "snapnum")
    for c in "xyz":
        boxed = boxed.where((F.col(c) > F.col(f"{c}lo")) & (F.col(c) < F.col(f"{c}hi")))
    return boxed.drop(*edges)


def halo_extract(
    particles: DataFrame | Cells,
    halos: DataFrame,
    halo_id: int,
    snapnum: int,
    base: str,
    box: bool = True,
    rlim: float = 1.2,
    overwrite: bool = False,
) -> DataFrame:
    """Stored gas of one halo for drawing: the cube around it (``box``) or its members; reused when present.

    Of particles stored by place only the files that can hold some are read.
    """
    cols = ["x", "y", "z", "Mc", "Sfr", "logT"]

    def build() -> DataFrame:
        if isinstance(particles, Cells) and box:
            centre = halos.where((F.col("snapnum") == snapnum) & (F.col("haloId") == halo_id))
            limits = halo_box(centre, rlim).select(*[f"{c}{side}" for c in "xyz" for side in ("lo", "hi")]).first()
            if limits is None:
                raise ValueError(f"no halo {halo_id} at snapshot {snapnum}")
            return particles.in_cube(snapnum, limits.asDict()).select(*cols)
        if isinstance(particles, Cells):
            return particles.of_halo(snapnum, halo_id).select(*cols)
        if box:
            return particles_in_box(particles, halos, snapnum, halo_id, rlim).select(*cols)
        return particles_of_halo(particles, snapnum, halo_id, cols)

    params = {"snapnum": snapnum, "haloId": halo_id, "rlim": rlim if box else None}
    spark = particles.spark if isinstance(particles, Cells) else particles.sparkSession
    return materialize(spark, base, "box" if box else "halo", params, build, overwrite)
