"""Galaxy merger trees from the stars: which galaxy is the continuation of which."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators.joins import join_skewed
from ..operators.lineage import cut_lineage, new_path


def star_flows(stars: DataFrame) -> DataFrame:
    """Stellar mass of every galaxy by the galaxy its stars sat in before: (snapnum, galId, psnap, pgal, Mass).

    Stars outside galaxies keep their last galaxy; psnap and pgal are NULL for stars in their first one.  This is
    the only step that touches single stars.
    """
    w = Window.partitionBy("PId").orderBy("snapnum")
    return (
        stars.where("galId <> 0")
        .select("snapnum", "galId", "Mass", F.lag(F.struct("snapnum", "galId")).over(w).alias("_prev"))
        .groupBy("snapnum", "galId", F.col("_prev.snapnum").alias("psnap"), F.col("_prev.galId").alias("pgal"))
        .agg(F.sum("Mass").alias("Mass"))
    )


def _founder_id():
    """Simulation-wide id of a galaxy that starts a new line: founding snapshot and galId in one number."""
    return F.shiftleft(F.col("snapnum").cast("long"), 32) + F.col("galId")


def galaxy_main_ids(flows: DataFrame, written: bool = False) -> DataFrame:
    """(snapnum, galId, mainId): a galaxy continues the mainId that holds most of its stellar mass.

    A galaxy without older stars starts a new mainId.  Each snapshot depends on the ones before it, so the loop
    runs over snapshots (at most a time grid's worth), on the galaxy-to-galaxy flows only.  Ties go to the
    smallest mainId.  ``written`` says that ``flows`` is a stored table by snapnum already.
    """
    if not written:
        flows = cut_lineage(flows, partition_by="snapnum")
    listed = flows.select("snapnum").distinct().orderBy("snapnum").collect()
    spark = flows.sparkSession
    # one table that grows by a partition per snapshot: every round reads it with a single scan
    path = new_path(spark)
    kind = dict(flows.dtypes)
    schema = f"galId {kind['galId']}, mainId bigint, snapnum {kind['snapnum']}"

    if not listed:
        return spark.createDataFrame([], schema)

    def resolved() -> DataFrame:
        return spark.read.schema(schema).parquet(path)

    for i, (snapnum,) in enumerate(listed):
        now = flows.where(F.col("snapnum") == snapnum)
        if i:
            known = resolved().select(F.col("snapnum").alias("psnap"), F.col("galId").alias("pgal"), "mainId")
            now = now.join(known, ["psnap", "pgal"], "left")
        else:
            now = now.withColumn("mainId", F.lit(None).cast("long"))
        # mass without a mainId ranks last, so it decides only where there is nothing else
        rank = F.struct(F.col("mainId").isNotNull(), F.col("Mass"), -F.col("mainId"))
        lines = (
            now.groupBy("snapnum", "galId", "mainId")
            .agg(F.sum("Mass").alias("Mass"))
            .groupBy("snapnum", "galId")
            .agg(F.max_by("mainId", rank).alias("mainId"))
            .select("galId", F.coalesce(F.col("mainId"), _founder_id()).alias("mainId"), "snapnum")
        )
        lines.write.mode("append").partitionBy("snapnum").parquet(path)
    return resolved()


def galaxy_tree(
    stars: DataFrame, hosts: DataFrame | None = None, galaxies: DataFrame | None = None, halos: DataFrame | None = None
) -> DataFrame:
    """(mainId, snapnum, galId, Mstar, mainIdNext) plus hostId, Mtot, Mhost when those catalogues are given.

    ``mainIdNext`` is the mainId that holds most of the galaxy's stars the next time they are in a galaxy.
    """
    flows = cut_lineage(star_flows(stars), partition_by="snapnum")
    main = galaxy_main_ids(flows, written=True)
    mass = flows.groupBy("snapnum", "galId").agg(F.sum("Mass").alias("Mstar"))
    following = (
        flows.where("psnap is not null")
        .join(main, ["snapnum", "galId"])
        .groupBy("psnap", "pgal", "mainId")
        .agg(F.sum("Mass").alias("Mass"))
        .groupBy(F.col("psnap").alias("snapnum"), F.col("pgal").alias("galId"))
        .agg(F.max_by("mainId", F.struct(F.col("Mass"), -F.col("mainId"))).alias("mainIdNext"))
    )
    tree = main.join(mass, ["snapnum", "galId"]).join(following, ["snapnum", "galId"], "left")
    cols = ["mainId", "snapnum", "galId"]
    if hosts is not None:
        tree = tree.join(hosts.select("snapnum", F.col("haloId").alias("galId"), "hostId"), ["snapnum", "galId"], "left")
        cols.append("hostId")
    cols.append("Mstar")
    if galaxies is not None:
        tree = tree.join(galaxies.select("snapnum", "galId", F.col("Mgal").alias("Mtot")), ["snapnum", "galId"], "left")
        cols.append("Mtot")
    if halos is not None and hosts is not None:
        tree = tree.join(
            halos.select("snapnum", F.col("haloId").alias("hostId"), F.col("Mvir").alias("Mhost")),
            ["snapnum", "hostId"],
            "left",
        )
        cols.append("Mhost")
    return tree.select(*cols, "mainIdNext")


def star_table(stars: DataFrame, main: DataFrame) -> DataFrame:
    """Star rows with ``mainId`` (kept while a star is outside galaxies) and ``initId`` (its first galaxy)."""
    so_far = Window.partitionBy("PId").orderBy("snapnum").rowsBetween(Window.unboundedPreceding, 0)
    ever = so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = F.when(F.col("galId") != 0, F.col("galId"))
    lines = main.select("snapnum", "galId", "mainId")
    # stars outside galaxies, which may be half of them under one id, have nothing to be joined with
    held = join_skewed(stars.where("galId <> 0"), lines, ["snapnum", "galId"], "left", ["PId"])
    free = stars.where("galId = 0 or galId is null").withColumn("mainId", F.lit(None).cast(lines.schema["mainId"].dataType))
    return (
        held.unionByName(free)
        .withColumn("mainId", F.last("mainId", ignorenulls=True).over(so_far))
        .withColumn("initId", F.first(inside, ignorenulls=True).over(ever))
    )


def galaxy_relations(stars: DataFrame, tree: DataFrame, hosts: DataFrame, t0: int, t1: int) -> DataFrame:
    """What became of every galaxy of ``t0`` at ``t1``: descendant, fate and relation.

    fate: SELF when the descendant carries the same mainId, else MERGE.  relation: the descendant's line is
    followed back to ``t0`` and compared with the galaxy: SELF, SAT (the line is its host), CEN (it hosts the
    line), SIB (common host), NGB; SELF when the line did not exist yet.
    """
    inside = stars.where("galId <> 0")
    early = inside.where(F.col("snapnum") == t0).select("PId", "galId")
    late = inside.where(F.col("snapnum") == t1).select("PId", F.col("galId").alias("descId"), "Mass")
    descendant = (
        early.join(late, "PId")
        .groupBy("galId", "descId")
        .agg(F.sum("Mass").alias("Mass"))
        .groupBy("galId")
        .agg(F.max_by("descId", F.struct(F.col("Mass"), -F.col("descId"))).alias("descId"))
    )
    here = (
        tree.where(F.col("snapnum") == t0)
        .select("snapnum", "galId", "mainId", "Mstar")
        .join(hosts.select("snapnum", F.col("haloId").alias("galId"), "hostId"), ["snapnum", "galId"], "left")
    )
    # the most massive galaxy of a line stands for it at t0
    line = here.groupBy("mainId").agg(
        F.max_by(F.struct("galId", "hostId"), F.struct(F.col("Mstar"), -F.col("galId"))).alias("b")
    ).select(F.col("mainId").alias("descMainId"), F.col("b.galId").alias("backId"), F.col("b.hostId").alias("backHost"))
    there = tree.where(F.col("snapnum") == t1).select(F.col("galId").alias("descId"), F.col("mainId").alias("descMainId"))
    host, back = F.col("hostId"), F.col("backId")
    label = (
        F.when(F.col("descId").isNull(), None)
        .when(back.isNull() | (F.col("mainId") == F.col("descMainId")), "SELF")
        .when(back == host, "SAT")
        .when(F.col("backHost") == F.col("galId"), "CEN")
        .when((F.col("backHost") == host) & (host != back) & (host != F.col("galId")), "SIB")
        .otherwise("NGB")
    )
    return (
        here.join(descendant, "galId", "left")
        .join(there, "descId", "left")
        .join(line, "descMainId", "left")
        .select(
            "galId",
            "mainId",
            "descId",
            "descMainId",
            F.when(F.col("descId").isNull(), None)
            .when(F.col("mainId") == F.col("descMainId"), "SELF")
            .otherwise("MERGE")
            .alias("fate"),
            label.alias("relation"),
        )
    )
