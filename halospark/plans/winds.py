"""Wind particles: life cycle, wind table, birth tags, nested tracks, and the share of wind in accreted mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators.joins import Knots, join_skewed, with_snap_after, with_snap_before
from ..operators.ordered import running_total, with_diff
from .progenitors import distinct_halos, halo_relations


def wind_lifecycle(
    launches: DataFrame, rejoins: DataFrame, particles: DataFrame, grid: DataFrame, n_snaps: int
) -> DataFrame:
    """(PId, snapfirst, minit, birthId, snaplast, mlast) per launch.

    ``snapfirst`` is the last snapshot before the launch, ``birthId`` the halo of the particle there (0 = none),
    ``snaplast`` the first one after the rejoin (``n_snaps`` when it never rejoined).  Launches before the first
    snapshot have no birth snapshot and drop out.
    """
    times = Knots(grid, "a")
    born = (
        with_snap_before(launches.select("PhEWKey", "PId", "Mass", "atime"), "atime", times, "snapfirst")
        .where("snapfirst >= 0")
        .select("PhEWKey", "PId", "snapfirst", F.col("Mass").alias("minit"))
    )
    # cut the particle table down to launch sites first: that join may broadcast the launches, a left join may not
    sites = born.select("snapfirst", "PId").distinct()
    at_birth = particles.select(
        F.col("snapnum").alias("snapfirst"), "PId", F.col("haloId").alias("birthId")
    ).join(sites, ["snapfirst", "PId"], "left_semi")
    ended = with_snap_after(rejoins.select("PhEWKey", "Mass", "atime"), "atime", times, "snaplast").select(
        "PhEWKey", "snaplast", F.col("Mass").alias("mlast")
    )
    return (
        born.join(at_birth, ["snapfirst", "PId"], "left")
        .join(ended, "PhEWKey", "left")
        .select(
            "PId",
            "snapfirst",
            "minit",
            F.coalesce(F.col("birthId"), F.lit(0)).alias("birthId"),
            F.coalesce(F.col("snaplast"), F.lit(n_snaps)).alias("snaplast"),
            F.coalesce(F.col("mlast"), F.lit(0.0)).alias("mlast"),
        )
    )


def wind_table(particles: DataFrame, lifecycle: DataFrame | None = None, snaplast: int | None = None) -> DataFrame:
    """Every appearance of a wind particle, its launch and its end: (PId, snapnum, Mass, haloId, Mloss).

    Without ``lifecycle`` the launch and end rows are left out.  ``Mloss`` keeps the sign of the mass change.
    """
    rows = particles.where("Mc > 0")
    if snaplast is not None:
        rows = rows.where(F.col("snapnum") < snaplast)
    rows = rows.select("PId", "snapnum", "Mass", "haloId")
    if lifecycle is not None:
        # both marks come out of one pass over the life cycles; their halo is unknown
        marks = lifecycle.select(
            "PId",
            F.explode(
                F.array(
                    F.struct(F.col("snapfirst").alias("snapnum"), F.col("minit").alias("Mass")),
                    F.struct(F.col("snaplast").alias("snapnum"), F.col("mlast").alias("Mass")),
                )
            ).alias("m"),
        ).select("PId", "m.snapnum", "m.Mass", F.lit(0).alias("haloId"))
        rows = rows.unionByName(marks)
    # equal snapshots: the heavier row first, so that mass only flows out; haloId settles the rest
    ordered = rows.withColumn("_desc", -F.col("Mass"))
    return with_diff(ordered, "PId", ["snapnum", "_desc", "haloId"], "Mass", "Mloss").drop("_desc")


def wind_subset(winds: DataFrame, history: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Wind rows in the halos the tracked gas ever visited, with the birth halo of the wind particle."""
    births = lifecycle.select("PId", "snapfirst", "birthId")
    return (
        join_skewed(winds.where("haloId <> 0"), distinct_halos(history), ["snapnum", "haloId"], salt_on=["PId"])
        .join(births, "PId", "left")
        .select("PId", "snapnum", "haloId", "Mass", "Mloss", "snapfirst", "birthId")
    )


def with_birth_tag(subset: DataFrame, target: int, progenitors: DataFrame, hosts: DataFrame) -> DataFrame:
    """Add ``birthTag``: relation of the birth halo to the target; NULL when the birth halo is unknown."""
    birth_halos = distinct_halos(subset, "snapfirst", "birthId")
    tags = halo_relations(target, birth_halos, progenitors, hosts).select(
        F.col("snapnum").alias("snapfirst"), F.col("haloId").alias("birthId"), F.col("relation").alias("birthTag")
    )
    return join_skewed(subset, tags, ["snapfirst", "birthId"], "left", ["PId", "snapnum"])


def loss_by_tag(subset: DataFrame) -> DataFrame:
    """Wind mass lost to each (snapnum, haloId) by birth tag; losses without a tag do not take part."""
    return subset.where("birthTag is not null").groupBy("snapnum", "haloId", "birthTag").agg(
        F.sum("Mloss").alias("Mloss")
    )


def wind_mass_partition(history: DataFrame, subset: DataFrame) -> DataFrame:
    """(PId, snapnum, birthTag, Mgain): each mass gain shared out over the birth tags of the wind around it.

    The share of a tag is its part of all wind mass lost to the halo at that snapshot.  Gas in a halo without
    wind gains from IGM; where the losses add up to zero every tag row carries the whole gain.  Shares are worked
    out on the loss table (a few rows per halo), so the gas is joined once and needs no window.
    """
    halo = Window.partitionBy("snapnum", "haloId")
    total = F.sum("Mloss").over(halo)
    shares = loss_by_tag(subset).select(
        "snapnum",
        "haloId",
        "birthTag",
        F.when(total == 0, 1.0).otherwise(F.try_divide(F.col("Mloss"), total)).alias("share"),
    )
    return join_skewed(history, shares, ["snapnum", "haloId"], "left", ["PId"]).select(
        "PId",
        "snapnum",
        F.coalesce(F.col("birthTag"), F.lit(C.IGM)).alias("birthTag"),
        (F.col("Mgain") * F.coalesce(F.col("share"), F.lit(1.0))).alias("Mgain"),
    )


# -- nested tracks ----------------------------------------------------------------------------------------
#: Records of a row of a track, unless the caller says otherwise.
CHUNK = 4096


def build_tracks(
    records: DataFrame,
    launches: DataFrame | None = None,
    key: str = "PhEWKey",
    time: str = "atime",
    fields: tuple[str, ...] = ("Mass", "M_c", "dr", "dv"),
    first: tuple[str, ...] = ("PID", "ainit", "Minit", "Z_c", "MinPotID"),
    segment: Column | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per wind particle: ``track`` = struct of arrays in time order, ``records`` = their number.

    ``launches`` (with ``key``) restricts and extends the records.  The head fields ``first`` are those of the first
    record of the whole track, ``records`` is its total.  A row stays bounded whatever a key's share of all records:
    the records of a key are numbered in time order over ranges of (key, time), and row ``segment`` has the records from
    segment * chunk on, ``chunk`` of them.  ``segment`` names another unit, a non-decreasing whole-number function of
    ``time``, whose rows are as large as the caller lets them be.
    """
    if launches is not None:
        # one particle may have a third of all records
        records = join_skewed(records, launches, [key], salt_on=[time])
    present = [c for c in fields if c in records.columns]
    heads = [c for c in first if c in records.columns]
    placed = records.select(key, time, *present, *[c for c in heads if c not in present])
    if segment is None:
        order = [F.col(c) for c in placed.columns if c != key]
        ranked = running_total(placed, [key], order, F.lit(1), "_rank", "records")
        placed = ranked.withColumn("segment", F.floor((F.col("_rank") - 1) / chunk).cast("int"))
        # the first record of a key tells its head
        head = placed.where("_rank = 1").select(key, *[F.col(c).alias(f"_first_{c}") for c in heads], "records")
    else:
        placed = placed.withColumn("segment", segment.cast("int"))
        head = placed.groupBy(key).agg(
            *[F.min_by(c, F.struct(time, *present)).alias(f"_first_{c}") for c in heads], F.count("*").alias("records")
        )
    parts = placed.groupBy(key, "segment").agg(F.sort_array(F.collect_list(F.struct(time, *present))).alias("_rows"))
    return parts.join(head, key).select(
        key,
        "segment",
        *[F.col(f"_first_{c}").alias(c) for c in heads],
        F.struct(*[F.col(f"_rows.{c}").alias(c) for c in (time, *present)]).alias("track"),
        "records",
    )
