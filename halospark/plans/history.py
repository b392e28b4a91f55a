"""Gas histories and the accretion of a galaxy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import select
from ..operators.lineage import cut_lineage
from ..operators.ordered import with_diff
from ..sources.store import inputs_version, materialize
from .progenitors import host_table, progenitor_table, with_relation
from .splits import ancestor_spans, split_ancestors, split_table
from .winds import wind_lifecycle, wind_mass_partition, wind_subset, wind_table, with_birth_tag


def gas_history(
    ids: DataFrame, gas: DataFrame, ancestors: DataFrame, snapnum: int, stars: DataFrame | None = None
) -> DataFrame:
    """Tracked particles at every snapshot up to ``snapnum``: (PId, snapnum, Mass, haloId, gen, Mgain).

    Before a particle was spawned its ancestor stands in for it (also for itself after own splits), with the mass
    scaled by 2**-gen.  All sources to look up are put into one small table of snapshot spans, so the particle
    table is read and joined once for ancestors and tracked particles together.
    """
    ids = ids.select("PId").distinct()
    spans = ancestor_spans(ancestors).select(
        "PId", F.col("parentId").alias("source"), "gen", "first", "last", F.lit(1).alias("by_ancestor")
    )
    direct = ids.select(
        "PId",
        F.col("PId").alias("source"),
        F.lit(0).alias("gen"),
        F.lit(0).alias("first"),
        F.lit(snapnum).alias("last"),
        F.lit(0).alias("by_ancestor"),
    )
    lookup = spans.unionByName(direct)
    rows = gas.where(F.col("snapnum") <= snapnum).select(F.col("PId").alias("source"), "snapnum", "Mass", "haloId")
    found = (
        rows.join(lookup, "source")
        .where(F.col("snapnum").between(F.col("first"), F.col("last")))
        .select(
            "PId",
            "snapnum",
            (F.col("Mass") / F.pow(F.lit(2.0), F.col("gen"))).alias("Mass"),
            "haloId",
            "gen",
            "by_ancestor",
        )
    )
    # an ancestor row replaces the particle's own row of that snapshot; layout by PId serves both windows
    per_snapshot = Window.partitionBy("PId", "snapnum")
    kept = (
        found.repartition("PId")
        .withColumn("_taken", F.max("by_ancestor").over(per_snapshot))
        .where("by_ancestor = _taken")
        .drop("_taken", "by_ancestor")
    )
    if stars is not None:
        own = (
            stars.where(F.col("snapnum") <= snapnum)
            .select("PId", "snapnum", "Mass", "haloId")
            .join(ids, "PId", "left_semi")
            .withColumn("gen", F.lit(0))
        )
        kept = kept.unionByName(own)
    return with_diff(kept, "PId", "snapnum", "Mass", "Mgain")


@dataclass(frozen=True)
class Simulation:
    """The input tables of a run and the number of its snapshots."""

    gas: DataFrame
    dark: DataFrame
    halos: DataFrame
    hosts: DataFrame
    grid: DataFrame
    splits: DataFrame
    launches: DataFrame
    rejoins: DataFrame
    n_snaps: int
    stars: DataFrame | None = None


@dataclass(frozen=True)
class PermanentTables:
    """Tables built once per run (store them with ``sources.store.materialize``)."""

    lifecycle: DataFrame
    winds: DataFrame
    hosts: DataFrame
    splits: DataFrame
    progenitors: DataFrame


def permanent_tables(sim: Simulation, snapnum: int, halo_mass: bool = True) -> PermanentTables:
    """The tables of a run for targets at ``snapnum``; ``halo_mass=False`` leaves the progenitors' masses out."""
    halos = sim.halos if halo_mass else sim.halos.select("snapnum", "haloId")
    lifecycle = wind_lifecycle(sim.launches, sim.rejoins, sim.gas, sim.grid, sim.n_snaps)
    return PermanentTables(
        lifecycle=lifecycle,
        winds=wind_table(sim.gas, lifecycle),
        hosts=host_table(sim.hosts),
        splits=split_table(sim.splits, sim.grid),
        progenitors=progenitor_table(sim.dark, halos, sim.hosts, snapnum),
    )


def stored_tables(sim: Simulation, base: str, params: dict[str, object], snapnum: int, overwrite: bool = False) -> PermanentTables:
    """:func:`permanent_tables` kept below ``base``: what is there for these ``params`` is loaded, the rest is built.

    ``params`` name the run that ``sim`` holds, so that tables of different runs never meet.  A table also knows the files
    that it was built from: where one of its inputs has changed it is built anew, and the others stay.
    """
    spark = sim.gas.sparkSession
    halos = sim.halos.select("snapnum", "haloId")
    versions: dict[int, str] = {}

    def version(*inputs: DataFrame) -> str:
        for df in inputs:
            if id(df) not in versions:
                versions[id(df)] = inputs_version(df)
        return "".join(versions[id(df)][: max(8, 40 // len(inputs))] for df in inputs)

    def stored(name: str, own: dict[str, object], inputs: tuple[DataFrame, ...], build) -> DataFrame:
        return materialize(spark, base, name, {**params, **own}, build, overwrite, inputs=version(*inputs))

    launched = (sim.launches, sim.rejoins, sim.gas, sim.grid)
    lifecycle = stored("lifecycle", {}, launched, lambda: wind_lifecycle(sim.launches, sim.rejoins, sim.gas, sim.grid, sim.n_snaps))
    return PermanentTables(
        lifecycle=lifecycle,
        winds=stored("winds", {}, launched, lambda: wind_table(sim.gas, lifecycle)),
        hosts=stored("hosts", {}, (sim.hosts,), lambda: host_table(sim.hosts)),
        splits=stored("splits", {}, (sim.splits, sim.grid), lambda: split_table(sim.splits, sim.grid)),
        progenitors=stored(
            "progenitors", {"snapnum": snapnum}, (sim.dark, sim.halos, sim.hosts), lambda: progenitor_table(sim.dark, halos, sim.hosts, snapnum)
        ),
    )


@dataclass(frozen=True)
class Accretion:
    """History of the tracked gas, the wind around it, and the wind share of every mass gain."""

    history: DataFrame
    subset: DataFrame
    partition: DataFrame


def missing_fields(history: DataFrame, subset: DataFrame) -> list[str]:
    """Columns still missing before the wind share can be worked out (empty = ready)."""
    need = [("history", history, ("Mgain", "relation")), ("subset", subset, ("Mloss", "birthTag"))]
    return [f"{name}.{c}" for name, df, cols in need for c in cols if c not in df.columns]


def track_accretion(
    sim: Simulation,
    snapnum: int,
    gal_id: int,
    include_stars: bool = False,
    tables: PermanentTables | None = None,
    ids: DataFrame | None = None,
) -> Accretion:
    """Follow the gas (and stars) of one galaxy back in time and say whose wind it gained.

    ``ids`` tracks other particles of the galaxy, e.g. :func:`recent_accretion`.
    """
    tables = tables or permanent_tables(sim, snapnum, halo_mass=False)
    if include_stars and sim.stars is None:
        raise ValueError("include_stars needs a star table")
    if ids is None:
        ids = select.gas_in_galaxy(sim.gas, snapnum, gal_id)
        if include_stars:
            ids = ids.union(select.stars_in_galaxy(sim.stars, snapnum, gal_id)).distinct()
    # ids, the target's progenitors, history and wind subset are small and used several times each: written once,
    # so that the tables they come from are read once
    ids = cut_lineage(ids.select("PId"))
    line = cut_lineage(tables.progenitors.where(F.col("haloId") == gal_id))
    ancestors = split_ancestors(ids, tables.splits, per_snapshot=True)
    history = cut_lineage(gas_history(ids, sim.gas, ancestors, snapnum, sim.stars if include_stars else None))
    # galaxies and halos share their ids
    history = with_relation(history, gal_id, line, tables.hosts)
    subset = cut_lineage(wind_subset(tables.winds, history, tables.lifecycle))
    subset = with_birth_tag(subset, gal_id, line, tables.hosts)
    missing = missing_fields(history, subset)
    if missing:
        raise ValueError(f"tables are not ready, missing {missing}")
    return Accretion(history, subset, wind_mass_partition(history, subset))


def accretion_mode(
    history: DataFrame, partition: DataFrame, tmax: DataFrame, snapnum: int, threshold: float = C.LOGT_THRESHOLD
) -> DataFrame:
    """(PId, mode, Mass): how each tracked particle's mass came in.

    A particle that sat in another halo than the target's progenitor before is a Merger as a whole.  Otherwise
    its wind gains are Recycled-{self,central,satellite,IGM} and the rest is Cold or Hot by its highest
    temperature.
    """
    foreign = (F.col("snapnum") < snapnum) & (F.col("haloId") != 0) & (F.col("relation") != C.SELF)
    state = history.groupBy("PId").agg(
        F.max(foreign).alias("merger"),
        F.max(F.when(F.col("snapnum") == snapnum, F.col("Mass"))).alias("now"),
    )
    tag = F.col("birthTag")
    recycled = (
        partition.groupBy(
            "PId",
            F.when(tag == C.SELF, "Recycled-self")
            .when(tag == C.PARENT, "Recycled-central")
            .when(tag == C.SAT, "Recycled-satellite")
            .otherwise("Recycled-IGM")
            .alias("mode"),
        )
        .agg(F.sum("Mgain").alias("Mass"))
        .join(state.where("not merger").select("PId"), "PId", "left_semi")
    )
    gained = partition.groupBy("PId").agg(F.sum("Mgain").alias("gained"))
    highest = tmax.groupBy("PId").agg(F.max("Tmax").alias("Tmax"))
    base = (
        state.join(gained, "PId", "left")
        .join(highest, "PId", "left")
        .select(
            "PId",
            F.when(F.col("merger"), "Merger").when(F.col("Tmax") > threshold, "Hot").otherwise("Cold").alias("mode"),
            F.when(F.col("merger"), F.col("now"))
            .otherwise(F.col("now") - F.coalesce(F.col("gained"), F.lit(0.0)))
            .alias("Mass"),
        )
    )
    return base.unionByName(recycled)


def with_tmax(history: DataFrame, gas: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """Attach today's maximum temperature of gas and stars to a history; rows without a particle drop out."""
    parts = gas.select("PId", "Tmax")
    if stars is not None:
        parts = parts.unionByName(stars.select("PId", "Tmax"))
    return history.join(parts, "PId")


def recent_accretion(gas: DataFrame, gal_id: int, snapnum: int) -> DataFrame:
    """Gas in the galaxy now that was not in it one snapshot earlier."""
    now = select.gas_in_galaxy(gas, snapnum, gal_id)
    return now.join(select.gas_in_galaxy(gas, snapnum - 1, gal_id), "PId", "left_anti")


def star_history(stars: DataFrame, gal_id: int, snapnum: int) -> DataFrame:
    """All earlier rows of the stars that are in the galaxy at ``snapnum``."""
    ids = select.stars_in_galaxy(stars, snapnum, gal_id)
    return stars.where(F.col("snapnum") <= snapnum).join(ids, "PId", "left_semi")
