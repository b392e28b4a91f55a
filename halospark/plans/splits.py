"""Particle splitting: split events, generations and ancestors.

Counting backwards from the end of the run, a particle's *generation* rises by one at every split it took part
in, and keeps rising along its parents.  A particle of generation g holds 2**-g of the mass found there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import with_snap_after
from ..operators.lineage import cut_and_count, cut_lineage

# parents climbed in the first round
LEVELS_PER_ROUND = 3
ANCESTOR_COLUMNS = ("PId", "parentId", "Mass", "snapnext", "parentGen", "gen")


def with_parent_gen(split: DataFrame) -> DataFrame:
    """``parentGen``: how many splits of the parent happened at or after this one (average rank on ties).

    Splits are counted per parent and short stretch of time first and only the counts are summed per parent, so
    the rows of a much-split parent spread over the stretches.
    """
    key = ["parentId", "_stretch"]
    split = split.withColumn("_stretch", F.floor(F.col("atime") * 4096))
    later = Window.partitionBy("parentId").orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        split.groupBy(*key)
        .agg(F.count("*").alias("_n"))
        .withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0)))
        .drop("_n")
    )
    w = Window.partitionBy(*key).orderBy(F.desc("atime"))
    not_earlier = F.count("*").over(w.rangeBetween(Window.unboundedPreceding, 0))
    same_time = F.count("*").over(w.rangeBetween(0, 0))
    average_rank = F.col("_later") + not_earlier - (same_time - 1) / 2
    return split.join(counts, key).withColumn("parentGen", average_rank.cast("int")).drop("_later", "_stretch")


def split_table(split: DataFrame, grid: DataFrame) -> DataFrame:
    """The split log with ``snapnext`` (first snapshot after the split) and ``parentGen``."""
    placed = with_snap_after(split, "atime", grid, "snapnext")
    return with_parent_gen(placed).select("PId", "parentId", "Mass", "atime", "snapnext", "parentGen")


def _climbed(rows: DataFrame, jumps: DataFrame) -> DataFrame:
    """The events that a jump leads to from each of ``rows``: generations add up along the way."""
    below = rows.select(
        F.col("PId").alias("_tracked"), F.col("parentId").alias("_via"), (F.col("gen") - F.col("parentGen")).alias("_gained")
    )
    return below.join(jumps, "_via").select(
        F.col("_tracked").alias("PId"), "parentId", "Mass", "snapnext", "parentGen", (F.col("_gained") + F.col("_add")).alias("gen")
    )


def _lines_of_parents(level: DataFrame, births: DataFrame, n_births: int) -> DataFrame:
    """``level`` and all events above it, by pointer doubling.

    The first round climbs LEVELS_PER_ROUND parents, which is as far as most lines go.  Where some go on, the log is
    joined with itself: after k joins each particle knows its events 2^k steps up and the generations on the way, and
    the lines found so far, shifted by that much, are as many steps more.  So a line of n parents takes about log2(n)
    written rounds.
    """
    jumps = births.select(F.col("PId").alias("_via"), "parentId", "Mass", "snapnext", "parentGen", (F.col("own") + 1).alias("_add"))
    levels = [level]
    for _ in range(LEVELS_PER_ROUND):
        levels.append(_climbed(levels[-1], jumps))
    steps = [rows.withColumn("_step", F.lit(k)) for k, rows in enumerate(levels)]
    top = F.col("_step") == LEVELS_PER_ROUND
    written, unfinished = cut_and_count(reduce(DataFrame.unionByName, steps), top)
    found = [written.where(~top).drop("_step")]
    lines, far = [written.where(top).drop("_step")], 1
    left = unfinished
    while left:
        # events one more jump of this length up, for all that the lines have
        more, left = cut_and_count(_climbed(reduce(DataFrame.unionByName, lines), jumps), F.lit(True))
        lines.append(more)
        if left and far >= n_births:
            raise RuntimeError("the split log is cyclic: a line of parents is longer than the log")
        far *= 2
        if left:
            above = jumps.select("_via", F.col("parentId").alias("_next"), (F.col("_add") - F.col("parentGen")).alias("_gained"))
            second = jumps.select(F.col("_via").alias("_next"), "parentId", "Mass", "snapnext", "parentGen", "_add")
            twice = above.join(second, "_next").withColumn("_add", F.col("_gained") + F.col("_add")).select(*jumps.columns)
            jumps, left = cut_and_count(twice, F.lit(True))
    return reduce(DataFrame.unionByName, found + lines)


def split_ancestors(ids: DataFrame, splits: DataFrame, per_snapshot: bool = False) -> DataFrame:
    """All split events on the way from the tracked particles back to their oldest ancestors.

    One row per (tracked PId, event): ``parentId`` stands in for PId before ``snapnext`` with generation ``gen``.
    Rounds are written out and double the reach; they end where no parent is left.  A line of parents with more steps
    than the log has splits is a cycle, an error.

    Splits that an ancestor went through before give rows too, every one of them.  Of those between two snapshots a
    history can see the one of highest generation only: ``per_snapshot=True`` keeps just these, reduced before they
    are given to the descendants, which is what :func:`ancestor_spans` needs of a much-split ancestor.
    """
    # the ids enter every level of the first round: looked up once
    ids = cut_lineage(ids.select("PId").distinct())
    events = splits.select("PId", "parentId", "Mass", "snapnext", "parentGen")
    # splits a particle went through itself = the generation at which it was born, less one
    own = events.groupBy(F.col("parentId").alias("PId")).agg(F.max("parentGen").alias("own"))
    # read by every round and at the end: worked out and written once
    births, n_births = cut_and_count(
        events.join(own, "PId", "left").withColumn("own", F.coalesce(F.col("own"), F.lit(0))), F.lit(True)
    )
    events = births.drop("own")
    seeds = births.join(ids, "PId", "left_semi").withColumn("gen", F.col("own") + 1).select(*ANCESTOR_COLUMNS)
    lineage = _lines_of_parents(seeds, births, n_births)

    # splits of an ancestor before the one that made the descendant: same parent, higher count from the end
    own_splits = events.select(
        "parentId", F.col("Mass").alias("_m"), F.col("snapnext").alias("_s"), F.col("parentGen").alias("_g")
    )
    if per_snapshot:
        # equal counts (splits at the same time): the larger mass
        top = F.max(F.struct("_g", "_m"))
        own_splits = own_splits.groupBy("parentId", "_s").agg(top.alias("_t")).select("parentId", "_s", "_t._g", "_t._m")
    of_ancestors = (
        lineage.select("PId", "parentId", "gen", "parentGen")
        .join(own_splits, "parentId")
        .where("_g > parentGen")
        .select(
            "PId",
            "parentId",
            F.col("_m").alias("Mass"),
            F.col("_s").alias("snapnext"),
            "parentGen",
            (F.col("gen") + F.col("_g") - F.col("parentGen")).alias("gen"),
        )
    )
    of_tracked = (
        events.drop("PId")
        .withColumn("PId", F.col("parentId"))
        .join(ids, "PId", "left_semi")
        .withColumn("gen", F.col("parentGen"))
        .select(*ANCESTOR_COLUMNS)
    )
    return lineage.unionByName(of_ancestors).unionByName(of_tracked)


def ancestor_spans(ancestors: DataFrame) -> DataFrame:
    """Ancestor events as spans of snapshots: (PId, parentId, gen, first, last), at most one span per snapshot.

    At a snapshot the ancestor of the highest generation among the events after it counts; equal generations go
    to the smallest parentId.
    """
    w = Window.partitionBy("PId").orderBy(F.desc("snapnext"))
    return (
        ancestors.groupBy("PId", "snapnext")
        .agg(F.max(F.struct("gen", (-F.col("parentId")).alias("neg"))).alias("_top"))
        .withColumn("_best", F.max("_top").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .select(
            "PId",
            (-F.col("_best.neg")).alias("parentId"),
            F.col("_best.gen").alias("gen"),
            F.coalesce(F.lead("snapnext").over(w), F.lit(0)).alias("first"),
            (F.col("snapnext") - 1).alias("last"),
        )
        .where("first <= last")
    )


def with_split_gain(history: DataFrame, splits: DataFrame) -> DataFrame:
    """Correct ``Mgain`` at the snapshot after a split.

    A newborn particle gained its mass less half of the mass that split; a particle that split gets the half it
    gave away added back.  Other rows keep their value.
    """
    born = splits.groupBy("PId", F.col("snapnext").alias("snapnum")).agg((F.sum("Mass") / 2).alias("_born"))
    given = splits.groupBy(F.col("parentId").alias("PId"), F.col("snapnext").alias("snapnum")).agg(
        (F.sum("Mass") / 2).alias("_given")
    )
    key = ["PId", "snapnum"]
    return (
        history.join(born, key, "left")
        .join(given, key, "left")
        .withColumn(
            "Mgain",
            F.when(F.col("_born").isNotNull(), F.col("Mass") - F.col("_born")).otherwise(
                F.col("Mgain") + F.coalesce(F.col("_given"), F.lit(0.0))
            ),
        )
        .drop("_born", "_given")
    )
