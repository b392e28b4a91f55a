"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and ``cap``, as close to 1 as the token constraints allow in relative entropy
(bounded form), so rates are exponentially tilted: the odds rate : (cap - rate) change by exp(lambda * x), x = size
over its source's mean size.  One multiplier per source meets that source's token target; Newton's iteration on the
dual finds all of them at once, each round one aggregation over the counts of documents per (source, size).  Rates are
then rounded to whole copies block by block, carrying the rounding error from larger to smaller documents.

Cases: a NULL or empty text has size 0 and is never taken; a NULL source is a source of its own, the last; a source
whose target is cap times its size is taken cap times; if all sizes are 0 all targets are; rows repeated under one
doc_id are mixed as separate documents; an empty table gives an empty mix; other columns pass through :func:`mix`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halospark.operators.lineage import cut_and_count, cut_lineage
from halospark.operators.ordered import with_row_number

from .common import free_prefix

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
#: Documents that one task rounds together; relative error of a target at which Newton's iteration stops.
BLOCK_DOCS = 4096
TOLERANCE = 1e-9
#: Newton's steps are kept inside a halving bracket, so this many rounds always suffice for doubles.
MAX_ROUNDS = 200


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_level(sources: DataFrame, cap: int) -> float:
    """The level t with sum(min(cap * size, weight * t)) = sum(size): what stops at its cap is shared again by weight.

    Each round is one aggregation; a round without a newly capped source ends the search.
    """
    full = F.col("source_size") * cap
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    level, n_capped = 0.0, -1
    while True:
        capped = F.col("weight") * F.lit(level) > full
        row = sources.agg(
            F.count_if(capped).alias("n"),
            F.coalesce(F.sum(F.when(capped, full)), F.lit(0)).alias("used"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if row.n == n_capped or not row.open:
            return level
        level, n_capped = (total - row.used) / row.open, row.n


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, n_docs, weight, target): weights go round in the order of the sources' code points."""
    found = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    ranked = with_row_number(found, [F.col("source").asc_nulls_last()], "rank")
    weight = F.get(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights)))).cast("int"))
    known = cut_lineage(ranked.withColumn("weight", weight).drop("rank"))
    level = water_level(known, cap)
    return known.withColumn("target", F.least(F.col("weight") * F.lit(level), (F.col("source_size") * cap).cast("double")))


def rate(multiplier: Column, size: Column, mean: Column, cap: int) -> Column:
    return F.lit(float(cap)) / (1 + F.lit(cap - 1.0) * F.exp(F.greatest(-multiplier * size / mean, F.lit(-700.0))))


def balance(sizes: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """``targets`` with ``multiplier``, the dual variable of each source (NULL: all or nothing is taken)."""
    counts = cut_lineage(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    share = F.col("target") / (F.col("source_size") * cap)
    open_ = (F.col("source_size") > 0) & (F.col("target") > 0) & (share < 1 - 1e-12)
    state = targets.where(open_).select(
        F.col("source").alias("of"),
        (F.col("source_size") / F.col("n_docs")).alias("mean"),
        F.log(share / (1 - share)).alias("aim"),
        F.lit(0.0).alias("multiplier"),
        F.lit(float("-inf")).alias("lo"),
        F.lit(float("inf")).alias("hi"),
        F.lit(False).alias("met"),
    )
    state, rest = cut_and_count(state, F.lit(True))
    for _ in range(MAX_ROUNDS):
        if not rest:
            break
        r = rate(F.col("multiplier"), F.col("size"), F.col("mean"), cap)
        words = F.col("n") * F.col("size")
        sums = (
            counts.join(state, F.col("source").eqNullSafe(F.col("of")))
            .withColumn("r", r)
            .groupBy("of")
            .agg(
                F.sum(words * F.col("r") / cap).alias("f"),
                F.sum(words * F.col("r") / cap * (1 - F.col("r") / cap) * F.col("size") / F.col("mean")).alias("slope"),
                F.sum(words).alias("all"),
                *[F.first(c).alias(c) for c in ("mean", "aim", "multiplier", "lo", "hi", "met")],
            )
        )
        # on the log odds of the share the dual is close to a line
        p = F.col("f") / F.col("all")
        off = F.log(p / (1 - p)) - F.col("aim")
        lo = F.when(off < 0, F.col("multiplier")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("multiplier")).otherwise(F.col("hi"))
        step = F.col("multiplier") - off * F.col("f") * (1 - p) / F.col("slope")
        inside = (step > F.col("lo2")) & (step < F.col("hi2"))
        half = (
            F.when(F.col("hi2") == float("inf"), F.col("multiplier") * 2 + 1)
            .when(F.col("lo2") == float("-inf"), F.col("multiplier") * 2 - 1)
            .otherwise((F.col("lo2") + F.col("hi2")) / 2)
        )
        met = F.abs(off) < TOLERANCE
        moved = sums.withColumns({"lo2": lo, "hi2": hi, "met2": F.col("met") | F.coalesce(met, F.lit(False))}).select(
            "of",
            "mean",
            "aim",
            F.when(F.col("met2"), F.col("multiplier")).when(inside, step).otherwise(half).alias("multiplier"),
            F.col("lo2").alias("lo"),
            F.col("hi2").alias("hi"),
            F.col("met2").alias("met"),
        )
        state, rest = cut_and_count(moved, ~F.col("met"))
    found = state.select("of", "multiplier")
    return targets.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


ROUNDED = "doc_id bigint, version bigint, size bigint, source_size bigint, target double, copies int"


def _round_block(cap: int):
    def task(key: tuple, block: pa.Table) -> pa.Table:
        size = block.column("size").to_numpy()
        order = np.lexsort((block.column("version").to_numpy(), block.column("doc_id").fill_null(-1).to_numpy(), -size))
        rates = block.column("rate").to_numpy()
        copies, carry = np.zeros(len(size), np.int32), 0.0
        for i in order.tolist():
            n = int(size[i])
            if n:
                carry += rates[i] * n
                copies[i] = min(cap, max(0, int(carry / n + 0.5)))
                carry -= float(copies[i]) * n
        kept = block.select(["doc_id", "version", "size", "source_size", "target"])
        return kept.append_column("copies", pa.array(copies, pa.int32()))

    return task


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per document: doc_id, version (hash of id, source and text), size, source_size, target, copies."""
    sizes = cut_lineage(
        docs.select(
            F.col("doc_id").cast("long"),
            F.xxhash64("doc_id", "source", "text").alias("version"),
            F.col("source").cast("string"),
            n_words(F.col("text")).alias("size"),
        )
    )
    solved = cut_lineage(balance(sizes, source_targets(sizes, weights, cap), cap))
    told = solved.select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        "multiplier",
        (F.col("source_size") / F.col("n_docs")).alias("mean"),
        F.ceil(F.col("n_docs") / block_docs).alias("n_blocks"),
        F.xxhash64("source").alias("source_hash"),
    )
    tilted = rate(F.col("multiplier"), F.col("size"), F.col("mean"), cap)
    bound = F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(F.lit(0.0))
    rated = sizes.join(told, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id",
        "version",
        "size",
        "source_size",
        "target",
        F.when(F.col("multiplier").isNotNull(), tilted).otherwise(bound).alias("rate"),
        "source_hash",
        F.pmod("version", F.col("n_blocks")).alias("block"),
    )
    return rated.groupBy("source_hash", "block").applyInArrow(_round_block(cap), ROUNDED)


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it."""
    own = free_prefix(docs, "_mix")
    taken = copies(docs, **options).groupBy(F.col("doc_id").alias(f"{own}_id"), F.col("version").alias(f"{own}_version")).agg(
        F.sum("copies").cast("int").alias(f"{own}_n"), F.count("*").cast("int").alias(f"{own}_rows")
    )
    marked = docs.withColumn(f"{own}_row", F.xxhash64("doc_id", "source", "text")).join(
        taken.where(f"{own}_n > 0").hint("merge"), F.col(f"{own}_row") == F.col(f"{own}_version")
    )
    # rows repeated in the input share their copies: the first ones take one more where they do not divide evenly
    row = F.row_number().over(Window.partitionBy(f"{own}_row").orderBy(f"{own}_row"))
    share = F.floor(F.col(f"{own}_n") / F.col(f"{own}_rows")) + (row <= F.col(f"{own}_n") % F.col(f"{own}_rows")).cast("int")
    return (
        marked.withColumn(f"{own}_share", share.cast("int"))
        .where(f"{own}_share > 0")
        .withColumn(f"{own}_copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}_share"))))
        .select(*docs.columns)
    )
