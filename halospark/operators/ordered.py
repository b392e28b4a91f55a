"""Ordered computations.

Two kinds of groups occur.  *Bounded* groups (one row per particle and snapshot, one row per bin, ...) use a
plain window.  *Unbounded* groups (a whole table, all records of one key) are cut into consecutive blocks: each
block is finished on its own and only one summary row per block travels on, so no key needs to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage

_BLOCK = "_block"


def with_diff(
    df: DataFrame,
    key: str,
    order: str | list[str],
    value: str,
    out: str,
    block: Column | None = None,
) -> DataFrame:
    """``value`` minus the previous ``value`` of the same key, 0 for the first row.

    ``block`` (a non-decreasing function of ``order``) cuts unbounded keys: the last value of each block is
    handed to the next one as an extra row, so a hot key spreads over its blocks.
    """
    orders = [order] if isinstance(order, str) else list(order)
    by = [F.col(c) for c in orders]
    if block is None:
        w = Window.partitionBy(key).orderBy(*by)
        return df.withColumn(out, F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)))

    cut = df.withColumn(_BLOCK, block)
    last = cut.groupBy(key, _BLOCK).agg(F.max_by(F.struct(value), F.struct(*orders)).alias("_last"))
    handed_on = (
        last.withColumn("_last", F.lag("_last").over(Window.partitionBy(key).orderBy(_BLOCK)))
        .where("_last is not null")
        .select(key, _BLOCK, F.col(f"_last.{value}").alias(value), F.lit(0).alias("_own"))
    )
    w = Window.partitionBy(key, _BLOCK).orderBy("_own", *by)
    return (
        cut.withColumn("_own", F.lit(1))
        .unionByName(handed_on, allowMissingColumns=True)
        .withColumn(out, F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)))
        .where("_own = 1")
        .drop("_own", _BLOCK)
    )


def with_cumsum(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Running total inside bounded groups (a particle's snapshots, the snapshots of one tag)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(w))


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    value: Column,
    out: str = "running",
    total: str | None = None,
) -> DataFrame:
    """Inclusive running total of ``value`` per ``keys`` (none = whole table) in ``order``, for any group size.

    The rows are range-partitioned by (keys, order) and written once; each range is summed on its own and the
    totals of the ranges before it are added.  ``total`` also attaches the total of the group.
    """
    ranged = cut_lineage(
        df.withColumn("_value", value)
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn(_BLOCK, F.spark_partition_id())
    )
    # one row per (range, key): without keys as many as there are ranges, else only keys on a range edge repeat
    sums = ranged.groupBy(_BLOCK, *keys).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    if total:
        carried = carried.withColumn(total, F.sum("_sum").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(_BLOCK, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(carried.drop("_sum"), [_BLOCK, *keys])
        .withColumn(out, F.col("_carry") + F.sum("_value").over(inside))
        .drop("_value", "_carry", _BLOCK)
    )


def with_row_number(df: DataFrame, order: list[Column], out: str = "rn", total: str | None = None) -> DataFrame:
    """1-based position of every row in an order of the whole table.

    Rows that tie in ``order`` follow a hash of their columns, so that many ties still spread over the ranges and a
    repeated run numbers them alike.
    """
    tie = "_tie"
    numbered = running_total(
        df.withColumn(tie, F.xxhash64(*df.columns)), [], [*order, F.col(tie)], F.lit(1), out, total
    )
    return numbered.drop(tie)


def every_nth(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Every k-th row in the given order."""
    return with_row_number(df, order, "_rn").where(F.col("_rn") % k == 0).drop("_rn")


def stride_sample(df: DataFrame, n: int, order: list[Column], rank: str | None = None) -> DataFrame:
    """``n`` rows spread evenly over the order: stride = max(1, rows div n), starting at the first row."""
    numbered = with_row_number(df, order, "_rn", "_rows").withColumn(
        "_stride", F.greatest(F.lit(1), F.floor(F.col("_rows") / n))
    )
    taken = numbered.where(
        ((F.col("_rn") - 1) % F.col("_stride") == 0) & (F.col("_rn") - 1 < n * F.col("_stride"))
    )
    if rank:
        taken = taken.withColumn(rank, ((F.col("_rn") - 1) / F.col("_stride")).cast("long"))
    return taken.drop("_rn", "_rows", "_stride")


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation per group, one column per entry of ``probs``.

    Equal values are counted first; ranks come from :func:`running_total`, so neither a large group nor many
    distinct values ever meet in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_total(counts, keys, [F.col(value)], F.col("_n"), "_upto", "_all")
    aggs = []
    for name, p in probs.items():
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"{name}: probability {p} is outside [0, 1]")
        pos = (F.col("_all") - 1) * F.lit(p)
        low = F.floor(pos)
        aggs += [
            F.min(F.when(F.col("_upto") > low, F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(pos), F.col(value))).alias(f"_hi_{name}"),
            F.max(pos - low).alias(f"_fr_{name}"),
        ]
    return (
        ranked.groupBy(*keys)
        .agg(*aggs)
        .select(
            *keys,
            *[
                (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n)
                for n in probs
            ],
        )
    )
