"""Two-dimensional histograms, maps and cumulative histograms.  Grids are long tables (one row per cell)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.physics import log10_or_null, with_ion_mass


def dense_grid(cells: DataFrame, nx: int, ny: int, ix: str, iy: str, fill: dict[str, object]) -> DataFrame:
    """All nx * ny cells; empty ones get the ``fill`` values."""
    every = cells.sparkSession.range(nx * ny).select(
        F.expr(f"cast(id div {ny} as int)").alias(ix), F.expr(f"cast(id % {ny} as int)").alias(iy)
    )
    return every.join(cells, [ix, iy], "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items() if v is not None}
    )


def phase_diagram(
    gas: DataFrame,
    nx: int = C.PHASE_CELLS,
    ny: int = C.PHASE_CELLS,
    log_rho: str = "LogRho",
    logT: str = "LogT",
    oxygen: str = "O",
    ions: bool = False,
) -> DataFrame:
    """Gas in the density-temperature plane: count, mass, metal mass (and ion masses) per cell.

    The range is fixed; cells are found by truncation and the first row and column stay empty.
    """
    (x0, x1), (y0, y1) = C.PHASE_X, C.PHASE_Y
    ix = ((F.col(log_rho) - x0) / (x1 - x0) * nx).cast("int")
    iy = ((F.col(logT) - y0) / (y1 - y0) * ny).cast("int")
    rows = gas.withColumns({"ix": ix, "iy": iy})
    mass = F.col("Mass")
    sums = {"Mass": mass, "Zmet": mass * F.col(oxygen) / C.SOLAR["O"] * C.METALS_PER_OXYGEN}
    if ions:
        rows = with_ion_mass(rows, oxygen=oxygen)
        sums |= {c: F.col(c) for c in ("MHI", "MCIV", "MOVI", "MNeVIII", "MSiIV")}
    cells = (
        rows.where((F.col("ix") > 0) & (F.col("ix") < nx) & (F.col("iy") > 0) & (F.col("iy") < ny))
        .groupBy("ix", "iy")
        .agg(F.count("*").alias("count"), *[F.sum(e).alias(n) for n, e in sums.items()])
    )
    grid = dense_grid(cells, nx, ny, "ix", "iy", {"count": 0, **{n: 0.0 for n in sums}})
    return grid.select(
        "ix",
        "iy",
        (x0 + F.col("ix") * ((x1 - x0) / nx)).alias("LogRho"),
        (y0 + F.col("iy") * ((y1 - y0) / ny)).alias("LogT"),
        "count",
        *sums,
    )


def _binned_by_range(df: DataFrame, nx: int, ny: int) -> DataFrame:
    """Right-closed equal-width bins over the range of the data itself, on x and y."""
    limits = df.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"{c}lo") for c in "xy"],
            *[F.max(c).cast("double").alias(f"{c}hi") for c in "xy"],
        )
    ).scalar()

    def index(c: str, n: int) -> Column:
        lo, hi = limits[f"{c}lo"], limits[f"{c}hi"]
        inside = F.greatest(F.ceil((F.col(c) - lo) / (hi - lo) * n) - 1, F.lit(0))
        # a single value sits in the middle of a range widened around it
        return F.when(hi > lo, inside).otherwise((n + 1) // 2 - 1).cast("int")

    return df.withColumns({"xbin": index("x", nx), "ybin": index("y", ny)})


def density_map(df: DataFrame, nx: int = 128, ny: int = 128) -> DataFrame:
    """log10 of the mass in every cell of the projected map (NULL where empty)."""
    cells = _binned_by_range(df, nx, ny).groupBy("xbin", "ybin").agg(F.sum("Mass").alias("Mass"))
    return dense_grid(cells, nx, ny, "xbin", "ybin", {"Mass": 0.0}).select(
        "xbin", "ybin", log10_or_null(F.col("Mass")).alias("logMass")
    )


def temperature_map(df: DataFrame, nx: int = 128, ny: int = 128) -> DataFrame:
    """Mass-weighted logT in every cell of the projected map (0 where empty)."""
    cells = (
        _binned_by_range(df, nx, ny)
        .groupBy("xbin", "ybin")
        .agg(F.try_divide(F.sum(F.col("Mass") * F.col("logT")), F.sum("Mass")).alias("logT"))
    )
    return dense_grid(cells, nx, ny, "xbin", "ybin", {"logT": 0.0}).select("xbin", "ybin", "logT")


def to_matrix(df: DataFrame, row: str, col: str, value: str, n: int) -> DataFrame:
    """Long grid -> one row per ``row`` and columns ``c0 .. c{n-1}``."""
    wide = df.groupBy(row).pivot(col, list(range(n))).agg(F.first(value))
    return wide.select(row, *[F.col(f"`{i}`").alias(f"c{i}") for i in range(n)])


def value_range(df: DataFrame, col: str) -> DataFrame:
    """Colour range of a log map: empty cells count as 0 for the minimum."""
    return df.agg(F.min(F.coalesce(F.col(col), F.lit(0.0))).alias("vmin"), F.max(col).alias("vmax"))


def cum_hist(
    df: DataFrame,
    col: str,
    bins: int | list[float] = 10,
    weight: str | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Cumulative (weighted) histogram: rows (i, edge, cum), starting at 0; ``reverse`` cumulates from the top.

    ``bins`` is a number of equal bins over the data range or a list of edges; the last bin is closed.
    """
    x = F.col(col).cast("double")
    w = F.lit(1.0) if weight is None else F.col(weight)
    if isinstance(bins, int):
        n = bins
        data = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
        # a single value gets a range of width 1 around it
        lo = F.when(data["hi"] > data["lo"], data["lo"]).otherwise(data["lo"] - 0.5)
        step = F.when(data["hi"] > data["lo"], data["hi"] - data["lo"]).otherwise(F.lit(1.0)) / n
        i = F.least(F.floor((x - lo) / step), F.lit(n - 1)).cast("int")
        # rounding may put a value one bin off the edges lo + i * step
        i = F.when(x < lo + i * step, i - 1).when((x >= lo + (i + 1) * step) & (i < n - 1), i + 1).otherwise(i)
        edge = lo + F.col("i") * step
    else:
        n = len(bins) - 1
        i = F.lit(None).cast("int")
        for k in reversed(range(n)):
            upper = x <= bins[k + 1] if k == n - 1 else x < bins[k + 1]
            i = F.when((x >= bins[k]) & upper, k).otherwise(i)
        edge = F.get(F.array(*[F.lit(float(b)) for b in bins]), F.col("i"))
    counts = df.select(i.alias("bin"), w.alias("w")).where("bin is not null").groupBy("bin").agg(F.sum("w").alias("w"))
    edges = df.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("i"))
    # edge i closes bin i - 1 (from the bottom) or opens bin i (from the top)
    at = F.col("i") if reverse else F.col("i") - 1
    order = F.col("i").desc() if reverse else F.col("i").asc()
    bounded = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        edges.withColumn("bin", at)
        .join(counts, "bin", "left")
        .withColumn("cum", F.sum(F.coalesce(F.col("w"), F.lit(0.0))).over(bounded))
        .select("i", edge.alias("edge"), "cum")
    )
