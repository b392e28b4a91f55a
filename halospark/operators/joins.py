"""As-of, interval, interpolation and positional joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from .lineage import cut_lineage
from .ordered import with_row_number

# parts a hot key of a skewed join is spread over
SALTS = 16
# rows of a node of a grid's tree
FANOUT = 1024


def join_skewed(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salt_on: list[str] | None = None
) -> DataFrame:
    """Equi join of a big side whose keys may be hot (one halo, "no halo", one cell) with a smaller one.

    Rows of one key are spread over SALTS parts by a hash of ``salt_on`` (all columns by default; deterministic,
    so a retried task repeats itself) and the small side is repeated for each part.  Unlike the adaptive skew
    join this also works where the result is grouped by the join keys right away.  ``how``: inner or left.

    The parts are joined to the small side rather than exploded from it: an explode keeps the size estimate of one
    copy, and the copies of a side just below the broadcast threshold would then meet in the driver and in every task.
    A side that turns out small enough with its copies is still broadcast, by Spark's adaptive planning.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    salt = F.pmod(F.xxhash64(*(salt_on or big.columns)), F.lit(SALTS)).cast("int")
    parts = small.sparkSession.range(0, SALTS, 1, 1).select(F.col("id").cast("int").alias("_salt"))
    repeated = small.crossJoin(F.broadcast(parts))
    return big.withColumn("_salt", salt).join(repeated, [*keys, "_salt"], how).drop("_salt")


# -- as-of on the time grid -------------------------------------------------------------------------------
class Knots:
    """A grid of rows in the order of a number, as a tree whose nodes have at most FANOUT entries.

    The top node, the only thing that ever goes to every event, is a constant array of at most FANOUT rows.  A grid that
    fits is that node.  A larger one is numbered in ranges of the key, every FANOUT rows are a leaf, which also holds the
    last row of the leaf before and the first of the leaf after it, and the first keys of the leaves are the level
    above.  Events go down one equi join a level, so neither the size of a grid nor knots that crowd matter.
    Rows with a NULL key are no knots.
    """

    def __init__(self, grid: DataFrame, key: str | Column, payload: tuple[str, ...] = ()):
        at = F.col(key) if isinstance(key, str) else key
        rows = grid.select(at.alias("k"), *payload).where("k is not null")
        self.columns = rows.columns
        top = rows.orderBy(*rows.columns).limit(FANOUT + 1).collect()
        self.levels: list[DataFrame] = []
        if len(top) > FANOUT:
            top = self._grow(rows)
            rows = self.levels[-1].select("k", "child")
        self.top, self.n_top = _array_of(rows, top), len(top)

    def _grow(self, rows: DataFrame) -> list:
        """Write the leaves and the levels between them and the top; the top's rows (first key and number of a node)."""
        numbered = with_row_number(rows, [F.col(c) for c in rows.columns], "_n")
        node, place = F.floor((F.col("_n") - 1) / FANOUT), (F.col("_n") - 1) % FANOUT
        also = F.array_compact(F.array(node, F.when(place == 0, node - 1), F.when(place == FANOUT - 1, node + 1)))
        leaves = numbered.withColumn("_first", place == 0).select("*", F.explode(also).alias("_node"), node.alias("_own"))
        leaves = cut_lineage(
            leaves.where("_node >= 0")
            .groupBy("_node")
            .agg(
                F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("_near"),
                (F.min("_n") - 1).alias("_before"),
                F.min(F.when(F.col("_own") == F.col("_node"), F.col("k"))).alias("k"),
            )
            # past the last leaf there is only the row that would be its neighbour
            .where("k is not null")
        )
        self.leaves = leaves.drop("k")
        level = leaves.select("k", F.col("_node").alias("child"))
        while True:
            self.levels.append(level)
            top = level.orderBy("child").limit(FANOUT + 1).collect()
            if len(top) <= FANOUT:
                return top
            node = F.floor(F.col("child") / FANOUT)
            grown = level.groupBy(node.alias("_node")).agg(F.sort_array(F.collect_list(F.struct("k", "child"))).alias("_near"))
            self.levels[-1] = cut_lineage(grown)
            level = self.levels[-1].select(F.col("_near")[0]["k"].alias("k"), F.col("_node").alias("child"))

    def locate(self, df: DataFrame, value: Column) -> DataFrame:
        """``df`` with ``_near``: knots in order, the last one at or before the value and the first after it among them;
        ``_upto``: how many of ``_near`` lie at or before the value; ``_rank``: how many knots of the whole grid do."""
        found = df.withColumn("_value", value).withColumn("_near", self.top)
        if self.levels:
            for table in [*reversed(self.levels[:-1]), self.leaves]:
                # before the first knot: the first node
                child = F.when(F.col("_value").isNotNull(), F.get("_near", F.greatest(_count_upto(), F.lit(1)) - 1)["child"])
                found = _worked_out(found, child, "_node").drop("_near").join(table, "_node", "left").drop("_node")
            found = _worked_out(found, F.coalesce(_count_upto(), F.lit(0)), "_upto")
            return found.withColumn("_rank", F.coalesce("_before", F.lit(0)) + F.col("_upto")).drop("_before", "_value")
        return _worked_out(found, _count_upto(self.n_top), "_upto").withColumn("_rank", F.col("_upto")).drop("_value")


def _worked_out(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column that is worked out once, as a generator's output.

    The optimizer takes an alias for its expression when it carries conditions over joins, and with a lambda function in
    it (Spark 4.1) puts a filter on a side that lacks the columns.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _array_of(rows: DataFrame, values: list) -> Column:
    """Collected rows as a constant array of structs."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def literal(name: str, v: object) -> str:
        text = "NULL" if v is None else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"'{name}', CAST({text} AS {types[name]})"

    structs = [f"named_struct({', '.join(literal(n, v) for n, v in zip(types, row))})" for row in values]
    of = ", ".join(f"`{n}`: {t}" for n, t in types.items())
    return F.expr(f"array({', '.join(structs)})").cast(f"array<struct<{of}>>")


def _count_upto(n: int = FANOUT + 2) -> Column:
    """How many of the ordered ``_near`` (at most ``n``) have a key at or before ``_value``: bisection by halving steps."""
    steps = [1 << b for b in reversed(range(n.bit_length()))]

    def step(found: Column, by: Column) -> Column:
        return F.when(F.get("_near", found + by - 1)["k"] <= F.col("_value"), found + by).otherwise(found)

    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), step) if steps else F.lit(0)


def with_snaps(
    df: DataFrame, time: str, grid: DataFrame | Knots, after: str | None = None, before: str | None = None, a: str = "a"
) -> DataFrame:
    """Indexes of the first snapshot strictly after an event (the number of grid times at or before it) and of the last
    one at or before it (-1: there is none), under the names given.  An event without a time has none before it."""
    knots = grid if isinstance(grid, Knots) else Knots(grid, a)
    found = knots.locate(df, F.col(time))
    rank = F.coalesce("_rank", F.lit(0))
    out = {name: c.cast("int") for name, c in ((after, rank), (before, rank - 1)) if name}
    return found.select(*[c for c in df.columns if c not in out], *[c.alias(name) for name, c in out.items()])


def with_snap_after(df: DataFrame, time: str, grid: DataFrame | Knots, out: str, a: str = "a") -> DataFrame:
    """Index of the first snapshot strictly after an event (= number of grid times <= the event time)."""
    return with_snaps(df, time, grid, after=out, a=a)


def with_snap_before(df: DataFrame, time: str, grid: DataFrame | Knots, out: str, a: str = "a") -> DataFrame:
    """Index of the last snapshot at or before an event; -1 when there is none."""
    return with_snaps(df, time, grid, before=out, a=a)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: list[str],
    values: list[str],
    direction: str = "backward",
    allow_exact: bool = True,
    block: Column | None = None,
) -> DataFrame:
    """Nearest earlier (``backward``) or later (``forward``) right row per left row, for right sides of any size.

    Both sides are merged and sorted once per ``by`` key.  ``block`` (a monotone function of ``on``) splits hot
    keys: the value a block inherits from its neighbours enters it as one extra row.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be backward or forward")
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"rename the value columns {sorted(clash)}: the left side has them too")
    back = direction == "backward"
    block = F.lit(0) if block is None else block
    lefts = left.withColumn("_block", block)
    rights = right.select(*by, on, *values).withColumn("_block", block)

    keys = [*by, "_block"]
    pick = F.max_by if back else F.min_by
    # of right rows with equal time and key the one with the largest (forward: smallest) values counts
    edge = rights.groupBy(*keys).agg(pick(F.struct(*values), F.struct(on, *values)).alias("_edge"))
    # every block that holds rows of either side inherits the nearest edge before (after) it
    cells = lefts.select(*keys).distinct().join(edge, keys, "full")
    along = Window.partitionBy(*by).orderBy(F.col("_block").asc() if back else F.col("_block").desc())
    inherited = (
        cells.withColumn(
            "_hit", F.last("_edge", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
        )
        .where("_hit is not null")
        .select(*keys, F.lit(0).alias("_side"), "_hit")
    )
    # sort position of the sides at equal times decides whether exact matches count
    right_side = 1 if allow_exact else 3
    merged = (
        lefts.withColumn("_side", F.lit(2))
        .unionByName(
            rights.select(*by, on, "_block", F.lit(right_side).alias("_side"), F.struct(*values).alias("_hit")),
            allowMissingColumns=True,
        )
        .unionByName(inherited, allowMissingColumns=True)
        .withColumn("_first", (F.col("_side") != 0).cast("int"))
    )
    time = F.col(on).asc() if back else F.col(on).desc()
    w = Window.partitionBy(*keys).orderBy("_first", time, "_side", F.col("_hit").asc() if back else F.col("_hit").desc())
    return (
        merged.withColumn(
            "_found", F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        )
        .where("_side = 2")
        .select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])
    )


# -- interpolation ----------------------------------------------------------------------------------------
def interpolate(df: DataFrame, x: str, knots: DataFrame, kx: str, ky: str, out: str) -> DataFrame:
    """Piecewise linear interpolation in a table of knots of any size; NULL outside its range."""
    sides = knots.select(F.col(kx).cast("double").alias("k"), F.col(ky).cast("double").alias("y"))
    found = Knots(sides, "k", ("y",)).locate(df.withColumn("_x", F.col(x).cast("double")), F.col("_x"))
    # the segment starts at the last knot at or below the value
    v, lo, hi = F.col("_x"), F.get("_near", F.col("_upto") - 1), F.get("_near", F.col("_upto"))
    inner = lo["y"] + F.try_divide((v - lo["k"]) * (hi["y"] - lo["y"]), hi["k"] - lo["k"])
    # the last knot belongs to the range: there its own value counts
    value = F.when(F.col("_upto") > 0, F.when(v == lo["k"], lo["y"]).when(hi.isNotNull(), inner))
    return found.withColumn(out, value).select(*[c for c in df.columns if c != out], out)


# -- intervals --------------------------------------------------------------------------------------------
def snapshot_for_redshift(df: DataFrame, z: str, plan: DataFrame) -> DataFrame:
    """Attach the plan rows whose ``zlo <= z < zhi``; rows outside all intervals keep NULLs.

    A plan row with an empty or open interval is an error when the result is evaluated.

    Intervals are cut into cells of width 0.05 so that the join is an equi join on the cell.
    """
    cell = 0.05
    text = F.format_string("bad redshift interval [%s, %s)", F.col("zlo").cast("string"), F.col("zhi").cast("string"))
    zlo = F.when(F.col("zlo") < F.col("zhi"), F.col("zlo")).otherwise(F.raise_error(text))
    cells = F.sequence(F.floor(F.col("zlo") / cell), F.floor(F.col("zhi") / cell))
    valid = plan.withColumn("zlo", zlo).withColumn("_cell", F.explode(cells))
    # the interval is part of the join condition, so that rows without one stay
    inside = (F.col("_at") == F.col("_cell")) & (F.col(z) >= F.col("zlo")) & (F.col(z) < F.col("zhi"))
    return df.withColumn("_at", F.floor(F.col(z) / cell)).join(valid, inside, "left").drop("_cell", "_at")


# -- ion fractions on the (density, temperature) grid -----------------------------------------------------
def blend_ion_tables(low: DataFrame, high: DataFrame, z: float, z_low: float, z_high: float) -> DataFrame:
    """Ion table at redshift z, linear in z between two tables (ion, ih, it, log_frac)."""
    weight = (z - z_low) / (z_high - z_low)
    return low.join(high.withColumnRenamed("log_frac", "_high"), ["ion", "ih", "it"]).select(
        "ion", "ih", "it", (F.col("log_frac") * (1.0 - weight) + F.col("_high") * weight).alias("log_frac")
    )


def ion_table_at(tables: DataFrame, z: float) -> DataFrame:
    """Ion table at redshift z from tables at several (zred, ion, ih, it, log_frac): linear in z between the two that
    bracket it, the nearest one outside their range."""
    below, above = F.max(F.when(F.col("zred") <= z, F.col("zred"))), F.min(F.when(F.col("zred") >= z, F.col("zred")))
    edges = tables.agg(F.coalesce(below, F.min("zred")).alias("low"), F.coalesce(above, F.max("zred")).alias("high")).first()
    low, high = (tables.where(F.col("zred") == v).drop("zred") for v in (edges.low, edges.high))
    return low if edges.low == edges.high else blend_ion_tables(low, high, z, edges.low, edges.high)


def ion_corners(table: DataFrame) -> DataFrame:
    """(ih, it, ion) -> the four corner values of the cell that starts at this grid point."""
    key = ["ion", "ih", "it"]
    shifted = [
        table.select("ion", (F.col("ih") - di).alias("ih"), (F.col("it") - dt).alias("it"), F.col("log_frac").alias(n))
        for n, di, dt in (("y1", 0, 0), ("y2", 1, 0), ("y3", 1, 1), ("y4", 0, 1))
    ]
    # one pass: the four shifted copies meet in their cell; cells without all corners are no cells
    stacked = shifted[0]
    for s in shifted[1:]:
        stacked = stacked.unionByName(s, allowMissingColumns=True)
    return stacked.groupBy(*key).agg(*[F.max(n).alias(n) for n in ("y1", "y2", "y3", "y4")]).dropna()


def with_ion_fractions(
    df: DataFrame,
    table: DataFrame,
    ions: list[str],
    log_nh: str = "lognH",
    logT: str = "logT",
    shape: tuple[int, int] = (C.ION_NH_POINTS, C.ION_T_POINTS),
    origin: tuple[float, float] = (C.ION_NH_LOW, C.ION_T_LOW),
    step: tuple[float, float] = (C.ION_NH_STEP, C.ION_T_STEP),
) -> DataFrame:
    """``f<ion>`` for every ion by bilinear interpolation in the log fractions; edge cells extrapolate.

    The ions are pivoted into one row per cell first, so the particles take part in a single join.
    """
    wide = ion_corners(table).groupBy("ih", "it").pivot("ion", ions).agg(F.first(F.struct("y1", "y2", "y3", "y4")))

    def position(col: str, i: int) -> Column:
        return (F.col(col).cast("double") - origin[i]) / step[i]

    def cell(col: str, i: int) -> Column:
        p = position(col, i)
        return F.greatest(F.lit(0), F.least(F.lit(shape[i] - 2), p.cast("int")))

    located = df.withColumns({"ih": cell(log_nh, 0), "it": cell(logT, 1)})
    t = position(log_nh, 0) - F.col("ih")
    u = position(logT, 1) - F.col("it")

    def fraction(ion: str) -> Column:
        y = F.col(f"`{ion}`")
        log_f = (1 - t) * (1 - u) * y["y1"] + t * (1 - u) * y["y2"] + t * u * y["y3"] + (1 - t) * u * y["y4"]
        return F.pow(F.lit(10.0), log_f)

    # one row per cell of the grid: the optimizer broadcasts it where its true size allows
    wide = wide.where((F.col("ih") < shape[0]) & (F.col("it") < shape[1]) & (F.col("ih") >= 0) & (F.col("it") >= 0))
    joined = located.join(wide, ["ih", "it"], "left")
    return joined.withColumns({f"f{ion}": fraction(ion) for ion in ions}).drop("ih", "it", *ions)


# -- positional identity ----------------------------------------------------------------------------------
def attach_group_ids(particles: DataFrame, groups: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Attach group columns (galId, haloId, hostId) to particles by file position.

    Group files list gas, then dark, then star particles.  ``particles.idx`` is the position inside its type,
    so the file position adds the counts of the types before it (from ``snapshots``).
    Particles without a group row get 0.
    """
    key = ["snapnum", "idx"]
    ids = [c for c in groups.columns if c not in key]
    if snapshots is None:
        placed = particles.withColumn("_pos", F.col("idx"))
    else:
        # one row per snapshot, so at most a time grid's worth of rows is broadcast
        counts = snapshots.groupBy("snapnum").agg(F.max("n_gas").alias("n_gas"), F.max("n_dark").alias("n_dark"))
        offset = (
            F.when(F.col("ptype") == C.PTYPE["dark"], F.col("n_gas"))
            .when(F.col("ptype") == C.PTYPE["star"], F.col("n_gas") + F.col("n_dark"))
            .otherwise(0)
        )
        placed = particles.join(F.broadcast(counts), "snapnum", "left").withColumn("_pos", F.col("idx") + offset).drop(
            "n_gas", "n_dark"
        )
    listed = groups.withColumnRenamed("idx", "_pos")
    return (
        placed.join(listed, ["snapnum", "_pos"], "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ids})
        .drop("_pos")
    )
