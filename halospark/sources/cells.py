"""Particles stored by place: files that hold a stretch of a space-filling curve, skipped by their statistics.

``build_cells`` sorts the particles of every snapshot along a Morton curve of grid cells and cuts them into files; an
index table has one row per file (its stretch of cells and its extent in x, y and z), and a halo table says which files
hold members of which halo.  ``Cells`` answers cubes and halos from the files that can hold something: the index is a
small table, the files that are left are listed in the plan as any scan's are, and inside them Parquet's row groups are
skipped by the same limits.

Particles without a position are stored and are in no cube; places outside the box belong to the cells at its edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import load, save

AXES = ("x", "y", "z")
#: Bits of a cell's number along an axis: the curve has 2^(3 * BITS) cells.
BITS = 10
#: Files of a table, about: the index and the lists of chosen files, which the driver holds, do not grow beyond that.
FILES = 10_000
_SIDES = tuple(f"{c}{side}" for c in AXES for side in ("lo", "hi"))


#: The bits of every number below 2^BITS with two zeros before each.
_SPREAD = [sum((v >> b & 1) << 3 * b for b in range(BITS)) for v in range(1 << BITS)]


def cell_number(low: float, high: float) -> Column:
    """Place on the Morton curve of the grid cell that (x, y, z) lies in; NULL without a position.

    The bits are looked up in a constant: worked out bit by bit they make code too large for Java's compiler.
    """
    n, key = 1 << BITS, F.lit(0).cast("long")
    spread = F.split(F.lit(",".join(map(str, _SPREAD))), ",").cast("array<bigint>")
    for k, c in enumerate(AXES):
        at = F.floor((F.col(c).cast("double") - low) / (high - low) * n)
        key = key.bitwiseOR(F.shiftleft(F.get(spread, F.greatest(F.lit(0), F.least(at, F.lit(n - 1))).cast("int")), k))
    return F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull(), key)


def curve_ranges(low: list[int], high: list[int], most: int = 64) -> list[tuple[int, int]]:
    """At most ``most`` ranges of cells that cover the grid box low..high (inclusive, three axes each).

    Octants are divided from the largest down while there is room for more ranges; touching ranges are one.
    """

    def inside(corner: tuple[int, ...], size: int) -> int:
        """0: outside, 1: partly inside, 2: wholly inside."""
        if any(c > h or c + size - 1 < lo for c, lo, h in zip(corner, low, high)):
            return 0
        return 2 if all(c >= lo and c + size - 1 <= h for c, lo, h in zip(corner, low, high)) else 1

    def merged(nodes: list) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for start, size in sorted((s, n**3) for s, _, n in nodes):
            if out and out[-1][1] + 1 == start:
                out[-1][1] = start + size - 1
            else:
                out.append([start, start + size - 1])
        return [(a, b) for a, b in out]

    nodes = [(0, (0, 0, 0), 1 << BITS)]
    while True:
        finer = []
        for start, corner, size in nodes:
            if size == 1 or inside(corner, size) == 2:
                finer.append((start, corner, size))
                continue
            half = size // 2
            for octant in range(8):
                at = tuple(c + half * (octant >> k & 1) for k, c in enumerate(corner))
                if inside(at, half):
                    finer.append((start + octant * half**3, at, half))
        if finer == nodes or len(merged(finer)) > most:
            return merged(nodes)
        nodes = finer


def build_cells(particles: DataFrame, out: str, low: float, high: float, rows_per_file: int = 4_000_000) -> Cells:
    """Store particles (snapnum, x, y, z, ...) of a box from ``low`` to ``high`` along every axis, by place.

    A file has ``rows_per_file`` rows; where that would make more than FILES files, each has its share of all rows.
    """
    order = ["snapnum", "cell"]
    most = max(rows_per_file, -(-particles.count() // FILES))
    # a cell may hold very many particles: a hash of the row deals them over ranges
    placed = particles.withColumn("cell", cell_number(low, high)).withColumn("_tie", F.xxhash64(*particles.columns))
    (
        placed.repartitionByRange(*order, "_tie")
        .sortWithinPartitions(*order)
        .drop("_tie")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", most)
        .partitionBy("snapnum")
        .parquet(f"{out}/rows")
    )
    spark = particles.sparkSession
    rows = spark.read.parquet(f"{out}/rows").withColumn("file", F.substring_index(F.col("_metadata.file_path"), "/rows/", -1))
    extent = [f(c).alias(f"{c}{side}") for c in AXES for f, side in ((F.min, "lo"), (F.max, "hi"))]
    cells = [F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"), F.count("*").alias("n")]
    index = rows.groupBy("snapnum", "file").agg(*extent, *cells, F.lit(low).alias("low"), F.lit(high).alias("high"))
    save(index.withColumn("number", F.monotonically_increasing_id()), f"{out}/files")
    if "haloId" in particles.columns:
        # a halo's files by number: names would make most of a row; the index, of about FILES rows, can be broadcast
        numbers = F.broadcast(load(spark, f"{out}/files").select("file", "number"))
        members = rows.where("haloId <> 0").select("snapnum", "haloId", "file").join(numbers, "file")
        save(members.groupBy("snapnum", "haloId", "number").agg(F.count("*").alias("n")), f"{out}/halos", sort_by=["snapnum", "haloId"])
    return Cells(spark, out)


@dataclass(frozen=True)
class Cells:
    """Particles stored by :func:`build_cells`."""

    spark: SparkSession
    path: str

    def _read(self, files: DataFrame) -> DataFrame:
        """The rows of the named files only, without opening any other."""
        names = [f"{self.path}/rows/{r.file}" for r in files.select("file").distinct().orderBy("file").collect()]
        everything = self.spark.read.parquet(f"{self.path}/rows")
        if not names:
            return everything.where("false")
        return self.spark.read.schema(everything.schema).option("basePath", f"{self.path}/rows").parquet(*names)

    def files(self, cubes: DataFrame) -> DataFrame:
        """The index rows of the files whose extent meets a cube (snapnum, xlo, xhi, ...) of their snapshot."""
        index = load(self.spark, f"{self.path}/files")
        own = index.select("snapnum", "file", *[F.col(s).alias(f"_{s}") for s in _SIDES])
        meets = F.lit(True)
        for c in AXES:
            meets = meets & (F.col(f"_{c}hi") > F.col(f"{c}lo")) & (F.col(f"_{c}lo") < F.col(f"{c}hi"))
        return own.join(cubes.select("snapnum", *_SIDES), "snapnum").where(meets).select("snapnum", "file").distinct()

    def in_cubes(self, cubes: DataFrame) -> DataFrame:
        """Particles strictly inside the cube of their snapshot, with the cube's other columns.

        ``cubes``: (snapnum, xlo, xhi, ylo, yhi, zlo, zhi, ...), any number for a snapshot.
        """
        found = self._read(self.files(cubes)).drop("cell").join(cubes, "snapnum")
        for c in AXES:
            found = found.where((F.col(c) > F.col(f"{c}lo")) & (F.col(c) < F.col(f"{c}hi")))
        return found.drop(*_SIDES)

    def in_cube(self, snapnum: int, limits: dict[str, float]) -> DataFrame:
        """Particles strictly inside one cube; its ranges of cells and its sides also skip row groups."""
        edge = self.spark.createDataFrame([(snapnum, *[float(limits[s]) for s in _SIDES])], "snapnum int, " + ", ".join(f"{s} double" for s in _SIDES))
        files = self.files(edge)
        box = load(self.spark, f"{self.path}/files").select("low", "high").first()
        rows = self._read(files).where(F.col("snapnum") == snapnum)
        if box is not None:
            n = 1 << BITS
            at = lambda v: max(0, min(n - 1, int((v - box.low) // ((box.high - box.low) / n))))
            # a cell less and a cell more: the division above and the one of the stored rows may round differently
            low, high = ([max(0, min(n - 1, at(limits[f"{c}{side}"]) + by)) for c in AXES] for side, by in (("lo", -1), ("hi", 1)))
            any_range = F.lit(False)
            for a, b in curve_ranges(low, high):
                any_range = any_range | F.col("cell").between(a, b)
            rows = rows.where(any_range)
        for c in AXES:
            rows = rows.where((F.col(c) > float(limits[f"{c}lo"])) & (F.col(c) < float(limits[f"{c}hi"])))
        return rows.drop("cell")

    def of_halo(self, snapnum: int, halo_id: int) -> DataFrame:
        """Members of one halo, from the files that hold some."""
        here = (F.col("snapnum") == snapnum) & (F.col("haloId") == halo_id)
        held = load(self.spark, f"{self.path}/halos").where(here)
        if "file" not in held.columns:  # tables stored before the files had numbers name them
            held = load(self.spark, f"{self.path}/files").select("file", "number").join(held.select("number"), "number")
        return self._read(held).where(here).drop("cell")
