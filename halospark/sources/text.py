"""Text catalogues and event logs.

Spark has no row order, but group files identify a particle by its line.  Line numbers are recovered in parallel:
rows of one input split keep their order inside a task, so a line's number is its place in the split plus the row
counts of the splits before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.physics import log10_or_null
from . import schemas

_SPACES = r"\s+"


# input splits whose counts, about forty bytes each, are sent to every executor
MOST_SENT_SPLITS = 1_000_000


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines that are not blank, with the file and the input split they come from."""
    return spark.read.text(path).where(F.trim("value") != "").select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def _most_splits(lines: DataFrame) -> int:
    """No scan of these files has more input splits: one for each file, and one for each full split of the bytes."""
    spark = lines.sparkSession
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    longest, least = (as_bytes(spark.conf.get(f"spark.sql.files.{c}")) for c in ("maxPartitionBytes", "openCostInBytes"))
    size = int(str(lines._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    split = min(longest, max(least, size // max(1, spark.sparkContext.defaultParallelism)))
    return len(lines._jdf.inputFiles()) + size // max(1, split)


def _split_table(tagged: DataFrame) -> DataFrame:
    """(_key, _start, _shift, _lines) of rows with a running ``_id``: what to add to ``_id`` for a place in the file."""
    counts = tagged.groupBy("_key", "_start").agg(
        F.min("_id").alias("_base"), F.count("*").alias("_n"), F.min("_check").alias("_name"), F.max("_check").alias("_other")
    )
    own = Window.partitionBy("_key")
    before = own.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    one_file = F.min("_name").over(own) == F.max("_other").over(own)
    base = F.when(one_file, F.col("_base")).otherwise(F.raise_error(F.lit("two file names have one hash")))
    return counts.select(
        "_key", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - base).alias("_shift"), F.sum("_n").over(own).alias("_lines")
    )


def _numbered(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (_file, _start, ...) in the order of their files with ``_line``, their place in their file, and ``_lines``.

    A task numbers the rows of its input splits; what came before a split is looked up in a table of one row for each
    split, under a hash of the file's name and the split's start.  That table alone is shuffled.  It is sent to the
    executors where the number of splits, which is known from the files, allows it, so that the text itself stays where
    it was read; beyond MOST_SENT_SPLITS the two meet in a join of Spark's choice.
    """
    tagged = rows.withColumns({"_id": F.monotonically_increasing_id(), "_key": F.xxhash64("_file"), "_check": F.hash("_file")})
    splits = _split_table(tagged)
    if _most_splits(lines) <= MOST_SENT_SPLITS:
        splits = F.broadcast(splits)
    found = tagged.join(splits, ["_key", "_start"]).withColumn("_line", F.col("_id") + F.col("_shift"))
    return found.drop("_id", "_shift", "_start", "_key", "_check")


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Add ``_line`` (0-based, per file) and ``_lines`` (their number)."""
    return _numbered(lines, lines)


def _typed(lines: DataFrame, schema: T.StructType, sep: str, keep: list[str]) -> DataFrame:
    """Split the lines and cast; a bad or missing field is NULL."""
    parts = F.split(F.trim("value"), sep)
    cols = [F.get(parts, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]
    return lines.select(*cols, *keep)


def read_catalogue(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    sep: str = _SPACES,
    skip: int = 0,
    skip_last: bool = False,
    keep_line: str | None = None,
    keep_file: str | None = None,
) -> DataFrame:
    """Separated text with a declared schema, without the first ``skip`` and (optionally) the last line per file.

    ``keep_line`` keeps the 0-based number of the data line, ``keep_file`` the path.
    """
    lines = _lines(spark, path)
    keep = []
    if skip or skip_last or keep_line:
        lines = with_line_numbers(lines)
        lines = lines.where(F.col("_line") >= skip)
        if skip_last:
            lines = lines.where(F.col("_line") < F.col("_lines") - 1)
    if keep_line:
        keep.append((F.col("_line") - skip).alias(keep_line))
    if keep_file:
        keep.append(F.col("_file").alias(keep_file))
    return _typed(lines, schema, sep, keep)


def with_path_keys(df: DataFrame, path: str) -> DataFrame:
    """Model and snapshot number out of a path column: ``.../<model>/<name>_<digits>[.suffix]``.

    Paths that do not look like that give NULL keys and ``path_ok`` = false.
    """
    pattern = r"([^/]+)/[^/]*?_z?(\d{3})(\.[^/]*)?$"
    p = F.col(path)
    return df.withColumns(
        {
            "model": F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")),
            "snapnum": F.regexp_extract(p, pattern, 2).try_cast("int"),
            "path_ok": p.rlike(pattern),
        }
    )


def _of_snapshot(df: DataFrame) -> DataFrame:
    return with_path_keys(df, "_file").drop("_file", "model", "path_ok")


def read_sovcirc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Halo catalogues: a header line, and a last line that is no halo."""
    return _of_snapshot(
        read_catalogue(spark, path, schemas.SOVCIRC, skip=1, skip_last=True, keep_file="_file")
    )


def read_stat(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _of_snapshot(read_catalogue(spark, path, schemas.STAT, keep_file="_file"))


def read_sopar(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _of_snapshot(read_catalogue(spark, path, schemas.SOPAR, keep_file="_file"))


def _read_positional(spark, path, schema, sep, n, abs_ids) -> DataFrame:
    df = read_catalogue(spark, path, schema, sep=sep, skip=1, keep_line="idx", keep_file="_file")
    if n is not None:
        df = df.where(F.col("idx") < n)
    if abs_ids:
        df = df.withColumns({f.name: F.abs(f.name) for f in schema.fields})
    return _of_snapshot(df)


def read_sogrp(
    spark: SparkSession, path: str | list[str], n: int | None = None, abs_ids: bool = False
) -> DataFrame:
    """(haloId, hostId) per particle by file position ``idx``; ``n`` keeps the first n (e.g. gas) particles."""
    return _read_positional(spark, path, schemas.SOGRP, r"\s*,\s*", n, abs_ids)


def read_grp(
    spark: SparkSession, path: str | list[str], n: int | None = None, abs_ids: bool = False
) -> DataFrame:
    """galId per particle by file position ``idx``."""
    return _read_positional(spark, path, schemas.GRP, _SPACES, n, abs_ids)


def rows_upto(ptype: int, n_gas: int, n_dark: int, n_star: int) -> int:
    """How many leading rows of a group file belong to a type code (0 gas; 1 gas and dark; 4 all)."""
    return {0: n_gas, 1: n_gas + n_dark, 4: n_gas + n_dark + n_star}[ptype]


def read_fof(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Friends-of-friends groups with a galaxy (``Mgal >= 0``), renumbered 0.. in the order of each file.

    The groups are numbered as they are read, after the filter; a header line that looks like one of them is taken off.
    """
    lines = _lines(spark, path)
    rows = _typed(lines, schemas.FOF, _SPACES, ["_file", "_start"])
    numbered = _numbered(rows.where("Mgal >= 0"), lines)
    # one row for each file: whether its first line was numbered too
    first = rows.where("_start = 0").withColumn("_id", F.monotonically_increasing_id())
    first = first.groupBy("_file").agg(F.coalesce(F.min_by("Mgal", "_id") >= 0, F.lit(False)).cast("int").alias("_header"))
    groups = numbered.join(first, "_file").where("_line >= _header").withColumn("gid", F.col("_line") - F.col("_header"))
    return _of_snapshot(groups.select("gid", "Mgal", "Mstar", "Mfof", "x", "y", "z", "_file"))


def read_timegrid(spark: SparkSession, path: str) -> DataFrame:
    return read_catalogue(spark, path, schemas.TIMEGRID, skip=1)


def read_tcosmic(spark: SparkSession, path: str) -> DataFrame:
    return read_catalogue(spark, path, schemas.TCOSMIC, skip=1)


def read_sightlines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_catalogue(spark, path, schemas.SIGHTLINE)


def read_zplan(spark: SparkSession, path: str) -> DataFrame:
    return read_catalogue(spark, path, schemas.ZPLAN)


def read_phase_grid(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(schemas.PHASE_GRID).option("header", True).csv(path)
    return df.withColumn("LogM", log10_or_null(F.col("Mass")))


# -- event logs -------------------------------------------------------------------------------------------
def read_log(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    columns: list[str] | None = None,
    sep: str = ",",
) -> DataFrame:
    """Event log in many files ``name.N``; only ``name.0`` has a header line.

    ``sep`` of one character goes to the CSV reader with column pruning; anything else is a regular expression.
    The header is the row of ``*.0`` whose first two (numeric) fields do not parse.
    """
    first, second = schema.fields[0].name, schema.fields[1].name
    if len(sep) == 1:
        rows = spark.read.schema(schema).option("sep", sep).csv(path)
        named = rows.select("*", F.col("_metadata.file_name").alias("_file"))
    else:
        named = _typed(
            spark.read.text(path)
            .where(F.trim("value") != "")
            .select("value", F.col("_metadata.file_name").alias("_file")),
            schema,
            sep,
            ["_file"],
        )
    header = F.col("_file").endswith(".0") & F.col(first).isNull() & F.col(second).isNull()
    return named.where(~header).select(*(columns or schema.fieldNames()))


def read_split(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    return read_log(spark, path, schemas.SPLIT, sep=sep)


def read_initwinds(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str] | None = None,
    min_pot_id: bool = True,
    sep: str = ",",
) -> DataFrame:
    """Wind launches; ``min_pot_id=False`` for logs written without that column."""
    kept = [f for f in schemas.INITWINDS.fields if min_pot_id or f.name != "MinPotID"]
    return read_log(spark, path, T.StructType(kept), columns, sep)


def read_rejoin(
    spark: SparkSession, path: str | list[str], columns: list[str] | None = None, sep: str = ","
) -> DataFrame:
    return read_log(spark, path, schemas.REJOIN, columns, sep)


def read_phews(
    spark: SparkSession, path: str | list[str], columns: list[str] | None = None, sep: str = _SPACES
) -> DataFrame:
    return read_log(spark, path, schemas.PHEWS, columns, sep)
