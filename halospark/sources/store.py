"""Writing and reusing derived tables."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FORMATS = ("parquet", "csv")


def _check(fmt: str) -> None:
    if fmt not in _FORMATS:
        raise ValueError(f"format must be one of {_FORMATS}")


def save(
    df: DataFrame, path: str, fmt: str = "parquet", schema: T.StructType | None = None, sort_by: list[str] | None = None
) -> None:
    """Write a table, replacing what is there.  ``schema`` fixes column order and types.

    ``sort_by`` range-partitions and sorts, so files follow the global order without a single-task sort.
    """
    _check(fmt)
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in df.columns])
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def load(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    _check(fmt)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def table_path(base: str, name: str, params: dict[str, object], fmt: str = "parquet") -> str:
    """Where a table with these parameters lives: equal parameters, equal place."""
    text = json.dumps({**params, "fformat": fmt}, sort_keys=True, default=str)
    return f"{base.rstrip('/')}/{name}/{hashlib.sha256(text.encode()).hexdigest()[:20]}"


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions below a table's path, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.isDirectory())
    done = [f"{path}/{name}" for name in found]
    return [v for v in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{v}/_SUCCESS"))]


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a version of the table at this path has been committed."""
    return bool(_versions(spark, path))


def inputs_version(*tables: DataFrame) -> str:
    """What the rows of some tables come from, as a short key: the name, length and time of every file they read.

    The files are listed by Spark, not read; a table without files is told by its rows.  What is computed from the files
    is not in the key: that is for the parameters of the table that is built.
    """
    spark = tables[0].sparkSession
    parts = []
    for df in tables:
        files = sorted(df.inputFiles())
        if files:
            rows = spark.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
        else:
            rows = df
        facts = rows.select(F.xxhash64(*rows.columns).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h") % 1_000_003).alias("s"))
        parts.append(tuple(facts.first()))
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:20]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(
    spark: SparkSession,
    base: str,
    name: str,
    params: dict[str, object],
    build: Callable[[], DataFrame],
    overwrite: bool = False,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    sort_by: list[str] | None = None,
    inputs: str = "",
    buckets: tuple[int, list[str]] | None = None,
) -> DataFrame:
    """Reuse the stored table of exactly these parameters, or build, store and read it back.

    Each write is a new version next to the old one, which goes only when the new one is complete: ``build`` may read
    the table that it replaces, and a failed write leaves it as it was.  With ``inputs`` (of :func:`inputs_version`) a
    version is reused only where it was built from the same inputs.  ``buckets`` = (number, keys) stores the rows in
    buckets, so that columns added later (:func:`add_column`) and joins on the keys meet them without a shuffle.
    """
    path = table_path(base, name, params, fmt)
    old = _versions(spark, path)
    if overwrite or not old or (inputs and not old[-1].endswith(f"-{inputs}")):
        version = f"{path}/{time.time_ns():020d}-{uuid4().hex}" + (f"-{inputs}" if inputs else "")
        if buckets is None:
            save(build(), version, fmt, schema, sort_by)
        else:
            _save_buckets(build(), version, *buckets)
        for gone in old:
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(gone)}")
            _delete(spark, gone)
        old = [version]
    if buckets is not None:
        return _with_added(spark, old[-1], *buckets)
    return load(spark, old[-1], fmt, schema if fmt == "csv" else None)


# -- columns added to a stored table ------------------------------------------------------------------------
def _table_name(path: str) -> str:
    return f"stored_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def _save_buckets(df: DataFrame, path: str, n: int, keys: list[str]) -> None:
    writer = df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys)
    writer.option("path", path).saveAsTable(_table_name(path))


def _load_buckets(spark: SparkSession, path: str, n: int, keys: list[str]) -> DataFrame:
    """The bucketed table at a path; a session that has not written it learns of its buckets."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = spark.read.parquet(path).schema.toDDL()
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _added(spark: SparkSession, version: str) -> dict[str, str]:
    """Names of the columns added to a version, and where the newest complete side table of each is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{version}/_added")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
    found = {name: _versions(spark, f"{version}/_added/{name}") for name in names}
    return {name: paths[-1] for name, paths in found.items() if paths}


def _with_added(spark: SparkSession, version: str, n: int, keys: list[str]) -> DataFrame:
    table = _load_buckets(spark, version, n, keys)
    for path in _added(spark, version).values():
        table = table.join(_load_buckets(spark, path, n, keys), keys, "left")
    return table


def add_column(
    spark: SparkSession,
    base: str,
    name: str,
    params: dict[str, object],
    column: str,
    build: Callable[[DataFrame], DataFrame],
    buckets: tuple[int, list[str]],
    overwrite: bool = False,
) -> DataFrame:
    """A stored, bucketed table with one more column, which ``build`` works out from the table where it is not there yet.

    The column is kept beside the rows, in a side table of the same buckets with the keys and the column only; the rows
    are not written again, and the side table goes with the version it belongs to.  The keys must name one row each.
    """
    version = _versions(spark, table_path(base, name, params))[-1]
    n, keys = buckets
    if overwrite or column not in _added(spark, version):
        table = _with_added(spark, version, n, keys)
        side = f"{version}/_added/{column}"
        old = _versions(spark, side)
        new = f"{side}/{time.time_ns():020d}-{uuid4().hex}"
        _save_buckets(build(table.drop(column)).select(*keys, column), new, n, keys)
        # counted in its buckets, without a shuffle
        if _load_buckets(spark, new, n, keys).groupBy(*keys).count().where("count > 1").limit(1).count():
            spark.sql(f"DROP TABLE {_table_name(new)}")
            _delete(spark, new)
            raise ValueError(f"the keys {keys} name several rows: {column} cannot be kept beside them")
        for gone in old:
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(gone)}")
            _delete(spark, gone)
    return _with_added(spark, version, n, keys)


def ensure_column(df: DataFrame, name: str, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add a derived column only when a stored table does not have it yet."""
    return df if name in df.columns else add(df)


def write_tracks(tracks: DataFrame, path: str, key: str = "PhEWKey", n: int | None = None) -> None:
    """Nested tracks in ``n`` files by particle, or as many as their size asks for; segments of a track spread too."""
    keys = [key, "segment"] if "segment" in tracks.columns else [key]
    dealt = tracks.repartition(n, *keys) if n else tracks.hint("rebalance", *keys)
    dealt.write.mode("overwrite").parquet(path)


def write_sightlines(lines: DataFrame, path: str) -> None:
    """Text files by direction, lines by distance and target, in the fixed-width form of the simulator.

    Lines are dealt by ranges of (direction, distance, target): a direction has as many files as its size asks for, and
    their names follow the order of the lines.
    """

    def number(c: str) -> Column:
        return F.format_string("% .6f", F.col(c))

    text = lines.withColumn("value", F.concat_ws(" ", number("x"), number("y"), number("z"), F.col("axis").cast("string"), "label"))
    (
        text.repartitionByRange("dir", "b", "rank")
        .sortWithinPartitions("dir", "b", "rank")
        .select("value", "dir")
        .write.mode("overwrite")
        .partitionBy("dir")
        .text(path)
    )
