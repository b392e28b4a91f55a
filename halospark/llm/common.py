"""What the operators share: tables of the test folder, white space, the shared folder, small Arrow helpers."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halospark.operators.lineage import new_path

# What a batch took goes back to the system when it is done with, instead of staying with the worker for its life.
pa.set_memory_pool(pa.system_memory_pool())

#: White space is these six ASCII characters only; letters are folded from A-Z to a-z only.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def free_prefix(docs: DataFrame, wanted: str) -> str:
    """``wanted``, longer by as many underscores as it takes that no column of the input begins with it."""
    taken = [c.lower() for c in docs.columns]
    while any(c.startswith(wanted) for c in taken):
        wanted = f"_{wanted}"
    return wanted


def check_prefix(docs: DataFrame, into: str) -> None:
    clash = [c for c in docs.columns if c.lower().startswith(into.lower())]
    if clash:
        raise ValueError(f"the input has columns {clash}: name another prefix than {into!r}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """The words of a text as an array; none for an empty or missing text."""
    body = F.coalesce(stripped(text), F.lit(""))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_RUN))


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, with a scheme, for files that tasks write themselves."""
    path = new_path(spark)
    return path if ":" in path else f"file://{path}"


def shuffle_parts(spark: SparkSession) -> int:
    """The number of parts that the cluster's owner wants a shuffle to have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20):
    """Slices of a batch whose ``column`` holds at most ``max_bytes`` (or one row): bounds a task's memory."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < len(size):
        base = end[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(end, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_list(column: pa.Array) -> list:
    """``to_pylist`` of a string column, several times faster."""
    return column.to_numpy(zero_copy_only=False).tolist()


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and all words in one flat array."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    offsets = parts.offsets.to_numpy()
    flat = parts.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    seen = np.concatenate([[0], np.cumsum(real)])
    counts = seen[offsets[1:] - offsets[0]] - seen[offsets[:-1] - offsets[0]]
    return counts, flat.filter(pa.array(real))


def spread(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``lengths``, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def give_back() -> None:
    """Free memory goes back to the system, where the C library can do that: workers live on between tasks."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
