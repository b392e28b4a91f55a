"""Hard negatives by exact integer scores, looked up in subset-sum tables of the anchors (Four Russians).

Vectors become integers, floor(SCALE * x).  The score of two is their integer inner product.

1. Index: every row's integers are written as packed bit planes (two's complement, the last plane counts negative), one
   byte for each group of eight dimensions, in order of label and vec_id, in blocks of CANDIDATES rows.
2. Tables: for a group of eight dimensions an anchor has 256 subset sums.  A byte of a candidate's plane picks one; the
   picks of all groups add up to the plane's inner product, and planes add up by shifts to the full score.  Tables are
   made in the task, for SIDE anchors at a time, and every score is exact.
3. Positives: blocks of ANCHORS anchors meet the blocks of their own label only, and each pair of blocks keeps the best
   of each anchor.  Negatives: each block of anchors, now with its positives' scores, meets every block of candidates,
   and keeps the best in the range of each positive.  The best of all blocks are ranked by Spark with partial limits.

The anchors are a query set that meets all rows in blocks; a block pair returns a few rows for each anchor.

Cases: rows with a NULL label, vec_id or vector, or with a NULL or non-finite component, take no part.  A shorter vector
counts as continued with zeros.  Rows repeated under one vec_id each count as a row, but a row is never a positive of
its own vec_id; a repeated anchor gives its rows each time, numbered by ``anchor``.  Equal scores go by vec_id.  Tables
without rows or anchors give none; an anchor without positives gives none.  Components whose integers do not fit 31
bits are an error.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halospark.operators.joins import join_skewed
from halospark.operators.lineage import cut_lineage
from halospark.operators.ordered import with_row_number

from .common import packed

SCALE = 256
#: Rows of a block of candidates, and of a block of anchors; anchors whose tables are held at once.
CANDIDATES, ANCHORS, SIDE = 4096, 1024, 128
GROUP = 8


# -- integers, planes and tables ------------------------------------------------------------------------------------------
def to_planes(ints: np.ndarray, planes: int) -> np.ndarray:
    """(row, plane, group): the bytes of ``planes`` bit planes of integers (row, dimension), eight dimensions a byte."""
    bits = (ints[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray, groups: int) -> np.ndarray:
    """(group, 256, anchor): for each byte the sum of the anchor's integers in the dimensions whose bits it has."""
    wide = np.zeros((len(anchors), groups * GROUP), np.int64)
    wide[:, : anchors.shape[1]] = anchors
    eight = wide.T.reshape(groups, GROUP, len(anchors))
    table = np.zeros((groups, 1 << GROUP, len(anchors)), np.int64)
    for k in range(GROUP):
        table[:, 1 << k : 2 << k] = table[:, : 1 << k] + eight[:, k : k + 1]
    return table


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidate, anchor): inner products, from the highest plane down by shift and add."""
    total = np.zeros((planes.shape[0], tables.shape[2]), tables.dtype)
    top = planes.shape[1] - 1
    for k in range(top, -1, -1):
        part = tables[0][planes[:, k, 0]]
        for g in range(1, planes.shape[2]):
            part += tables[g][planes[:, k, g]]
        total = -part if k == top else (total << 1) + part
    return total


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, ints): rows that take part."""
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    fits = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    small = F.forall("ints", lambda i: F.abs(i) < (1 << 30))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")
    rows = rows.where("vec_id is not null and label is not null and embedding is not null").where(fits).withColumn("ints", ints)
    return rows.select("vec_id", "label", F.when(small, F.col("ints")).otherwise(F.raise_error(F.lit("a component is too large"))).cast("array<int>").alias("ints"))


def indexed(rows: DataFrame) -> tuple[DataFrame, int, bool]:
    """Rows (vec_id, label, ints, planes, block) by label and vec_id, the number of planes, and whether scores need 64 bits."""
    facts = rows.agg(
        F.coalesce(F.max(F.array_max(F.transform("ints", lambda i: F.greatest(i, -1 - i)))), F.lit(0)).alias("largest"),
        F.coalesce(F.max(F.size("ints")), F.lit(0)).alias("dims"),
    ).first()
    planes, dims = int(facts.largest).bit_length() + 1, max(1, facts.dims)
    at_once = max(1, (1 << 22) // (planes * dims))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, at_once):
                part = batch.slice(k, at_once)
                column = part.column("ints")
                size = column.value_lengths().to_numpy()
                ints = np.zeros((part.num_rows, dims), np.int64)
                ints[np.arange(dims) < size[:, None]] = column.flatten().to_numpy()
                data = [pa.array([packed(r) for r in x], pa.binary()) for x in (ints.astype("<i4"), to_planes(ints, planes))]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), *data], names=["vec_id", "label", "ints", "planes"])

    packed_rows = rows.mapInArrow(task, "vec_id bigint, label bigint, ints binary, planes binary")
    numbered = with_row_number(packed_rows, [F.col("label"), F.col("vec_id")], "rn")
    index = numbered.select("vec_id", "label", "ints", "planes", "rn", F.floor((F.col("rn") - 1) / CANDIDATES).alias("block"))
    return cut_lineage(index), planes, 4 * dims * (int(facts.largest) + 1) ** 2 >= 1 << 31


# -- a pair of blocks ---------------------------------------------------------------------------------------------------------
def _array(column: pa.ChunkedArray, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _best(score: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each anchor the k largest allowed scores, one (anchors, candidates) a round; equal scores in candidate order."""
    hidden = np.where(allowed, score, np.iinfo(score.dtype).min)
    every = np.arange(score.shape[1])
    for _ in range(min(k, score.shape[0])):
        at = hidden.argmax(axis=0)
        ok = np.flatnonzero(hidden[at, every] > np.iinfo(score.dtype).min)
        if not len(ok):
            return
        yield ok, at[ok]
        hidden[at, every] = np.iinfo(score.dtype).min


def _sides(anchors: pa.Table, block: pa.Table, planes: int, wide: bool) -> Iterator[tuple]:
    """For SIDE anchors at a time: where they begin, their ids and labels, the candidates' ids and labels, the scores."""
    if not anchors.num_rows or not block.num_rows:
        return
    block = block.sort_by("vec_id")
    ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
    bytes_ = _array(block.column("planes"), "u1", planes, -1)
    a_id, a_label = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    ints = _array(anchors.column("ints"), "<i4", -1)
    for k in range(0, len(a_id), SIDE):
        some = slice(k, k + SIDE)
        tables = subset_sums(ints[some].astype(np.int64), bytes_.shape[2])
        yield k, a_id[some], a_label[some], ids, labels, scores(tables if wide else tables.astype(np.int32), bytes_)


def _table(names: list[str], parts: list[tuple]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(names, columns)})


def _positives(planes: int, wide: bool, k: int):
    def task(anchors: pa.Table, block: pa.Table) -> pa.Table:
        number = anchors.column("anchor").to_numpy()
        out = []
        for at, a_id, a_label, ids, labels, score in _sides(anchors, block, planes, wide):
            allowed = (labels[:, None] == a_label) & (ids[:, None] != a_id)
            for which, row in _best(score, allowed, k):
                out.append((number[at + which], ids[row], score[row, which]))
        return _table(["anchor", "vec_id", "score"], out)

    return task


def _negatives(planes: int, wide: bool, k: int, low: int, high: int):
    """``low`` and ``high``: the range of a negative's score, in percent of the positive's."""

    def task(anchors: pa.Table, block: pa.Table) -> pa.Table:
        number = anchors.column("anchor").to_numpy()
        positives = anchors.column("positive_scores").combine_chunks()
        size = positives.value_lengths().to_numpy()
        most = int(size.max(initial=0))
        wanted = np.zeros((len(size), most), np.int64)
        wanted[np.arange(most) < size[:, None]] = positives.flatten().to_numpy()
        out = []
        for at, _, a_label, ids, labels, score in _sides(anchors, block, planes, wide):
            other, hundred = labels[:, None] != a_label, 100 * score.astype(np.int64)
            for nth in range(most):
                own = wanted[at : at + len(a_label), nth]
                allowed = other & (hundred >= low * own) & (hundred <= high * own) & (nth < size[at : at + len(a_label)])
                for which, row in _best(score, allowed, k):
                    out.append((number[at + which], np.full(len(which), nth), ids[row], score[row, which]))
        return _table(["anchor", "nth", "vec_id", "score"], out)

    return task


# -- the search -------------------------------------------------------------------------------------------------------------------
def mine(vectors: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor).

    ``anchor``: a condition on vec_id; ``label``: the label of a row.  An anchor's positives are its ``positives`` best
    rows of the same label; for each of them the ``negatives`` best rows of other labels come back whose score is
    between ``low`` and ``high`` percent of the positive's.  ``anchor`` in the result numbers the anchors.
    """
    index, planes, wide = indexed(usable(vectors, label))
    chosen = with_row_number(index.where(anchor).select("vec_id", "label", "ints"), [F.col("label"), F.col("vec_id")], "anchor")
    chosen = cut_lineage(chosen.withColumn("anchors", F.floor((F.col("anchor") - 1) / ANCHORS)))
    candidates = index.select("block", "vec_id", "label", "planes")

    # same label: the blocks from the first to the last row of the label
    spans = index.groupBy("label").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    there = join_skewed(chosen, spans, ["label"], salt_on=["anchor"]).withColumn("block", F.explode(F.sequence("first", "last"))).drop("first", "last")
    pairs = there.select(F.col("anchors").alias("side"), F.col("block").alias("of")).distinct()
    meeting = candidates.join(pairs, F.col("block") == F.col("of")).drop("of")
    found = (
        there.groupBy("anchors", "block")
        .cogroup(meeting.groupBy("side", "block"))
        .applyInArrow(_positives(planes, wide, positives), "anchor bigint, vec_id bigint, score bigint")
    )
    order = [F.col("score").desc(), F.col("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("rank") <= positives)
    ranked = cut_lineage(ranked.select("anchor", (F.col("rank") - 1).cast("long").alias("nth"), "vec_id", "score"))

    # other labels: every block
    last = F.coalesce(F.max("block"), F.lit(0)), F.coalesce(F.max("anchors"), F.lit(0))
    last_block, last_anchors = index.agg(last[0]).first()[0], chosen.agg(last[1]).first()[0]
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))
    lists = ranked.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "score"))), lambda p: p["score"]).alias("positive_scores"))
    asking = chosen.join(lists, "anchor").withColumn("block", F.explode(upto(last_block)))
    every = candidates.withColumn("anchors", F.explode(upto(last_anchors)))
    near = (
        asking.groupBy("anchors", "block")
        .cogroup(every.groupBy("anchors", "block"))
        .applyInArrow(_negatives(planes, wide, negatives, low, high), "anchor bigint, nth bigint, vec_id bigint, score bigint")
    )
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(*order))).where(F.col("rank") <= negatives)
    named = ranked.join(chosen.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    named = named.select("anchor", "anchor_id", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(named, ["anchor", "nth"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "anchor"
    )
