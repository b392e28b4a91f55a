"""Approximate nearest neighbours on shifted space-filling curves.

Each of CURVES orderings projects the unit vectors on DIMS random orthogonal directions, shifts them, cuts the
coordinates into 2^BITS steps, and numbers the cells along a Hilbert curve.  Spark range-partitions and ranks every
vector in every ordering.  A query looks at the window of ranks around its own place in each ordering, the windows are
met block by block of BLOCK rows as matrix products, and the best of all windows are merged by exact cosine.  Blocks
only deal the work out: what a query sees of a block is cut to its window, so BLOCK has no part in the result.

``window`` is the share of an ordering that a window covers.  Vectors that cluster are found with small windows;
vectors spread evenly over many dimensions (as in the test tables, where the nearest cosine is about 0.4) have no
order that keeps neighbours together, and need windows of half an ordering for a recall above 0.9.  The work is then
in proportion to queries times vectors, in blocks.

Cases: vectors that are NULL, all zero or hold NULL or non-finite components take no part, nor do those whose length
is not the most frequent one (the larger of two equally frequent); equal cosines go to the smaller vec_id; rows
repeated under one vec_id with equal vectors count once; a NULL vec_id takes no part; with fewer than ``k``
candidates all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halospark.operators.joins import join_skewed
from halospark.operators.lineage import cut_lineage
from halospark.operators.ordered import running_total

CURVES, DIMS, BITS, BLOCK, WINDOW, SEED = 4, 10, 6, 4096, 0.5, 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points (n x dims, each below 2^bits); dims * bits <= 63."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    high = 1 << (bits - 1)
    # from the top bit down: reflect and swap axes as the curve turns
    q = high
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = high
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Ordering:
    """One curve: its directions and its shift, the same in every task."""

    def __init__(self, curve: int, length: int):
        rng = np.random.default_rng([SEED, curve, length])
        dims = min(DIMS, length)
        self.directions = np.linalg.qr(rng.standard_normal((length, dims)))[0]
        self.shift = rng.uniform(0, 1, dims)
        self.scale = np.sqrt(length) / 8 * ((1 << BITS) - 1)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A projection of a unit vector spreads by 1 / sqrt(length); eight of that fill the range."""
        cells = np.floor((unit @ self.directions) * self.scale + self.shift + (1 << BITS) / 2)
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = vectors.select(F.col("vec_id").cast("long"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & fine & F.exists("embedding", lambda x: x != 0))
    length = df.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1)
    top = length.first()
    return df.where(F.size("embedding") == (top.length if top else 0))


def folded(points: DataFrame, query: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (vec_id, nth, ids, is_query, embedding), and the query rows (query_id, vec_id, nth) they stand for.

    ``ids`` are the ``k`` + 1 smallest vec_ids with that vector, ``vec_id`` the first of them; ``nth`` tells vectors of
    one vec_id apart.
    """
    once = cut_lineage(points.withColumn("is_query", F.coalesce(query, F.lit(False))).groupBy("vec_id", "embedding").agg(F.max("is_query").alias("is_query")))
    # row_number with a bound is cut down in every task before the shuffle, so a large group sends k + 1 rows from each
    same = Window.partitionBy("embedding").orderBy("vec_id")
    least = once.select("vec_id", "embedding").withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1)
    ids = least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = once.where("is_query").groupBy("embedding").agg(F.lit(True).alias("is_query"))
    groups = ids.join(asked, "embedding", "left").select(
        F.col("ids")[0].alias("vec_id"), "ids", F.coalesce("is_query", F.lit(False)).alias("is_query"), "embedding"
    )
    groups = cut_lineage(groups.withColumn("nth", F.row_number().over(Window.partitionBy("vec_id").orderBy("embedding"))))
    members = once.where("is_query").select(F.col("vec_id").alias("query_id"), "embedding")
    # the many query rows of one vector are spread over parts of their own
    members = join_skewed(members, groups.where("is_query").select("embedding", "vec_id", "nth"), ["embedding"], salt_on=["query_id"])
    return groups, cut_lineage(members.select("query_id", "vec_id", "nth"))


def ordered(points: DataFrame) -> DataFrame:
    """(curve, rank, n, vec_id, nth, is_query, vector): every distinct vector's rank (from 0) in each ordering of n."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orderings: list[Ordering] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1)
            orderings = orderings or [Ordering(c, v.shape[1]) for c in range(CURVES)]
            # scaled by the largest component first, so that no square can overflow or vanish
            unit = v / np.abs(v).max(axis=1, keepdims=True)
            unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            packed = pa.array([row.tobytes() for row in v], pa.binary())
            for c, o in enumerate(orderings):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), c, np.int32)), pa.array(o.keys(unit)), batch.column("vec_id"), batch.column("nth"), batch.column("is_query"), packed],
                    names=["curve", "place", "vec_id", "nth", "is_query", "vector"],
                )

    keyed = points.select("vec_id", "nth", "is_query", "embedding").mapInArrow(
        task, "curve int, place bigint, vec_id bigint, nth int, is_query boolean, vector binary"
    )
    ranked = running_total(keyed, ["curve"], [F.col("place"), F.col("vec_id"), F.col("nth")], F.lit(1), "rank", "n")
    return ranked.withColumn("rank", F.col("rank") - 1).drop("place")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; the same bits for the same pair, wherever it is met."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return np.clip((a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))), -1.0, 1.0)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks().to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _block_best(k: int):
    def task(queries: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, float]] = []
        if queries.num_rows and block.num_rows:
            q, v = _matrix(queries.column("vector")), _matrix(block.column("vector"))
            q_id, q_nth = queries.column("vec_id").to_pylist(), queries.column("nth").to_pylist()
            by_rank = np.argsort(block.column("rank").to_numpy())
            v, v_rank = v[by_rank], block.column("rank").to_numpy()[by_rank]
            v_id, v_nth = block.column("vec_id").to_numpy()[by_rank], block.column("nth").to_numpy()[by_rank]
            low = np.searchsorted(v_rank, queries.column("start").to_numpy(), "left")
            high = np.searchsorted(v_rank, queries.column("stop").to_numpy(), "right")
            unit_v = _unit(v)
            for first in range(0, len(q), 256):
                near = _unit(q[first : first + 256]) @ unit_v.T
                for i, row in enumerate(near, first):
                    row = row[low[i] : high[i]]
                    bound = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    hit = low[i] + np.flatnonzero(row >= bound - 1e-9)
                    exact = cosines(np.broadcast_to(q[i], (len(hit), q.shape[1])), v[hit])
                    for j in np.lexsort((v_nth[hit], v_id[hit], -exact))[:k]:
                        out.append((q_id[i], q_nth[i], int(v_id[hit[j]]), int(v_nth[hit[j]]), float(exact[j])))
        kinds = {"q_vec": pa.int64(), "q_nth": pa.int32(), "vec_id": pa.int64(), "nth": pa.int32(), "score": pa.float64()}
        columns = zip(*out) if out else [()] * len(kinds)
        return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns)})

    return task


def nearest(vectors: DataFrame, query: Column, k: int = 5, window: float = WINDOW) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest by cosine that the windows of each query row hold.

    Equal vectors share one place, so windows and blocks count distinct vectors; their ids come back after the rerank.
    """
    groups, members = folded(usable(vectors), query, k)
    # besides the k wanted, a query meets every vector under its own vec_id
    own = groups.select(F.explode("ids").alias("id"), "vec_id").join(members.select(F.col("query_id").alias("id")).distinct(), "id")
    most = own.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    places = cut_lineage(ordered(groups).withColumn("block", F.floor(F.col("rank") / BLOCK)))
    reach = F.ceil(F.col("n") * (window / 2))
    # a window that would pass an end of the ordering is moved inside, so that all are equally wide
    start = F.greatest(F.lit(0), F.least(F.col("rank") - reach, F.col("n") - 1 - 2 * reach))
    stop = F.least(F.col("n") - 1, F.greatest(F.col("rank") + reach, 2 * reach))
    probes = places.where("is_query").select(
        "curve",
        F.explode(F.sequence(F.floor(start / BLOCK), F.floor(stop / BLOCK))).alias("block"),
        start.cast("long").alias("start"),
        stop.cast("long").alias("stop"),
        "vec_id",
        "nth",
        "vector",
    )
    met = (
        probes.groupBy("curve", "block")
        .cogroup(places.select("curve", "block", "rank", "vec_id", "nth", "vector").groupBy("curve", "block"))
        .applyInArrow(_block_best(k + most), "q_vec bigint, q_nth int, vec_id bigint, nth int, score double")
    )
    order = F.struct((-F.col("score")).alias("far"), F.col("vec_id"), F.col("nth"), F.col("score"))
    best = met.groupBy("q_vec", "q_nth").agg(F.slice(F.sort_array(F.collect_set(order)), 1, k + most).alias("best"))
    each = best.select("q_vec", "q_nth", F.explode("best").alias("b")).select("q_vec", "q_nth", "b.vec_id", "b.nth", "b.score")
    # the ids of a large group go to many queries
    given = join_skewed(each, groups.select("vec_id", "nth", "ids"), ["vec_id", "nth"], salt_on=["q_vec", "q_nth"])
    found = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id"), F.col("score").alias("score")))))
    lists = given.groupBy("q_vec", "q_nth").agg(F.sort_array(found).alias("found"))
    lists = lists.select(F.col("q_vec").alias("vec_id"), F.col("q_nth").alias("nth"), "found")
    mine = join_skewed(members, lists, ["vec_id", "nth"], salt_on=["query_id"]).select(
        "query_id", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k).alias("best")
    )
    return mine.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score"
    )
