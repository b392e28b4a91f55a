"""Jaccard similarity join of word shingles with signature trees, and the classes of linked documents.

1. Every document becomes its set of shingle hashes (64 bit), computed in its own task.  Tasks also count how often
   shingles fall into the cells of a sketch of fixed size; the summed sketch, on a logarithmic scale, is broadcast.
2. Sets that can be similar are brought together without loss: in any fixed order of all shingles, two sets with
   Jaccard similarity t share a shingle among the first n - ceil(t * n) + 1 of each.  The order is by sketch cell,
   rarest first, so passages that many documents share hardly come up.  Equal sets of a batch are folded first, and keys
   travel as packed arrays with their place in the order.  In a large corpus unrelated documents share a key by chance,
   and chains of those would make one group of all.  So the documents of a key that up to FEW share are met as pairs: a
   pair goes on if the key can be its first common shingle with enough shingles behind it, and is an edge if the
   profiles of the two sets (shingles counted in hashed parts) differ by no more than similar sets can.  The documents of
   a key that more share are chained; a bucket returns a forest of those.
3. The connected groups of that candidate graph are joined by signature trees.  A leaf is one set as a bitmap of
   hashed tokens with its size; an inner node ORs the bitmaps of its children and keeps their range of sizes and
   the largest number of tokens that share bits in one leaf.  Two subtrees are walked together and left as soon as the
   largest possible overlap, popcount(A & B) plus hidden tokens, cannot reach the threshold for any sizes in their
   ranges.  Leaves stand in the order of their smallest hashes, so that similar sets share nodes.  Leaf pairs that
   stay are checked on their exact sets, unless only classes are wanted and links have united them already.  A large
   group is cut into blocks of BLOCK sets sorted by size, and each pair of blocks with possible sizes is a task of
   its own: no group is ever one task.
4. Links form a forest per task; components are found by exchanging smallest neighbours in rounds on tables.  Where
   links are counted, a task gives one number for each of its sets, never the pairs.

Nothing is capped or sampled.  A group of n near copies of similar size costs (n / BLOCK)^2 / 2 block tasks.

Cases: a text without words, empty or NULL has no shingles and is alone; with fewer words than a shingle has the whole
sequence is the one shingle; rows repeated under one doc_id are linked with each other and each is returned (a row's
links are counted from its own text); a NULL doc_id is alone, with a NULL component and no links; other columns are
ignored by the join and kept by :func:`one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halospark.operators.lineage import cut_and_count, cut_lineage
from halospark.operators.ordered import running_total

from .common import as_list, free_prefix, packed, pieces, shuffle_parts, split_words, spread

#: Sets per block and children per node of a signature tree.
BLOCK, FANOUT = 512, 8
#: The sketch has 2^SKETCH_BITS cells (of one byte when broadcast), whatever the input, and travels in SLICES parts.
SKETCH_BITS, SLICES = 24, 64
#: Bytes of text that a task turns into sets at once.
PIECE_BYTES = 4 << 20
#: Node pairs whose bitmaps are compared at once, in bytes.
PAIR_BYTES = 16 << 20
#: Leaves of a side whose exact overlaps are counted together, and shingles of theirs at once.
TILE, TILE_SHINGLES = 64, 1 << 16
#: Sum of bytes of the sets that one small-group task holds.
GROUP_BYTES = 32 << 20
#: Documents of a key that are met as pairs.
FEW = 16
#: A profile has a part (one byte) for each SHINGLES_PER_PART shingles, in steps of two and within these bounds.
SHINGLES_PER_PART, LEAST_PARTS, MOST_PARTS = 8, 32, 4096

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S1, _S2, _S3 = np.uint64(30), np.uint64(27), np.uint64(31)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value for each 64-bit value."""
    x = (x + _STEP).astype(np.uint64)
    x = (x ^ (x >> _S1)) * _M1
    x = (x ^ (x >> _S2)) * _M2
    return x ^ (x >> _S3)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    import xxhash

    counts, flat = split_words(pc.ascii_lower(texts))
    coded = flat.dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in as_list(coded.dictionary)] or [0], np.uint64)
    word = own[coded.indices.to_numpy()] if len(flat) else own[:0]
    last = np.cumsum(counts)
    sets, empty = [], np.zeros(0, np.uint64)
    # rolling over the flat array; shingles that cross texts are never looked at
    roll = np.zeros(max(0, len(word)), np.uint64)
    with np.errstate(over="ignore"):
        n = len(word) - width + 1
        if n > 0:
            mixed = np.full(n, width, np.uint64)
            for k in range(width):
                mixed = scramble(mixed ^ word[k : k + n])
            roll[:n] = mixed
        for c, end in zip(counts.tolist(), last.tolist()):
            if c >= width:
                sets.append(np.unique(roll[end - c : end - width + 1]))
            elif c:
                whole = np.full(1, c, np.uint64)
                for k in range(end - c, end):
                    whole = scramble(whole ^ word[k])
                sets.append(scramble(whole ^ np.uint64(c)))
            else:
                sets.append(empty)
    return sets


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a = scramble(s).sum(dtype=np.uint64)
        b = scramble(s ^ _M2).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


# -- keys that similar sets share --------------------------------------------------------------------------
def cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def prefix(s: np.ndarray, rarity: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the order (sketch level, hash): similar sets share at least one of them."""
    n = len(s)
    keep = n - -(-percent * n // 100) + 1
    level = rarity[cells(s)]
    if keep >= n:
        return s
    bound = np.partition(level, keep - 1)[keep - 1]
    below = s[level < bound]
    return np.concatenate([below, s[level == bound][: keep - len(below)]])  # s is sorted by hash


def in_order(kept: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """A prefix in the order of all shingles: (sketch level, hash)."""
    return kept[np.lexsort((kept, rarity[cells(kept)]))]


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The fewest shingles that similar sets of sizes n and m have in common."""
    return -(-percent * (n + m) // (100 + percent))


def profile(s: np.ndarray) -> bytes:
    """Size of a set, and its shingles counted in hashed parts, modulo 256."""
    parts = min(MOST_PARTS, max(LEAST_PARTS, 1 << (len(s) // SHINGLES_PER_PART).bit_length()))
    count = np.bincount((s & np.uint64(parts - 1)).astype(np.int64), minlength=parts)
    return packed(np.array([len(s)], "<u4")) + packed(count.astype(np.uint8))


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    data = b"".join(x.as_buffer() for x in rows)
    return np.frombuffer(data, np.uint8).reshape(len(rows), width)


def can_be_similar(left: pa.Array, right: pa.Array, percent: int) -> np.ndarray:
    """Whether sets with these profiles can be similar; true where one is missing.

    The parts' counts differ by at least their distance modulo 256, and the sum of that is no more than the shingles that
    only one of the two sets has.
    """
    out = np.ones(len(left), bool)
    known = pc.and_(pc.is_valid(left), pc.is_valid(right)).to_numpy(zero_copy_only=False)
    widths = [pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (left, right)]
    for key in np.unique((widths[0] << 32 | widths[1])[known]).tolist():
        a, b = key >> 32, key & (1 << 32) - 1
        every = np.flatnonzero(known & (widths[0] == a) & (widths[1] == b))
        step = max(1, PAIR_BYTES // max(a, b))
        for k in range(0, len(every), step):
            own = pa.array(every[k : k + step])
            x, y = _matrix(left.take(own), a), _matrix(right.take(own), b)
            n, m = (np.ascontiguousarray(z[:, :4]).view("<u4")[:, 0].astype(np.int64) for z in (x, y))
            x, y = x[:, 4:], y[:, 4:]
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] + x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] + y[:, y.shape[1] // 2 :]
            apart = np.minimum(x - y, y - x).sum(axis=1, dtype=np.int64)
            out[every[k : k + step]] = apart <= n + m - 2 * least_overlap(n, m, percent)
    return out


def size_level(n: int, percent: int) -> int:
    """Sizes of similar sets are at most nine levels apart; with percent = 100 they are equal, and so a level each."""
    return int(8 * math.log(n) / math.log(100 / percent)) if percent < 100 else min(10 * n, 65535)


# -- forests -------------------------------------------------------------------------------------------------
class Forest:
    """Union-find over 0..n-1; a root is the smallest number of its tree."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): component is the smallest node that can be reached.

    Large-star and small-star rounds: in each, nodes point to the smallest neighbour they have, until nothing
    changes.  Every step is a partial aggregate and an equi join; the edges are a table after each round.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, left = cut_and_count(edges, F.lit(True))
    while left:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: larger neighbours point to the smallest neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut_lineage(large)
        # small star: a node and its smaller neighbours point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        # done when every node points to one that points nowhere
        small = cut_lineage(small)
        tops = small.select(F.col("a").alias("top")).distinct()
        multi = small.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        left = multi + small.join(tops, F.col("b") == F.col("top"), "left_semi").limit(1).count()
        edges = small
    pointed = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pointed.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


# -- signature trees ---------------------------------------------------------------------------------------------
class SignatureTree:
    """A tree over sets: per level bitmaps (words of 64 bits), smallest and largest size, spare tokens.

    ``spare`` of a leaf is its number of tokens less its number of bits: what a bitmap can hide.
    """

    def __init__(self, sets: list[np.ndarray], bits: int):
        width = bits // 64
        leaf = np.zeros((len(sets), width), np.uint64)
        for i, s in enumerate(sets):
            place = (s >> np.uint64(20)) % np.uint64(bits)
            np.bitwise_or.at(leaf[i], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        size = np.array([len(s) for s in sets], np.int64)
        spare = size - np.bitwise_count(leaf).sum(axis=1).astype(np.int64)
        self.maps, self.low, self.high, self.spare = [leaf], [size], [size], [spare]
        while len(self.maps[-1]) > 1:
            cut = np.arange(0, len(self.maps[-1]), FANOUT)
            self.maps.append(np.bitwise_or.reduceat(self.maps[-1], cut, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], cut))
            self.high.append(np.maximum.reduceat(self.high[-1], cut))
            self.spare.append(np.maximum.reduceat(self.spare[-1], cut))

    def children(self, level: int, i: int) -> range:
        return range(i * FANOUT, min((i + 1) * FANOUT, len(self.maps[level - 1])))


def _possible(a: SignatureTree, la: int, i: np.ndarray, b: SignatureTree, lb: int, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether any leaf below node i of ``a`` can be similar to one below node j of ``b``.

    Overlap is at most popcount(A & B) + the tokens hidden in the bitmaps, and at most the smaller largest size; a
    similar pair needs overlap >= percent / (100 + percent) * (sum of sizes), which is least for the smallest sizes.
    """
    step = max(1, PAIR_BYTES // (8 * a.maps[0].shape[1]))
    overlap = np.zeros(len(i), np.int64)
    for k in range(0, len(i), step):
        part = slice(k, k + step)
        overlap[part] = np.bitwise_count(a.maps[la][i[part]] & b.maps[lb][j[part]]).sum(axis=1, dtype=np.int64)
    overlap += np.minimum(a.spare[la][i], b.spare[lb][j])
    overlap = np.minimum(overlap, np.minimum(a.high[la][i], b.high[lb][j]))
    return (100 + percent) * overlap >= percent * (a.low[la][i] + b.low[lb][j])


def leaf_pairs(a: SignatureTree, b: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves (i of ``a``, j of ``b``) that may be similar; of one tree with itself those with i < j.

    Level by level: pairs of nodes whose bound is too low are dropped together with all pairs below them.
    """
    same = a is b
    la, lb = len(a.maps) - 1, len(b.maps) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(i):
        ok = _possible(a, la, i, b, lb, j, percent)
        i, j = i[ok], j[ok]
        if not la and not lb:
            break
        down_a, down_b = la >= lb, lb >= la
        fan_a = np.minimum((i + 1) * FANOUT, len(a.maps[la - 1])) - i * FANOUT if down_a else np.ones(len(i), np.int64)
        fan_b = np.minimum((j + 1) * FANOUT, len(b.maps[lb - 1])) - j * FANOUT if down_b else np.ones(len(j), np.int64)
        n = fan_a * fan_b
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i2, j2, fb = np.repeat(i, n), np.repeat(j, n), np.repeat(fan_b, n)
        i = i2 * FANOUT + k // fb if down_a else i2
        j = j2 * FANOUT + k % fb if down_b else j2
        la, lb = la - down_a, lb - down_b
        if same:
            i, j = i[i <= j], j[i <= j]
    return (i[i < j], j[i < j]) if same else (i, j)


def join_trees(
    a: SignatureTree, sets_a: list[np.ndarray], b: SignatureTree, sets_b: list[np.ndarray], percent: int, forest: Forest, shift: int
) -> None:
    """Unite all similar leaves of two trees (or of one with itself) in ``forest``; b's leaves begin at ``shift``.

    Leaf pairs that stay are checked on exact sets, except where earlier links have already united the two.
    """
    i, j = leaf_pairs(a, b, percent)
    for x, y in zip(i.tolist(), j.tolist()):
        if forest.root(x) != forest.root(y + shift):
            s, r = sets_a[x], sets_b[y]
            both = len(s) + len(r) - len(np.union1d(s, r))
            if 100 * both >= percent * (len(s) + len(r) - both):
                forest.union(x, y + shift)


def _incidence(sets: list[np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """1.0 where a set (row) has a token (column)."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
    hit = tokens[at] == flat
    out = np.zeros((len(sets), len(tokens)), np.float32)
    out[owner[hit], at[hit]] = 1.0
    return out


def overlaps(sets_a: list[np.ndarray], sets_b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact number of common tokens of every pair of leaves: products of 0-1 matrices, tile by tile."""
    out = np.zeros(len(i), np.int64)
    tile = (i // TILE << 32) + j // TILE
    order = np.argsort(tile, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1) if len(i) else []:
        rows, at_row = np.unique(i[own], return_inverse=True)
        columns, at_column = np.unique(j[own], return_inverse=True)
        left, right = [sets_a[x] for x in rows], [sets_b[y] for y in columns]
        common = np.intersect1d(np.concatenate(left), np.concatenate(right))
        both = np.zeros((len(left), len(right)), np.int64)
        for k in range(0, len(common), TILE_SHINGLES):
            part = common[k : k + TILE_SHINGLES]
            both += (_incidence(left, part) @ _incidence(right, part).T).astype(np.int64)
        out[own] = both[at_row, at_column]
    return out


def count_links(
    a: SignatureTree, sets_a: list[np.ndarray], b: SignatureTree, sets_b: list[np.ndarray], percent: int, forest: Forest, shift: int, weight: np.ndarray
) -> np.ndarray:
    """As :func:`join_trees`, with every leaf pair that stays checked; the links of every leaf, by its partners' weights."""
    i, j = leaf_pairs(a, b, percent)
    size_a, size_b = (np.array([len(s) for s in sets], np.int64) for sets in (sets_a, sets_b))
    both = overlaps(sets_a, sets_b, i, j)
    linked = 100 * both >= percent * (size_a[i] + size_b[j] - both)
    i, j = i[linked], j[linked] + shift
    for x, y in zip(i.tolist(), j.tolist()):
        forest.union(x, y)
    links = np.zeros(len(weight), np.int64)
    np.add.at(links, i, weight[j])
    np.add.at(links, j, weight[i])
    return links


def _bits(sets: list[np.ndarray]) -> int:
    """Bits per leaf: four for each token of a middling set, so that a bitmap takes a sixteenth of its set."""
    middle = int(np.median([len(s) for s in sets])) if sets else 1
    return min(1 << 15, max(64, 1 << (4 * middle - 1).bit_length()))


# -- the join ------------------------------------------------------------------------------------------------------
DESCRIBED = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, profile binary, slice int, counts binary"


def described(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, n_shingles, h1, h2, profile): size, hash and profile of every document's set; and slices of each
    task's sketch: a byte per cell, at most 255 counted in a task, compressed."""
    per_slice = 1 << (SKETCH_BITS - 6)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
    names = ["doc_id", "n_shingles", "h1", "h2", "profile", "slice", "counts"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint8)
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                sets = shingle_sets(part.column("text").fill_null(""), width)
                hashes = np.array([set_hash(s) for s in sets], np.int64).reshape(-1, 2)
                cell, n = np.unique(cells(np.concatenate(sets)), return_counts=True)
                sketch[cell] = np.minimum(255, sketch[cell] + np.minimum(n, 255))
                own = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])]
                own += [pa.array([profile(s) if len(s) else None for s in sets], pa.binary()), *(pa.nulls(len(sets), t) for t in types[5:])]
                yield pa.RecordBatch.from_arrays(own, names=names)
        for k in range(SLICES):
            counts = sketch[k * per_slice : (k + 1) * per_slice]
            if counts.any():
                row = [None] * 5 + [k, pa.compress(packed(counts), "zstd", asbytes=True)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, DESCRIBED)


def _sum_slice(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    per_slice = 1 << (SKETCH_BITS - 6)
    total = np.zeros(per_slice, np.int64)
    for batch in rows:
        for counts in batch.column("counts").to_pylist():
            total += np.frombuffer(pa.decompress(counts, per_slice, "zstd"), np.uint8)
    level = np.minimum(255, 4 * np.log2(1 + total)).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed(level)], pa.binary())], names=["slice", "levels"])


def rarity_levels(table: DataFrame) -> bytes:
    """The summed sketch, 2^SKETCH_BITS bytes: the only thing the driver receives, of fixed size."""
    parts = table.where("slice is not null").select("slice", "counts")
    summed = parts.groupBy("slice").applyInArrow(_sum_slice, "slice int, levels binary").collect()
    levels = np.zeros((SLICES, 1 << (SKETCH_BITS - 6)), np.uint8)
    for row in summed:
        levels[row.slice] = np.frombuffer(row.levels, np.uint8)
    return levels.tobytes()


#: Of every key: 32 bits of it (the bucket gives more), the shingle before it in the order (0: none), its document, the size
#: of the set, and its place.
KEYS = "bucket int, keys binary, before binary, docs binary, sizes binary, places binary"


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; eight where one is negative."""
    kind = "<i8" if x.min(initial=0) < 0 else next(t for t in ("u1", "<u2", "<u4", "<i8") if x.max(initial=0) <= np.iinfo(t).max)
    return packed(x.astype(kind))


def _wide(data: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: "u1", 2: "<u2", 4: "<u4", 8: "<i8"}[data.size // n]).astype(np.int64)


def packed_keys(docs: DataFrame, width: int, percent: int, rarity: bytes, buckets: int) -> DataFrame:
    """Prefixes of a batch's sets as packed arrays (see KEYS), equal sets of a batch once."""
    sent = docs.sparkSession.sparkContext.broadcast(rarity)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            folded: set[tuple[int, int]] = set()
            for part in pieces(batch, "text", PIECE_BYTES):
                keys, before, owner, sizes = [], [], [], []
                for doc, s in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text").fill_null(""), width)):
                    h = set_hash(s)
                    if doc is None or not len(s) or h in folded:
                        continue
                    folded.add(h)
                    keys.append(in_order(prefix(s, level, percent), level))
                    before.append(np.concatenate([np.zeros(1, np.uint64), keys[-1][:-1]]))
                    owner.append(doc)
                    sizes.append(len(s))
                if not keys:
                    continue
                n = np.array([len(k) for k in keys])
                key, last = scramble(np.concatenate(keys)), np.concatenate(before)
                doc, size, place = np.repeat(np.array(owner, np.int64), n), np.repeat(np.array(sizes, np.int64), n), spread(n)
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                key, last, doc, size, place = (key >> np.uint64(32)).astype("<u4")[order], last[order], doc[order], size[order], place[order]
                ends = np.cumsum(np.bincount(bucket, minlength=buckets))
                rows = [(b, int(s), int(e)) for b, (s, e) in enumerate(zip([0, *ends[:-1]], ends)) if e > s]
                data = [[packed(key[s:e]), packed(last[s:e]), _narrow(np.diff(doc[s:e], prepend=0)), _narrow(size[s:e]), _narrow(place[s:e])] for _, s, e in rows]
                columns = [pa.array([b for b, _, _ in rows], pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*data))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in KEYS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, KEYS)


def _forest_edges(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) of a forest that connects what the pairs connect."""
    pair = np.unique(np.sort(np.stack([x, y], axis=1), axis=1), axis=0)
    names, index = np.unique(pair, return_inverse=True)
    forest = Forest(len(names))
    for i, j in index.reshape(-1, 2).tolist():
        forest.union(i, j)
    roots = forest.roots()
    real = roots != np.arange(len(names))
    return names[real], names[roots[real]]


def _bucket_pairs(percent: int):
    """Pairs (a, b) of documents of equal keys; ``sure`` are edges as they are, the others wait for their profiles.

    The documents of a key are ordered by size; a gap that no similar pair can cross ends the group.
    """

    def task(bucket: pa.Table) -> pa.Table:
        key, last = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in bucket.column(c)]) for c, t in (("keys", "<u4"), ("before", "<u8")))
        rows = {c: [x.as_buffer() for x in bucket.column(c)] for c in ("docs", "sizes", "places")}
        n = [x.as_buffer().size // 4 for x in bucket.column("keys")]
        doc = np.concatenate([np.cumsum(_wide(x, k)) for x, k in zip(rows["docs"], n)])
        size, place = (np.concatenate([_wide(x, k) for x, k in zip(rows[c], n)]) for c in ("sizes", "places"))
        order = np.lexsort((size, key))
        key, last, doc, size, place = key[order], last[order], doc[order], size[order], place[order]
        sizes, at = np.unique(size, return_inverse=True)
        level = np.array([size_level(x, percent) for x in sizes.tolist()], np.int64)[at]
        starts = np.concatenate([[True], (key[1:] != key[:-1]) | (level[1:] - level[:-1] > 9)])
        group = np.cumsum(starts) - 1
        members = np.bincount(group)[group]
        again = np.flatnonzero(~starts[1:] & (members[1:] > FEW) & (doc[1:] != doc[:-1]))
        a, b = _forest_edges(doc[again], doc[again + 1])
        some = np.flatnonzero((members > 1) & (members <= FEW))
        left, right = [a[:0]], [b[:0]]
        for k in range(1, FEW):
            i, j = some[:-k], some[k:]
            own = (group[i] == group[j]) & (doc[i] != doc[j]) & (100 * size[i] >= percent * size[j])
            i, j = i[own], j[own]
            # their first common shingle has no common one before it, and enough to come
            first = (last[i] != last[j]) | (last[i] == 0)
            room = np.minimum(size[i] - place[i], size[j] - place[j]) >= least_overlap(size[i], size[j], percent)
            i, j = i[first & room], j[first & room]
            left.append(np.minimum(doc[i], doc[j]))
            right.append(np.maximum(doc[i], doc[j]))
        pair = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        sure = np.arange(len(a) + len(pair)) < len(a)
        return pa.table({"a": np.concatenate([a, pair[:, 0]]), "b": np.concatenate([b, pair[:, 1]]), "sure": sure})

    return task


def likely(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose profiles can be those of similar sets; a doc_id with several sets passes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array(can_be_similar(batch.column("left"), batch.column("right"), percent))
            yield batch.select(["a", "b"]).filter(ok)

    own = known.where("profile is not null and doc_id is not null").groupBy("doc_id").agg(F.min("profile").alias("low"), F.max("profile").alias("high"))
    own = own.select("doc_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("profile"))
    # profiles grow with the input: never broadcast
    side = lambda of, name: own.select(F.col("doc_id").alias(of), F.col("profile").alias(name)).hint("merge")
    both = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b")
    return both.select("a", "b", "left", "right").mapInArrow(task, "a bigint, b bigint")


def candidate_groups(docs: DataFrame, known: DataFrame, width: int, percent: int, rarity: bytes) -> DataFrame:
    """(node, component): the documents that can be similar to others, and their group; ``known`` are the described sets."""
    keys = packed_keys(docs, width, percent, rarity, shuffle_parts(docs.sparkSession))
    pairs = cut_lineage(keys.groupBy("bucket").applyInArrow(_bucket_pairs(percent), "a bigint, b bigint, sure boolean"))
    met = likely(pairs.where("not sure").select("a", "b").distinct(), known, percent)
    return components(pairs.where("sure").select("a", "b").unionByName(met))


def _one_join(
    docs: np.ndarray, side: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, percent: int, counted: bool
) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """The links of one group, or between the two sides of a block pair: a forest of edges, and (n, h1, h2, links)."""
    seen: dict[tuple[int, int, bytes], int] = {}
    for i, k in enumerate(zip(side.tolist(), docs.tolist())):
        seen.setdefault((*k, sets[i].tobytes()), i)
    least = {i: int(scramble(sets[i]).min()) for i in seen.values()}
    order = sorted(seen.values(), key=lambda i: (side[i], least[i], len(sets[i]), docs[i]))
    n_left = sum(1 for i in order if side[i] == 0)
    left, right = [sets[i] for i in order[:n_left]], [sets[i] for i in order[n_left:]]
    forest, bits, weight = Forest(len(order)), _bits(sets), copies[order]
    links = np.zeros(len(order), np.int64)
    if left:
        tree = SignatureTree(left, bits)
        other, others, shift = (SignatureTree(right, bits), right, n_left) if right else (tree, left, 0)
        if counted:
            links = count_links(tree, left, other, others, percent, forest, shift, weight)
        else:
            join_trees(tree, left, other, others, percent, forest, shift)
    named = docs[order].tolist()
    edges = [(named[i], named[r]) for i, r in enumerate(forest.roots().tolist()) if named[i] != named[r]]
    return edges, [(len(sets[i]), *set_hash(sets[i]), n) for i, n in zip(order, links.tolist()) if n]


LINKS = "a bigint, b bigint, n_shingles bigint, h1 bigint, h2 bigint, links bigint"


def _join_task(percent: int, counted: bool):
    def task(rows: pa.Table) -> pa.Table:
        group, doc, side, copies = (rows.column(c).to_numpy() for c in ("component", "node", "side", "copies"))
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in rows.column("shingles").combine_chunks()]
        order = np.argsort(group, kind="stable")
        out: list[tuple] = []
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            edges, counts = _one_join(doc[own], side[own], [sets[i] for i in own], copies[own], percent, counted)
            out += [(*e, None, None, None, None) for e in edges] + [(None, None, *c) for c in counts]
        columns = zip(*out) if out else [()] * 6
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n_shingles", "h1", "h2", "links"])

    return task


def _with_sets(rows: DataFrame, width: int) -> DataFrame:
    """The placed rows with the shingles of their text instead of the text, where the text has the set placed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                h1, h2 = part.column("h1").to_pylist(), part.column("h2").to_pylist()
                sets = shingle_sets(part.column("text").fill_null(""), width)
                own = [i for i, s in enumerate(sets) if set_hash(s) == (h1[i], h2[i])]
                place = [part.column(c).take(pa.array(own, pa.int64())) for c in ("places", "node")]
                yield pa.RecordBatch.from_arrays([*place, pa.array([packed(sets[i]) for i in own], pa.binary())], names=["places", "node", "shingles"])

    place = "struct<bundle: bigint, left_block: bigint, right_block: bigint, side: int, component: bigint, copies: bigint>"
    sets = rows.mapInArrow(task, f"places array<{place}>, node bigint, shingles binary")
    return sets.select("node", "shingles", F.explode("places").alias("p")).select("node", "shingles", "p.*")


def placements(member: DataFrame, percent: int) -> DataFrame:
    """(node, h1, h2, places): the tasks that each set of a candidate group takes part in.

    Small groups are bundled by a hash; a large one is cut into blocks by size, and a set goes to each pair of
    blocks that its own belongs to and whose sizes can be similar.
    """
    spark = member.sparkSession
    size = member.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    placed = cut_lineage(member.join(size.where("members > 1"), "component"))
    fits = (F.col("members") <= BLOCK) & (F.col("tokens") * 8 <= GROUP_BYTES)
    bundle = F.pmod(F.xxhash64("component"), F.lit(4 * shuffle_parts(spark)))
    at = lambda b, left, right, side: F.struct(
        b.alias("bundle"), left.cast("long").alias("left_block"), right.cast("long").alias("right_block"), side.cast("int").alias("side"), F.col("component"), F.col("copies")
    )
    small = placed.where(fits).select("node", "h1", "h2", F.array(at(bundle, F.lit(0), F.lit(0), F.lit(0))).alias("places"))
    ranked = running_total(placed.where(~fits), ["component"], [F.col("n"), F.col("node"), F.col("h1"), F.col("h2")], F.lit(1), "rank")
    # a block also ends where its tokens fill a task
    per_block = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(GROUP_BYTES / 16) * F.col("members") / F.col("tokens"))))
    block = cut_lineage(ranked.select("node", "h1", "h2", "copies", "component", "n", F.floor((F.col("rank") - 1) / per_block).alias("block")))
    spans = block.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    partner = spans.select("component", F.col("block").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    pairs = spans.join(partner, "component").where(
        (F.col("high") * 100 >= F.col("other_low") * percent) & (F.col("other_high") * 100 >= F.col("low") * percent)
    )
    first = F.col("block") <= F.col("other")
    place = at(F.lit(-1).cast("long"), F.least("block", "other"), F.greatest("block", "other"), F.when(first, 0).otherwise(1))
    partners = pairs.select("component", "block", "other")
    of_set = block.join(partners, ["component", "block"]).groupBy("node", "h1", "h2").agg(F.collect_list(place).alias("places"))
    return small.unionByName(of_set)


def linked(docs: DataFrame, width: int = 5, percent: int = 80, counted: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, h1, h2 (hash of its set), component_id; if ``counted`` also n_links.

    Documents link when 100 * overlap >= percent * union of their sets of ``width``-word shingles.  ``n_links`` are the
    other rows (with a doc_id) whose sets link with a row's own, copies included.
    """
    known = cut_lineage(described(docs, width))
    sets = known.where("slice is null").select("doc_id", "n_shingles", "h1", "h2")
    same = ["n_shingles", "h1", "h2"]
    filled = sets.where("n_shingles > 0 and doc_id is not null")
    heads = cut_lineage(filled.groupBy(*same).agg(F.min("doc_id").alias("head"), F.count("*").alias("copies")))
    groups = candidate_groups(docs, known, width, percent, rarity_levels(known))
    # a key's owner need not be the smallest of its equals: go over to heads
    member = (
        sets.join(groups, F.col("doc_id") == F.col("node"))
        .join(heads, same)
        .groupBy(F.col("head").alias("node"), F.col("n_shingles").alias("n"), "h1", "h2")
        .agg(F.min("component").alias("component"), F.first("copies").alias("copies"))
    )
    places = placements(cut_lineage(member), percent)
    # the places grow with the input: never broadcast, whatever a small input's size suggests
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(places.hint("merge"), "node")
    tasks = _with_sets(texts, width).groupBy("bundle", "left_block", "right_block", F.when(F.col("bundle") < 0, F.col("component")).alias("own"))
    found = cut_lineage(tasks.applyInArrow(_join_task(percent, counted), LINKS))
    classes = components(found.where("a is not null").select("a", "b"))
    of = heads.join(classes, F.col("head") == F.col("node"), "left").select(*same, "copies", F.coalesce("component", "head").alias("class"))
    if counted:
        others = found.where("h1 is not null").groupBy(*same).agg(F.sum("links").alias("links"))
        of = of.join(others, same, "left").select(*same, "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known_id = F.col("doc_id").isNotNull()
    links = [F.when(known_id, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links")] if counted else []
    return sets.join(of, same, "left").select("doc_id", *same, F.when(known_id, F.coalesce("class", "doc_id")).alias("component_id"), *links)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest doc_id of each class, and those without doc_id, with their own columns."""
    gone = free_prefix(docs, "_lost")
    lost = linked(docs, width, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    # the lost documents grow with the input: never broadcast
    return docs.join(lost.hint("merge"), F.col("doc_id") == F.col(gone), "left_anti")
