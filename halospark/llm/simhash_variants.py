"""SimHash near-duplicates by deletion variants: 64-bit fingerprints that differ in at most two bits are linked.

1. Fingerprints: XXH64 of every shingle of a text; a bit is set where more than half of the hashes have it.  Equal
   fingerprints are folded before anything else, with the smallest doc_id of each.
2. Index: two fingerprints at distance two or less, cut into two segments of 32 bits, differ by at most one bit in one
   of them.  So every segment is indexed under its 32 variants with one bit deleted, and linked fingerprints meet
   under an equal key.  Keys travel as packed arrays of (fingerprint, smallest doc_id, number of the variant).
3. Dense segments: where more than DENSE fingerprints have the same segment, its keys are refined by the other one, cut
   into halves of 16 bits.  Fingerprints equal in the dense segment differ by at most one bit in one of the halves:
   they meet under the segment with a half that has one bit deleted.  Those that differ in its bit i are equal in one
   of the halves: they meet under the segment without bit i and a whole half.  So no key has more than 2 * DENSE
   fingerprints but for refined ones, which leave 17 bits free: at most 2^17, in one array of a task.
4. Each bucket of keys verifies its pairs on the whole fingerprints inside its arrays and returns a forest of edges,
   never the pairs.  The components of all edges are the classes.

Nothing is capped: the refined keys find the same links.  The number of buckets grows with the fingerprints.

Cases: a text without words, empty or NULL has fingerprint zero and is linked like any other; with fewer words than a
shingle has the whole sequence is the one shingle; rows repeated under one doc_id are linked with each other and each is
returned; a NULL doc_id is alone, with a NULL component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halospark.operators.joins import join_skewed
from halospark.operators.lineage import cut_and_count, cut_lineage

from .common import packed, pieces, shuffle_parts, split_words
from .jaccard_tree import components, scramble

SEED = 42
DISTANCE = 2
#: Bytes of text, and shingles, that a task turns into bits at once.
PIECE_BYTES, SHINGLES_AT_ONCE = 4 << 20, 1 << 17
#: Equal segments beyond which keys are refined.
DENSE = 512
#: Bytes of keys that a bucket gets on average, at most, and bytes of a key on its way.
BUCKET_BYTES, KEY_BYTES = 48 << 20, 17
#: Pairs that a bucket holds at once before it goes over to their forest.
PAIRS_AT_ONCE = 1 << 20


# -- fingerprints ---------------------------------------------------------------------------------------------------
def simhashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of shingles (repeats included) and fingerprint of every text."""
    counts, flat = split_words(pc.ascii_lower(texts))
    # words one space apart, texts one after the other: a shingle is a stretch of bytes
    sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    spaced = pc.binary_join_element_wise(flat, pa.scalar("", flat.type), pa.scalar(" ", flat.type))
    line = spaced.buffers()[2] or b""
    start = np.cumsum(sizes + 1) - sizes - 1
    n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last = first + np.repeat(np.minimum(counts, width), n) - 1
    begin, end = start[first], start[last] + sizes[last]
    text = np.repeat(np.arange(len(counts)), n)
    votes = np.zeros((len(counts), 64), np.int64)
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    for k in range(0, len(first), SHINGLES_AT_ONCE):
        some = slice(k, k + SHINGLES_AT_ONCE)
        h = np.array([digest(view[a:b], SEED) for a, b in zip(begin[some].tolist(), end[some].tolist())], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.concatenate([[True], np.diff(text[some]) != 0]))
        votes[text[some][new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    ones = 2 * votes > n[:, None]
    return n, np.packbits(ones, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, n_shingles, fingerprint as a signed long) of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                n, print_ = simhashes(part.column("text").fill_null(""), width)
                columns = [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(print_.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id bigint, n_shingles bigint, fingerprint bigint")


# -- keys -----------------------------------------------------------------------------------------------------------
# Numbers of the variants, one byte: segment, deleted bit               0 ..  63
#                                    segment, whole; half, deleted bit  64 .. 127
#                                    segment, deleted bit; half, whole 128 .. 255
_LOW = np.uint64(0xFFFFFFFF)


def keys(prints: np.ndarray, variant: np.ndarray) -> np.ndarray:
    """The key of each fingerprint under a variant: different for different variants or kept bits."""
    v = variant.astype(np.uint64)
    plain, whole = variant < 64, (variant >= 64) & (variant < 128)
    segment = np.where(plain, v >> np.uint64(5), np.where(whole, (v >> np.uint64(5)) & np.uint64(1), (v >> np.uint64(6)) & np.uint64(1)))
    bit = np.where(plain, v & np.uint64(31), np.where(whole, np.uint64(32), (v >> np.uint64(1)) & np.uint64(31)))
    half = np.where(plain, np.uint64(0), np.where(whole, (v >> np.uint64(4)) & np.uint64(1), v & np.uint64(1)))
    own = np.where(segment == 0, prints & _LOW, prints >> np.uint64(32))
    other = np.where(segment == 0, prints >> np.uint64(32), prints & _LOW)
    own = own & ~(np.uint64(1) << bit)
    kept = (other >> (np.uint64(16) * half)) & np.uint64(0xFFFF)
    kept = np.where(whole, kept & ~(np.uint64(1) << (v & np.uint64(15))), np.where(plain, np.uint64(0), kept))
    return (v << np.uint64(48) | kept << np.uint64(32)) ^ own


def variants(segment: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, variant) of all keys of rows: a segment of a fingerprint, and a mask of the bits whose keys are dense."""
    rows, out = [], []
    every = np.arange(len(segment))
    for bit in range(32):
        hot = (dense >> bit) & 1 == 1
        rows.append(every[~hot])
        out.append(segment[~hot] * 32 + bit)
        for half in (0, 1):
            rows.append(every[hot])
            out.append(128 + segment[hot] * 64 + bit * 2 + half)
    # where no plain key is left, fingerprints with an equal segment meet under refined ones
    hot = dense == (1 << 32) - 1
    for half_bit in range(32):
        rows.append(every[hot])
        out.append(64 + segment[hot] * 32 + half_bit)
    return np.concatenate(rows), np.concatenate(out).astype(np.uint8)


def dense_keys(segments: DataFrame) -> DataFrame:
    """(segment, value, dense): for each segment next to a dense one, or dense itself, the deleted bits that lead there."""
    often = segments.groupBy("segment", "value").count().where(F.col("count") > DENSE)
    bits = F.array(*[F.lit(1 << b).cast("long") for b in range(32)])
    flipped = F.transform(bits, lambda b: F.struct(F.col("value").bitwiseXOR(b).alias("value"), b.alias("dense")))
    own = F.array(F.struct("value", F.lit((1 << 32) - 1).cast("long").alias("dense")))
    near = often.select("segment", F.explode(F.concat(flipped, own)).alias("n"))
    return near.groupBy("segment", F.col("n.value").alias("value")).agg(F.bit_or("n.dense").alias("dense"))


PACKED = "bucket int, prints binary, heads binary, variants binary"


def packed_keys(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows (fingerprint, head, segment, dense) as packed arrays of all their keys, by bucket of keys."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(k, 1 << 13)
                prints, head, segment, dense = (part.column(c).to_numpy() for c in ("fingerprint", "head", "segment", "dense"))
                row, variant = variants(segment.astype(np.int64), dense)
                own = prints[row].view(np.uint64)
                bucket = (scramble(keys(own, variant)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ends = np.cumsum(np.bincount(bucket, minlength=buckets))
                own, variant, of = own[order], variant[order], head[row[order]]
                cuts = [(b, int(s), int(e)) for b, (s, e) in enumerate(zip([0, *ends[:-1]], ends)) if e > s]
                data = [pa.array([packed(x[s:e]) for _, s, e in cuts], pa.binary()) for x in (own, of, variant)]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in cuts], pa.int32()), *data], names=["bucket", "prints", "heads", "variants"])

    return rows.mapInArrow(task, PACKED)


# -- verification -----------------------------------------------------------------------------------------------------
def smallest_label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of 0..n-1 the smallest number that the edges (a, b) reach."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Links:
    """Edges between 0..n-1, kept as a forest once they are many."""

    def __init__(self, n: int):
        self.n, self.pairs, self.held = n, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.pairs.append((a, b))
        self.held += len(a)
        if self.held > PAIRS_AT_ONCE:
            label = self.labels()
            real = np.flatnonzero(label != np.arange(self.n))
            self.pairs, self.held = [(real, label[real])], 0

    def labels(self) -> np.ndarray:
        a, b = zip(*self.pairs) if self.pairs else ([np.zeros(0, int)],) * 2
        return smallest_label(self.n, np.concatenate(a), np.concatenate(b))


def _link_by_flips(prints: np.ndarray, index: np.ndarray, links: Links) -> None:
    """All links of one large group, by looking up what differs in one or two of the bits that are not all equal."""
    order = np.argsort(prints)
    prints, index = prints[order], index[order]
    free = [b for b in range(64) if (int(np.bitwise_or.reduce(prints ^ prints[0])) >> b) & 1]
    flips = [1 << b for b in free] + [1 << b | 1 << c for k, b in enumerate(free) for c in free[:k]]
    for flip in flips:
        want = prints ^ np.uint64(flip)
        found = np.minimum(np.searchsorted(prints, want), len(prints) - 1)
        hit = np.flatnonzero((prints[found] == want) & (want > prints))
        links.add(index[hit], index[found[hit]])


def bucket_edges(rows: pa.Table) -> pa.Table:
    """A forest of edges (a, b) of heads whose fingerprints are linked and share a key of the bucket."""
    prints, heads, variant = (
        np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows.column(c)]) for c, kind in (("prints", "<u8"), ("heads", "<i8"), ("variants", "u1"))
    )
    key = keys(prints, variant)
    order = np.argsort(key)
    key, prints, heads = key[order], prints[order], heads[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(new, len(key)))
    names, index = np.unique(heads, return_inverse=True)
    links = Links(len(names))
    several = (size > 1) & (size <= 2 * DENSE)
    end = np.repeat(new + size, size)
    here = np.flatnonzero(np.repeat(several, size))
    for k in range(1, int(size[several].max(initial=1))):
        here = here[here + k < end[here]]
        hit = here[np.bitwise_count(prints[here] ^ prints[here + k]) <= DISTANCE]
        links.add(index[hit], index[hit + k])
    for s, e in zip(new[size > 2 * DENSE].tolist(), (new + size)[size > 2 * DENSE].tolist()):
        _link_by_flips(prints[s:e], index[s:e], links)
    label = links.labels()
    real = np.flatnonzero(label != np.arange(len(names)))
    return pa.table({"a": pa.array(names[real], pa.int64()), "b": pa.array(names[label[real]], pa.int64())})


def linked(docs: DataFrame, width: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, fingerprint (signed long), component_id (smallest doc_id reachable)."""
    spark = docs.sparkSession
    prints = cut_lineage(fingerprints(docs, width))
    known = prints.where("doc_id is not null")
    heads, n = cut_and_count(known.groupBy("fingerprint").agg(F.min("doc_id").alias("head")), F.lit(True))
    low, high = F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned("fingerprint", 32)
    segments = heads.select("fingerprint", "head", F.posexplode(F.array(low, high)).alias("segment", "value"))
    rows = join_skewed(segments, dense_keys(segments), ["segment", "value"], "left", ["fingerprint"])
    rows = rows.select("fingerprint", "head", F.col("segment").cast("long"), F.coalesce("dense", F.lit(0).cast("long")).alias("dense"))
    buckets = max(shuffle_parts(spark), n * 64 * KEY_BYTES // BUCKET_BYTES)
    edges = packed_keys(rows, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(bucket_edges, "a bigint, b bigint")
    classes = components(cut_lineage(edges))
    of = heads.join(classes, F.col("head") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "head").alias("component_id"))
    # a fingerprint may stand for a third of all rows
    found = join_skewed(known, of, ["fingerprint"], salt_on=["doc_id"])
    alone = prints.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long"))
    return found.select("doc_id", "n_shingles", "fingerprint", "component_id").unionByName(alone)


def as_hex(fingerprint: str) -> Column:
    """16 lowercase hex digits of a signed long."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
