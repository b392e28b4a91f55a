"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff, scores per document.

    p(w | h) = d(c(h w)) c(h w) / C(h)           where the bigram was seen in training
             = alpha(h) p(w)                      where only h was; alpha(h) = (1 - sum of the above) / (1 - sum of p(w) over them)
             = p(w)                               where h was not
    p(w)     = d1(c(w)) c(w) / N, and what the discounts leave for all unknown words together

How it runs.  Words are 64-bit hashes; tasks hand on packed arrays, never a row per token.
1. Word counts: summed per piece of a task, then per bucket of words: the unigram table, written by bucket.
2. Bigrams: each piece of a task sorts its bigrams, counts them, and sends each bucket of contexts its part together
   with the documents they stand in.  A context that fills more than a bucket's share is dealt over as many buckets.
3. Each bucket asks the unigram table for the counts of its distinct words (once each), and evaluates its tokens: what
   needs no total of the whole corpus is summed per document at once, and the sums of a document are added up by bucket of
   documents before anything is written.  A bucket holds the documents it has tokens of, no others.  Backoff weights need the Good-Turing discounts
   of all bigrams, so contexts with unseen bigrams are written with their sums: the context table, by bucket.
4. With the discounts known, the context table gives alpha(h), and the parts of every document are added up.

The driver sees counts of counts, and the contexts heavier than a bucket, of which there are at most as many as
buckets.  The number of buckets is spark.sql.shuffle.partitions.

Cases: a NULL or empty text is its end token alone; a context whose leftover mass is zero gets one more count in its
denominator, so every probability is positive; without any training token every token has probability 1; rows repeated
under one doc_id each get their score; a NULL doc_id hashes as the empty text; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halospark.operators.lineage import cut_lineage

from .common import as_list, give_back, packed, pieces, shuffle_parts, split_words
from .jaccard_tree import scramble

END, START = np.uint64(1), np.uint64(2)
#: Counts up to LARGEST are discounted.
LARGEST = 5
#: Bytes of text that one piece of a task takes in; its arrays are about twenty times that.
PIECE_BYTES = 9 << 20
#: Parts of a bucket's contexts that are evaluated one after the other: the arrays are about ten times a part's bytes.
CONTEXT_PARTS = 4
#: Rows of a piece: its documents are numbered in 16 bits.
PIECE_ROWS = 1 << 16


# -- arithmetic of the model -----------------------------------------------------------------------------------
def discounts(n: list[int]) -> np.ndarray:
    """d[c] for c = 0..LARGEST (0: unused) from the numbers n[r] of types seen r times, r = 1..LARGEST + 1.

    Katz's formula on the counts of counts, or, where copies in the corpus bend them so that a ratio leaves (0, 1), on
    their log-linear fit n[r] = a * r^b; with too few counts for b < -1, (r - 1/2) / r.
    """
    r = np.arange(1, LARGEST + 2)
    some = [k for k in r if n[k]]
    tries = [np.array(n[1:], float)] if len(some) == len(r) else []
    if len(some) > 1:
        b = np.polyfit(np.log(some), np.log([n[k] for k in some]), 1)[0]
        if b < -1:
            tries.append(r.astype(float) ** b)
    for m in tries:
        common = (LARGEST + 1) * m[LARGEST] / m[0]
        if common < 1:
            d = (r[1:] * m[1:] / (r[:-1] * m[:-1]) - common) / (1 - common)
            if ((d > 0) & (d < 1)).all():
                return np.array([0.0, *d])
    return np.array([0.0, *(r[:-1] - 0.5) / r[:-1]])


class Unigrams:
    """p(w) from a count, given N and the counts of counts."""

    def __init__(self, total: int, n: list[int]):
        self.d = discounts(n)
        left = sum((1 - self.d[r]) * r * n[r] for r in range(1, LARGEST + 1))
        self.total = total + (left <= 0)
        self.unknown = (left if left > 0 else 1) / self.total

    def p(self, count: np.ndarray) -> np.ndarray:
        d = np.where(count <= LARGEST, self.d[np.minimum(count, LARGEST)], 1.0)
        return np.where(count > 0, d * count / self.total, self.unknown)


def denominators(sums: np.ndarray) -> np.ndarray:
    """C(h), and one more where no bigram of h is discounted: something is left for what h was never seen with.

    ``sums`` per context: C, tokens of its bigrams seen 1..LARGEST times, mass of their words in the unigrams.
    """
    return sums[:, 0] + (sums[:, 1 : 1 + LARGEST].sum(axis=1) == 0)


def backoff(sums: np.ndarray, d: np.ndarray) -> np.ndarray:
    """alpha(h): exactly what makes the probabilities after h add up to one."""
    low = sums[:, 1 : 1 + LARGEST]
    mass = (low @ d[1:] + (sums[:, 0] - low.sum(axis=1))) / denominators(sums)
    return (1 - mass) / (1 - sums[:, 1 + LARGEST])


# -- tokens of a piece -------------------------------------------------------------------------------------------
def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def token_pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about PIECE_BYTES of text at most (or one row), and no more rows than 16 bits can number.

    The pieces of a batch are about equally large: what a piece sends by type costs most in a small one.
    """
    for k in range(0, batch.num_rows, PIECE_ROWS):
        part = batch.slice(k, PIECE_ROWS)
        size = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
        yield from pieces(part, "text", -(-size // max(1, -(-size // PIECE_BYTES))) + (1 << 16))


class Tokens:
    """The tokens of a piece: word code and previous word's code of each, its document, hashes of the codes."""

    def __init__(self, part: pa.RecordBatch):
        texts = part.column("text").fill_null("")
        counts, flat = split_words(pc.ascii_lower(texts))
        coded = flat.dictionary_encode()
        names = as_list(coded.dictionary)
        self.hash = np.array([*map(xxhash.xxh3_64_intdigest, names), int(END), int(START)], np.uint64)
        end, start = len(names), len(names) + 1
        self.word = np.full(len(flat) + len(counts), end, np.int32)
        self.word[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = coded.indices.to_numpy()
        self.doc = np.repeat(np.arange(len(counts), dtype=np.uint16), counts + 1)
        self.previous = np.empty_like(self.word)
        self.previous[1:] = self.word[:-1]
        self.previous[self.previous == end] = start
        if len(self.word):
            self.previous[0] = start
            self.previous[1:][self.word[:-1] == end] = start
        self.doc_id = part.column("doc_id")
        self.held = np.array([is_held_out(d) for d in self.doc_id.to_pylist()], bool)
        self.version = np.array([xxhash.xxh32_intdigest(t.as_buffer() or b"") for t in texts], np.uint64)


def word_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (scramble(h) % np.uint64(buckets)).astype(np.int64)


def cut_by(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and (bucket, from, to) of those that have something."""
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    return order, [(b, int(s), int(e)) for b, (s, e) in enumerate(zip([0, *ends[:-1]], ends)) if e > s]


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _table(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(names, types, rows)])


def joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)])


# -- 1. the unigram table ----------------------------------------------------------------------------------------
UNIGRAMS = "bucket int, words binary, counts binary, n_types bigint, n_tokens bigint, n_seen array<bigint>"


def unigram_table(docs: DataFrame, buckets: int) -> DataFrame:
    """By bucket: sorted word hashes (u64), their training counts (u32), and the bucket's counts of counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in token_pieces(batch):
                t = Tokens(part)
                count = np.bincount(t.word[~t.held[t.doc]], minlength=len(t.hash))
                some = np.flatnonzero(count)
                h, n = t.hash[some], count[some].astype("<u4")
                order, cuts = cut_by(word_bucket(h, buckets), buckets)
                h, n = h[order], n[order]
                yield _rows(["bucket", "words", "counts"], [pa.int32(), pa.binary(), pa.binary()], [(b, packed(h[s:e]), packed(n[s:e])) for b, s, e in cuts])

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        h, n = joined(rows.column("words"), "<u8"), joined(rows.column("counts"), "<u4")
        words, at = np.unique(h, return_inverse=True)
        counts = np.bincount(at, n).astype(np.int64)
        seen = np.bincount(np.minimum(counts, LARGEST + 2), minlength=LARGEST + 2)[: LARGEST + 2]
        row = (key[0].as_py(), packed(words), packed(counts.astype("<i8")), len(words), int(counts.sum()), seen.tolist())
        names = ["bucket", "words", "counts", "n_types", "n_tokens", "n_seen"]
        return _table(names, [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())], [row])

    packed_counts = docs.mapInArrow(task, "bucket int, words binary, counts binary")
    return cut_lineage(packed_counts.groupBy("bucket").applyInArrow(total, UNIGRAMS))


def heavy_words(table: DataFrame, least: float) -> dict[int, int]:
    """Words with at least ``least`` training tokens: with ``least`` = N / k there are no more than k."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, n = np.frombuffer(r["words"], "<i8"), np.frombuffer(r["counts"], "<i8")
                yield _rows(["word", "n"], [pa.int64(), pa.int64()], list(zip(h[n >= least].tolist(), n[n >= least].tolist())))

    rows = table.select("words", "counts").mapInArrow(task, "word bigint, n bigint").collect()
    return {r.word & (1 << 64) - 1: r.n for r in rows}


# -- 2. bigrams by bucket of contexts -------------------------------------------------------------------------------
#: Words of a row: its distinct ones, and for every type which of them (16 bits where they suffice).
BIGRAMS = """bucket int, contexts binary, context_types binary, words binary, which binary, occurrences binary,
    docs binary, ids binary, has_id binary, versions binary, held binary"""
_BIGRAM_NAMES = [x.split()[0] for x in BIGRAMS.split(",")]


def bigram_rows(docs: DataFrame, buckets: int, heavy: dict[int, int], least: float) -> DataFrame:
    """The bigram types of every piece, by bucket, with the documents that each stands in (once per occurrence)."""
    heavy_h = np.array(sorted(heavy), np.uint64)
    # a heavy context's tokens are dealt over about twice as many buckets as they would fill
    heavy_parts = np.array([min(buckets, 1 + math.ceil(2 * heavy[h] / max(least, 1))) for h in sorted(heavy)], np.uint64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in token_pieces(batch):
                t = Tokens(part)
                pair = t.previous.astype(np.int64) * len(t.hash) + t.word
                order = np.argsort(pair, kind="stable")
                pair, doc = pair[order], t.doc[order].astype("<u2")
                del order, t.word, t.previous, t.doc
                first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(pair)))
                pair = pair[first]
                h, w = t.hash[pair // len(t.hash)], t.hash[pair % len(t.hash)]
                del pair
                bucket = scramble(h)
                if len(heavy_h):
                    at = np.minimum(np.searchsorted(heavy_h, h), len(heavy_h) - 1)
                    is_heavy = heavy_h[at] == h
                    bucket = np.where(is_heavy, bucket + scramble(w) % heavy_parts[at], bucket)
                bucket = (bucket % np.uint64(buckets)).astype(np.int64)
                order, cuts = cut_by(bucket, buckets)
                h, w, n, begin = h[order], w[order], n[order], first[order]
                # a bucket gets the documents that it has tokens of, ids as steps and flags as bits
                ids, has_id, version = t.doc_id.fill_null(0).to_numpy(), t.doc_id.is_valid().to_numpy(zero_copy_only=False), t.version.astype("<u4")
                for b, s, e in cuts:
                    new = np.flatnonzero(np.concatenate([[True], h[s + 1 : e] != h[s : e - 1]]))
                    total = int(n[s:e].sum())
                    where = np.repeat(begin[s:e] - np.concatenate([[0], np.cumsum(n[s:e])[:-1]]), n[s:e]) + np.arange(total)
                    words, which = np.unique(w[s:e], return_inverse=True)
                    which = which.astype("<u2" if len(words) <= 1 << 16 else "<u4")
                    there, number = np.unique(doc[where], return_inverse=True)
                    known = [np.diff(ids[there], prepend=0).astype("<i8"), np.packbits(has_id[there]), version[there], np.packbits(t.held[there])]
                    row = (b, packed(h[s:e][new]), packed(np.diff(np.append(new, e - s)).astype("<u4")), packed(words), packed(which), packed(n[s:e].astype("<u4")), packed(number.astype("<u2")), *map(packed, known))
                    yield _rows(_BIGRAM_NAMES, [pa.int32(), *[pa.binary()] * 10], [row])
                give_back()

    return docs.mapInArrow(task, BIGRAMS).repartition(buckets, "bucket")


class Bucket:
    """The merged bigrams of a part of a bucket's contexts, and the pieces whose tokens they are.

    A document belongs to one piece only; every part has all pieces, in the same order.
    """

    def __init__(self, rows: pa.Table, part: int, parts: int):
        h, w, sizes = [], [], []
        self.pieces: list[tuple] = []
        column = {name: rows.column(name).combine_chunks() for name in _BIGRAM_NAMES[1:]}
        for k in range(rows.num_rows):
            buffer = {name: c[k].as_buffer() for name, c in column.items()}
            contexts, types = np.frombuffer(buffer["contexts"], "<u8"), np.frombuffer(buffer["context_types"], "<u4")
            own = (scramble(contexts) >> np.uint64(40)) % np.uint64(parts) == np.uint64(part)
            mine = np.repeat(own, types)
            h.append(np.repeat(contexts[own], types[own]))
            words = np.frombuffer(buffer["words"], "<u8")
            w.append(words[np.frombuffer(buffer["which"], "<u2" if len(words) <= 1 << 16 else "<u4")[mine]])
            every = np.frombuffer(buffer["occurrences"], "<u4")
            sizes.append(every[mine])
            ids, versions = np.cumsum(np.frombuffer(buffer["ids"], "<i8")), np.frombuffer(buffer["versions"], "<u4").astype(np.uint64)
            has_id, held = (np.unpackbits(np.frombuffer(buffer[c], np.uint8), count=len(ids)).astype(bool) for c in ("has_id", "held"))
            self.pieces.append((np.frombuffer(buffer["docs"], "<u2")[np.repeat(mine, every)], sizes[-1], ids, has_id, versions, held))
        h, w = np.concatenate(h), np.concatenate(w)
        with np.errstate(over="ignore"):
            key = scramble(scramble(h) ^ (w * np.uint64(3)))
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        del key
        self.h, self.w = h[first], w[first]
        self.types = np.split(at.astype(np.int32), np.cumsum([len(x) for x in sizes])[:-1])
        self.count = np.zeros(len(first), np.int64)
        for types, (doc, size, *_, held) in zip(self.types, self.pieces):
            trained = ~held[doc]
            if len(size):
                np.add.at(self.count, types, np.add.reduceat(trained, np.cumsum(size, dtype=np.int64) - size, dtype=np.int64))
        self.words, self.word = np.unique(self.w, return_inverse=True)


# -- 3. counts of the words that a bucket asks for ---------------------------------------------------------------------
def _ask(buckets: int):
    names, types = ["word_bucket", "asker", "words"], [pa.int32(), pa.int32(), pa.binary()]

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        words = np.unique(joined(rows.column("words"), "<u8"))
        order, cuts = cut_by(word_bucket(words, buckets), buckets)
        words = words[order]
        return _table(names, types, [(b, key[0].as_py(), packed(words[s:e])) for b, s, e in cuts])

    return task


def _answer(asked: pa.Table, table: pa.Table) -> pa.Table:
    words, counts = joined(table.column("words"), "<u8"), joined(table.column("counts"), "<i8")
    out = []
    for r in asked.to_pylist():
        want = np.frombuffer(r["words"], "<u8")
        found = np.zeros(len(want), np.int64)
        if len(words):
            at = np.minimum(np.searchsorted(words, want), len(words) - 1)
            found = np.where(words[at] == want, counts[at], 0)
        out.append((r["asker"], r["word_bucket"], packed(found.astype("<i8"))))
    return _table(["bucket", "word_bucket", "counts"], [pa.int32(), pa.int32(), pa.binary()], out)


# -- the evaluated bucket -------------------------------------------------------------------------------------------------
#: kind 0: sums per document; 1: contexts that wait for alpha; 2: sums of heavy contexts; 3: counts of counts
EVALUATED = """kind int, doc_bucket int, ids binary, has_id binary, versions binary, held binary, sums binary,
    context_hash binary, context_sums binary, waiting binary, n_seen array<bigint>"""
_EVALUATED_NAMES = [x.split()[0] for x in EVALUATED.split(",")]
_EVALUATED_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 8, pa.list_(pa.int64())]
#: columns of ``sums``: n_tokens, n_known, base, score without discounts, rows, tokens of bigrams seen 1..LARGEST times
N_SUMS = 5 + LARGEST


def no_sums(n: int) -> list[np.ndarray]:
    """The columns of ``sums`` for n documents: scores, and counts in four bytes."""
    return [np.zeros(n, np.float64 if k in (2, 3) else np.uint32) for k in range(N_SUMS)]


def _pack_sums(sums: list[np.ndarray]) -> bytes:
    """Sums by column: the two scores as they are, counts in as many bytes as the largest needs."""
    out = [len(sums[0]).to_bytes(4, "little")]
    for k, column in enumerate(sums):
        kind = "<f8" if k in (2, 3) else "u1" if column.max(initial=0) < 256 else "<u4"
        out += [b"814"[("<f8", "u1", "<u4").index(kind)].to_bytes(), packed(column.astype(kind))]
    return b"".join(out)


def _unpack_sums(data: bytes) -> list[np.ndarray]:
    n, at = int.from_bytes(data[:4], "little"), 4
    sums = []
    for _ in range(N_SUMS):
        kind = np.dtype({b"8": "<f8", b"1": "u1", b"4": "<u4"}[data[at : at + 1]])
        sums.append(np.frombuffer(data, kind, n, at + 1))
        at += 1 + n * kind.itemsize
    return sums


def _doc_parts(ids, has_id, versions, held, sums, buckets: int) -> list[tuple]:
    """kind 0 rows: sums of documents, cut by bucket of documents, ids as steps."""
    bucket = word_bucket(ids.view(np.uint64), buckets)
    order = np.lexsort((ids, bucket))
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    out = []
    for b, (s, e) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        if e > s:
            pick = order[s:e]
            own = [packed(np.diff(ids[pick], prepend=0)), packed(has_id[pick]), packed(versions[pick].astype("<u4")), packed(held[pick])]
            out.append((0, b, *own, _pack_sums([x[pick] for x in sums]), None, None, None, None))
    return out


def _evaluate(buckets: int, unigrams: Unigrams, heavy: np.ndarray, heavy_total: np.ndarray):
    """``heavy_total`` are the training tokens after each heavy context; 0 where they are not known yet."""

    def one_part(b: Bucket, word_count: np.ndarray, own: list[np.ndarray]) -> tuple:
        """Contexts with their sums, tokens that wait for a context, and counts of counts; adds to the documents' ``own``."""
        p1 = unigrams.p(word_count)[b.word]
        contexts, ctx = np.unique(b.h, return_inverse=True)
        is_heavy = np.isin(contexts, heavy)
        c, n = b.count, len(contexts)
        seen = c > 0
        sums = np.zeros((n, 2 + LARGEST))
        sums[:, 0] = np.bincount(ctx, c, minlength=n)
        for r in range(1, LARGEST + 1):
            sums[:, r] = r * np.bincount(ctx[c == r], minlength=n)
        sums[:, 1 + LARGEST] = np.bincount(ctx[seen], p1[seen], minlength=n)
        # by type: what can be said now; every alpha is still to come, and the denominator of a heavy context whose
        # tokens are not counted yet, or of which no discounted bigram is known here
        hot, below = is_heavy[ctx], denominators(sums)
        if len(heavy):
            total = heavy_total[np.minimum(np.searchsorted(heavy, contexts), len(heavy) - 1)]
            settled = is_heavy & (total > 0) & (sums[:, 1 : 1 + LARGEST].sum(axis=1) > 0)
            below = np.where(settled, total, below)
            now = (~is_heavy | settled)[ctx]
        else:
            now = np.ones(len(ctx), bool)
        value = np.where(seen, np.log10(np.maximum(c, 1)), np.log10(p1))
        value -= np.where(seen & now, np.log10(np.maximum(below, 1))[ctx], 0.0)
        wait = (seen & ~now) | (~seen & (hot | (sums[ctx, 0] > 0)))
        per_type = [np.ones(len(c)), word_count[b.word] > 0, np.log10(word_count[b.word] + 1.0), value, b.w == END]
        per_type += [c == r for r in range(1, LARGEST + 1)]
        waiting, base = [], 0
        for types, (doc, size, *known) in zip(b.types, b.pieces):
            docs, of = len(known[0]), np.repeat(types, size)
            for column, x in zip(own, per_type):
                column[base : base + docs] += np.bincount(doc, x[of], minlength=docs).astype(column.dtype)
            still = wait[of]
            of, pair = of[still], ctx[of[still]] * docs + doc[still]
            names, at = np.unique(pair, return_inverse=True)
            n_seen, n_unseen = (np.bincount(at, x[of], minlength=len(names)) for x in (seen, ~seen))
            waiting.append(np.stack([names // docs, names % docs + base, n_seen, n_unseen], axis=1).astype("<u4"))
            base += docs
        counts = np.bincount(np.minimum(c[seen], LARGEST + 2), minlength=LARGEST + 2)[: LARGEST + 2]
        return contexts, sums, np.concatenate(waiting), counts

    def evaluated(rows: pa.Table, answers: pa.Table) -> pa.Table:
        words = np.unique(joined(rows.column("words"), "<u8"))
        order, cuts = cut_by(word_bucket(words, buckets), buckets)
        told = {r["word_bucket"]: np.frombuffer(r["counts"], "<i8") for r in answers.to_pylist()}
        count_of = np.zeros(len(words), np.int64)
        for bucket, s, e in cuts:
            count_of[order[s:e]] = told[bucket]
        contexts, sums, waiting, own, counts, base = [], [], [], None, 0, 0
        for k in range(CONTEXT_PARTS):
            b = Bucket(rows, k, CONTEXT_PARTS)
            own = own or no_sums(sum(len(piece[2]) for piece in b.pieces))
            some, their, tokens, seen = one_part(b, count_of[np.searchsorted(words, b.words)], own)
            tokens[:, 0] += base
            base += len(some)
            contexts.append(some)
            sums.append(their)
            waiting.append(tokens)
            counts = counts + seen
        contexts, sums, waiting = np.concatenate(contexts), np.concatenate(sums), np.concatenate(waiting)
        known = [np.concatenate(x) for x in zip(*(piece[2:] for piece in b.pieces))]
        # rows of other kinds go with some bucket of documents
        out, here = _doc_parts(*known, own, buckets), rows.column("bucket")[0].as_py()
        # the contexts that some token waits for, and those tokens: (context, document, seen, unseen)
        if len(waiting):
            used_ctx, waiting[:, 0] = np.unique(waiting[:, 0], return_inverse=True)
            used_doc, waiting[:, 1] = np.unique(waiting[:, 1], return_inverse=True)
            out.append((1, here, *(packed(x[used_doc]) for x in known), None, packed(contexts[used_ctx]), packed(sums[used_ctx]), packed(waiting), None))
        is_heavy = np.isin(contexts, heavy)
        if is_heavy.any():
            out.append((2, here, None, None, None, None, None, packed(contexts[is_heavy]), packed(sums[is_heavy]), None, None))
        out.append((3, here, *[None] * 8, counts.tolist()))
        return _table(_EVALUATED_NAMES, _EVALUATED_TYPES, out)

    def task(rows: pa.Table, answers: pa.Table) -> pa.Table:
        result = evaluated(rows, answers)
        give_back()
        return result

    return task


# -- the parts of documents, by bucket of documents -------------------------------------------------------------------------
def _merged(rows: pa.Table) -> tuple:
    """ids, has_id, versions, held and sums of the documents of kind 0 rows, each once."""
    ids = np.concatenate([np.cumsum(np.frombuffer(x.as_buffer(), "<i8")) for x in rows.column("ids")] or [np.zeros(0, np.int64)])
    versions = joined(rows.column("versions"), "<u4").astype(np.uint64)
    has_id, held = joined(rows.column("has_id"), bool), joined(rows.column("held"), bool)
    with np.errstate(over="ignore"):
        name = scramble(ids.view(np.uint64) ^ scramble(versions + has_id))
    _, first, at = np.unique(name, return_index=True, return_inverse=True)
    known = [x[first] for x in (ids, has_id, versions, held)]
    del ids, versions, has_id, held, name
    total, base = no_sums(len(first)), 0
    for x in rows.column("sums"):
        part = _unpack_sums(x.as_py())
        of = at[base : base + len(part[0])]
        for column, own in zip(total, part):
            np.add.at(column, of, own.astype(column.dtype))
        base += len(of)
    return *known, total


def _gather(key: tuple, rows: pa.Table) -> pa.Table:
    """The rows of a bucket of documents with those of kind 0 added up."""
    rows = rows.select(_EVALUATED_NAMES)
    parts = rows.filter(pc.equal(rows.column("kind"), 0))
    rest = rows.filter(pc.not_equal(rows.column("kind"), 0))
    if parts.num_rows:
        own = _table(_EVALUATED_NAMES, _EVALUATED_TYPES, _doc_parts(*_merged(parts), 1))
        own = own.set_column(1, "doc_bucket", pa.array([key[0].as_py()] * own.num_rows, pa.int32()))
        rest = pa.concat_tables([rest, own.cast(rest.schema)])
    give_back()
    return rest


# -- 4. the sum -------------------------------------------------------------------------------------------------------------
PARTS = "doc_bucket int, ids binary, has_id binary, versions binary, held binary, sums binary"


def _settle(buckets: int, d: np.ndarray, heavy: np.ndarray, heavy_sums: np.ndarray):
    """The parts of waiting contexts, now that the discounts and the sums of heavy contexts are known."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h = np.frombuffer(r["context_hash"], "<u8")
                sums = np.frombuffer(r["context_sums"], np.float64).reshape(len(h), -1).copy()
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                    hot = heavy[at] == h
                    sums[hot] = heavy_sums[at[hot]]
                known = sums[:, 0] > 0
                alpha, below = np.zeros(len(h)), np.zeros(len(h))
                alpha[known] = np.log10(backoff(sums[known], d))
                below[known] = np.log10(denominators(sums[known]))
                ctx, doc, seen, unseen = np.frombuffer(r["waiting"], "<u4").reshape(-1, 4).astype(np.int64).T
                ids, versions = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["versions"], "<u8")
                parts = no_sums(len(ids))
                parts[3] = np.bincount(doc, unseen * alpha[ctx] - seen * below[ctx], minlength=len(ids))
                rows = _doc_parts(ids, np.frombuffer(r["has_id"], bool), versions, np.frombuffer(r["held"], bool), parts, buckets)
                yield _rows(_EVALUATED_NAMES[1:7], _EVALUATED_TYPES[1:7], [x[1:7] for x in rows])

    return task


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, copies bigint"


def _add_up(d: np.ndarray, base_total: float):
    """Scores of the documents of a bucket; ``base_total`` is the denominator of the base, N + V + 1."""

    def added(rows: pa.Table) -> pa.Table:
        ids, has_id, _, held, total = _merged(rows)
        total = np.stack(total, axis=1)
        copies = np.maximum(total[:, 4], 1)
        n, n_known = np.rint(total[:, 0] / copies), np.rint(total[:, 1] / copies)
        base = total[:, 2] / copies - n * math.log10(base_total)
        score = (total[:, 3] + total[:, 5:] @ np.log10(d[1:])) / copies
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=~has_id),
                "held_out": pa.array(held),
                "n_tokens": pa.array(n.astype(np.int64)),
                "n_known": pa.array(n_known.astype(np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(score),
                "copies": pa.array(copies.astype(np.int64)),
            }
        )

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        result = added(rows)
        give_back()
        return result

    return task


def score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    buckets = shuffle_parts(spark)
    table = unigram_table(docs, buckets)
    totals = table.agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("n_types"), F.lit(0)).alias("v"),
        *[F.coalesce(F.sum(F.get("n_seen", F.lit(r))), F.lit(0)).alias(f"n{r}") for r in range(1, LARGEST + 2)],
    ).first()
    unigrams = Unigrams(totals.n, [0, *[totals[f"n{r}"] for r in range(1, LARGEST + 2)]])
    least = totals.n / buckets
    heavy_count = heavy_words(table, least) if totals.n else {}
    # every training token but the end is a context once; the start as often as there are ends
    after = heavy_count | {int(START): heavy_count.pop(int(END), 0)}
    # the start is a context of every training document, as the end is a token of each
    heavy_count[int(START)] = max(1, totals.n // 2)
    heavy = np.array(sorted(heavy_count), np.uint64)
    heavy_total = np.array([after[h] for h in sorted(heavy_count)], np.float64)

    rows = bigram_rows(docs, buckets, heavy_count, least)
    # both uses take all columns of the rows: one shuffle serves the two
    asked = rows.groupBy("bucket").applyInArrow(_ask(buckets), "word_bucket int, asker int, words binary")
    answers = (
        asked.groupBy("word_bucket")
        .cogroup(table.select(F.col("bucket").alias("word_bucket"), "words", "counts").groupBy("word_bucket"))
        .applyInArrow(_answer, "bucket int, word_bucket int, counts binary")
    )
    evaluated = rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_evaluate(buckets, unigrams, heavy, heavy_total), EVALUATED)
    parts = cut_lineage(evaluated.groupBy("doc_bucket").applyInArrow(_gather, EVALUATED))

    seen = parts.where("kind = 3").agg(*[F.coalesce(F.sum(F.get("n_seen", F.lit(r))), F.lit(0)).alias(f"n{r}") for r in range(1, LARGEST + 2)]).first()
    d = discounts([0, *[seen[f"n{r}"] for r in range(1, LARGEST + 2)]])
    heavy_sums = np.zeros((len(heavy), 2 + LARGEST))
    for r in parts.where("kind = 2").select("context_hash", "context_sums").toLocalIterator():
        at = np.searchsorted(heavy, np.frombuffer(r.context_hash, "<u8"))
        heavy_sums[at] += np.frombuffer(r.context_sums, np.float64).reshape(len(at), -1)
    waiting = parts.where("kind = 1").drop("kind", "doc_bucket", "n_seen").mapInArrow(_settle(buckets, d, heavy, heavy_sums), PARTS)
    all_parts = parts.where("kind = 0").select("doc_bucket", "ids", "has_id", "versions", "held", "sums").unionByName(waiting)
    scores = all_parts.groupBy("doc_bucket").applyInArrow(_add_up(d, totals.n + totals.v + 1.0), SCORES)
    return scores.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.n).cast("long").alias("train_tokens"), "base_score", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    ).drop("copy")
