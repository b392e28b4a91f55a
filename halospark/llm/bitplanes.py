"""Token files of bit planes: ids cut into blocks, each block transposed into bit planes, each plane compressed.

A file holds the ids of one range of documents, in order.  Every block of BLOCK ids becomes one plane of bits per bit
of its largest id (the planes above are all zero and left out), and each plane is a zstandard frame.  A chunk index at
the end names the place of every block and plane; a manifest counts the ids before each file and lists its documents.

    file  = "BPLN" plane*  chunks  footer
    chunk = place (u64), number of ids (u32), number of planes (u32), compressed plane lengths (u32 * 32)
    footer = number of chunks (u64), "BPLN"

Files are written in ascending document order: quantiles of doc_id cut the documents into as many ranges as
spark.sql.shuffle.partitions says, each one partition and one file.  A file's name carries a fresh id for each attempt
and only files that the manifest names count.

Cases: a NULL or empty text is its end id alone; rows repeated under one doc_id follow each other, ordered by ids;
a NULL doc_id comes first; a table without rows has no files; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_list, packed, pieces, shared_path, shuffle_parts, split_words

BLOCK = 1 << 16
LEVEL = 3
#: Words whose ids a worker remembers before it starts anew (200 bytes each), and bytes of text encoded at once.
REMEMBERED, PIECE_BYTES = 700_000, 4 << 20
MAGIC = b"BPLN"
CHUNK = np.dtype([("place", "<u8"), ("ids", "<u4"), ("planes", "<u4"), ("lengths", "<u4", 32)])


def to_planes(ids: np.ndarray) -> list[bytes]:
    """The bit planes of up to BLOCK ids, lowest bit first."""
    n = int(ids.max(initial=0)).bit_length()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(n)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    bits = np.zeros((n, 32), np.uint8)
    for k, plane in enumerate(planes):
        bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file; ids may come in pieces of any length."""

    def __init__(self, out):
        self.out, self.at, self.chunks = out, 0, []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.pack = zstandard.ZstdCompressor(LEVEL).compress
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            whole = np.concatenate(self.waiting)
            full = len(whole) // BLOCK * BLOCK
            for k in range(0, full, BLOCK):
                self._block(whole[k : k + BLOCK])
            self.waiting, self.n_waiting = [whole[full:]], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.pack(p) for p in to_planes(ids)]
        self.chunks.append((self.at, len(ids), len(planes), [len(p) for p in planes] + [0] * (32 - len(planes))))
        self._put(b"".join(planes))

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        self._put(np.array(self.chunks, CHUNK).tobytes() + struct.pack("<Q", len(self.chunks)) + MAGIC)
        self.out.close()


class PlaneReader:
    """Random access to the ids of one file through its chunk index; keeps one block in memory."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        (n,) = struct.unpack("<Q", source.read_at(12, size - 12)[:8])
        self.chunks = np.frombuffer(source.read_at(n * CHUNK.itemsize, size - 12 - n * CHUNK.itemsize), CHUNK)
        self.starts = np.concatenate([[0], np.cumsum(self.chunks["ids"], dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def block(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            c = self.chunks[k]
            ends = np.cumsum(c["lengths"][: c["planes"]], dtype=np.int64)
            data = self.source.read_at(int(ends[-1]) if len(ends) else 0, int(c["place"]))
            planes = [self.unpack(data[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
            self.held = (k, from_planes(planes, int(c["ids"])))
        return self.held[1]

    def read(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids start..start+n-1, block by block."""
        k = int(np.searchsorted(self.starts, start, side="right")) - 1
        while n:
            first = start - int(self.starts[k])
            part = self.block(k)[first : first + n]
            yield part
            start, n, k = start + len(part), n - len(part), k + 1


#: Letters that no normaliser changes but for their case; marks (without the apostrophe) that are a token part of their own.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_MARK = r"!-&(-/:-@\[-`{-~"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def joined_stretches(values: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` (one after the other, of ``size``) that ``code`` names, and where each one ends."""
    n = size[code]
    ends = np.cumsum(n)
    first = (np.cumsum(size) - size)[code] - ends + n
    return values[np.arange(len(n) and ends[-1]) + np.repeat(first, n)], ends


class WordCoder:
    """The tokenizers library's ids of whole texts, word by word; remembers words it has met.

    The tokenizer must drop white space and never join across it (word-level vocabularies with word ends).  Where it has
    word ends, letters and the marks after them are looked up apart, and in lower case where it folds case itself.
    """

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.known: dict[str, bytes] = {}
        parsed = json.loads(definition)
        normalizer = parsed.get("normalizer") or {}
        self.folds = "Lowercase" in [x["type"] for x in normalizer.get("normalizers", [normalizer]) if x]
        suffix = parsed["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _learn(self, plain: list[str], other: list[str]) -> None:
        """Plain parts are encoded many to a call, side by side; the tokens that end a word tell where each ends."""
        for k in range(0, len(plain), 512):
            some = plain[k : k + 512]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            data, stops = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            self.known.update(zip(some, [data[i:j] for i, j in zip([0, *stops], stops)]))
        for k in range(0, len(other), 512):
            some = other[k : k + 512]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        key, tail = words, pa.nulls(len(words), words.type).fill_null("")
        if self.ends is not None:
            stem = pc.utf8_rtrim(words, MARKS)
            plain = pc.match_substring_regex(stem, f"^{_LETTERS}$")
            key = pc.if_else(plain, pc.utf8_lower(stem) if self.folds else stem, words)
            tail = pc.replace_substring_regex(pc.if_else(plain, words, ""), f"^{_LETTERS}", "")
        key, tail = key.dictionary_encode(), tail.dictionary_encode()
        names = as_list(key.dictionary) + as_list(tail.dictionary)
        new = [w for w in dict.fromkeys(names) if w and w not in self.known]
        one_part = f"^({_LETTERS}|[{_MARK}]+)$" if self.ends is not None else "$^"
        simple = pc.match_substring_regex(pa.array(new, pa.string()), one_part).to_pylist()
        self._learn([w for w, s in zip(new, simple) if s], [w for w, s in zip(new, simple) if not s])
        own = [self.known[w] if w else b"" for w in names]
        size = np.array([*map(len, own)], np.int64) // 4
        code = np.empty(2 * len(words), np.int64)
        code[0::2], code[1::2] = key.indices.to_numpy(), tail.indices.to_numpy() + len(key.dictionary)
        ids, ends = joined_stretches(np.frombuffer(b"".join(own), "<u4"), size, code)
        return ids, np.diff(ends[1::2], prepend=0)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, ``end_id`` after each, and where each begins (and the last ends)."""
        counts, flat = split_words(texts)
        coded = flat.dictionary_encode()
        ids, size = self.ids_of(coded.dictionary)
        word = np.full(len(flat) + len(counts), len(size), np.int32)
        word[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = coded.indices.to_numpy()
        stream, ends = joined_stretches(np.append(ids, np.uint32(end_id)), np.append(size, 1), word)
        return stream, np.concatenate([[0], ends[np.cumsum(counts + 1) - 1]])


@functools.lru_cache(maxsize=2)
def _coder(definition: str) -> WordCoder:
    """One coder per worker process: tasks that follow each other share what it remembers."""
    return WordCoder(definition)


def id_type(definition: str, end_id: int) -> str:
    """What an id takes on its way between tasks: 16 bits where all of the vocabulary fit."""
    parsed = json.loads(definition)
    added = [t["id"] for t in parsed.get("added_tokens") or []]
    return "<u2" if max([end_id, *parsed["model"]["vocab"].values(), *added]) < 1 << 16 else "<u4"


def range_bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """Ids that cut the documents into ``parts`` ranges of about as many each; reads the ids only."""
    shares = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 100 * parts).alias("b")).first().b if shares else None
    return np.array(found or [], np.int64)


def tokenise(docs: DataFrame, tokenizer_json: str, end_id: int, bounds: np.ndarray) -> DataFrame:
    """(part, doc_id, ids) of every text: its range, and its ids in the type of :func:`id_type`.

    The tokenizer's definition (a file of under 2 MB) is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kind = id_type(tokenizer_json, end_id)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                doc_id = piece.column("doc_id")
                stream, starts = coder.encode(piece.column("text"), end_id)
                data = stream.astype(kind)
                offsets = (starts * data.itemsize).astype("<i8")
                buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
                ids = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).cast(pa.binary())
                # without an id: before all others
                known = np.where(doc_id.is_valid().to_numpy(zero_copy_only=False), doc_id.fill_null(0).to_numpy(), np.iinfo(np.int64).min)
                part = np.searchsorted(bounds, known, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), doc_id, ids], names=["part", "doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "part int, doc_id bigint, ids binary")


MANIFEST = "file string, first_part int, begin bigint, doc_ids binary, has_id binary, lengths binary, n_ids bigint"
_MANIFEST_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
#: Documents of a manifest row: a file of more has several rows.
ROW_DOCS = 1 << 18


def write_planes(tokens: DataFrame, folder: str, parts: int, kind: str) -> DataFrame:
    """Write (part, doc_id, ids) in ascending doc_id order; the manifest of all files, also a table in ``folder``.

    Every range of documents is one partition and one file, in the order of the ranges.
    """
    spark = tokens.sparkSession
    names = [x.split()[0] for x in MANIFEST.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        file, writer, part, begin, waiting = f"{uuid4().hex}.planes", None, 0, 0, []

        def row() -> pa.RecordBatch:
            doc_ids, has_id, lengths = (np.concatenate(x) for x in zip(*waiting))
            values = [file, part, begin, packed(doc_ids), packed(has_id), packed(lengths), int(lengths.sum())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _MANIFEST_TYPES)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(base, recursive=True)
                writer = PlaneWriter(fs.open_output_stream(f"{base}/{file}", compression=None))
                part = batch.column("part")[0].as_py()
            column, doc_id = batch.column("ids"), batch.column("doc_id")
            for data in column:
                writer.add(np.frombuffer(data.as_buffer(), kind))
            lengths = pc.binary_length(column).to_numpy().astype("<i8") // np.dtype(kind).itemsize
            waiting.append((doc_id.fill_null(0).to_numpy().astype("<i8"), doc_id.is_valid().to_numpy(zero_copy_only=False), lengths))
            if sum(len(x[0]) for x in waiting) >= ROW_DOCS:
                yield row()
                begin += sum(int(x[2].sum()) for x in waiting)
                waiting = []
        if writer is not None:
            writer.close()
        if waiting:
            yield row()

    ordered = tokens.repartitionById(parts, "part").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(task, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``file_start``, the number of ids in the files before; the sums are one number per file."""
    files = manifest.groupBy("first_part").agg(F.sum("n_ids").alias("n_ids")).orderBy("first_part").collect()
    starts, total = [], 0
    for f in files:
        starts.append((f.first_part, total))
        total += f.n_ids
    return manifest.join(manifest.sparkSession.createDataFrame(starts, "first_part int, file_start bigint"), "first_part")


def read_planes(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for f in batch.to_pylist():
                lengths = np.frombuffer(f["lengths"], "<i8")
                begin = f["begin"] + np.cumsum(lengths) - lengths
                sums = np.zeros(len(lengths), np.int64)
                with fs.open_input_file(f"{base}/{f['file']}") as source:
                    reader = PlaneReader(source)
                    for k, (at, n) in enumerate(zip(begin.tolist(), lengths.tolist())):
                        crc = 0
                        for part in reader.read(at, n):
                            crc = zlib.crc32(part.tobytes(), crc)
                        sums[k] = crc
                doc_id = pa.array(np.frombuffer(f["doc_ids"], "<i8"), mask=~np.frombuffer(f["has_id"], bool))
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array(begin + f["file_start"]), pa.array(lengths), pa.array(sums)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = with_starts(manifest)
    # one file is one task's work, as it was when written
    return rows.repartition(max(1, rows.count()), "file", "begin").mapInArrow(task, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def store_tokens(docs: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """Tokenise, write the token files into the shared folder, and read every document back from them."""
    folder = shared_path(docs.sparkSession)
    parts = shuffle_parts(docs.sparkSession)
    tokens = tokenise(docs, tokenizer_json, end_id, range_bounds(docs, parts))
    manifest = write_planes(tokens, folder, parts, id_type(tokenizer_json, end_id))
    return read_planes(manifest, folder)
