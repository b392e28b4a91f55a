"""Byte-level BPE as a sentencepiece model written straight from a rank file, for encoding and decoding.

The 256 bytes are mapped to 256 printable characters; each vocabulary entry becomes a piece of mapped characters with
score -rank, so that sentencepiece's merges (highest score first, leftmost on ties) are the merges of the ranks.  The
normaliser is the identity.  A text is cut into pre-tokens by a pattern, each pre-token is encoded by itself (an entry
of the vocabulary is its own id), and decoding maps pieces back to bytes.

Every document is encoded in its own row: no shuffle.  The model (under 2 MB, the size of its vocabulary file) is sent
to the executors once.

Cases: a NULL or empty text has no ids and decodes to no bytes; a text of any length is encoded whole; repeated rows
are encoded alike; other columns pass through.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_list, pieces

#: Words whose ids a worker remembers before it starts anew (about 200 bytes each); bytes of text encoded at once.
REMEMBERED, PIECE_BYTES = 1_000_000, 4 << 20
UNKNOWN = "<unknown>"


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where Latin-1 has a visible one, else from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 bytes and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol-buffer field: varint for int, 32 bit for float, length-delimited for bytes."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a rank table.  Ranks must be 0..n-1; they become the piece ids."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0..n-1 without gaps")
    chars = byte_chars()
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte must have a rank")
    # Field numbers and enum values of sentencepiece's model format.
    piece_type = {"normal": 1, "unknown": 2}
    bpe = 2
    model = bytearray()
    for entry, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(chars[b] for b in entry).encode()
        model += _field(1, _field(1, text) + _field(2, -float(rank)) + _field(3, piece_type["normal"]))
    model += _field(1, _field(1, UNKNOWN.encode()) + _field(2, 0.0) + _field(3, piece_type["unknown"]))
    model += _field(2, _field(3, bpe))  # trainer: model type
    model += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))  # normaliser: changes nothing
    return bytes(model)


#: A space between two characters that are not white space: where a text may be cut before it is matched.
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Without these and without spaces side by side, at a line's or the text's end, every space is a lone one.
_OTHER_SPACE = re.compile(r"[^\S \n]")


def _words(text: str) -> list[str]:
    """The text cut before its lone spaces."""
    if _OTHER_SPACE.search(text) or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
        words = _LONE_SPACE.split(text)
    else:
        words = text.split(" ")
    return [words[0], *[" " + w for w in words[1:]]]


class Codec:
    """Encoder and decoder of one worker.

    The pattern must begin a new match at every single space between words, as those of byte-level vocabularies do:
    then words can be matched and encoded each by itself, with the space before it, and remembered.
    """

    def __init__(self, model: bytes, pattern: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.match = regex.compile(pattern).findall
        self.chars = byte_chars()
        self.latin = dict(enumerate(self.chars))
        byte_of = {c: b for b, c in enumerate(self.chars)}
        n = self.sp.get_piece_size() - 1
        names = [self.sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = [bytes(byte_of[c] for c in name) for name in names]
        self.entry = {b: struct.pack("<I", i) for i, b in enumerate(self.bytes_of)}
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of words; what is no entry of the vocabulary is merged by the model, all in one call."""
        matches = {w: [m.encode() for m in self.match(w)] for w in words}
        ids = {m: self.entry.get(m) for found in matches.values() for m in found}
        rest = [m for m, known in ids.items() if known is None]
        for m, merged in zip(rest, self.sp.encode([m.decode("latin-1").translate(self.latin) for m in rest])):
            ids[m] = struct.pack(f"<{len(merged)}I", *merged)
        for w, found in matches.items():
            self.known[w] = b"".join([ids[m] for m in found])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [_words(t) if t else [] for t in texts]
        new = {w for words in cut for w in words}.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {w for words in cut for w in words}
        self._learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def _codec(model: bytes, pattern: str) -> Codec:
    """One codec per worker process: tasks that follow each other share what it remembers."""
    return Codec(model, pattern)


def _coder(docs: DataFrame, model: bytes, pattern: str):
    model_there = docs.sparkSession.sparkContext.broadcast(model)
    return lambda: _codec(model_there.value, pattern)


def encode(docs: DataFrame, model: bytes, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as binary column ``into`` (little-endian unsigned 32 bit)."""
    codec = _coder(docs, model, pattern)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, PIECE_BYTES):
                ids = codec().encode_all(as_list(part.column(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=[*part.schema.names, into])

    return docs.mapInArrow(task, T.StructType([*docs.schema.fields, T.StructField(into, T.BinaryType())]))


def decode(coded: DataFrame, model: bytes, ids: str = "ids", into: str = "bytes") -> DataFrame:
    """``coded`` with the bytes that its ids stand for as binary column ``into``."""
    codec = _coder(coded, model, r"(?s).+")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, ids):
                texts = [codec().decode(x or b"") for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, into])

    return coded.mapInArrow(task, T.StructType([*coded.schema.fields, T.StructField(into, T.BinaryType())]))


def round_trip(docs: DataFrame, model: bytes, pattern: str) -> DataFrame:
    """Encode, then decode the ids: digests per document (doc_id, n_tokens, ids_sha256, decoded_sha256).

    One Python stage, so that neither ids nor decoded bytes leave the task.
    """
    codec = _coder(docs, model, pattern)
    kind = "doc_id " + docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                counts, ids_digest, text_digest = [], [], []
                for ids in codec().encode_all(as_list(part.column("text"))):
                    counts.append(len(ids) // 4)
                    ids_digest.append(hashlib.sha256(ids).hexdigest())
                    text_digest.append(hashlib.sha256(codec().decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(task, f"{kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
