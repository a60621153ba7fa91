"""Token-id files: id arrays with Elias-Fano encoded document boundaries.

A shard file is written by one task, streaming, in this order (little-endian):

    magic "TWTK0001"
    token ids, 16 bits each (32 if the vocabulary needs them)
    Elias-Fano sequence of the documents' ends within the shard
    Elias-Fano sequence of the document ids, less the first
    footer: n_docs, n_nulls, first id, n_ids, id width, bytes of both sequences

An Elias-Fano sequence keeps the low bits of its values packed and the high bits
in unary; a sample of every 256th one bit lets ``select`` find a value without
decoding the rest. Shards follow each other in ascending order of doc_id.

Edge cases: a null or empty text is one end id; null doc_ids come first; rows
that repeat are written each, in order of a hash of their text; an empty table
gives no shard; other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.storage import new_path

MAGIC = b"TWTK0001"
END_ID = 2
SAMPLE = 256
#: Distinct words whose ids a Python worker remembers (about 200 bytes each).
CACHE_WORDS = 1_000_000
_FOOTER = "<qqqqqqq"
_HEADER = "<qqqq"


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about 2 + log2(max / n) bits a value."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if bits:
            shifts = np.arange(bits, dtype=np.uint64)
            low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def to_bytes(self) -> bytes:
        head = struct.pack(_HEADER, self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, n_low, n_high = struct.unpack_from(_HEADER, data)
        at = struct.calcsize(_HEADER)
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, "<u8", -(-n // SAMPLE), at + n_low + n_high)
        return cls(n, bits, low, high, samples)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first = i * self.low_bits
        piece = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8], bitorder="little")
        piece = piece[first % 8 : first % 8 + self.low_bits]
        return int((piece.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum())

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, ones are counted up to the i-th."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, seen = start // 8, -(bin(int(self.high[start // 8]) & ((1 << start % 8) - 1)).count("1"))
        while seen + (ones := bin(int(self.high[byte])).count("1")) <= left:
            seen, byte = seen + ones, byte + 1
        at = int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[left - seen])
        return ((byte * 8 + at - i) << self.low_bits) | self._low(i)

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        values = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            values |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return values.astype(np.int64)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


# The normalisers and the splitting pattern of the tokenizers whose pieces between white space are independent.
_PIECE_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: The same pattern for lower-case texts of code points below 256.
_LATIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_PLAIN_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _byte_letters() -> dict[int, int]:
    """What the byte-level step writes for each byte: visible bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


def _parts_are_known(config: dict) -> bool:
    """Whether, after :func:`_splits_at_spaces`, bytes of pre-tokens go to the model as they are, and added tokens all hold "<|"."""
    rest = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[1:]
    return rest == [_PLAIN_BYTES] and not config["model"].get("dropout") and all("<|" in t["content"] for t in config["added_tokens"])


def _splits_at_spaces(config: dict) -> bool:
    """Whether a tokenizer lower-cases, and splits at white space before all else, as :class:`_Encoder` takes for granted."""
    steps = (config.get("normalizer") or {}).get("normalizers", [])
    first = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return [x["type"] for x in steps] == _PIECE_NORMALIZERS and first.get("pattern") == {"Regex": _PIECE_PATTERN}


class _Encoder(dict):
    """White-space separated piece of text -> bytes of its ids, where pieces are independent; other tokenizers get whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.letter = "H" if self.width == 2 else "I"
        self.apart: dict[str, bool] = {}
        config = json.loads(self.tokenizer.to_str())
        self.by_piece = _splits_at_spaces(config)
        self.by_part = self.by_piece and _parts_are_known(config)
        self.model = self.tokenizer.model

    def _apart(self, letter: str) -> bool:
        """Whether a stop after a letter is a pre-token of its own: a letter may become letter and mark, and mark and stop are one."""
        if letter not in self.apart:
            plain = self.tokenizer.normalizer.normalize_str(letter + ".")
            self.apart[letter] = self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)[-1][0] == "."
        return self.apart[letter]

    def _ids(self, piece: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _part_ids(self, part: str) -> bytes:
        """Of a pre-token of code points below 256, without the steps before the model."""
        ids = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(_BYTE_LETTERS))]
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        if self.by_part and max(piece) < "\u0100":
            parts = _LATIN_PARTS.findall(piece.lower())
            ids = b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else self._part_ids(parts[0])
        elif piece[-1] in ".," and piece[:-1].isalpha() and self._apart(piece[-2]):  # a word before a stop is likely known
            ids = self[piece[:-1]] + self[piece[-1]]
        else:
            ids = self._ids(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        # "<|" may begin a special token, which can span pieces; the others are white space to Python alone
        if not self.by_piece or "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._ids(text)
        return b"".join(map(self.__getitem__, (text.lower() if text.isascii() else text).split()))


_encoders: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    """One encoder a worker process: what it remembers serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = struct.pack(f"<{encoder.letter}", end_id)
        fs, base = filesystem(folder)
        shard = TaskContext.get().partitionId()
        draft, final = f"{base}/.{shard:06d}-{uuid.uuid4().hex}", f"{base}/{shard:06d}.tok"
        out, lengths, ids, nulls = None, [], [], 0
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(draft)
                out.write(MAGIC)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encoder.encode(text or "") + end
                out.write(data)
                lengths.append(len(data) // encoder.width)
                if doc_id is None:
                    nulls += 1
                else:
                    ids.append(doc_id)
        if out is None:
            return
        ends = np.cumsum(np.array(lengths, dtype=np.int64))
        first = ids[0] if ids else 0
        a = EliasFano.encode(ends).to_bytes()
        b = EliasFano.encode(np.array([x - first for x in ids], dtype=np.uint64)).to_bytes()
        out.write(a + b + struct.pack(_FOOTER, len(lengths), nulls, first, int(ends[-1]), encoder.width, len(a), len(b)))
        out.close()
        fs.move(draft, final)  # a task that runs twice leaves one whole file
        yield pa.record_batch({"shard": [shard], "n_docs": [len(lengths)], "n_ids": [int(ends[-1])]})

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes all texts into shard files; returns their list: path, start (ids before the shard), n_docs, n_ids.

    Texts are dealt by ranges of doc_id, so that each task writes one shard in
    order; only the list of shards, a row a task, passes through the driver.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    listed = ordered.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer, end_id), "shard long, n_docs long, n_ids long")
    shards, start = [], 0
    for r in sorted(listed.collect()):
        shards.append((f"{folder}/{r.shard:06d}.tok", start, r.n_docs, r.n_ids))
        start += r.n_ids
    return spark.createDataFrame(shards, "path string, start long, n_docs long, n_ids long")


class TokenShard:
    """A shard file: ``doc_ids``, and the ids of any document by its position."""

    def __init__(self, uri: str):
        fs, self.path = filesystem(uri)
        self.file = fs.open_input_file(self.path)
        size = self.file.size()
        footer = self.file.read_at(struct.calcsize(_FOOTER), size - struct.calcsize(_FOOTER))
        self.n_docs, self.nulls, first, self.n_ids, self.width, n_a, n_b = struct.unpack(_FOOTER, footer)
        both = self.file.read_at(n_a + n_b, size - struct.calcsize(_FOOTER) - n_a - n_b)
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        self.ends = EliasFano.from_bytes(both[:n_a])
        self.doc_ids = [None] * self.nulls + (EliasFano.from_bytes(both[n_a:]).decode() + first).tolist()
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")

    def ids(self, i: int) -> np.ndarray:
        start = self.ends.select(i - 1) if i else 0
        return self._read(start, self.ends.select(i))

    def _read(self, start: int, end: int) -> np.ndarray:
        data = self.file.read_at((end - start) * self.width, len(MAGIC) + start * self.width)
        return np.frombuffer(data, self.kind)

    def documents(self, chunk: int = 4_000_000) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) in order, reading about ``chunk`` ids at once."""
        ends = self.ends.decode()
        starts = np.concatenate([[0], ends[:-1]])
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + chunk, side="right")))
            data = self._read(int(starts[i]), int(ends[j - 1]))
            for d in range(i, j):
                yield self.doc_ids[d], int(starts[d]), data[starts[d] - starts[i] : ends[d] - starts[i]]
            i = j


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            docs, starts, counts, sums = [], [], [], []
            for doc_id, start, ids in TokenShard(path).documents():
                docs.append(doc_id)
                starts.append(before + start)
                counts.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.record_batch(
                {"doc_id": pa.array(docs, pa.int64()), "start": starts, "n_tokens": counts, "ids_crc32": pa.array(sums, pa.int64())}
            )


def read_digest(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    each = shards.repartition(max(1, shards.count())) if shards.count() else shards
    return each.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
