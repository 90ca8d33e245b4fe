"""Operator 10: sorted-string-table shards.

Documents are range-partitioned and sorted by identifier; every partition becomes one shard:

    data block*   entries with prefix-compressed keys, restart points, zstd; a CRC in front
    index block   last key, offset and length of every data block
    bloom block   number of probes, bit array over all keys
    footer        fixed 40 bytes: offsets and lengths of index and bloom, number of entries, magic

Keys are byte strings whose order is the identifier's order: integers as 8 big-endian bytes with the sign bit
flipped, strings as UTF-8. Values are the UTF-8 text, or token ids as little-endian uint32.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import small_batches

BLOCK_BYTES, RESTART, BITS_PER_KEY, LEVEL = 64 * 1024, 16, 10, 1
MAGIC = 0x51524E5353544231
FOOTER = struct.Struct("<QIQIQQ")
SCHEMA = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("section", T.StringType()), T.StructField("section_no", T.IntegerType()), T.StructField("file_offset", T.LongType()), T.StructField("entries", T.IntegerType()), T.StructField("first_key", T.BinaryType()), T.StructField("last_key", T.BinaryType()), T.StructField("payload", T.BinaryType())])


def encode_key(key: int | str | bytes) -> bytes:
    """TypeError for a key that is no whole number, string or bytes: others would lose their order or fall together."""
    if isinstance(key, bytes):
        return key
    if isinstance(key, str):
        return key.encode("utf-8", "surrogatepass")
    if isinstance(key, bool) or not isinstance(key, int | np.integer):
        raise TypeError(f"{type(key).__name__} can't be a key")
    return struct.pack(">Q", int(key) + (1 << 63))


def decode_int_key(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def encode_value(value) -> bytes:
    """Text or token ids; NULL becomes b'\\x00', anything else starts with \\x01, so that NULL and '' differ."""
    if value is None:
        return b"\x00"
    if isinstance(value, str):
        return b"\x01" + value.encode("utf-8", "surrogatepass")
    if isinstance(value, bytes | bytearray):
        return b"\x01" + bytes(value)
    return b"\x01" + np.asarray(value, "<u4").tobytes()


def decode_value(data: bytes, kind: str = "text"):
    if data[:1] == b"\x00":
        return None
    return {"text": lambda b: b.decode("utf-8", "surrogatepass"), "ids": lambda b: np.frombuffer(b, "<u4").tolist(), "bytes": bytes}[kind](data[1:])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(hashes: bytes, count: int, bits: int) -> np.ndarray:
    """(probe, key) places by double hashing from the two halves of the keys' 128-bit hashes, modulo 2**64."""
    b, a = np.frombuffer(hashes, "<u8").reshape(-1, 2).T
    return (a + np.arange(count, dtype=np.uint64)[:, None] * (b | np.uint64(1))) % np.uint64(bits)


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_intdigest(key).to_bytes(16, "little")


@dataclass
class ShardBuilder:
    """Takes entries in key order and yields the shard's sections as they are complete; holds one block, 16 bytes for each key, and the index."""

    block_bytes: int = BLOCK_BYTES
    offset: int = 0
    blocks: int = 0
    count: int = 0
    body: bytearray = field(default_factory=bytearray)
    restarts: list[int] = field(default_factory=list)
    in_block: int = 0
    first: bytes = b""
    last: bytes = b""
    index: list[tuple[bytes, int, int]] = field(default_factory=list)
    hashes: bytearray = field(default_factory=bytearray)
    lowest: bytes = b""

    def add(self, key: bytes, value: bytes) -> tuple | None:
        if self.count and key < self.last:
            raise ValueError("entries must come in the order of their keys")
        if not self.count:
            self.lowest = key
        if not self.in_block:
            self.first = key
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.body))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.body += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.count or key != self.last:
            self.hashes += _hash(key)
        self.last, self.in_block, self.count = key, self.in_block + 1, self.count + 1
        return self._close_block() if len(self.body) >= self.block_bytes else None

    def _section(self, name: str, number: int, entries: int, first: bytes, last: bytes, payload: bytes) -> tuple:
        row = (name, number, self.offset, entries, first, last, payload)
        self.offset += len(payload)
        return row

    def _close_block(self) -> tuple:
        raw = bytes(self.body) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
        payload = struct.pack("<I", zlib.crc32(packed)) + packed
        self.index.append((self.last, self.offset, len(payload)))
        row = self._section("data", self.blocks, self.in_block, self.first, self.last, payload)
        self.blocks += 1
        self.body, self.restarts, self.in_block = bytearray(), [], 0
        return row

    def finish(self) -> Iterator[tuple]:
        if self.in_block:
            yield self._close_block()
        index = struct.pack("<I", len(self.index)) + b"".join(struct.pack("<IQI", len(k), o, n) + k for k, o, n in self.index)
        at, size = self.offset, len(index)
        yield self._section("index", 0, len(self.index), self.lowest, self.last, index)
        keys = len(self.hashes) // 16
        bits = max(64, keys * BITS_PER_KEY)
        probes = max(1, round(BITS_PER_KEY * 0.69))
        array = np.zeros(-(-bits // 8), np.uint8)
        for first in range(0, len(self.hashes), 16 << 16):
            hit = _probes(self.hashes[first : first + (16 << 16)], probes, bits).ravel()
            np.bitwise_or.at(array, (hit >> np.uint64(3)).astype(np.int64), np.left_shift(1, hit & np.uint64(7), dtype=np.uint64).astype(np.uint8))
        bloom = struct.pack("<IQ", probes, bits) + array.tobytes()
        bloom_at = self.offset
        yield self._section("bloom", 0, keys, self.lowest, self.last, bloom)
        yield self._section("footer", 0, self.count, self.lowest, self.last, FOOTER.pack(at, size, bloom_at, len(bloom), self.count, MAGIC))


class ShardReader:
    """Lookup in the bytes of one shard: Bloom filter, then binary search in the index, in the restart points and along one run."""

    def __init__(self, data: bytes):
        self.data = data
        at, size, bloom_at, bloom_size, self.count, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.lasts, self.places = [], []
        (n,), p = struct.unpack_from("<I", data, at), at + 4
        for _ in range(n):
            k, o, length = struct.unpack_from("<IQI", data, p)
            p += 16
            self.lasts.append(data[p : p + k])
            self.places.append((o, length))
            p += k
        self.probes, self.bits = struct.unpack_from("<IQ", data, bloom_at)
        self.bloom = data[bloom_at + 12 : bloom_at + bloom_size]

    def may_contain(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(_hash(key), self.probes, self.bits).ravel().tolist())

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        o, n = self.places[i]
        packed = self.data[o + 4 : o + n]
        if struct.unpack_from("<I", self.data, o)[0] != zlib.crc32(packed):
            raise ValueError(f"block {i} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(packed)
        (k,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 - 4 * k
        return raw, list(struct.unpack_from(f"<{k}I", raw, end)), end

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            yield key, raw[at + rest : at + rest + size]
            at += rest + size

    def get_all(self, key: bytes) -> list[bytes]:
        """Every value of ``key``, in the order written."""
        if not self.may_contain(key):
            return []
        found: list[bytes] = []
        for i in range(bisect.bisect_left(self.lasts, key), len(self.places)):
            raw, restarts, end = self._block(i)
            firsts = [next(self._entries(raw, r, end))[0] for r in restarts] if len(restarts) < 8 else None
            if firsts is None:
                lo, hi = 0, len(restarts)
                while lo < hi:
                    mid = (lo + hi) // 2
                    if next(self._entries(raw, restarts[mid], end))[0] < key:
                        lo = mid + 1
                    else:
                        hi = mid
            else:
                lo = bisect.bisect_left(firsts, key)
            for k, v in self._entries(raw, restarts[max(0, lo - 1)], end):
                if k == key:
                    found.append(v)
                elif k > key:
                    return found
        return found

    def get(self, key: bytes) -> bytes | None:
        values = self.get_all(key)
        return values[0] if values else None

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.places)):
            raw, _, end = self._block(i)
            yield from self._entries(raw, 0, end)


def _sorted_entries(docs: DataFrame, key: str, value: str) -> DataFrame:
    if not isinstance(docs.schema[key].dataType, T.IntegralType | T.StringType | T.BinaryType):
        raise TypeError(f"{key} can't be a key: it is {docs.schema[key].dataType.simpleString()}")
    small_batches(docs.sparkSession)
    two = docs.select(F.col(key).alias("key"), F.col(value).alias("value")).where(F.col("key").isNotNull())
    return two.repartitionByRange("key").sortWithinPartitions("key", "value")


def _sections(block_bytes: int, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    builder = ShardBuilder(block_bytes)
    for frame in frames:
        for key, value in zip(frame["key"].tolist(), frame["value"].tolist(), strict=True):
            if row := builder.add(encode_key(key), encode_value(value)):
                yield row
    if builder.count:
        yield from builder.finish()


def build_shards(docs: DataFrame, key: str = "doc_id", value: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per section of every shard; the payloads of a shard, joined in the order of file_offset, are its file.

    Rows with a NULL key can't be looked up and are left out; a NULL value is stored as NULL, an empty text as empty.
    Repeated keys are all stored, next to each other and ordered by value, always in one shard; get_all() finds each. A text
    longer than a block gets a block of its own. Keys are whole numbers, strings or bytes (TypeError for others). An empty table gives no rows. Other columns are ignored.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId()
        held, size = [], 0
        for row in _sections(block_bytes, frames):
            held.append((shard, *row))
            size += len(row[-1])
            if size > 4 << 20:
                yield pd.DataFrame(held, columns=SCHEMA.names)
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=SCHEMA.names)

    return _sorted_entries(docs, key, value).mapInPandas(pack, SCHEMA)


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", value: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write one file per shard to ``folder``, which all executors must share, and return the manifest (file, first_key, last_key,
    entries, bytes). A file appears under its name only when it is whole, so a task that is run again replaces it. Call an action on the result once."""

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.sst"
        part = os.path.join(folder, f".{name}.{context.taskAttemptId()}")
        last = None
        with open(part, "wb") as out:
            for row in _sections(block_bytes, frames):
                out.write(row[-1])
                last = row
        if last is None:
            os.unlink(part)
            return
        os.replace(part, os.path.join(folder, name))
        yield pd.DataFrame([(name, last[4], last[5], last[3], last[2] + len(last[-1]))], columns=["file", "first_key", "last_key", "entries", "bytes"])

    os.makedirs(folder, exist_ok=True)
    return _sorted_entries(docs, key, value).mapInPandas(save, "file string, first_key binary, last_key binary, entries long, bytes long")
