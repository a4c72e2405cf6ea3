"""Token ids in raw binary shards with a minimal perfect hash index.

One shard file holds, for a range of ascending document ids:

    magic, id width, counts                      header (8 little-endian 64-bit numbers)
    ids of all documents, one after the other    payload, 16 or 32 bits each
    document ids and a validity byte each        keys, in order
    end of each document in the payload          ends
    levels of the hash index                     see :class:`HashIndex`

The index maps a key to its record in constant time: level after level, keys
that hash to a cell of their own keep it and the others go on to the next level;
the rank of the cell is the key's slot, and the slot holds the record number
and a fingerprint that tells strangers apart. The payload itself is only
touched where a record points.

A NULL id has no key: its record comes first and is read in order, not by key.
A repeated id has one slot, which points to the first of its adjacent records.
NULL and empty texts are their end id alone; an empty table gives no shards.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage, scratch_path
from .common import mix
from .units import unit_encoder

MAGIC = 0x31535449444E5856
MANIFEST = "shard int, path string, n_docs bigint, n_ids bigint"
RECORDS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
BLOCK = 1 << 22  # ids read at a time
LOAD = 2  # cells per key and level
PRINT = np.uint64(0xA24BAED4963EE407)


class HashIndex:
    """Minimal perfect hash over distinct 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: list[np.ndarray], slots: np.ndarray, prints: np.ndarray):
        self.sizes, self.bits, self.slots, self.prints = sizes, bits, slots, prints
        # rank: cells taken before each byte of the levels laid end to end
        taken = [np.concatenate([[0], np.cumsum(np.bitwise_count(b), dtype=np.int64)]) for b in bits]
        self.base = np.concatenate([[0], np.cumsum([t[-1] for t in taken])]).astype(np.int64)
        self.rank = taken

    @staticmethod
    def cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))) % np.uint64(size)

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ PRINT) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray, records: np.ndarray) -> HashIndex:
        """``mix`` is a bijection, so distinct keys part at some level."""
        sizes, bits, rest, placed = [], [], np.arange(len(keys)), []
        while len(rest):
            size = max(8, LOAD * len(rest) + 7 & ~7)
            at = cls.cell(keys[rest], len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            mine = alone[at]
            order = np.argsort(at[mine])
            placed.append(rest[mine][order])
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little"))
            rest = rest[~mine]
        order = np.concatenate(placed) if placed else np.zeros(0, np.int64)
        return cls(np.array(sizes, np.int64), bits, records[order].astype(np.int64), cls.fingerprint(keys[order]))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Record of each key, -1 for keys that are not there."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, (size, bits) in enumerate(zip(self.sizes.tolist(), self.bits)):
            at = self.cell(keys[rest], level, size).astype(np.int64)
            byte, bit = at >> 3, at & 7
            hit = (bits[byte] >> bit) & 1 == 1
            below = np.bitwise_count(bits[byte] & ((1 << bit) - 1).astype(np.uint8))
            slot = self.base[level] + self.rank[level][byte] + below
            out[rest[hit]] = slot[hit]
            rest = rest[~hit]
            if not len(rest):
                break
        found = np.flatnonzero(out >= 0)
        same = self.prints[out[found]] == self.fingerprint(keys[found])
        out[found[~same]] = -1
        found = found[same]
        out[found] = self.slots[out[found]]
        return out


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


class ShardWriter:
    def __init__(self, folder: str, number: int, width: int):
        # the manifest names the file of the attempt that won; others are never read
        self.path = os.path.join(folder, f"shard-{number:06d}-{uuid.uuid4().hex}.ids")
        self.width = width
        files, inner = _open(self.path)
        files.create_dir(os.path.dirname(inner), recursive=True)
        self.out = files.open_output_stream(inner)
        self.keys, self.known, self.ends, self.total = [], [], [], 0
        self.out.write(np.array([MAGIC, width], "<u8").tobytes())

    def add(self, key: int | None, ids: bytes) -> None:
        """``ids`` are little-endian unsigned 32-bit ids."""
        values = np.frombuffer(ids, "<u4")
        if self.width == 2 and len(values) and values.max() > 0xFFFF:
            raise ValueError("an id does not fit 16 bits")
        self.out.write(values.astype(f"<u{self.width}").tobytes())
        self.total += len(values)
        self.keys.append(key or 0)
        self.known.append(key is not None)
        self.ends.append(self.total)

    def close(self) -> None:
        keys, known = np.array(self.keys, np.int64), np.array(self.known, np.uint8)
        given = np.flatnonzero(known)
        distinct, first = np.unique(keys[given], return_index=True)
        index = HashIndex.build(distinct.view(np.uint64), given[first])
        for part in (keys, known, np.array(self.ends, np.int64), index.sizes, *index.bits, index.slots, index.prints):
            self.out.write(part.tobytes())
        self.out.write(np.array([len(keys), self.total, len(index.sizes), len(index.slots)], "<u8").tobytes())
        self.out.close()


class ShardReader:
    def __init__(self, path: str):
        files, inner = _open(path)
        self.file = files.open_input_file(inner)
        size = self.file.size()
        magic, self.width = np.frombuffer(self._at(0, 16), "<u8").tolist()
        if magic != MAGIC:
            raise ValueError(f"{path} is no id shard")
        self.n, self.total, levels, slots = np.frombuffer(self._at(size - 32, 32), "<u8").tolist()
        at = 16 + self.width * self.total
        body = self._at(at, size - 32 - at)
        place = 0

        def take(kind, count):
            nonlocal place
            out = np.frombuffer(body, kind, count, place)
            place += out.nbytes
            return out

        self.keys, self.known, self.ends = take(np.int64, self.n), take(np.uint8, self.n).astype(bool), take(np.int64, self.n)
        sizes = take(np.int64, levels)
        bits = [take(np.uint8, s // 8) for s in sizes.tolist()]
        self.index = HashIndex(sizes, bits, take(np.int64, slots), take(np.uint32, slots))

    def _at(self, start: int, count: int) -> bytes:
        return self.file.read_at(count, start)

    def bounds(self, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(records > 0, self.ends[records - 1], 0), self.ends[records]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids of the payload from ``start`` to ``end``, unsigned 32 bits."""
        return np.frombuffer(self._at(16 + self.width * start, self.width * (end - start)), f"<u{self.width}").astype("<u4")

    def get(self, key: int) -> np.ndarray | None:
        """The ids stored under a key."""
        record = self.index.find(np.array([key], np.int64).view(np.uint64))
        if record[0] < 0:
            return None
        (start,), (end,) = self.bounds(record)
        return self.ids(int(start), int(end))

    def records(self) -> np.ndarray:
        """The record of every key by the index; keyless and repeated ones in order."""
        out = np.arange(self.n)
        given = np.flatnonzero(self.known)
        found = self.index.find(self.keys[given].view(np.uint64))
        if (found < 0).any():
            raise ValueError("a stored key is missing from the index")
        first = np.concatenate([[True], self.keys[given][1:] != self.keys[given][:-1]]) if len(given) else np.zeros(0, bool)
        out[given[first]] = found[first]
        return out


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, width: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes shards in ascending id order; returns the manifest ``(shard, path, n_docs, n_ids)``.

    Documents are range-partitioned by id (ties by a hash of the text), so a
    shard is one partition and the shard numbers ascend with the ids. Payloads
    stream to the file; a task holds the keys and ends of its shard.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "ids")

    def write(batches):
        writer = None
        encoder = unit_encoder(tokenizer)
        number = TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                writer = writer or ShardWriter(folder, number, width)
                for key, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    writer.add(key, ids + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": number, "path": writer.path, "n_docs": len(writer.keys), "n_ids": writer.total}],
                                             schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("body")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut_lineage(ranged.mapInArrow(write, MANIFEST))


def read_ids(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, found through their indexes: see ``RECORDS``."""
    # one row per shard: the running sum is over shards, not documents
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(row["path"])
                starts, ends = shard.bounds(shard.records()) if shard.n else (np.zeros(0, np.int64),) * 2
                at = 0
                while at < shard.n:
                    # as many records as fit a block of ids, one at least
                    upto = max(at + 1, int(np.searchsorted(shard.ends, (shard.ends[at - 1] if at else 0) + BLOCK, side="right")))
                    keys = pa.array(shard.keys[at:upto], pa.int64(), mask=~shard.known[at:upto])
                    a, b, at = starts[at:upto], ends[at:upto], upto
                    low, high = int(a.min()), int(b.max())
                    ids = memoryview(shard.ids(low, high).tobytes())
                    crc = [zlib.crc32(ids[4 * (x - low) : 4 * (y - low)]) for x, y in zip(a.tolist(), b.tolist())]
                    yield pa.RecordBatch.from_arrays([keys, pa.array(a + row["base"]), pa.array(b - a), pa.array(crc, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(parts, "shard").mapInArrow(read, RECORDS)
