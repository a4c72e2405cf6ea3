"""Word hashing, per-process state and packed document chunks.

Words are the runs of ``[^\\x20\\x09-\\x0D]``, which is what ``bytes.split``
yields on UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SEED = 0x5EED
NO_ID = np.iinfo(np.int64).max


def text_bytes(text: str = "text") -> Column:
    """The UTF-8 bytes of a text column, empty for NULL."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def process_state(name: str, make: Callable):
    """One object per worker process.

    Task functions travel by value and bring fresh globals to each task; what is
    kept here lives as long as the reused Python worker.
    """
    holder = sys.modules.setdefault("_voxframe_state", types.ModuleType("_voxframe_state"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


class WordHashes(dict):
    """64-bit hash of each word, remembered for the words in use."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word, SEED)
        return value


def word_hashes(limit: int = 200_000) -> WordHashes:
    """The process's word hashes; emptied when they outgrow ``limit`` words."""
    cache = process_state("word_hashes", WordHashes)
    if len(cache) > limit:
        cache.clear()
    return cache


def blocks(texts: pa.Array, most: int, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Start and number of consecutive texts, ``most`` at once and ``size`` bytes, of which only a longer text alone has more."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = done = 0
    while start < len(texts):
        fit = int(np.searchsorted(ends, done + size, "right"))
        end = max(start + 1, min(start + most, fit))
        yield start, end - start
        start, done = end, int(ends[end - 1])


def hand_back() -> None:
    """Give up the word hashes and return freed memory to the system.

    A worker that waits for its next task otherwise keeps what its last one needed at most.
    """
    process_state("word_hashes", WordHashes).clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` items from each position on (positions that fit)."""
    n = max(0, len(hashes) - size + 1)
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= MULTIPLIER
        out += hashes[j : j + n]
    return mix(out)


class Words:
    """The words of several documents laid end to end."""

    def __init__(self, texts: Sequence[bytes]):
        self.words = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.total = int(self.ends[-1]) if len(self.ends) else 0
        self.doc = np.repeat(np.arange(len(self.words)), self.counts)
        known = word_hashes()
        self.hashes = np.fromiter(map(known.__getitem__, chain.from_iterable(self.words)), np.uint64, self.total)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the windows that lie in one document, and their hashes."""
        rolled = rolling(self.hashes, size)
        at = np.flatnonzero(self.ends[self.doc[: len(rolled)]] - np.arange(len(rolled)) >= size)
        return at, rolled[at]


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by hash range: ascending hashes give ascending buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack_documents(ids: np.ndarray, known: np.ndarray, texts: Sequence[bytes], zstd: zstandard.ZstdCompressor) -> bytes:
    """Documents as one compressed block: count, ids, id-is-given, lengths, bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    head = np.array([len(texts)], np.int64).tobytes() + ids.astype(np.int64).tobytes() + known.astype(np.uint8).tobytes() + sizes.tobytes()
    return zstd.compress(head + b"".join(texts))


def unpack_documents(blocks: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids, known, texts = [np.zeros(0, np.int64)], [np.zeros(0, bool)], []
    unzip = zstandard.ZstdDecompressor()
    for block in blocks:
        data = unzip.decompress(block)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        ids.append(np.frombuffer(data, np.int64, n, 8))
        known.append(np.frombuffer(data, np.uint8, n, 8 + 8 * n).astype(bool))
        sizes = np.frombuffer(data, np.int64, n, 8 + 9 * n)
        at = 8 + 17 * n
        for size in sizes.tolist():
            texts.append(data[at : at + size])
            at += size
    return np.concatenate(ids), np.concatenate(known), texts


def chunked(docs: DataFrame, chunks: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(chunk, block)``: documents dealt to chunks by a hash of id and text.

    The blocks of one chunk may come from many tasks. Compressed before they are
    shuffled, they take about a third of the text.
    """
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("id"),
        text_bytes(text).alias("text"),
        F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(chunks)).cast("int").alias("chunk"),
    )

    def pack(batches):
        zstd = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            chunk = batch.column(2).to_numpy()
            order = np.argsort(chunk, kind="stable")
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            texts = batch.column(1)
            first = runs(chunk[order])
            names, blocks = [], []
            for a, b in zip(first, np.append(first[1:], len(order))):
                rows = order[a:b]
                names.append(int(chunk[rows[0]]))
                blocks.append(pack_documents(ids[rows], known[rows], [texts[int(i)].as_py() for i in rows], zstd))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blocks, pa.binary())], names=["chunk", "block"])

    return rows.mapInArrow(pack, "chunk int, block binary")


def id_array(ids: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=~known)
