"""Exact substring deduplication with fixed-block anchors.

Every document is indexed by its non-overlapping blocks of ``block`` words (the
anchors) and probed with every rolling window of that size. A window of
``window`` words that two documents share contains, wherever it lies, a whole
anchor of the first of them if ``2 * block - 1 <= window``; so the second one's
probe of it hits. Hits are extended to all windows around them, these are
compared by 64-bit hashes across the corpus, and overlapping confirmed windows
run together to maximal repeats. A word goes if a window over it also starts in
a document with a smaller id.

Two exchanges of packed hashes do this. Chunks of documents send their distinct
probes, four bytes each, to hash buckets, and get one bit back per probe: an
anchor elsewhere has it. Then they send the windows around hits, each once per
chunk, and get back the smallest document of those that an earlier chunk has.
A hot passage is therefore one entry per chunk, however often it occurs, and no
pairs of documents are formed.

A NULL or empty text has no words. NULL ids come after all others, so such
documents lose words but take none. Rows with one id are no reason to remove
words from each other. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, bucket_of, chunked, id_array, runs, shuffle_partitions, unpack_documents

MESSAGE = "bucket int, chunk int, data binary"


class _Probes:
    """Distinct block hashes of a chunk, ascending, and where they occur."""

    def __init__(self, words: Words, block: int):
        self.at, hashes = words.windows(block)
        self.order = np.argsort(hashes, kind="stable")
        ordered = hashes[self.order]
        self.first = runs(ordered)
        self.values = ordered[self.first]
        self.sizes = np.diff(np.append(self.first, len(ordered)))
        self.doc = words.doc[self.at]
        self.anchor = (self.at - words.starts[self.doc]) % block == 0


def _messages(chunk: int, buckets: int, hashes: np.ndarray, parts) -> pa.Table:
    """One row per bucket that gets something; ``parts(a, b)`` makes its data."""
    edges = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(edges))
    data = [parts(int(edges[k]), int(edges[k + 1])) for k in full]
    return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int32()), "data": pa.array(data, pa.binary())})


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)


def _blocks(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return unpack_documents(table.column("block").to_pylist())


def remove_repeats(docs: DataFrame, window: int = 13, block: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)``; kept words are joined by one space."""
    block = block or (window + 1) // 2
    if 2 * block - 1 > window:
        raise ValueError("a window must contain a whole block wherever it lies")
    parts = shuffle_partitions(docs)
    buckets = 2 * parts
    chunks = chunked(docs, 2 * parts, doc_id, text)

    def probe(table: pa.Table) -> pa.Table:
        _, _, texts = _blocks(table)
        probes = _Probes(Words(texts), block)
        if not len(probes.values):
            return _messages(0, buckets, probes.values, None)
        doc, anchor = probes.doc[probes.order], probes.anchor[probes.order]
        several = np.maximum.reduceat(doc, probes.first) != np.minimum.reduceat(doc, probes.first)
        anchored = np.logical_or.reduceat(anchor, probes.first)
        low = probes.values.astype(np.uint32)

        def data(a: int, b: int) -> bytes:
            return np.array([b - a], np.uint32).tobytes() + low[a:b].tobytes() + _bits(anchored[a:b]) + _bits(several[a:b])

        return _messages(table.column("chunk")[0].as_py(), buckets, probes.values, data)

    def hit(table: pa.Table) -> pa.Table:
        """Per probe: does an anchor have it, in another document than this one's only?"""
        rows = table.column("data").to_pylist()
        sizes = [int(np.frombuffer(d, np.uint32, 1)[0]) for d in rows]
        values = np.concatenate([np.frombuffer(d, np.uint32, n, 4) for d, n in zip(rows, sizes)])
        anchored = np.concatenate([_flags(d, n, 4 + 4 * n) for d, n in zip(rows, sizes)])
        several = np.concatenate([_flags(d, n, 4 + 4 * n + (n + 7) // 8) for d, n in zip(rows, sizes)])
        order = np.argsort(values, kind="stable")
        first = runs(values[order])
        count = np.diff(np.append(first, len(order)))
        good = np.logical_or.reduceat(anchored[order], first) & ((count > 1) | np.logical_or.reduceat(several[order], first))
        hits = np.empty(len(order), bool)
        hits[order] = np.repeat(good, count)
        ends = np.cumsum(sizes)
        data = [_bits(hits[e - n : e]) for e, n in zip(ends, sizes)]
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "data": pa.array(data, pa.binary())})

    def extend(documents: pa.Table, answers: pa.Table) -> pa.Table:
        """The windows around hits, each once with its smallest document."""
        ids, _, texts = _blocks(documents)
        words = Words(texts)
        probes = _Probes(words, block)
        got = answers.sort_by("bucket").column("data").to_pylist()
        edges = np.searchsorted(bucket_of(probes.values, buckets), np.arange(buckets + 1))
        counts = np.diff(edges)
        flags = [_flags(d, int(n)) for d, n in zip(got, counts[counts > 0])]
        hits = np.zeros(words.total + 1, np.int64)
        if flags:
            hits[probes.at[probes.order]] = np.repeat(np.concatenate(flags), probes.sizes)
        hits = np.concatenate([[0], np.cumsum(hits)])
        at, hashes = words.windows(window)
        near = hits[at + window - block + 1] > hits[at]
        at, hashes = at[near], hashes[near]
        order = np.argsort(hashes, kind="stable")
        first = runs(hashes[order])
        values = hashes[order][first]
        least = np.minimum.reduceat(ids[words.doc[at[order]]], first) if len(first) else np.zeros(0, np.int64)
        return _messages(documents.column("chunk")[0].as_py(), buckets, values, lambda a, b: _pairs(values[a:b], least[a:b])) if documents.num_rows else _messages(0, buckets, values, None)

    def earliest(table: pa.Table) -> pa.Table:
        """To each chunk: its windows that a smaller document elsewhere has, with that document."""
        got = [_unpair(d) for d in table.column("data").to_pylist()]
        values, docs_ = np.concatenate([v for v, _ in got]), np.concatenate([d for _, d in got])
        sender = np.repeat(np.array(table.column("chunk").to_pylist()), [len(v) for v, _ in got])
        order = np.argsort(values, kind="stable")
        first = runs(values[order])
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(docs_[order], first), np.diff(np.append(first, len(order))))
        later = np.flatnonzero(least < docs_)
        later = later[np.argsort(sender[later], kind="stable")]
        first = runs(sender[later])
        names, data = [], []
        for a, b in zip(first, np.append(first[1:], len(later))):
            names.append(int(sender[later[a]]))
            data.append(_pairs(values[later[a:b]], least[later[a:b]]))
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(names), pa.int32()), "chunk": pa.array(names, pa.int32()), "data": pa.array(data, pa.binary())})

    def keep(documents: pa.Table, answers: pa.Table) -> pa.Table:
        ids, known, texts = _blocks(documents)
        words = Words(texts)
        at, hashes = words.windows(window)
        mine = ids[words.doc[at]]
        order = np.argsort(hashes, kind="stable")
        first = runs(hashes[order])
        values = hashes[order][first]
        least = np.minimum.reduceat(mine[order], first) if len(first) else np.zeros(0, np.int64)
        for data in answers.column("data").to_pylist():
            other, smaller = _unpair(data)
            place = np.searchsorted(values, other)
            least[place] = np.minimum(least[place], smaller)
        repeated = np.zeros(len(at), bool)
        repeated[order] = np.repeat(least, np.diff(np.append(first, len(order)))) < mine[order]
        edges = np.zeros(words.total + 1, np.int64)
        np.add.at(edges, at[repeated], 1)
        np.add.at(edges, np.minimum(at[repeated] + window, words.total), -1)
        gone = np.cumsum(edges[:-1]) > 0
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.starts) * (words.counts > 0) if len(texts) else np.zeros(0, np.int64)
        kept = []
        for i, body in enumerate(words.words):
            if removed[i]:
                body = [w for w, g in zip(body, gone[words.starts[i] : words.ends[i]].tolist()) if not g]
            kept.append(b" ".join(body))
        return pa.table({"doc_id": id_array(ids, known), "n_words": pa.array(words.counts), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    hits = chunks.groupBy("chunk").applyInArrow(probe, MESSAGE).groupBy("bucket").applyInArrow(hit, MESSAGE)
    around = chunks.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, MESSAGE)
    first = around.groupBy("bucket").applyInArrow(earliest, MESSAGE)
    out = chunks.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(keep, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def _pairs(values: np.ndarray, docs: np.ndarray) -> bytes:
    """Hashes, then documents relative to the smallest, in four bytes where they fit."""
    base = int(docs.min())
    wide = int(docs.max()) - base > 0xFFFFFFFF
    offset = (docs.astype(np.uint64) - np.uint64(base & (2**64 - 1))).astype(np.uint64 if wide else np.uint32)
    return np.array([len(values), base, wide], np.int64).tobytes() + values.tobytes() + offset.tobytes()


def _unpair(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, base, wide = np.frombuffer(data, np.int64, 3).tolist()
    offset = np.frombuffer(data, np.uint64 if wide else np.uint32, n, 24 + 8 * n).astype(np.uint64)
    return np.frombuffer(data, np.uint64, n, 24), (offset + np.uint64(base & (2**64 - 1))).view(np.int64)
