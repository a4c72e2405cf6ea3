"""SimHash near duplicates, linked exactly by vantage-point trees.

Fingerprints within ``distance`` bits of each other are linked, and documents
reachable over links form a component. Copies share a fingerprint, so the search
runs over distinct fingerprints and never expands groups of copies.

The fingerprint is cut into ``blocks`` equal blocks: two fingerprints within
``distance`` bits are within ``radius = distance // blocks`` bits in one of
them. For each block there is a vantage-point tree. Its first two levels deal
fingerprints to shards by their exact Hamming distances to a vantage point,
where the second one depends on the first distance. By the triangle inequality
partners lie at most ``radius`` shells apart, and as distances to a vantage
point change with the parity of the distance in between, only shells of the
right parity matter; so each fingerprint visits the few shards beyond the
boundary as a guest. Inside a shard the tree goes on with vantage points taken
from its own members, prunes by the same bounds, and compares the leaves bit by
bit. A shard reports each member's lowest linked partner (a star, not pairs),
and the stars are joined to components across shards.

NULL or wordless texts have fingerprint zero and are linked like any other.
A component's id is its smallest non-NULL document id. Repeated rows each keep
their row; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..operators.components import resolve_graph
from ..session import cut_lineage
from .common import mix, text_bytes

BITS = 64
LEAF = 1 << 21  # pairs compared at once
POINT = "shard int, fp bigint, home boolean"


def simhash(text: str = "text", shingle: int = 4, seed: int = 42) -> Column:
    """64-bit fingerprint as a long: a bit is set if over half the shingle hashes have it."""

    def prints(texts: pa.Array) -> pa.Array:
        digest = xxhash.xxh64_intdigest
        out = []
        for scalar in texts:
            words = scalar.as_py().lower().split()
            if not words:
                out.append(0)
                continue
            last = max(1, len(words) - shingle + 1)
            votes = np.zeros(BITS, np.int64)
            for at in range(0, last, 65536):
                stop = min(last, at + 65536)
                hashes = np.array([digest(b" ".join(words[i : i + shingle]), seed) for i in range(at, stop)], np.uint64)
                votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out.append(int(np.packbits(2 * votes > last, bitorder="little").view(np.int64)[0]))
        pa.default_memory_pool().release_unused()
        return pa.array(out, pa.int64())

    return arrow_udf(prints, "bigint")(text_bytes(text))


def _vantage(block: int, path: np.ndarray, width: int) -> np.ndarray:
    """A fixed pseudo-random vantage point for each node."""
    return mix(np.asarray(path, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(block + 1)) & np.uint64((1 << width) - 1)


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def shards_of(fps: np.ndarray, blocks: int, distance: int) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """``(shard, index, home)`` arrays: where each fingerprint lives and where it is a guest."""
    width, radius = BITS // blocks, distance // blocks
    out, every = [], np.arange(len(fps))
    for block in range(blocks):
        part = (fps >> np.uint64(block * width)) & np.uint64((1 << width) - 1)
        first = _distance(part, _vantage(block, 0, width))
        for step in range(radius + 1):  # the lower partner of a pair goes up
            shell = first + step
            second = _distance(part, _vantage(block, shell + 1, width))
            for turn in range(-radius, radius + 1):
                if (step - turn) % 2 or (step == 0 and turn < 0):
                    continue
                inner = second + turn
                there = (shell <= width) & (inner >= 0) & (inner <= width)
                shard = (block * (width + 1) + shell) * (width + 1) + inner
                out.append((shard[there], every[there], step == 0 and turn == 0))
    return out


def _link(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of ``a[i]`` and ``b[i]``; the lower index becomes the root."""
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while not np.array_equal(parent[parent], parent):
            parent[:] = parent[parent]


def link_shard(fps: np.ndarray, home: np.ndarray, block: int, blocks: int, distance: int, leaf: int = LEAF) -> np.ndarray:
    """Index of the root of each member after linking all pairs with one at home."""
    width, radius = BITS // blocks, distance // blocks
    part = (fps >> np.uint64(block * width)) & np.uint64((1 << width) - 1)
    parent = np.arange(len(fps))

    def compare(queries: np.ndarray, others: np.ndarray) -> None:
        rows = max(1, leaf // max(1, len(others)))
        for at in range(0, len(queries), rows):
            q = queries[at : at + rows]
            i, j = np.nonzero(np.bitwise_count(fps[q][:, None] ^ fps[others][None, :]) <= distance)
            a, b = q[i], others[j]
            apart = parent[a] != parent[b]
            if apart.any():
                _link(parent, a[apart], b[apart])

    stack = [(np.flatnonzero(home), np.arange(len(fps)))]
    while stack:
        queries, others = stack.pop()
        if not len(queries) or not len(others):
            continue
        values = part[queries]
        if len(queries) * len(others) <= leaf or (values == values[0]).all():
            near = _distance(part[others], values[0]) <= radius if (values == values[0]).all() else slice(None)
            compare(queries, others[near])
            continue
        point = values[len(values) // 2]
        to_queries, to_others = _distance(values, point), _distance(part[others], point)
        for shell in np.unique(to_queries).tolist():  # prune what the triangle bound excludes
            stack.append((queries[to_queries == shell], others[np.abs(to_others - shell) <= radius]))
    return parent


def links(points: DataFrame, blocks: int = 4, distance: int = 4) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that connect all within ``distance`` bits."""
    width = BITS // blocks

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for shard, index, home in shards_of(fps, blocks, distance):
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(fps[index].view(np.int64)), pa.array(np.full(len(shard), home))],
                                                 names=["shard", "fp", "home"])

    def connect(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        fps = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False)
        roots = link_shard(fps, home, shard // (width + 1) ** 2, blocks, distance)
        tied = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.table({"a": fps[tied].view(np.int64), "b": fps[roots[tied]].view(np.int64)})

    dealt = points.select("fp").mapInArrow(deal, POINT)
    return dealt.groupBy("shard").applyInArrow(connect, "a bigint, b bigint")


def components(prints: DataFrame, blocks: int = 4, distance: int = 4) -> DataFrame:
    """``(fp, root)`` for every distinct fingerprint of ``prints`` (a column ``fp``)."""
    points = prints.select("fp").distinct()
    roots = resolve_graph(links(points, blocks, distance).select(F.lit(0).alias("case_id"), "a", "b"))
    if roots is None:
        return points.withColumn("root", F.col("fp"))
    named = roots.select(F.col("label").alias("fp"), "root")
    return points.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, blocks: int = 4, distance: int = 4,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp, component_id)`` for every row of ``docs``."""
    prints = cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), simhash(text, shingle, seed).alias("fp")))
    named = cut_lineage(components(prints, blocks, distance))
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(named, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "text_hash", "fp", "component_id")
