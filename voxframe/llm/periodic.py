"""Maximal periodic runs of words, by tiles of each period octave.

A run is a stretch of words with smallest period ``q`` and at least
``max(least, power * q)`` words that no neighbour extends. Periods are searched
octave by octave. For each, a document is exploded into overlapping tiles, a
few periods long each, and the tiles are dealt over the cluster and solved one
by one: at boundaries every ``spacing`` words, Z-functions of the words ahead
and of the reversed words behind tell, for all periods of the octave at once,
how far the text goes on equal to itself. The intervals that a run leaves in
several tiles overlap by more than a period; shuffled by document and period,
overlapping ones are stitched, and of equal intervals the smallest period stays.

Only tiles that can touch a run are made. In a run every window of ``gram``
words (16 for the defaults) comes again within one period, so the next equal
window of its document is that near for a whole stretch of places; a tile
without such a stretch holds no run. The windows are compared by 64-bit hashes,
which may let a tile through in vain but keep none out. Tile words are numbered
by their 64-bit hashes.

A very long document spreads over tasks tile by tile, and a group here is the
fragments of one document and period. Rows repeated in full are solved once.
NULL and empty texts have no words and no runs; NULL ids stay. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.skew import attach
from ..session import cut_lineage
from .common import Words, id_array, mix, rolling, shuffle_partitions, text_bytes

LEAST, POWER, TILE = 24, 3, 2048
BLOCK_BYTES = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
FAR = np.iinfo(np.int64).max


class Octaves:
    """The period classes and what follows for each from the least length and power of a run."""

    def __init__(self, least: int = LEAST, power: int = POWER, tile: int = TILE):
        if power < 2 or least < 2:
            raise ValueError("runs must hold two words and two periods at least")
        self.least, self.power, self.tile = least, power, tile
        # periods below ``base`` are one class, as runs have ``least`` words anyway
        self.base = 1 << (max(1, least // 3).bit_length() - 1)
        self.gram = min(self._again(p) for p in range(1, least + 1))

    def _again(self, period: int) -> int:
        """Words of a run that come again one period later, at least."""
        return max(self.least - period, (self.power - 1) * period)

    def classes(self, longest: int) -> Iterator[tuple[int, int, int]]:
        """``(spacing, low, high)``: periods from ``low`` to below ``high`` that a text of ``longest`` words can have."""
        if self.base > 1 and longest >= self.least:
            yield self.base, 1, self.base
        low = self.base
        while max(self.least, self.power * low) <= longest:
            yield low, low, 2 * low
            low *= 2

    def stride(self, spacing: int) -> int:
        return spacing * max(4, -(-self.tile // spacing))

    def stretch(self, low: int, high: int) -> int:
        """Places in a row whose window comes again, at least."""
        return min(self._again(p) for p in {low, high - 1, *range(low, min(high, self.least + 1))}) - self.gram + 1


def _tiles(words: Words, octaves: Octaves) -> dict[tuple[int, int, int], tuple[int, int]]:
    """``(document, spacing, tile)`` to first and last place of the tiles that may touch a run."""
    at, grams = words.windows(octaves.gram)
    if not len(at):
        return {}
    grams = grams ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(grams, kind="stable")
    equal = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    if not len(equal):
        return {}
    ahead = np.full(words.total + 1, FAR)
    ahead[at[order[equal]]] = at[order[equal + 1]] - at[order[equal]]
    found = {}
    for spacing, low, high in octaves.classes(int(words.counts.max())):
        edges = np.diff((ahead < high).astype(np.int8), prepend=0)
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        stride = octaves.stride(spacing)
        for a, b in zip(first, last):
            if b - a < octaves.stretch(low, high):
                continue
            doc = int(words.doc[a])
            start, n = int(words.starts[doc]), int(words.counts[doc])
            end = min(n, int(b) - start + high + octaves.gram)
            for tile in range((int(a) - start) // stride, (end - 1) // stride + 1):
                found[doc, spacing, tile] = (start + tile * stride, start + min(n, (tile + 1) * stride + 4 * spacing))
    return found


def z_values(s: list[int], last: int) -> list[int]:
    """How many items from each place up to ``last`` on equal those from the start."""
    n, z, left, right = len(s), [0] * (last + 1), 0, 0
    for i in range(1, last + 1):
        j = i
        if i < right:
            known = z[i - left]
            if known < right - i:
                z[i] = known
                continue
            j = right
        while j < n and s[j] == s[j - i]:
            j += 1
        z[i], left, right = j - i, i, j
    return z


def fragments(w: list[int], spacing: int, low: int, high: int, base: int = 1) -> list[tuple[int, int, int]]:
    """``(period, start, end)``: stretches of a tile with a period of the class, two periods and two ``base`` long at least.

    Around a boundary the words two spacings behind and four ahead are compared;
    what neighbouring boundaries see of one stretch overlaps by a period.
    """
    n, open_, done = len(w), {}, []
    for b in range(0, n - low + 1, spacing):
        left, right, reach = max(0, b - 2 * spacing), min(n, b + 4 * spacing), min(n, b + high - 1)
        ahead = w[b:right]
        forward = z_values(ahead, min(high - 1, len(ahead) - 1)) if len(ahead) > low else []
        behind = w[left:b][::-1]
        joined = behind + [-1] + w[left:reach][::-1]
        back = z_values(joined, len(behind) + 1 + reach - b - low) if behind else []
        for p in range(low, min(high - 1, n - b) + 1):
            more = forward[p] if p < len(forward) else 0
            less = back[len(behind) + 1 + reach - b - p] if behind else 0
            if less + p + more < max(2 * p, 2 * base):
                continue
            start, end = b - less, b + p + more
            known = open_.get(p)
            if known and start <= known[1] - p:
                known[0], known[1] = min(known[0], start), max(known[1], end)
            else:
                if known:
                    done.append((p, *known))
                open_[p] = [start, end]
    return done + [(p, *known) for p, known in open_.items()]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that a run holds after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [w for w, gone in zip(words, (np.cumsum(edges[:-1]) > 0).tolist()) if not gone]


def _blocks(batches, column: int):
    """Slices of the batches with about a megabyte of text each."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64) + 64)
        cuts = np.append(np.flatnonzero(np.diff(sizes // BLOCK_BYTES)) + 1, len(sizes)) if len(sizes) else []
        at = 0
        for cut in cuts:
            yield batch.slice(at, int(cut) - at)
            at = int(cut)
    pa.default_memory_pool().release_unused()


def find_runs(docs: DataFrame, least: int = LEAST, power: int = POWER, tile: int = TILE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs, kept_text)``: all runs by start, then period, and the words left when each run keeps one period."""
    octaves = Octaves(least, power, tile)
    parts = shuffle_partitions(docs)
    number, body = F.col(doc_id).cast("bigint"), text_bytes(text)
    key = F.concat(F.hex(F.xxhash64(number, body)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), number, body)))
    rows = docs.select(key.alias("key"), number.alias("id"), body.alias("body"))
    tile_type = pa.struct([("spacing", pa.int64()), ("tile", pa.int64()), ("data", pa.binary())])

    def suspects(batches):
        zstd = zstandard.ZstdCompressor(level=3)
        for batch in _blocks(batches, 2):
            words = Words(batch.column(2).to_pylist())
            made: dict[int, list] = {}
            for (doc, spacing, number), (a, b) in _tiles(words, octaves).items():
                local = np.unique(words.hashes[a:b], return_inverse=True)[1].astype(np.int32)
                made.setdefault(doc, []).append({"spacing": spacing, "tile": number, "data": zstd.compress(local.tobytes())})
            names = sorted(made)
            picked = batch.take(pa.array(names, pa.int64()))
            texts = [zstd.compress(b" ".join(words.words[d])) for d in names]
            yield pa.RecordBatch.from_arrays(
                [picked.column(0), picked.column(1), pa.array(range(len(names)), pa.int64()), pa.array(texts, pa.binary()), pa.array([made[d] for d in names], pa.list_(tile_type))],
                names=["key", "id", "place", "words", "tiles"])

    def clear(batches):
        for batch in _blocks(batches, 2):
            words = Words(batch.column(2).to_pylist())
            held = {doc for doc, _, _ in _tiles(words, octaves)}
            free = np.array([d for d in range(batch.num_rows) if d not in held], np.int64)
            picked = batch.column(1).take(pa.array(free))
            yield pa.RecordBatch.from_arrays(
                [picked, pa.array(words.counts[free]), pa.array([b" ".join(words.words[d]) for d in free], pa.binary())], names=["doc_id", "n_words", "kept"])

    def solve(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            keys, found = [], []
            for name, spacing, number, low, data in zip(*[batch.column(c).to_pylist() for c in ("key", "spacing", "tile", "low", "data")]):
                w = np.frombuffer(unzip.decompress(data), np.int32).tolist()
                at = number * octaves.stride(spacing)
                got = fragments(w, spacing, low, octaves.base if low < spacing else 2 * low, octaves.base)
                keys += [name] * len(got)
                found += [(p, at + a, at + b) for p, a, b in got]
            columns = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array(columns[:, c]) for c in range(3)]], names=["key", "period", "start", "end"])

    def finish(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in _blocks(batches, 1):
            counts, kept = [], []
            for data, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = unzip.decompress(data).split()
                counts.append(len(words))
                kept.append(b" ".join(collapse(words, [(r["start"], r["length"], r["period"]) for r in runs or []])))
            runs = pa.array([r or [] for r in batch.column(2).to_pylist()], batch.column(2).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), runs, pa.array(kept, pa.binary())], names=["doc_id", "n_words", "runs", "kept"])

    held = cut_lineage(rows.mapInArrow(suspects, "key string, id bigint, place bigint, words binary, tiles array<struct<spacing: bigint, tile: bigint, data: binary>>"))
    # the class below the base shares the spacing of the next one: one tile, two searches
    lows = F.when((F.col("t.spacing") == octaves.base) & F.lit(octaves.base > 1), F.array(F.lit(1), F.lit(octaves.base))).otherwise(F.array(F.col("t.spacing")))
    tiles = held.select("key", F.explode("tiles").alias("t")).select("key", "t.*", F.explode(lows.cast("array<bigint>")).alias("low"))
    dealt = tiles.repartition(parts, "key", "spacing", "tile", "low").dropDuplicates(["key", "spacing", "tile", "low"])
    seen = dealt.mapInArrow(solve, "key string, period bigint, start bigint, end bigint")
    runs = stitch(seen, least, power).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    named = runs.select("key", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    joined = attach(held.select("key", "id", "place", "words"), named, ["key"], ["place"], "left").select(F.col("id").alias("doc_id"), "words", "runs")
    ended = joined.mapInArrow(finish, f"doc_id bigint, n_words bigint, runs {RUNS}, kept binary")
    free = rows.mapInArrow(clear, "doc_id bigint, n_words bigint, kept binary").select("doc_id", "n_words", F.array().cast(RUNS).alias("runs"), "kept")
    return ended.unionByName(free).select("doc_id", "n_words", "runs", F.col("kept").cast("string").alias("kept_text"))


def stitch(seen: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """``(key, start, length, period)``: the runs that the fragments ``key, period, start, end`` make up."""
    order = W.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = F.coalesce((F.col("start") > reach - F.col("period")).cast("int"), F.lit(1))
    numbered = seen.withColumn("opened", opened).withColumn("run", F.sum("opened").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = numbered.groupBy("key", "period", "run").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    long = whole.where((F.col("length") >= least) & (F.col("length") >= power * F.col("period")))
    return long.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
