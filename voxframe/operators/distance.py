"""Surface distances between sparse masks, exact and anisotropic.

The surface voxels of a case lie in small cubes, and one short row per cube with the
box around its voxels makes up the block index. Between two boxes there is a least and
a greatest distance, so the nearest target of everything in a cube lies in cubes whose
least distance is no more than the smallest greatest one. Only these are sent to the
cube, as two bytes a voxel, and searched from the nearest on until the distances found
are below the next bound. What moves grows with the surfaces; no volume is filled and
no row for a pair of voxels is formed.

The index of one case is searched in one task. Its size is bounded by the shape of the
volume, 17,408 cubes for 512 x 512 x 271.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .batches import map_sorted_groups
from .cubes import BLOCK, coordinates, map_cubes, pack, unpack
from .skew import attach, exact_quantiles

EMPTY_PENALTY_MM = 100.0
# bounds are widened by this share against rounding
SLACK = 1e-9

_MAX_CELLS = 4_000_000
_BOX = ("x0", "x1", "y0", "y1", "z0", "z1")


def _surface_blocks(mask: DataFrame, preds: Sequence[str], truth: str) -> DataFrame:
    """One row per cube and set: what lies on ``source`` but outside ``target`` and asks for it, or, without ``source``, the surface of ``target``.

    ``zeros`` counts the surface voxels of ``source`` inside ``target``.
    """
    flags = [*preds, truth]
    bit = {f: np.uint8(1 << i) for i, f in enumerate(flags)}
    kind = mask.schema["case_id"].dataType.simpleString()
    sets = [(None, f) for f in flags] + [pair for p in preds for pair in ((p, truth), (truth, p))]
    schema = f"case_id {kind}, source string, target string, block bigint, zeros bigint, cells binary, " + ", ".join(f"{c} int" for c in _BOX)

    def rows(case: pa.Array, cube: np.ndarray, core: np.ndarray, skin: np.ndarray):
        number = pack(cube)
        for source, target in sets:
            chosen = (skin & bit[source or target]) > 0
            zeros = np.zeros(len(cube), np.int64)
            if source:
                inside = chosen & ((core & bit[target]) > 0)
                zeros, chosen = inside.sum(axis=1), chosen & ~inside
            at, cell = np.nonzero(chosen)
            counts = np.bincount(at, minlength=len(cube))
            used = np.flatnonzero((counts > 0) | (zeros > 0))
            if not len(used):
                continue
            ends = np.cumsum(counts)
            box = np.zeros((len(cube), 6), np.int32)
            full = np.flatnonzero(counts)
            if len(full):
                for i, axis in enumerate(coordinates(cube[at], cell)):
                    box[full, 2 * i] = np.minimum.reduceat(axis, (ends - counts)[full])
                    box[full, 2 * i + 1] = np.maximum.reduceat(axis, (ends - counts)[full])
            packed = cell.astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [case.take(pa.array(used)), pa.array([source] * len(used), pa.string()), pa.array([target] * len(used), pa.string()), pa.array(number[used]),
                 pa.array(zeros[used].astype(np.int64)), pa.array([packed[ends[i] - counts[i] : ends[i]].tobytes() for i in used], pa.binary()), *[pa.array(box[used, i]) for i in range(6)]],
                names=["case_id", "source", "target", "block", "zeros", "cells", *_BOX])

    return map_cubes(mask, flags, schema, rows)


def _candidates(index: DataFrame, mask: DataFrame) -> DataFrame:
    """``(case_id, source, target, block, other, least)``: the target cubes that each asking cube must look into."""
    kind = index.schema["case_id"].dataType.simpleString()

    def bound(table: pa.Table, starts: np.ndarray):
        ends = np.append(starts[1:], table.num_rows)
        asks = table.column("source").is_valid().to_numpy()
        box = np.stack([table.column(c).to_numpy() for c in _BOX], axis=1).astype(np.float64)
        step = np.stack([table.column(c).to_numpy() for c in ("sx", "sy", "sz")], axis=1)
        number = table.column("block").to_numpy()
        asking, other, least = [], [], []
        for start, end in zip(starts, ends):
            queries, targets = start + np.flatnonzero(asks[start:end]), start + np.flatnonzero(~asks[start:end])
            if not len(queries) or not len(targets):
                continue
            rows = max(1, _MAX_CELLS // len(targets))
            for low in range(0, len(queries), rows):
                part = queries[low : low + rows]
                near, far = np.zeros((len(part), len(targets))), np.zeros((len(part), len(targets)))
                for i in range(3):
                    q0, q1 = box[part, 2 * i][:, None], box[part, 2 * i + 1][:, None]
                    t0, t1 = box[targets, 2 * i][None, :], box[targets, 2 * i + 1][None, :]
                    near += (np.maximum(0, np.maximum(t0 - q1, q0 - t1)) * step[start, i]) ** 2
                    far += (np.maximum(t1 - q0, q1 - t0) * step[start, i]) ** 2
                a, b = np.nonzero(near <= far.min(axis=1, keepdims=True) * (1 + SLACK))
                asking.append(part[a])
                other.append(targets[b])
                least.append(near[a, b])
        if asking:
            rows_, others = np.concatenate(asking), np.concatenate(other)
            picked = table.select(["case_id", "source", "target", "block"]).take(pa.array(rows_))
            yield from picked.append_column("other", pa.array(number[others])).append_column("least", pa.array(np.concatenate(least))).to_batches()

    return map_sorted_groups(index, ["case_id", "target"], [], f"case_id {kind}, source string, target string, block bigint, other bigint, least double", bound, mask)


def _nearest(table: pa.Table, starts: np.ndarray):
    """The first row of a group asks, the others hold targets by rising ``least``, all squared."""
    ends = np.append(starts[1:], table.num_rows)
    cells, other, block, least = (table.column(c) for c in ("cells", "other", "block", "least"))
    bounds, step = least.to_numpy(), np.stack([table.column(c).to_numpy() for c in ("sx", "sy", "sz")], axis=1)

    def voxels(row: int, number: int) -> np.ndarray:
        return np.stack(coordinates(unpack(number), np.frombuffer(cells[row].as_py(), np.uint16).astype(np.int64)))

    taken, found = [], []
    for start, end in zip(starts.tolist(), ends.tolist()):
        if bounds[start] >= 0 or end == start + 1:
            continue
        asked = voxels(start, block[start].as_py())
        best = np.full(asked.shape[1], np.inf)
        for row in range(start + 1, end):
            open_ = np.flatnonzero(best > bounds[row] * (1 - SLACK))
            if not len(open_):
                break
            held = voxels(row, other[row].as_py())
            rows = max(1, _MAX_CELLS // held.shape[1])
            for low in range(0, len(open_), rows):
                part = open_[low : low + rows]
                square = np.zeros((len(part), held.shape[1]))
                for i in range(3):  # axis by axis, without an array of three numbers a pair
                    gap = (asked[i, part][:, None] - held[i][None, :]) * step[start, i]
                    gap *= gap
                    square += gap
                best[part] = np.minimum(best[part], square.min(axis=1))
        taken += [start] * len(best)
        found.append(np.sqrt(best))
    if taken:
        out = table.select(["case_id", "source", "target"]).take(pa.array(taken)).append_column("distance", pa.array(np.concatenate(found)))
        yield from out.to_batches()


def variant_distances(mask: DataFrame, spacing: DataFrame, preds: Sequence[str] = ("pred",), truth: str = "gt") -> DataFrame:
    """``(case_id, variant, direction, distance)`` between each mask of ``preds`` and ``truth``, for all variants in one pass.

    A row for every surface voxel, both directions: 0 inside the other mask, else the distance to its
    nearest voxel, which lies on its surface. A mask that is empty gives no rows. ``spacing`` is one
    row ``(case_id, sx, sy, sz)`` per case.
    """
    blocks = cut_lineage(_surface_blocks(mask, preds, truth))  # read by the index, the targets and the queries
    steps = spacing.select("case_id", "sx", "sy", "sz")
    # a cube that only has zeros does not ask
    index = blocks.where("octet_length(cells) > 0").select("case_id", "source", "target", "block", *_BOX)
    pairs = _candidates(attach(index, steps, ["case_id"], ["block"]), blocks)
    held = blocks.where("source is null").select("case_id", "target", F.col("block").alias("other"), "cells")
    asked = blocks.where("source is not null and octet_length(cells) > 0").select("case_id", "source", "target", "block", F.lit(-1.0).alias("least"), "cells")
    meeting = attach(pairs.join(held, ["case_id", "target", "other"]).unionByName(asked, allowMissingColumns=True), steps, ["case_id"], ["block"])
    kind = mask.schema["case_id"].dataType.simpleString()
    outside = map_sorted_groups(meeting, ["case_id", "source", "target", "block"], ["least"], f"case_id {kind}, source string, target string, distance double", _nearest, blocks)
    inside = blocks.where("zeros > 0").select("case_id", "source", "target", F.explode(F.array_repeat(F.lit(0.0), F.col("zeros").cast("int"))).alias("distance"))
    forth = F.col("target") == truth
    named = outside.unionByName(inside).select(
        "case_id", F.when(forth, F.col("source")).otherwise(F.col("target")).alias("variant"), F.when(forth, "p2g").otherwise("g2p").alias("direction"), "distance")
    return cut_lineage(named)


def surface_distances(mask: DataFrame, spacing: DataFrame) -> DataFrame:
    """``(case_id, direction, distance)`` for every surface voxel of ``pred`` and ``gt``; see :func:`variant_distances`."""
    return variant_distances(mask, spacing).drop("variant")


def hd95(distances: DataFrame, cases: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """95th percentile of the pooled distances; 100 mm when a mask is empty."""
    pooled = exact_quantiles(distances, keys, "distance", {"hd95_3d": 0.95})
    return cases.select(*keys).join(pooled, list(keys), "left").fillna(EMPTY_PENALTY_MM, ["hd95_3d"])


def asd(distances: DataFrame, cases: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Mean of the two directed means; 100 mm when a mask is empty."""
    means = distances.groupBy(*keys).agg(
        F.avg(F.when(F.col("direction") == "p2g", F.col("distance"))).alias("_p"),
        F.avg(F.when(F.col("direction") == "g2p", F.col("distance"))).alias("_g"),
    ).select(*keys, ((F.col("_p") + F.col("_g")) / 2.0).alias("asd_3d"))
    return cases.select(*keys).join(means, list(keys), "left").fillna(EMPTY_PENALTY_MM, ["asd_3d"])
