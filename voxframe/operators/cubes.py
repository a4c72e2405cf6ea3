"""Sparse masks as small dense cubes with a halo of one voxel.

Voxel rows are dealt to cubes of ``BLOCK**3`` cells; one that lies on a cube's face
also goes to the cube beyond it, so a single shuffle of little more than the mask
brings each cube all it needs to look one step across its border. Inside, the flags
of a cell are bits of one byte and all cubes of a batch are handled together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import map_sorted_groups

BLOCK = 16
CELLS = 4_000_000
# cube coordinates are packed into one number, each shifted to be positive
SPAN = 1 << 19


def with_halo(mask: DataFrame, flags: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``(case_id, bx, by, bz, cell, bits)``: each voxel in its cube and on the rim of the cubes that its face touches."""
    side = block + 2
    home = {a: F.floor(F.col(a) / block).cast("int") for a in "xyz"}
    inner = {a: F.pmod(F.col(a), F.lit(block)).cast("int") + 1 for a in "xyz"}

    def place(axis: str | None = None, step: int = 0):
        cube = [(home[a] + step if a == axis else home[a]).alias(f"b{a}") for a in "xyz"]
        x, y, z = (F.lit(0 if step > 0 else side - 1) if a == axis else inner[a] for a in "xyz")
        return F.struct(*cube, ((x * side + y) * side + z).alias("cell"))

    rims = [F.when(inner[a] == (1 if step < 0 else block), place(a, step)) for a in "xyz" for step in (-1, 1)]
    bits = sum((F.when(F.col(f) == 1, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))
    places = F.explode(F.filter(F.array(place(), *rims), lambda p: p.isNotNull()))
    return mask.select("case_id", bits.cast("tinyint").alias("bits"), places.alias("p")).select("case_id", "p.*", "bits")


def map_cubes(mask: DataFrame, flags: Sequence[str], schema: str, fn: Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]],
              block: int = BLOCK) -> DataFrame:
    """``fn(case, cube, core, surface)`` for many cubes at once.

    ``cube`` has a row of three coordinates per cube, ``core`` and ``surface`` the bits of its cells: which flags a
    cell has, and which it has while a face neighbour has not. Beyond the border is background.
    """
    side = block + 2
    most = max(1, CELLS // side**3)

    def run(table: pa.Table, starts: np.ndarray):
        cell, bits = table.column("cell").to_numpy(), table.column("bits").to_numpy().view(np.uint8)
        # a cube that got a rim and nothing of its own has no surface
        own = np.logical_and.reduce([(at > 0) & (at <= block) for at in (cell // side**2, cell // side % side, cell % side)])
        used = np.logical_or.reduceat(own, starts)
        sizes = np.diff(np.append(starts, table.num_rows))
        kept = np.repeat(used, sizes)
        cell, bits, starts, sizes = cell[kept], bits[kept], starts[used], sizes[used]
        ends = np.cumsum(sizes)
        names = table.column("case_id").combine_chunks() if table.column("case_id").num_chunks != 1 else table.column("case_id").chunk(0)
        cubes = np.stack([table.column(f"b{a}").to_numpy()[starts] for a in "xyz"], axis=1)
        for low in range(0, len(starts), most):
            high = min(len(starts), low + most)
            first, last = int(ends[low] - sizes[low]), int(ends[high - 1])
            dense = np.zeros((high - low, side**3), np.uint8)
            dense[np.repeat(np.arange(high - low), sizes[low:high]), cell[first:last]] = bits[first:last]
            v = dense.reshape(-1, side, side, side)
            core = v[:, 1:-1, 1:-1, 1:-1]
            around = v[:, :-2, 1:-1, 1:-1] & v[:, 2:, 1:-1, 1:-1] & v[:, 1:-1, :-2, 1:-1] & v[:, 1:-1, 2:, 1:-1] & v[:, 1:-1, 1:-1, :-2] & v[:, 1:-1, 1:-1, 2:]
            shape = (high - low, block**3)
            yield from fn(names.take(pa.array(starts[low:high])), cubes[low:high], core.reshape(shape), (core & ~around).reshape(shape))

    return map_sorted_groups(with_halo(mask, flags, block), ["case_id", "bx", "by", "bz"], [], schema, run, mask)


def coordinates(cube: np.ndarray, cell: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Voxel coordinates of cells, given the cube coordinates of each."""
    inside = (cell // (block * block), cell // block % block, cell % block)
    return tuple((cube[..., i] * block + inside[i]).astype(np.int32) for i in range(3))


def pack(cube: np.ndarray) -> np.ndarray:
    """One number for each cube."""
    c = cube.astype(np.int64) + SPAN
    return (c[:, 0] << 40) | (c[:, 1] << 20) | c[:, 2]


def unpack(number: int) -> np.ndarray:
    return np.array([(number >> shift & 0xFFFFF) - SPAN for shift in (40, 20, 0)], np.int64)
