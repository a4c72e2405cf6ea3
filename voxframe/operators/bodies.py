"""The body in a volume, found on run-length masks.

Each slice array becomes the runs of bright pixels in its lines. Runs that overlap in
neighbouring lines make up the components of the slice, and one short record per
component (size and extent) is all that later steps add up. To join components across
slices, blocks of consecutive slices meet in one task, the first slice of a block also
in the block before, and there runs that overlap in the same line of two slices link
their components. No pixel ever becomes a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .batches import map_sorted_groups
from .components import join_pairs, resolve_graph
from .geometry import boxes_of
from .skew import attach

BODY_ABOVE = -500.0
SLICES = 32
# room for the slice number below the place of a component's first pixel in its plane
DEPTH_BITS = 20


def runs_of(bright: np.ndarray) -> np.ndarray:
    """``(line, start, end)`` of every run of true pixels in a plane, in raster order."""
    edges = np.diff(bright.astype(np.int8), axis=1, prepend=0, append=0)
    line, start = np.nonzero(edges == 1)
    return np.stack([line, start, np.nonzero(edges == -1)[1]], axis=1).astype(np.int32)


def overlaps(a: np.ndarray, b: np.ndarray, down: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of runs ``a`` and ``b`` that share a column, ``b`` lying ``down`` lines below."""
    step = width + 1
    line = (a[:, 0].astype(np.int64) + down) * step
    first = np.searchsorted(b[:, 0].astype(np.int64) * step + b[:, 2], line + a[:, 1], side="right")
    last = np.searchsorted(b[:, 0].astype(np.int64) * step + b[:, 1], line + a[:, 2], side="left")
    n = np.maximum(0, last - first)
    i = np.repeat(np.arange(len(a)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def slice_components(slices: DataFrame, above: float = BODY_ABOVE) -> DataFrame:
    """One row per slice: its runs, each with the number of its component, and a record per component.

    A component is named by its first pixel in raster order and the slice. NaN and missing pixels are not bright.
    """
    kind = slices.schema["case_id"].dataType.simpleString()
    fields = [("label", pa.int64()), ("size", pa.int64()), *[(f"{a}{n}", pa.int32()) for a in "xy" for n in "01"]]
    record = pa.struct(fields)

    def find(batches):
        for batch in batches:
            runs, parts = [], []
            for z, width, pixels in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                values = pixels.values.to_numpy(zero_copy_only=False) if pixels.is_valid else np.zeros(0)
                made = runs_of(np.asarray(values, np.float64).reshape(-1, width) > above)
                root = join_pairs(len(made), *overlaps(made, made, 1, width)) if len(made) else np.zeros(0, np.int64)
                first, number = np.unique(root, return_inverse=True)
                size, box = np.zeros(len(first), np.int64), np.zeros((len(first), 4), np.int32)
                np.add.at(size, number, made[:, 2] - made[:, 1])
                for i, (column, less, f) in enumerate(((0, 0, np.minimum), (0, 0, np.maximum), (1, 0, np.minimum), (2, 1, np.maximum))):
                    box[:, i] = made[first, column] - less
                    f.at(box[:, i], number, made[:, column] - less)
                label = ((made[first, 0].astype(np.int64) * width + made[first, 1]) << DEPTH_BITS) | z
                runs.append(np.concatenate([made, number[:, None].astype(np.int32)], axis=1).tobytes())
                parts.append([dict(zip((f for f, _ in fields), row)) for row in zip(label.tolist(), size.tolist(), *box.T.tolist())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(runs, pa.binary()), pa.array(parts, pa.list_(record))], names=["case_id", "slice_idx", "width", "runs", "parts"])

    rows = slices.select("case_id", F.col("slice_idx").cast("int"), F.col("width").cast("int"), F.col("pixels").cast("array<double>"))
    struct = "struct<label: bigint, size: bigint, x0: int, x1: int, y0: int, y1: int>"
    return rows.mapInArrow(find, f"case_id {kind}, slice_idx int, width int, runs binary, parts array<{struct}>")


def links_between_slices(found: DataFrame, depth: int = SLICES) -> DataFrame:
    """``(case_id, a, b)``: labels of components that touch in neighbouring slices."""
    kind = found.schema["case_id"].dataType.simpleString()
    own = F.floor(F.col("slice_idx") / depth).cast("int")
    blocks = F.when(F.col("slice_idx") % depth == 0, F.array(own, own - 1)).otherwise(F.array(own))
    rows = found.select("case_id", F.explode(blocks).alias("block"), "slice_idx", "width", "runs", F.col("parts.label").alias("labels"))

    def link(table: pa.Table, starts: np.ndarray):
        ends = np.append(starts[1:], table.num_rows)
        place, width = table.column("slice_idx").to_numpy(), table.column("width").to_numpy()
        runs, labels = table.column("runs"), table.column("labels")
        case, upper, lower = [], [], []
        for start, end in zip(starts.tolist(), ends.tolist()):
            before = None
            for row in range(start, end):
                here = np.frombuffer(runs[row].as_py(), np.int32).reshape(-1, 4), np.array(labels[row].as_py(), np.int64)
                if before is not None and place[row] == place[row - 1] + 1 and len(here[0]) and len(before[0]):
                    i, j = overlaps(before[0], here[0], 0, int(width[row]))
                    pairs = np.unique(np.stack([before[1][before[0][i, 3]], here[1][here[0][j, 3]]], axis=1), axis=0)
                    case += [row] * len(pairs)
                    upper.append(pairs[:, 0])
                    lower.append(pairs[:, 1])
                before = here
        if case:
            yield pa.RecordBatch.from_arrays(
                [table.column("case_id").take(pa.array(case)).combine_chunks(), pa.array(np.concatenate(upper)), pa.array(np.concatenate(lower))], names=["case_id", "a", "b"])

    return map_sorted_groups(rows, ["case_id", "block"], ["slice_idx"], f"case_id {kind}, a bigint, b bigint", link, found)


def body_components(slices: DataFrame, above: float = BODY_ABOVE) -> DataFrame:
    """``(case_id, label, size, x0, x1, y0, y1, z0, z1)`` for every bright component of a volume."""
    found = cut_lineage(slice_components(slices, above))
    parts = found.select("case_id", F.col("slice_idx").alias("z"), F.explode("parts").alias("p")).select("case_id", "z", "p.*")
    roots = resolve_graph(links_between_slices(found))
    if roots is not None:
        named = attach(parts, roots, ["case_id", "label"], ["z"], "left")
        parts = named.withColumn("label", F.coalesce("root", "label"))
    ends = [f(c).alias(c) for c, f in (("x0", F.min), ("x1", F.max), ("y0", F.min), ("y1", F.max))]
    return parts.groupBy("case_id", "label").agg(F.sum("size").alias("size"), *ends, F.min("z").alias("z0"), F.max("z").alias("z1"))


def body_box(slices: DataFrame, cases: DataFrame, margin: int = 5, above: float = BODY_ABOVE) -> DataFrame:
    """Half-open box around the largest bright component of slice arrays; see :func:`geometry.body_bbox`."""
    return boxes_of(body_components(slices, above), cases, margin)

