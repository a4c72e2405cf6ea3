"""Sparse masks: alignment of two masks and small per-voxel operators.

A paired mask table has one row per voxel set in either mask:
``(case_id, x, y, z, pred, gt)`` with 0/1 flags. Absent voxels are background.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import binarize
from .cubes import coordinates, map_cubes

VOXEL = ["case_id", "x", "y", "z"]

def align_masks(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Full outer alignment as a union and one grouping, so a single shuffle."""
    both = pred.select(*VOXEL, F.lit(1).alias("pred"), F.lit(0).alias("gt")).unionByName(
        truth.select(*VOXEL, F.lit(0).alias("pred"), F.lit(1).alias("gt"))
    )
    return both.groupBy(*VOXEL).agg(F.max("pred").alias("pred"), F.max("gt").alias("gt"))


def pair_from_scores(scored: DataFrame, threshold: float = 0.5, prob: str = "prob", gt: str = "gt") -> DataFrame:
    """Paired mask from voxel rows that carry a probability and a truth flag."""
    return scored.select(
        *VOXEL,
        binarize(F.col(prob), threshold).cast("int").alias("pred"),
        binarize(F.col(gt)).cast("int").alias("gt"),
    ).where("pred = 1 or gt = 1")


def raster_index(x, y, z, ny, nz):
    """Position of a voxel in row-major scan order."""
    return (F.col(x).cast("bigint") * ny + F.col(y)) * nz + F.col(z)


def surface(mask: DataFrame, flags: tuple[str, ...] = ("pred", "gt")) -> DataFrame:
    """Foreground voxels with at least one background face neighbour.

    Columns ``in_`` tell whether the voxel belongs to each mask, ``_surface`` whether
    it lies on its surface. One shuffle of the mask with the faces of its cubes.
    """
    kind = mask.schema["case_id"].dataType.simpleString()
    schema = f"case_id {kind}, x int, y int, z int, " + ", ".join([f"in_{f} int" for f in flags] + [f"{f}_surface int" for f in flags])

    def rows(case: pa.Array, cube: np.ndarray, core: np.ndarray, skin: np.ndarray):
        at, cell = np.nonzero(skin)
        columns = [case.take(pa.array(at)), *map(pa.array, coordinates(cube[at], cell))]
        for bits in (core[at, cell], skin[at, cell]):
            columns += [pa.array((bits >> i & 1).astype(np.int32)) for i in range(len(flags))]
        yield pa.RecordBatch.from_arrays(columns, names=["case_id", "x", "y", "z", *[f"in_{f}" for f in flags], *[f"{f}_surface" for f in flags]])

    return map_cubes(mask, flags, schema, rows)


def stack_slices(slices: DataFrame, depth: DataFrame, value: str, default: float = 0.0) -> DataFrame:
    """Dense 0..n-1 slices per case; gaps take ``default``, indices outside are dropped."""
    frame = depth.select("case_id", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)).alias("slice_idx"))
    return frame.join(slices.select("case_id", "slice_idx", value), ["case_id", "slice_idx"], "left").select(
        "case_id", "slice_idx", F.coalesce(value, F.lit(default)).alias(value)
    )


def slice_overlap(mask: DataFrame) -> DataFrame:
    """Per-slice counts and Dice; a slice empty in both masks scores 0, not 1."""
    per_slice = mask.groupBy("case_id", F.col("z").alias("slice_idx")).agg(
        F.sum("gt").alias("gt_count"),
        F.sum("pred").alias("pred_count"),
        F.sum(F.col("gt") * F.col("pred")).alias("overlap"),
    )
    total = F.col("gt_count") + F.col("pred_count")
    return per_slice.withColumn("dice", F.when(total > 0, F.col("overlap") * 2.0 / total).otherwise(F.lit(0.0)))


def z_profile(mask: DataFrame, depth: DataFrame) -> DataFrame:
    """Counts of both masks for every slice of the full depth."""
    per_slice = slice_overlap(mask).select("case_id", "slice_idx", "gt_count", "pred_count")
    frame = depth.select("case_id", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)).alias("slice_idx"))
    return frame.join(per_slice, ["case_id", "slice_idx"], "left").fillna(0, ["gt_count", "pred_count"])


def z_ranges(mask: DataFrame) -> DataFrame:
    """First and last slice of each mask and how many slices hold it."""
    flagged = slice_overlap(mask)
    return flagged.groupBy("case_id").agg(
        *[
            f(F.when(F.col(f"{m}_count") > 0, F.col("slice_idx"))).alias(f"{m}_{n}")
            for m in ("gt", "pred")
            for n, f in (("first", F.min), ("last", F.max), ("slices", F.count))
        ]
    )


def notable_slices(mask: DataFrame) -> DataFrame:
    """Largest truth, best match, largest miss and largest false positive per case.

    Each is left out when its maximum is not positive; ties go to the lowest slice.
    """
    s = slice_overlap(mask)
    targets = {
        "largest_truth": F.col("gt_count").cast("double"),
        "best_match": F.when(F.col("gt_count") > 0, F.col("dice")),
        "largest_miss": F.when(F.col("gt_count") > 0, (F.col("gt_count") - F.col("overlap")).cast("double")),
        "largest_false_positive": (F.col("pred_count") - F.col("overlap")).cast("double"),
    }
    long = s.select(
        "case_id",
        "slice_idx",
        F.explode(F.array(*[F.struct(F.lit(k).alias("target"), v.alias("amount")) for k, v in targets.items()])).alias("t"),
    ).select("case_id", "slice_idx", "t.target", "t.amount").where("amount > 0")
    return long.groupBy("case_id", "target").agg(
        F.max_by("slice_idx", F.struct(F.col("amount"), -F.col("slice_idx"))).alias("slice_idx"),
        F.max("amount").alias("amount"),
    )


def peak_slice(counts: DataFrame, depth: DataFrame) -> DataFrame:
    """Slice with most foreground, the middle slice when there is none."""
    top = counts.where("n_pos > 0").groupBy("case_id").agg(
        F.max_by("slice_idx", F.struct(F.col("n_pos"), -F.col("slice_idx"))).alias("_top")
    )
    return depth.join(top, "case_id", "left").select(
        "case_id", F.coalesce("_top", F.floor(F.col("n_slices") / 2).cast("int")).alias("peak_slice")
    )


def adjacency(mask: DataFrame) -> DataFrame:
    """Each pair of face neighbours once, as an equi-join on shifted coordinates."""
    steps = F.array(*[F.struct(*[F.lit(int(a == b)).alias(f"d{b}") for b in "xyz"]) for a in "xyz"])
    shifted = mask.select(*VOXEL, F.explode(steps).alias("s")).select(
        *VOXEL, *[(F.col(a) + F.col(f"s.d{a}")).alias(f"n{a}") for a in "xyz"]
    )
    other = mask.select("case_id", *[F.col(a).alias(f"n{a}") for a in "xyz"])
    return shifted.join(other, ["case_id", "nx", "ny", "nz"]).select(*VOXEL, "nx", "ny", "nz")
