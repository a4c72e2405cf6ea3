"""Rigid geometry on sparse voxels: coordinate projections, no voxel shuffle
beyond attaching per-case attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .skew import attach

AXES = ("x", "y", "z")


def _entry(ornt: Column, axis: int, part: int) -> Column:
    return F.element_at(F.element_at(ornt, axis + 1), part + 1)


def reorient(voxels: DataFrame, geometry: DataFrame, pieces: int | None = None) -> DataFrame:
    """Flip, then permute. ``geometry``: ``case_id, ornt, shape`` of the input volume. ``pieces``: see ``attach``."""
    rows = attach(voxels, geometry.select("case_id", "ornt", "shape"), ["case_id"], list(AXES), pieces=pieces)
    flipped = [
        F.when(_entry(F.col("ornt"), i, 1) == -1, F.element_at("shape", i + 1) - 1 - F.col(a)).otherwise(F.col(a))
        for i, a in enumerate(AXES)
    ]
    target = [_entry(F.col("ornt"), i, 0) for i in range(3)]
    moved = [
        F.when(target[0] == out, flipped[0]).when(target[1] == out, flipped[1]).otherwise(flipped[2]).cast("int").alias(a)
        for out, a in enumerate(AXES)
    ]
    rest = [c for c in voxels.columns if c not in ("case_id", *AXES)]
    return rows.select("case_id", *moved, *rest)


def restore_orientation(voxels: DataFrame, geometry: DataFrame, pieces: int | None = None) -> DataFrame:
    """Undo ``reorient``; ``ornt`` and ``shape`` are those of the original volume. ``pieces``: see ``attach``."""
    rows = attach(voxels, geometry.select("case_id", "ornt", "shape"), ["case_id"], list(AXES), pieces=pieces)
    back = []
    for i, a in enumerate(AXES):
        out = _entry(F.col("ornt"), i, 0)
        value = F.when(out == 0, F.col("x")).when(out == 1, F.col("y")).otherwise(F.col("z"))
        back.append(F.when(_entry(F.col("ornt"), i, 1) == -1, F.element_at("shape", i + 1) - 1 - value).otherwise(value).cast("int").alias(a))
    rest = [c for c in voxels.columns if c not in ("case_id", *AXES)]
    return rows.select("case_id", *back, *rest)


def body_bbox(labelled: DataFrame, cases: DataFrame, margin: int = 5) -> DataFrame:
    """Half-open box around the largest component, widened and clamped.

    Ties go to the lowest label; a case without a body keeps its full extent.
    Filling holes cannot move the box, so it is not done. ``cases``: nx, ny, nz.
    """
    per_label = labelled.groupBy("case_id", "label").agg(
        F.count("*").alias("size"), *[f(a).alias(f"{a}{n}") for a in AXES for n, f in (("0", F.min), ("1", F.max))]
    )
    return boxes_of(per_label, cases, margin)


def boxes_of(per_label: DataFrame, cases: DataFrame, margin: int = 5) -> DataFrame:
    """The same from one row ``case_id, label, size, x0, x1, y0, y1, z0, z1`` per component."""
    box = F.struct(*[F.col(f"{a}{n}") for a in AXES for n in "01"])
    largest = per_label.groupBy("case_id").agg(F.max_by(box, F.struct(F.col("size"), -F.col("label"))).alias("b"))
    joined = cases.select("case_id", "nx", "ny", "nz").join(largest, "case_id", "left")
    cols = []
    for a in AXES:
        cols.append(F.coalesce(F.greatest(F.lit(0), F.col(f"b.{a}0") - margin), F.lit(0)).alias(f"{a}_min"))
        cols.append(F.least(F.col(f"n{a}"), F.coalesce(F.col(f"b.{a}1") + margin + 1, F.col(f"n{a}"))).alias(f"{a}_max"))
    return joined.select("case_id", *cols)


def crop(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Voxels inside the half-open box, in box coordinates."""
    rows = attach(voxels, boxes, ["case_id"], list(AXES))
    inside = F.lit(True)
    for a in AXES:
        inside = inside & (F.col(a) >= F.col(f"{a}_min")) & (F.col(a) < F.col(f"{a}_max"))
    rest = [c for c in voxels.columns if c not in ("case_id", *AXES)]
    return rows.where(inside).select("case_id", *[(F.col(a) - F.col(f"{a}_min")).alias(a) for a in AXES], *rest)


def uncrop(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Shift box coordinates back; everything outside stays implicit background."""
    rows = attach(voxels, boxes.select("case_id", "x_min", "y_min", "z_min"), ["case_id"], list(AXES))
    rest = [c for c in voxels.columns if c not in ("case_id", *AXES)]
    return rows.select("case_id", *[(F.col(a) + F.col(f"{a}_min")).alias(a) for a in AXES], *rest)


def neighbour_stack(slices: DataFrame, depth: DataFrame, value: str, n: int = 3, block: int = 64) -> DataFrame:
    """Channels s-h..s+h of the same case as columns ``c0..c{n-1}``.

    A neighbour outside the volume repeats the edge slice, one missing inside it is
    NULL. Blocks of slices go to tasks whole, with copies of the ``h`` slices beside
    them, so arrays are shuffled once; ``depth`` is one ``(case_id, n_slices)`` row per case.
    """
    from ..functions.registry import check_neighbours

    half = check_neighbours(n) // 2
    s = F.col("slice_idx")
    own, first, last = (F.floor(at / block).cast("int") for at in (s, s - half, s + half))
    rows = slices.select("case_id", "slice_idx", own.alias("_own"), F.explode(F.sequence(first, last)).alias("_block"), F.col(value).alias("_value"))
    spans = depth.where("n_slices > 0").select("case_id", "n_slices", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_slices") - 1) / block).cast("int"))).alias("_block"))
    met = rows.join(spans, ["case_id", "_block"])
    order = W.partitionBy("case_id", "_block").orderBy("slice_idx")
    at = {0: F.col("_value")}
    for step in range(1, half + 1):
        below, above = (F.first("_value").over(order.rangeBetween(o, o)) for o in (-step, step))
        at[-step] = F.when(s - step < 0, at[1 - step]).otherwise(below)
        at[step] = F.when(s + step > F.col("n_slices") - 1, at[step - 1]).otherwise(above)
    channels = [at[k - half].alias(f"c{k}") for k in range(n)]
    return met.select("case_id", "slice_idx", "_own", "_block", *channels).where("_own = _block").drop("_own", "_block")
