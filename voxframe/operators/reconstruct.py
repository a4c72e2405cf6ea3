"""Prepared slices back to original geometry, and the forward chain it inverts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import orientation as ori
from ..functions import scalars
from ..session import cut_lineage
from .bodies import body_box
from .geometry import restore_orientation
from .masks import align_masks
from .overlap import confusion, dice
from .resample import axis_weights, output_length, resample, resample_depth, resize_slices
from .skew import attach


def _plane_matrix(prepared: int, cropped: int, offset: int, resampled: int, canonical: int) -> np.ndarray:
    """One in-plane axis of the inverse: resize back, paste into zeros, resample."""
    paste = np.zeros((resampled, cropped))
    paste[offset : offset + cropped] = np.eye(cropped)
    back = np.eye(prepared) if prepared == cropped else axis_weights(prepared, cropped)
    final = np.eye(resampled) if resampled == canonical else axis_weights(resampled, canonical)
    return final @ paste @ back


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _unplane(pixels: pd.Series, size: pd.DataFrame, box: pd.DataFrame) -> pd.Series:
    keys = pd.concat([size, box], axis=1)
    out = pd.Series([None] * len(pixels), index=pixels.index, dtype=object)
    for dims, rows in keys.groupby(list(keys.columns), sort=False).groups.items():
        h, w, ch, cw, rh, rw, nh, nw, x0, y0 = map(int, dims)
        stack = np.stack([np.asarray(p, dtype=np.float64) for p in pixels.loc[rows]]).reshape(-1, h, w)
        done = _plane_matrix(h, ch, x0, rh, nh) @ stack @ _plane_matrix(w, cw, y0, rw, nw).T
        out.loc[rows] = pd.Series(list(done.reshape(len(rows), -1)), index=rows, dtype=object)
    return out


def reconstruct_canonical(slices: DataFrame, metadata: DataFrame) -> DataFrame:
    """Probability slices in canonical orientation and shape.

    ``slices``: ``case_id, slice_idx, height, width, pixels``; ``metadata``: the
    per-case record with ``cropped_shape, resampled_shape, canonical_shape,
    original_shape, ornt`` and ``crop_bbox``. Slices beyond the cropped depth
    are ignored, missing ones are zero. All steps are linear and separable, so
    the in-plane ones collapse into one matrix product per slice.
    """
    rows = attach(slices.select("case_id", "slice_idx", "height", "width", "pixels"), metadata, ["case_id"], ["slice_idx"])
    rows = rows.where((F.col("slice_idx") >= 0) & (F.col("slice_idx") < F.element_at("cropped_shape", 3)))
    at = lambda name, i: F.element_at(name, i + 1)
    size = F.struct(
        F.col("height").alias("h"), F.col("width").alias("w"),
        at("cropped_shape", 0).alias("ch"), at("cropped_shape", 1).alias("cw"),
        at("resampled_shape", 0).alias("rh"), at("resampled_shape", 1).alias("rw"),
        at("canonical_shape", 0).alias("nh"), at("canonical_shape", 1).alias("nw"),
    )
    box = F.struct(F.col("crop_bbox.x_min").alias("x0"), F.col("crop_bbox.y_min").alias("y0"))
    planes = rows.select(
        "case_id",
        (F.col("slice_idx") + F.col("crop_bbox.z_min")).alias("slice_idx"),
        _unplane("pixels", size, box).alias("pixels"),
        at("canonical_shape", 1).alias("width"),
        at("resampled_shape", 2).alias("n_in"),
        at("canonical_shape", 2).alias("n_out"),
    )
    return resample_depth(planes, "n_in", "n_out")


def reconstruct(slices: DataFrame, metadata: DataFrame, threshold: float = 0.5, binarize: bool = True) -> DataFrame:
    """Voxels in original geometry: strictly above the threshold, cut after all interpolation.

    Without ``binarize`` every non-zero probability is kept as ``prob``. The
    orientation step only moves coordinates, so it follows the cut.
    """
    canonical = reconstruct_canonical(slices, metadata)
    cut = threshold if binarize else 0.0
    cells = canonical.select("case_id", "slice_idx", "width", F.posexplode("pixels").alias("p", "prob")).where(F.col("prob") > cut)
    voxels = cells.select(
        "case_id", F.floor(F.col("p") / F.col("width")).cast("int").alias("x"), (F.col("p") % F.col("width")).cast("int").alias("y"),
        F.col("slice_idx").cast("int").alias("z"), "prob",
    )
    # the restored shape must be the original one; a filter, so that no plan drops the check
    expected = ori.permute_axes(F.col("original_shape"), F.col("ornt"))
    refused = F.raise_error(F.concat(F.lit("reconstructed shape differs from the original for "), F.col("case_id").cast("string")))
    fits = F.when(expected == F.col("canonical_shape"), F.lit(True)).otherwise(refused.cast("boolean"))
    geometry = metadata.where(fits).select("case_id", "ornt", F.col("original_shape").alias("shape"))
    restored = restore_orientation(voxels, geometry)
    return restored.select("case_id", "x", "y", "z") if binarize else restored


def forward(images: DataFrame, labels: DataFrame, size: tuple[int, int] = (192, 192), target: float = 1.0,
            margin: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Forward chain on canonical slices: resample, crop to the body, window, resize.

    Inputs carry ``case_id, slice_idx, height, width, n_slices, sx, sy, sz, pixels``
    in canonical orientation. Returns image slices, label slices, the label slices
    before they were resized, and boxes with the resampled and cropped shapes.
    """
    # read by the search for the body and by the cut
    image = cut_lineage(resample(images, target, order=1))
    label = resample(labels, target, order=0)
    out = [output_length(F.first(n), F.first(f"s{a}") / F.lit(float(target))).cast("int").alias(f"n{a}") for n, a in (("height", "x"), ("width", "y"), ("n_slices", "z"))]
    shapes = images.groupBy("case_id").agg(*out)
    boxes = body_box(image, shapes, margin)
    shaped = cut_lineage(boxes.join(shapes, "case_id").select(
        "case_id", F.struct(*[c for c in boxes.columns if c != "case_id"]).alias("crop_bbox"),
        F.array("nx", "ny", "nz").alias("resampled_shape"),
        F.array(*[F.col(f"{a}_max") - F.col(f"{a}_min") for a in "xyz"]).alias("cropped_shape"),
    ))

    def cut(slices: DataFrame) -> DataFrame:
        rows = attach(slices, shaped, ["case_id"], ["slice_idx"])
        rows = rows.where((F.col("slice_idx") >= F.col("crop_bbox.z_min")) & (F.col("slice_idx") < F.col("crop_bbox.z_max")))
        height, width = F.element_at("cropped_shape", 1), F.element_at("cropped_shape", 2)
        line = lambda r: F.slice("pixels", r * F.col("width") + F.col("crop_bbox.y_min") + 1, width)
        rows_of = F.sequence(F.col("crop_bbox.x_min"), F.col("crop_bbox.x_max") - 1)
        # the lines are cut before the new width exists: inside a lambda a name
        # would resolve to the alias of the same projection
        rows = rows.withColumn("_cut", F.flatten(F.transform(rows_of, line)))
        return rows.select(
            "case_id", (F.col("slice_idx") - F.col("crop_bbox.z_min")).cast("int").alias("slice_idx"),
            height.alias("height"), width.alias("width"), F.col("_cut").alias("pixels"),
        )

    windowed = cut(image).withColumn("pixels", scalars.hu_window(F.col("pixels")))
    cropped = cut(label)
    return resize_slices(windowed, *size), resize_slices(cropped, *size, label=True), cropped, shaped


def preprocess(images: DataFrame, labels: DataFrame, size: tuple[int, int] = (192, 192), target: float = 1.0,
               margin: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Image slices, label slices and boxes with the shapes; see :func:`forward`."""
    image, label, _, shaped = forward(images, labels, size, target, margin)
    return image, label, shaped


def roundtrip_qc(labels: DataFrame, metadata: DataFrame, truth: DataFrame, flag_below: float = 0.80, run: bool = True) -> DataFrame:
    """Dice of the reconstructed prepared label against the untouched mask.

    Both empty scores 1; switched off gives NaN, which is never flagged.
    """
    if not run:
        return metadata.select("case_id", F.lit(float("nan")).alias("roundtrip_dice"), F.lit(False).alias("flagged"))
    pair = align_masks(reconstruct(labels, metadata), truth)
    counts = metadata.select("case_id").join(confusion(pair), "case_id", "left").fillna(0, ["tp", "fp", "fn"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("case_id", dice(tp, tp + fp, tp + fn).alias("roundtrip_dice")).withColumn("flagged", F.col("roundtrip_dice") < flag_below)
