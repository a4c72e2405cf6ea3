"""Training slices by name: neighbours, then augmentation, then crop."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.registry import check_evaluation, validate_config
from .augment import anatomic_parameters, augment_anatomic, augment_standard, crop_pixels, crop_windows, warp_slices
from .geometry import neighbour_stack

LABEL = -1
COLUMNS = ("case_id", "slice_idx", "channel", "height", "width", "pixels")


def channel_rows(slices: DataFrame, neighbours: int = 1) -> DataFrame:
    """One row per slice and channel; the slice's own label is channel -1."""
    depth = slices.groupBy("case_id").agg((F.max("slice_idx") + 1).alias("n_slices"))
    whole = slices.select("case_id", "slice_idx", F.struct("height", "width", "pixels", "label").alias("_slice"))
    stack = neighbour_stack(whole, depth, "_slice", neighbours)
    own = F.col(f"c{neighbours // 2}")
    part = lambda number, source, column: F.struct(F.lit(number).alias("channel"), source["height"].alias("height"), source["width"].alias("width"), source[column].alias("pixels"))
    parts = [part(k, F.col(f"c{k}"), "pixels") for k in range(neighbours)] + [part(LABEL, own, "label")]
    return stack.select("case_id", "slice_idx", F.explode(F.array(*parts)).alias("_part")).select("case_id", "slice_idx", "_part.*")


def _anatomic(rows: DataFrame, seed: int, epoch: int) -> DataFrame:
    images = augment_anatomic(rows.where(F.col("channel") != LABEL), seed, epoch)
    labels = warp_slices(anatomic_parameters(rows.where(F.col("channel") == LABEL), seed, epoch), label=True)
    return images.select(*COLUMNS).unionByName(labels.select(*COLUMNS))


AUGMENTATIONS = {
    "none": lambda rows, seed, epoch: rows,
    "standard": augment_standard,
    "anatomic": _anatomic,
}


def _crop_on_label(rows: DataFrame, size: int, height: int, width: int, seed: int, epoch: int) -> DataFrame:
    labels = rows.where(F.col("channel") == LABEL)
    voxels = labels.select("case_id", F.col("slice_idx").alias("z"), "width", F.posexplode("pixels").alias("p", "v")).where("v > 0 and not isnan(v)")
    mask = voxels.select("case_id", F.floor(F.col("p") / F.col("width")).cast("int").alias("x"), (F.col("p") % F.col("width")).cast("int").alias("y"), "z")
    windows = crop_windows(labels, mask, height, width, size, seed, epoch)
    return crop_pixels(rows, windows, size)


CROPS = {
    "none": lambda rows, size, height, width, seed, epoch: rows,
    "tumor": _crop_on_label,
}


def training_slices(slices: DataFrame, split: str, neighbours: int = 1, augmentation: str = "none", crop: str = "none",
                    crop_size: int = 96, height: int = 192, width: int = 192, seed: int = 42, epoch: int = 0) -> DataFrame:
    """``case_id, slice_idx, channel, height, width, pixels`` as a model sees them.

    ``slices`` carries ``case_id, slice_idx, height, width, pixels, label``. The
    channels of a slice and its label move alike. Splits other than ``train``
    accept neither augmentation nor crop. ``height`` and ``width`` are the
    common slice size and matter for crops only.
    """
    check_evaluation(split, "all", augmentation, crop)
    validate_config("all", augmentation, crop, neighbours, crop_size, height, width)
    rows = AUGMENTATIONS[augmentation](channel_rows(slices, neighbours), seed, epoch)
    rows = rows.select(*COLUMNS)
    return CROPS[crop](rows, crop_size, height, width, seed, epoch).select(*COLUMNS)
