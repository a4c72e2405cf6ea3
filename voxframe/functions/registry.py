"""Closed name -> function maps and the argument checks of the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names of modes and losses.
SAMPLING_MODES = ("all", "balanced", "hard_negatives")
AUGMENT_MODES = ("none", "standard", "anatomic")
CROP_MODES = ("none", "tumor")
LOSS_NAMES = ("dice_ce", "dice_focal", "tversky", "focal_tversky")


def one_of(kind: str, name: str, known) -> str:
    if name not in known:
        raise ValueError(f"unknown {kind}: {name!r}; choose from {', '.join(known)}")
    return name


def check_neighbours(n: int) -> int:
    if n < 1 or n % 2 != 1:
        raise ValueError(f"a slice needs as many neighbours on either side: {n} channels cannot be")
    return n


def check_crop(size: int, height: int, width: int) -> int:
    if size > min(height, width):
        raise ValueError(f"a {height} x {width} slice cannot hold a crop of {size}")
    if size % 16 or size < 32:
        raise ValueError(f"{size} is no crop size: crops are 32, 48, 64 and so on")
    return size


def check_sweep_split(split: str) -> str:
    if split == "test":
        raise ValueError("a threshold may be chosen on validation only, never on test")
    return split


def check_evaluation(split: str, sampling: str = "all", augment: str = "none", crop: str = "none") -> None:
    """Validation and test always see every slice, untouched."""
    if split != "train" and (sampling, augment, crop) != ("all", "none", "none"):
        raise ValueError(f"split {split!r} must use every slice, unaugmented and uncropped")


def validate_config(sampling="all", augment="none", crop="none", neighbours=1, crop_size=96, height=192, width=192):
    one_of("sampling mode", sampling, SAMPLING_MODES)
    one_of("augmentation", augment, AUGMENT_MODES)
    one_of("crop mode", crop, CROP_MODES)
    check_neighbours(neighbours)
    if crop == "tumor":
        check_crop(crop_size, height, width)


def config_problem(sampling: Column, augment: Column, crop: Column, neighbours: Column, crop_size: Column, height: Column, width: Column) -> Column:
    """What :func:`validate_config` would refuse first in each row of a table of configurations; NULL where nothing."""
    def known(kind: str, name: Column, names) -> Column:
        bad = ~F.coalesce(name.isin(*names), F.lit(False))
        return F.when(bad, F.concat(F.lit(f"unknown {kind}: "), F.coalesce(name, F.lit("nothing"))))

    odd = F.when(~((neighbours >= 1) & (F.pmod(neighbours, F.lit(2)) == 1)), F.concat(F.lit("neighbour count must be odd, got "), neighbours.cast("string")))
    fits = F.when(crop_size > F.least(height, width), F.concat(F.lit("too large a crop: "), crop_size.cast("string")))
    step = F.when((F.pmod(crop_size, F.lit(16)) != 0) | (crop_size < 32), F.concat(F.lit("no crop size: "), crop_size.cast("string")))
    return F.coalesce(known("sampling mode", sampling, SAMPLING_MODES), known("augmentation", augment, AUGMENT_MODES), known("crop mode", crop, CROP_MODES),
                      odd, F.when(crop == "tumor", F.coalesce(fits, step)))
