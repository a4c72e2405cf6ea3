"""Scalar column expressions shared by every report."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Hounsfield windows (low, high) and the body-slice cut.
LUNG_WINDOW = (-1000.0, 400.0)
MEDIASTINUM_WINDOW = (-150.0, 250.0)
BODY_SLICE_MIN_MEAN = 0.05

# Tumour size classes in mm3; a bound belongs to the upper class.
SMALL_BELOW = 1000.0
MEDIUM_BELOW = 5000.0
SIZE_CLASSES = ("small", "medium", "large")


def binarize(value: Column, threshold: float | Column = 0.5) -> Column:
    """Strictly above the threshold; NaN, which Spark orders above all numbers, is not."""
    return (value > threshold) & ~F.isnan(value)


def clip(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(value, low), high)


def window_value(value: Column, low: float = LUNG_WINDOW[0], high: float = LUNG_WINDOW[1]) -> Column:
    """Clip one intensity to the window and scale it to [0, 1]."""
    return (clip(value, low, high) - F.lit(low)) / F.lit(high - low)


def hu_window(pixels: Column, low: float = LUNG_WINDOW[0], high: float = LUNG_WINDOW[1]) -> Column:
    """``window_value`` over a pixel array."""
    return F.transform(pixels, lambda v: window_value(v, low, high))


def clip_window(pixels: Column, low, high) -> Column:
    """Clip a pixel array without rescaling; bounds may be columns."""
    return F.transform(pixels, lambda v: clip(v, low, high))


def classify_size(volume: Column) -> Column:
    return (
        F.when(volume < SMALL_BELOW, F.lit("small"))
        .when(volume < MEDIUM_BELOW, F.lit("medium"))
        .otherwise(F.lit("large"))
    )


def voxel_volume(spacing: Column) -> Column:
    """Product of a spacing array."""
    return F.aggregate(spacing, F.lit(1.0), lambda acc, v: acc * v)


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def percent(num: Column, den: Column) -> Column:
    return safe_ratio(num * 100.0, den, 0.0)


def change_pct(new: Column, old: Column) -> Column:
    return safe_ratio((new - old) * 100.0, old, 0.0)


def ratio_to_at_least_one(num: Column, den: Column) -> Column:
    return num / F.greatest(den, F.lit(1))


def format_shape(shape: Column) -> Column:
    return F.array_join(F.transform(shape, lambda v: v.cast("string")), "x")


def format_spacing(spacing: Column) -> Column:
    return F.array_join(F.transform(spacing, lambda v: F.format_string("%.3f", v.cast("double"))), "x")


def round_half_even(value: Column, digits: int = 0) -> Column:
    """Half-to-even on the shortest decimal form of the double."""
    return F.bround(value, digits)


def even_ties(value: Column, digits: int) -> Column:
    """A double for ``%.<digits>f``: where it is a tie in binary, the even neighbour, which ``format_string`` would round up."""
    return F.when(F.abs(value * float(2 ** (digits + 1))) % 2.0 == 1.0, round_half_even(value, digits)).otherwise(value)


def nan_to_null(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def cosine_lr(epoch: Column, period: int, base_lr: float, floor_ratio: float = 0.01) -> Column:
    """Cosine annealing from ``base_lr`` to its floor, held after ``period`` epochs."""
    floor = base_lr * floor_ratio
    phase = F.least(epoch, F.lit(period)) * F.lit(math.pi) / F.lit(float(period))
    return F.lit(floor) + F.lit(base_lr - floor) * (F.lit(1.0) + F.cos(phase)) / F.lit(2.0)


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
