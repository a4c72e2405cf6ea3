"""Segmentation losses as scores over prediction tables.

Rows are pixels ``(case_id, slice_idx, prob, gt)``; sums per slice, the mean
over slices last. Everything stays in double precision, so a confidently empty
slice does not vanish to zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.registry import LOSS_NAMES, one_of

# Smoothing of the denominators, focal exponents, Tversky weights.
SMOOTH = 1e-5
FOCAL_GAMMA = 2.0
TVERSKY_ALPHA, TVERSKY_BETA = 0.3, 0.7
FOCAL_TVERSKY_POWER = 0.75
TINY = 1e-7


def _pixel_terms() -> dict[str, Column]:
    p, g = F.col("prob"), F.col("gt").cast("double")
    # the probability of the true class; logs are cut where the loss library cuts them
    right = F.when(g > 0.5, p).otherwise(1.0 - p)
    ce = F.least(-F.log(F.greatest(right, F.lit(1e-300))), F.lit(100.0))
    return {"pg": p * g, "p": p, "g": g, "ce": ce, "focal": F.pow(1.0 - right, F.lit(FOCAL_GAMMA)) * ce}


def slice_losses(pixels: DataFrame, alpha: float = TVERSKY_ALPHA, beta: float = TVERSKY_BETA, area: int | None = None) -> DataFrame:
    """Dice, cross-entropy, focal and Tversky parts per slice.

    ``area`` is the number of pixels of a slice when absent rows mean
    probability 0 and no truth (they add nothing to any sum).
    """
    terms = _pixel_terms()
    sums = pixels.groupBy("case_id", "slice_idx").agg(*[F.sum(v).alias(k) for k, v in terms.items()], F.count("*").alias("rows"))
    n = F.lit(float(area)) if area else F.col("rows").cast("double")
    fp, fn = F.col("p") - F.col("pg"), F.col("g") - F.col("pg")
    return sums.select(
        "case_id", "slice_idx",
        (1.0 - 2.0 * F.col("pg") / (F.col("p") + F.col("g") + SMOOTH)).alias("dice"),
        (F.col("ce") / n).alias("ce"),
        (F.col("focal") / n).alias("focal"),
        (1.0 - F.col("pg") / (F.col("pg") + alpha * fp + beta * fn + SMOOTH)).alias("tversky"),
    )


def finish(name: str, dice: Column, ce: Column, focal: Column, tversky: Column) -> Column:
    """The loss from the already averaged parts."""
    return {
        "dice_ce": dice + ce,
        "dice_focal": dice + focal,
        "tversky": tversky,
        "focal_tversky": F.pow(F.greatest(tversky, F.lit(TINY)), F.lit(FOCAL_TVERSKY_POWER)),
    }[one_of("loss", name, LOSS_NAMES)]


def loss(pixels: DataFrame, name: str, keys: tuple[str, ...] = ("case_id",), **options) -> DataFrame:
    one_of("loss", name, LOSS_NAMES)
    parts = slice_losses(pixels, **options).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("dice", "ce", "focal", "tversky")])
    return parts.select(*keys, finish(name, *[F.col(c) for c in ("dice", "ce", "focal", "tversky")]).alias("loss"))
