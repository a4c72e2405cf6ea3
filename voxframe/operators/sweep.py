"""Threshold sweep in one pass.

Each pixel is put into the bucket "number of candidates below its
probability"; per case the counts of at most 22 buckets are summed from the
top, which gives the prediction size and overlap at every candidate at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.registry import check_sweep_split
from ..functions.scalars import binarize
from .overlap import dice

# 0.10 to 0.90 in steps of 0.05, then a finer tail.
DEFAULT_THRESHOLDS = tuple(round(0.05 * k, 2) for k in range(2, 19)) + (0.925, 0.95, 0.975, 0.99)


def missing_truth(pred_cases: DataFrame, truth_cases: DataFrame) -> DataFrame:
    """The first five predicted cases without truth."""
    return pred_cases.select("case_id").distinct().join(truth_cases, "case_id", "left_anti").orderBy("case_id").limit(5)


def require_truth(pred_cases: DataFrame, truth_cases: DataFrame) -> None:
    """Refuse a sweep when a predicted case has no truth; names the first five."""
    names = [r.case_id for r in missing_truth(pred_cases, truth_cases).collect()]
    if names:
        raise ValueError(f"no ground truth for: {names}")


def sweep_by_case(scored: DataFrame, thresholds: Sequence[float] = DEFAULT_THRESHOLDS) -> DataFrame:
    """Dice per (case, threshold) from pixel rows ``(case_id, prob, gt)``."""
    levels = sorted(thresholds)
    bucket = sum(binarize(F.col("prob"), t).cast("int") for t in levels)
    g = binarize(F.col("gt")).cast("int")
    hist = scored.groupBy("case_id", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(g).alias("n_gt"))
    # every case gets every bucket, so that each candidate has a row to sum from
    frame = hist.select("case_id").distinct().select(
        "case_id", F.explode(F.sequence(F.lit(0), F.lit(len(levels)))).alias("bucket")
    )
    full = frame.join(hist, ["case_id", "bucket"], "left").fillna(0, ["n", "n_gt"])
    above = W.partitionBy("case_id").orderBy("bucket").rowsBetween(W.currentRow, W.unboundedFollowing)
    summed = full.select(
        "case_id",
        "bucket",
        F.sum("n").over(above).alias("pred"),
        F.sum("n_gt").over(above).alias("inter"),
        F.sum("n_gt").over(W.partitionBy("case_id")).alias("gt"),
    )
    named = F.element_at(F.array(*[F.lit(float(t)) for t in levels]), F.col("bucket"))
    return summed.where("bucket > 0").select(
        "case_id", named.alias("threshold"), "pred", "inter", "gt",
        dice(F.col("inter"), F.col("pred"), F.col("gt")).alias("dice"),
    )


def threshold_sweep(scored: DataFrame, split: str = "val", thresholds: Sequence[float] = DEFAULT_THRESHOLDS,
                    truth_cases: DataFrame | None = None) -> DataFrame:
    """Mean Dice over cases for each candidate, 0.0 where there are no cases.

    The mean is an exact decimal sum over a count, rounded to 12 digits, so it
    does not depend on the order of partitions and ties stay ties. With
    ``truth_cases`` a predicted case without truth is refused.
    """
    check_sweep_split(split)
    if truth_cases is not None:
        require_truth(scored, truth_cases)
    total = F.sum(F.col("dice").cast("decimal(28,15)")).cast("double")
    means = sweep_by_case(scored, thresholds).groupBy("threshold").agg(F.round(total / F.count("*"), 12).alias("mean_dice"))
    candidates = scored.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(t)) for t in sorted(thresholds)])).alias("threshold"))
    return candidates.join(means, "threshold", "left").fillna(0.0, ["mean_dice"])


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest mean Dice; ties go to the lowest threshold."""
    return sweep.agg(
        F.max_by("threshold", F.struct(F.col("mean_dice"), -F.col("threshold"))).alias("best_threshold"),
        F.max("mean_dice").alias("best_dice"),
    )
