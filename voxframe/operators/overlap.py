"""Overlap metrics with exact empty-mask rules, per case and pooled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import binarize

FAILURE_BELOW = 0.10
OVERLAP_COLUMNS = ("dice_3d", "iou_3d", "sensitivity_3d", "precision_3d", "specificity_3d")


def confusion(mask: DataFrame, cases: DataFrame | None = None, keys: Sequence[str] = ("case_id",),
              n_voxels: str = "n_voxels") -> DataFrame:
    """tp, fp, fn counts; with ``cases`` also tn, taken from the volume shape.

    ``cases`` drives the result, so a case without any foreground voxel stays.
    """
    p, g = F.col("pred"), F.col("gt")
    counts = mask.groupBy(*keys).agg(
        F.sum(p * g).alias("tp"), F.sum(p * (1 - g)).alias("fp"), F.sum((1 - p) * g).alias("fn")
    )
    if cases is None:
        return counts
    out = cases.select(*keys, n_voxels).join(counts, list(keys), "left").fillna(0, ["tp", "fp", "fn"])
    return out.select(*keys, "tp", "fp", "fn", (F.col(n_voxels) - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def _tp_fp_fn():
    return F.col("tp"), F.col("fp"), F.col("fn")


def dice(tp: Column, pred: Column, gt: Column) -> Column:
    """2 tp / (pred + gt): 1 when both are empty, 0 when one is."""
    return (
        F.when((pred == 0) & (gt == 0), F.lit(1.0))
        .when((pred == 0) | (gt == 0), F.lit(0.0))
        .otherwise(tp * 2.0 / (pred + gt))
    )


def case_rules() -> dict[str, Column]:
    """Per-case ratios over tp, fp, fn, tn."""
    tp, fp, fn = _tp_fp_fn()
    tn = F.col("tn")
    pred, gt = tp + fp, tp + fn
    one = F.lit(1.0)
    return {
        "dice_3d": dice(tp, pred, gt),
        "iou_3d": F.when(tp + fp + fn == 0, one).otherwise(tp / (tp + fp + fn)),
        "sensitivity_3d": F.when(gt == 0, one).otherwise(tp / gt),
        "precision_3d": F.when((pred == 0) & (gt == 0), one).when(pred == 0, F.lit(0.0)).otherwise(tp / pred),
        "specificity_3d": F.when(tn + fp == 0, one).otherwise(tn / (tn + fp)),
    }


def micro_rules() -> dict[str, Column]:
    """Pooled ratios: every empty denominator gives 1."""
    tp, fp, fn = _tp_fp_fn()
    tn = F.col("tn")

    def ratio(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(1.0))

    return {
        "dice_3d": ratio(tp * 2.0, tp * 2 + fp + fn),
        "iou_3d": ratio(tp, tp + fp + fn),
        "sensitivity_3d": ratio(tp, tp + fn),
        "precision_3d": ratio(tp, tp + fp),
        "specificity_3d": ratio(tn, tn + fp),
    }


def overlap_metrics(counts: DataFrame) -> DataFrame:
    """All per-case ratios, flags and counts from one confusion row per case."""
    out = counts.select("*", *[c.alias(n) for n, c in case_rules().items()])
    gt = F.col("tp") + F.col("fn")
    return out.select(
        "*",
        ((F.col("dice_3d") < FAILURE_BELOW) & (gt > 0)).alias("is_failure"),
        (gt == 0).alias("gt_empty"),
        (F.col("tp") + F.col("fp") == 0).alias("pred_empty"),
    )


def micro_average(counts: DataFrame) -> DataFrame:
    pooled = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return pooled.select("tp", "fp", "fn", "tn", *[c.alias(n) for n, c in micro_rules().items()])


def macro_average(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean over cases; no cases gives 0, and a NaN stays visible."""
    return metrics.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


def fast_dice(scored: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Hard and soft Dice per case from running sums over pixel rows."""
    return finish_fast_dice(scored.groupBy(*keys).agg(*fast_dice_sums(threshold)), keys)


def fast_dice_sums(threshold: float) -> list[Column]:
    prob, gt = F.col("prob"), F.col("gt").cast("double")
    hard = binarize(prob, threshold).cast("double")
    return [
        F.sum(hard * gt).alias("inter_hard"),
        F.sum(hard).alias("pred_hard"),
        F.sum(prob * gt).alias("inter_soft"),
        F.sum(prob).alias("pred_soft"),
        F.sum(gt).alias("gt_sum"),
    ]


def finish_fast_dice(sums: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    return sums.select(
        *keys,
        dice(F.col("inter_hard"), F.col("pred_hard"), F.col("gt_sum")).alias("dice_hard"),
        dice(F.col("inter_soft"), F.col("pred_soft"), F.col("gt_sum")).alias("dice_soft"),
    )


def inference_time(batches: DataFrame) -> DataFrame:
    """Each case's share of its batches' wall time; one row per (batch, case, slice)."""
    return batches.groupBy("case_id").agg(F.sum(F.col("batch_seconds") / F.col("batch_size")).alias("inference_time_sec"))
