"""The whole report of a run as leaves: ``(section, name, leaf, value)``.

A run's facts, its threshold sweep, the summary, macro and micro averages, size
classes, every case, and the filtered block. As rows they stay distributed however
many cases a run has; ``sinks.report_lines`` makes one JSON line of each section entry.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .evaluate import METRIC_COLUMNS
from .overlap import macro_average, micro_average, micro_rules
from .reports import run_summary, stratified_report

# Names of the summary and of the filtered block, and the columns they come from.
SUMMARY = {
    "mean_dice_3d": "mean_dice_3d", "median_dice_3d": "median_dice_3d", "mean_iou_3d": "mean_iou_3d", "mean_hd95_mm": "mean_hd95_3d", "mean_asd_mm": "mean_asd_3d",
    "mean_sensitivity": "mean_sensitivity_3d", "mean_precision": "mean_precision_3d", "mean_specificity": "mean_specificity_3d", "mean_fp_components": "mean_fp_components",
    "mean_inference_time_sec": "mean_inference_time_sec", "failure_count": "failure_count", "failure_rate_percent": "failure_rate_percent",
}
FILTERED_MACRO = {
    "dice_3d": "pp_dice_3d", "iou_3d": "pp_iou_3d", "hd95_mm": "pp_hd95_3d", "asd_mm": "pp_asd_3d", "sensitivity": "pp_sensitivity_3d", "precision": "pp_precision_3d", "fp_components": "pp_fp_components",
}
FILTERED_MICRO = {"dice_3d": "dice_3d", "iou_3d": "iou_3d", "sensitivity": "sensitivity_3d", "precision": "precision_3d", "specificity": "specificity_3d"}
COUNTS = ("tp", "fp", "fn", "tn")


def _leaves(rows: DataFrame, section: str, name: Column, values: Mapping[str, Column]) -> DataFrame:
    """One leaf per entry of ``values``; NULL values are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("leaf"), v.cast("double").alias("value")) for k, v in values.items()]))
    long = rows.select(F.lit(section).alias("section"), name.cast("string").alias("name"), pairs.alias("p"))
    return long.select("section", "name", "p.leaf", "p.value").where("value is not null")


def _by_metric(strata: DataFrame) -> DataFrame:
    """The statistics of each size class, named after statistic and metric."""
    pairs = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{stat}_"), "metric").alias("leaf"), F.col(stat).alias("value")) for stat in ("mean", "median", "std")]))
    long = strata.select(F.lit("stratified_report").alias("section"), F.col("tumor_category").alias("name"), pairs.alias("p"))
    return long.select("section", "name", "p.leaf", "p.value").where("value is not null")


def run_report(run: DataFrame, sweep: DataFrame, metrics: DataFrame, min_fraction: float = 0.10) -> DataFrame:
    """``run``: one row of numbers about the run; ``sweep``: ``threshold, mean_dice``; ``metrics``: per case, with size class and perhaps ``pp_`` columns.

    The macro and micro averages hold no case as 0; the filtered block is there only with ``pp_`` columns.
    """
    metrics, sweep = cut_lineage(metrics), cut_lineage(sweep)  # short rows, read by every section
    numbers = [c for c, t in metrics.dtypes if t in ("double", "bigint", "int", "boolean") and c != "case_id"]
    whole = F.lit("all")
    best = sweep.agg(F.max_by("threshold", F.struct(F.col("mean_dice"), -F.col("threshold"))).alias("optimal_threshold"))
    summary = run_summary(metrics)
    strata = stratified_report(metrics)
    parts = [
        _leaves(run, "run", whole, {c: F.col(c) for c in run.columns}),
        _leaves(best, "run", whole, {"optimal_threshold": F.col("optimal_threshold")}),
        _leaves(sweep, "threshold_sweep", F.col("threshold"), {"mean_dice": F.col("mean_dice")}),
        _leaves(summary, "test_metrics_summary", whole, {k: F.col(c) for k, c in SUMMARY.items() if c in summary.columns}),
        _leaves(macro_average(metrics, METRIC_COLUMNS), "macro_average", whole, {c: F.col(c) for c in METRIC_COLUMNS}),
        _leaves(micro_average(metrics), "micro_average", whole, {c: F.col(c) for c in (*COUNTS, *micro_rules())}),
        _by_metric(strata),
        _leaves(strata.select("tumor_category", "n_patients", "failure_rate_pct").distinct(), "stratified_report", F.col("tumor_category"), {c: F.col(c) for c in ("n_patients", "failure_rate_pct")}),
        _leaves(metrics, "per_patient_test_metrics", F.col("case_id"), {c: F.col(c) for c in numbers}),
    ]
    if "pp_dice_3d" in metrics.columns:
        fails = metrics.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("pp_is_failure").cast("int")), F.lit(0)).alias("failed"), F.coalesce(F.avg("pp_components_removed"), F.lit(0.0)).alias("removed"))
        pooled = micro_average(metrics.select(*[F.col(f"pp_{c}").alias(c) for c in COUNTS]))
        parts += [
            _leaves(fails, "postprocessed", whole, {
                "min_fraction": F.lit(min_fraction), "mean_components_removed": F.col("removed"), "failure_count": F.col("failed"), "failure_rate_percent": F.col("failed") * 100.0 / F.greatest("n", F.lit(1))}),
            _leaves(macro_average(metrics, list(FILTERED_MACRO.values())), "postprocessed", F.lit("macro"), {k: F.col(c) for k, c in FILTERED_MACRO.items()}),
            _leaves(pooled, "postprocessed", F.lit("micro"), {k: F.col(c) for k, c in FILTERED_MICRO.items()}),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
