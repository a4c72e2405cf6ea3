"""Writers: CSV exports, JSON documents, the text report and masks."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import even_ties
from ..operators.evaluate import export_frame


def write_case_metrics(metrics: DataFrame, path: str, categories: DataFrame | None = None) -> bool:
    """Sorted per-case CSV; nothing is written for an empty table."""
    if metrics.isEmpty():
        warnings.warn("no case metrics to export")
        return False
    export_frame(metrics, categories).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")
    return True


def write_ordered_csv(rows: DataFrame, path: str, *order: str) -> None:
    """QC tables and histories in record order."""
    rows.orderBy(*order).write.mode("overwrite").csv(path, header=True, nullValue="")


def nested(leaves: Mapping) -> Column:
    """A struct column from a nested mapping of columns."""
    return F.struct(*[(nested(v) if isinstance(v, Mapping) else v).alias(k) for k, v in leaves.items()])


def report_json(row: DataFrame, leaves: Mapping) -> DataFrame:
    """One JSON document per row."""
    return row.select(F.to_json(nested(leaves)).alias("value"))


def sweep_json(sweep: DataFrame) -> DataFrame:
    """``best_threshold`` and a map from threshold text to mean Dice.

    The list holds one entry per candidate threshold, a fixed small number.
    """
    entry = F.struct(F.col("threshold").cast("string").alias("k"), F.col("mean_dice").alias("v"))
    doc = sweep.agg(
        F.max_by("threshold", F.struct(F.col("mean_dice"), -F.col("threshold"))).alias("best_threshold"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("sweep_results"),
    )
    return doc.select(F.to_json(F.struct("best_threshold", "sweep_results")).alias("value"))


def report_lines(leaves: DataFrame) -> DataFrame:
    """One JSON line per section entry of ``run_report.run_report``; an entry has a bounded number of leaves."""
    entries = leaves.groupBy("section", "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("leaf", "value")))).alias("values"))
    return entries.select(F.to_json(F.struct("section", "name", "values")).alias("value"))


def write_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").text(path)


# Lines of the audit report, filled from the one-row summary.
REPORT_LINES = (
    ("# Dataset audit", ()),
    ("- Cases: %d", ("n_cases",)),
    ("- Shape match: %s; affine match: %s; orientation match: %s", ("all_shape_match", "all_affine_match", "all_orientation_match")),
    ("- Empty images: %d; empty masks: %d", ("n_is_empty_image", "n_is_empty_mask")),
    ("- Volume range: %.2f to %.2f mm3 (mean %.2f)", ("min_volume", "max_volume", "mean_volume")),
)


# Lines of the full audit text, filled from ``audit_table.audit_totals``.
AUDIT_LINES = (
    ("# Audit of the volumes", ()),
    ("", ()),
    ("## Files and geometry", ()),
    ("- %d cases, %d images and %d labels found", ("n_cases", "n_images", "n_labels")),
    ("- equal shapes: %d; equal affines: %d (largest difference %.6e)", ("n_shape", "n_affine", "max_affine_diff")),
    ("- axes of images: %s; of labels: %s; equal in %d cases", ("img_codes", "lbl_codes", "n_orientation")),
    ("- spacing x: %.2f to %.2f mm, mean %.2f", ("sx_min", "sx_max", "sx_mean")),
    ("- spacing y: %.2f to %.2f mm, mean %.2f", ("sy_min", "sy_max", "sy_mean")),
    ("- spacing z: %.2f to %.2f mm, mean %.2f, %d different", ("sz_min", "sz_max", "sz_mean", "n_sz")),
    ("", ()),
    ("## Values", ()),
    ("- labels with 0 and 1 only: %d", ("n_binary",)),
    ("- images with NaN: %d, with infinite values: %d", ("n_img_has_nan", "n_img_has_inf")),
    ("- labels with NaN: %d, with infinite values: %d", ("n_lbl_has_nan", "n_lbl_has_inf")),
    ("- empty images: %d, empty labels: %d", ("n_is_empty_image", "n_is_empty_mask")),
    ("- copies among images: %d, among labels: %d", ("n_img_copies", "n_lbl_copies")),
    ("", ()),
    ("## Labelled regions", ()),
    ("- volume: %.2f to %.2f mm3, mean %.2f", ("volume_min", "volume_max", "volume_mean")),
    ("- slices: %d, of them labelled: %d (%.2f %%)", ("n_slices", "n_positive", "positive_pct")),
    ("- components a case: %d to %d, mean %.2f", ("parts_min", "parts_max", "parts_mean")),
    ("- share of the largest component: mean %.2f %%, least %.2f %%", ("largest_mean", "largest_min")),
    ("", ()),
    ("## What resizing costs", ()),
    ("- labelled slices lost: %d, in %d cases", ("n_lost", "n_losing")),
    ("- change of volume: mean %.2f %%", ("change_mean",)),
    ("- Dice after going down and back: mean %.4f, least %.4f", ("ceiling_mean", "ceiling_min")),
)


def _filled(text: str, cols: tuple[str, ...]) -> Column:
    """A line with its figures, decimal ties to even."""
    digits = re.findall(r"%(?:\.(\d+)f|[^%f]*[a-z])", text.replace("%%", ""))
    return F.format_string(text, *[even_ties(F.col(c), int(d)) if d else F.col(c) for c, d in zip(cols, digits, strict=True)])


def markdown_report(summary: DataFrame, lines=REPORT_LINES) -> DataFrame:
    """The report text, one value, from the aggregated summary row."""
    parts = [_filled(text, cols) if cols else F.lit(text) for text, cols in lines]
    return summary.select(F.concat_ws("\n", *parts).alias("value"))


def write_masks(voxels: DataFrame, metadata: DataFrame, path: str, variant: str = "raw") -> None:
    """Predicted voxels by case plus a small table of the cases' original affines."""
    voxels.select("case_id", "x", "y", "z").repartitionByRange("case_id", "z").write.mode("overwrite").parquet(f"{path}/{variant}")
    metadata.select("case_id", "original_affine", "original_shape").write.mode("overwrite").parquet(f"{path}/affines")
