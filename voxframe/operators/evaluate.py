"""The evaluation bundle: every metric per case, raw and after filtering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .components import connected_components, fate_of_sizes, removed_components
from .distance import asd, hd95, variant_distances
from .overlap import overlap_metrics
from .skew import attach

# Metric and export column names.
METRIC_COLUMNS = ("dice_3d", "iou_3d", "sensitivity_3d", "precision_3d", "specificity_3d", "hd95_3d", "asd_3d")
BASE_EXPORT = ("case_id", "tumor_category", "dice_3d", "iou_3d", "sensitivity_3d", "precision_3d", "specificity_3d",
               "hd95_3d", "asd_3d", "fp_components", "is_failure", "inference_time_sec")
UNKNOWN = "unknown"


def _metrics(mask: DataFrame, cases: DataFrame, variants: Sequence[str], spurious: DataFrame, surface_metrics: bool) -> DataFrame:
    """One row per case and variant: counts, nine metrics and flags. ``spurious`` has ``case_id, variant, fp_components``."""
    named = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), *[F.col(f"_{v}_{c}").alias(c) for c in ("tp", "fp", "fn")]) for v in variants]))
    g = F.col("gt")
    sums = []
    for v in variants:
        p = F.col(v)
        sums += [F.sum(p * g).alias(f"_{v}_tp"), F.sum(p * (1 - g)).alias(f"_{v}_fp"), F.sum((1 - p) * g).alias(f"_{v}_fn")]
    empty = [f"_{v}_{c}" for v in variants for c in ("tp", "fp", "fn")]
    wide = cases.select("case_id", "n_voxels").join(mask.groupBy("case_id").agg(*sums), "case_id", "left").fillna(0, empty)
    counts = wide.select("case_id", "n_voxels", named.alias("c")).select("case_id", "c.*", (F.col("n_voxels") - F.col("c.tp") - F.col("c.fp") - F.col("c.fn")).alias("tn"))
    keys = ["case_id", "variant"]
    metrics = overlap_metrics(counts).join(spurious, keys, "left").fillna(0, ["fp_components"])
    if not surface_metrics:
        nan = F.lit(float("nan"))
        return metrics.withColumn("hd95_3d", nan).withColumn("asd_3d", nan)
    distances = variant_distances(mask, cases, variants)
    rows = cases.select("case_id", F.explode(F.array(*map(F.lit, variants))).alias("variant"))
    metrics = metrics.join(hd95(distances, rows, keys), keys).join(asd(distances, rows, keys), keys)
    # short rows that every report reads several times
    return cut_lineage(metrics)


def _labelled(mask: DataFrame, cases: DataFrame) -> DataFrame:
    """Predicted voxels with their truth flag and component; the raster shape comes from ``cases``."""
    # any bound above the largest case keeps the raster order of each case
    shape = cases.agg(F.max("ny").alias("ny"), F.max("n_slices").alias("nz")).first()
    return connected_components(mask.where("pred = 1").select("case_id", "x", "y", "z", "gt"), int(shape.ny or 1), int(shape.nz or 1), carry=("gt",))


def label_predictions(mask: DataFrame, cases: DataFrame) -> DataFrame:
    """Components of the predicted mask."""
    return _labelled(mask, cases).drop("gt")


def _components(labelled: DataFrame) -> DataFrame:
    """One row per predicted component: size, and whether it meets the truth."""
    return labelled.groupBy("case_id", "label").agg(F.count("*").alias("size"), F.max("gt").alias("hit"))


def case_metrics(mask: DataFrame, cases: DataFrame, surface_metrics: bool = True) -> DataFrame:
    """One row per case with counts, nine metrics and flags.

    ``cases``: ``case_id, n_voxels, ny, n_slices, sx, sy, sz``. Without surface
    metrics HD95 and ASD are NaN and nothing else changes.
    """
    missed = F.sum((F.col("hit") == 0).cast("int")).alias("fp_components")
    spurious = _components(_labelled(mask, cases)).groupBy("case_id", F.lit("pred").alias("variant")).agg(missed)
    return _metrics(mask, cases, ("pred",), spurious, surface_metrics).drop("variant")


def evaluate(mask: DataFrame, cases: DataFrame, min_fraction: float = 0.10, surface_metrics: bool = True) -> tuple[DataFrame, DataFrame]:
    """Metrics on the raw prediction and, prefixed ``pp_``, on the filtered one.

    Returns the per-case table and the filtered paired mask. A fraction of 0
    leaves the ``pp_`` columns out. The filtered prediction is a second flag beside
    the raw one, so both go through one count, one surface and one distance search.
    """
    if not min_fraction:
        return case_metrics(mask, cases, surface_metrics), mask
    labelled = _labelled(mask, cases)
    fate = cut_lineage(fate_of_sizes(_components(labelled), min_fraction))
    marked = attach(labelled, fate.select("case_id", "label", "keep", "size"), ["case_id", "label"], ["x", "y", "z"], heavy="size")
    predicted = marked.select("case_id", "x", "y", "z", F.lit(1).alias("pred"), F.col("keep").cast("int").alias("kept"), "gt")
    missed = mask.where("pred = 0").select("case_id", "x", "y", "z", "pred", F.lit(0).alias("kept"), "gt")
    both = cut_lineage(predicted.unionByName(missed))  # read by the counts, the surfaces and the caller
    lost = (F.col("hit") == 0).cast("int")
    parts = F.explode(F.array(F.struct(F.lit("pred").alias("variant"), lost.alias("lost")), F.struct(F.lit("kept").alias("variant"), F.when(F.col("keep"), lost).alias("lost"))))
    spurious = fate.select("case_id", parts.alias("p")).groupBy("case_id", F.col("p.variant").alias("variant")).agg(F.coalesce(F.sum("p.lost"), F.lit(0)).alias("fp_components"))
    metrics = _metrics(both, cases, ("pred", "kept"), spurious, surface_metrics)
    raw = metrics.where("variant = 'pred'").drop("variant")
    skip = {"case_id", "variant", "gt_empty", "pred_empty"}
    pp = metrics.where("variant = 'kept'").select("case_id", *[F.col(c).alias(f"pp_{c}") for c in metrics.columns if c not in skip])
    removed = removed_components(fate).withColumnRenamed("components_removed", "pp_components_removed")
    joined = raw.join(pp, "case_id").join(removed, "case_id", "left").fillna(0, ["pp_components_removed"])
    return joined, both.where("kept = 1 or gt = 1").select("case_id", "x", "y", "z", F.col("kept").alias("pred"), "gt")


def with_category(metrics: DataFrame, categories: DataFrame | None) -> DataFrame:
    """Attach the size class; a case without one is ``unknown``."""
    if categories is None:
        return metrics.withColumn("tumor_category", F.lit(UNKNOWN))
    return metrics.join(categories.select("case_id", "tumor_category"), "case_id", "left").fillna(UNKNOWN, ["tumor_category"])


def with_inference_time(metrics: DataFrame, times: DataFrame) -> DataFrame:
    """Attach ``inference_time_sec``; a case that was never timed has none."""
    return metrics.join(times.select("case_id", "inference_time_sec"), "case_id", "left")


def export_frame(metrics: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Fixed columns, then the sorted ``pp_`` columns the table really has."""
    named = with_category(metrics, categories)
    counts = {"pp_tp", "pp_fp", "pp_fn", "pp_tn"}
    extra = sorted(c for c in metrics.columns if c.startswith("pp_") and c not in counts)
    base = [F.col(c) if c in named.columns else F.lit(None).cast("double").alias(c) for c in BASE_EXPORT]
    return named.select(*base, *extra).orderBy("case_id")
