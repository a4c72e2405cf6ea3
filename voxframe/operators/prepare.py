"""Preparation of a dataset: slices, inversion records, quality rows, index and totals."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions import orientation as ori
from ..functions import scalars
from ..session import cut_lineage
from .audit import integrity
from .masks import align_masks
from .overlap import confusion, dice
from .reconstruct import forward, reconstruct
from .sampling import flag_slices

LOW_ROUNDTRIP = 0.80
# The columns of the quality table, in file order.
QC_COLUMNS = (
    "case_id", "orientation", "shape_match", "affine_max_diff", "original_shape", "original_spacing", "resampled_shape", "cropped_shape",
    "crop_retained_pct", "n_slices_kept", "n_tumor_voxels_original", "n_tumor_voxels_cropped", "n_pos_slices_original",
    "n_pos_slices_before_resize", "n_pos_slices_after_resize", "pos_slices_lost_to_resize", "tumor_volume_original_mm3",
    "tumor_volume_reconstructed_mm3", "tumor_volume_change_pct", "roundtrip_dice", "problems",
)


class Prepared(NamedTuple):
    images: DataFrame
    labels: DataFrame
    metadata: DataFrame
    qc: DataFrame
    index: DataFrame


def _positive(slices: DataFrame, prefix: str) -> DataFrame:
    """Foreground voxels and slices with any, per case, counted inside the arrays."""
    found = slices.select("case_id", F.size(F.filter("pixels", lambda v: v > 0.5)).alias("n"))
    return found.groupBy("case_id").agg(F.sum("n").alias(f"{prefix}_voxels"), F.count_if(F.col("n") > 0).alias(f"{prefix}_slices"))


def inversion_records(headers: DataFrame, shaped: DataFrame, size: tuple[int, int], target: float) -> DataFrame:
    """What undoing the preparation needs. ``headers``: ``case_id, img_shape, img_affine, spacing``."""
    ornt = ori.orientation(F.col("img_affine"))
    floats, ints = (lambda *v: F.array(*[F.lit(float(x)) for x in v])), (lambda *v: F.array(*[F.lit(int(x)) for x in v]))
    return headers.join(shaped, "case_id").select(
        "case_id", F.col("img_affine").alias("original_affine"), F.col("img_shape").alias("original_shape"), F.col("spacing").alias("original_spacing"),
        ornt.alias("ornt"), ori.permute_axes(F.col("img_shape"), ornt).alias("canonical_shape"), ori.permute_axes(F.col("spacing"), ornt).alias("canonical_spacing"),
        floats(target, target, target).alias("target_spacing"), "resampled_shape", "crop_bbox", "cropped_shape", ints(*size).alias("target_slice_size"),
        F.lit(float(scalars.LUNG_WINDOW[0])).alias("hu_min"), F.lit(float(scalars.LUNG_WINDOW[1])).alias("hu_max"),
    )


def prepare(headers: DataFrame, images: DataFrame, labels: DataFrame, truth: DataFrame, size: tuple[int, int] = (192, 192), target: float = 1.0,
            margin: int = 5, run_qc: bool = True) -> Prepared:
    """The forward chain with its quality rows.

    ``headers``: ``case_id, img_shape, lbl_shape, img_affine, lbl_affine, spacing``; ``images`` and ``labels`` are
    canonical slices as :func:`reconstruct.forward` takes them; ``truth`` are the label's voxels in original geometry.
    The prepared label goes back through the whole inverse and is compared with them, unless ``run_qc`` is off: then
    its measures are NaN.
    """
    image, label, cropped, shaped = forward(images, labels, size, target, margin)
    label = cut_lineage(label)
    metadata = cut_lineage(inversion_records(headers, shaped, size, target))
    checks = integrity(headers, images, labels).select("case_id", F.col("img_orientation").alias("orientation"), "shape_match", F.col("max_affine_diff").alias("affine_max_diff"), "problems")
    original = truth.groupBy("case_id", "z").agg(F.count("*").alias("n")).groupBy("case_id").agg(F.sum("n").alias("original_voxels"), F.count("*").alias("original_slices"))
    rows = metadata.join(checks, "case_id")
    for part in (original, _positive(cropped, "cropped"), _positive(label, "prepared")):
        rows = rows.join(part, "case_id", "left")
    rows = rows.fillna(0, [f"{p}_{c}" for p in ("original", "cropped", "prepared") for c in ("voxels", "slices")])
    mm3 = scalars.voxel_volume(F.col("original_spacing"))
    if run_qc:
        pair = confusion(align_masks(reconstruct(label, metadata), truth))
        rows = rows.join(pair, "case_id", "left").fillna(0, ["tp", "fp", "fn"])
        tp, back, own = F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
        rows = rows.withColumns({"_dice": dice(tp, back, own), "_back_mm3": back * mm3})
    else:
        rows = rows.withColumns({"_dice": F.lit(float("nan")), "_back_mm3": F.lit(float("nan"))})
    own_mm3 = F.col("original_voxels") * mm3
    volume = lambda c: scalars.voxel_volume(F.col(c))
    rounded = scalars.round_half_even
    values = {
        "original_shape": scalars.format_shape(F.col("original_shape")), "original_spacing": scalars.format_spacing(F.col("original_spacing")),
        "crop_retained_pct": rounded(volume("cropped_shape") * 100.0 / volume("resampled_shape"), 2),
        "n_slices_kept": F.element_at("cropped_shape", 3),
        "n_tumor_voxels_original": F.col("original_voxels"), "n_tumor_voxels_cropped": F.col("cropped_voxels"),
        "n_pos_slices_original": F.col("original_slices"), "n_pos_slices_before_resize": F.col("cropped_slices"), "n_pos_slices_after_resize": F.col("prepared_slices"),
        "pos_slices_lost_to_resize": F.col("cropped_slices") - F.col("prepared_slices"),
        "tumor_volume_original_mm3": rounded(own_mm3, 2), "tumor_volume_reconstructed_mm3": rounded(F.col("_back_mm3"), 2),
        "tumor_volume_change_pct": F.when(own_mm3 > 0, rounded((F.col("_back_mm3") - own_mm3) * 100.0 / own_mm3, 3)).otherwise(F.lit(0.0)),
        "roundtrip_dice": rounded(F.col("_dice"), 4),
        "resampled_shape": scalars.format_shape(F.col("resampled_shape")), "cropped_shape": scalars.format_shape(F.col("cropped_shape")),
    }
    qc = cut_lineage(rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in QC_COLUMNS]))
    return Prepared(image, label, metadata, qc, slice_index(image, label))


def slice_index(images: DataFrame, labels: DataFrame) -> DataFrame:
    """``(case_id, n_slices, positive_slices, body_slices, tumor_voxels)``; the lists are as long as the volume is deep."""
    marks = images.select("case_id", "slice_idx", (F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v) / F.size("pixels")).alias("slice_mean"))
    counts = labels.select("case_id", "slice_idx", F.size(F.filter("pixels", lambda v: v > 0.5)).alias("n_pos"))
    rows = flag_slices(counts.join(marks, ["case_id", "slice_idx"]))
    chosen = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), F.col("slice_idx"))))
    return rows.groupBy("case_id").agg(
        F.count("*").alias("n_slices"), chosen("is_positive").alias("positive_slices"), chosen("is_body").alias("body_slices"), F.sum("n_pos").alias("tumor_voxels"))


def split_totals(index: DataFrame, split: DataFrame) -> DataFrame:
    """Cases, slices and positive slices of each part of the split."""
    rows = index.join(split.select("case_id", "split"), "case_id").select("split", "n_slices", F.size("positive_slices").alias("positive"))
    sums = rows.groupBy("split").agg(F.count("*").alias("n_cases"), F.sum("n_slices").alias("n_slices"), F.sum("positive").alias("positive_slices"))
    return sums.withColumn("positive_pct", scalars.safe_ratio(F.col("positive_slices") * 100.0, F.col("n_slices")))


def preparation_cost(qc: DataFrame) -> DataFrame:
    """One row: what the preparation alone loses. NaN measures are left out; without any the means are NULL."""
    def known(c: str):
        return F.when(~F.isnan(c), F.col(c))

    round_trip, change = known("roundtrip_dice"), known("tumor_volume_change_pct")
    return qc.agg(
        F.count("*").alias("n_cases"), F.avg(round_trip).alias("mean_roundtrip_dice"), F.min(round_trip).alias("min_roundtrip_dice"), F.max(round_trip).alias("max_roundtrip_dice"),
        F.coalesce(F.sum("pos_slices_lost_to_resize"), F.lit(0)).alias("positive_slices_lost"), F.count_if(F.col("pos_slices_lost_to_resize") > 0).alias("cases_affected"),
        F.avg(change).alias("mean_volume_change_pct"), F.avg("crop_retained_pct").alias("mean_crop_retained_pct"),
        F.coalesce(F.min(round_trip) < LOW_ROUNDTRIP, F.lit(False)).alias("low_roundtrip"),
    )
