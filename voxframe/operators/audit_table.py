"""The assembled dataset audit: one wide row per case, defaults for cases that failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars
from ..session import cut_lineage
from .audit import duplicates, fingerprint_volumes, integrity, intensity_stats, resize_loss
from .components import component_stats, connected_components
from .skew import attach

# The columns of the audit table in file order, with what a case has that could not be read.
DEFAULTS = {
    "img_exists": False, "lbl_exists": False, "shape_match": False, "affine_match": False, "max_affine_diff": 0.0,
    "width": 0, "height": 0, "num_slices": 0, "img_shape": None, "lbl_shape": None, "img_orientation": None, "lbl_orientation": None, "orientation_match": False,
    "spacing_x": 0.0, "spacing_y": 0.0, "spacing_z": 0.0, "voxel_vol_mm3": 0.0,
    "img_min_HU": 0.0, "img_max_HU": 0.0, "img_mean_HU": 0.0, "img_std_HU": 0.0, "img_p5_HU": 0.0, "img_p95_HU": 0.0,
    "tumor_voxels": 0, "tumor_volume_mm3": 0.0, "tumor_ratio_percent": 0.0, "positive_slices": 0, "negative_slices": 0,
    "mask_unique_values": None, "is_mask_binary": True, "img_has_nan": False, "img_has_inf": False, "lbl_has_nan": False, "lbl_has_inf": False,
    "is_empty_image": False, "is_empty_mask": False, "img_duplicate_of": None, "lbl_duplicate_of": None,
    "num_connected_components_3d": 0, "largest_component_voxels": 0, "largest_component_vol_mm3": 0.0, "largest_component_ratio_pct": 0.0,
    "tumor_z_min": -1, "tumor_z_max": -1, "tumor_z_center_rel": 0.0,
    "pos_slices_lost_after_resize": 0, "tumor_voxels_after_resize": 0, "tumor_voxels_diff": 0.0, "tumor_volume_change_pct": 0.0, "preprocessing_pre_post_dice_3d": 1.0,
}
NAMES = ("case_id", "pos", "image", "label")


def _label_figures(labels: DataFrame) -> DataFrame:
    """Voxels, slices, their range and the values of a label, from inside the arrays."""
    per = labels.select("case_id", "slice_idx", F.size(F.filter("pixels", lambda v: v > 0)).alias("n"), F.array_distinct("pixels").alias("values"))
    positive = F.col("n") > 0
    figures = per.groupBy("case_id").agg(
        F.sum("n").alias("tumor_voxels"), F.count_if(positive).alias("positive_slices"), F.min(F.when(positive, F.col("slice_idx"))).alias("_low"), F.max(F.when(positive, F.col("slice_idx"))).alias("_high"))
    # distinct values of a label are few; those of a broken one are at most its pixels
    values = per.select("case_id", F.explode("values").alias("v")).distinct().groupBy("case_id").agg(F.array_sort(F.collect_list("v")).alias("v"))
    return figures.join(values.select("case_id", F.concat(F.lit("["), F.lower(F.array_join(F.col("v").cast("array<string>"), ", ")), F.lit("]")).alias("mask_unique_values")), "case_id", "left")


def _components(labels: DataFrame, spacing: DataFrame) -> DataFrame:
    cells = labels.select("case_id", "slice_idx", "width", F.posexplode("pixels").alias("p", "v")).where("v > 0")
    voxels = cells.select("case_id", F.floor(F.col("p") / F.col("width")).cast("int").alias("x"), (F.col("p") % F.col("width")).cast("int").alias("y"), F.col("slice_idx").cast("int").alias("z"))
    widest = labels.agg(F.max("width").alias("ny"), F.max("slice_idx").alias("nz")).first()
    return component_stats(connected_components(voxels, int(widest.ny or 1), int((widest.nz or 0) + 1)), spacing)


def audit_table(cases: DataFrame, headers: DataFrame, images: DataFrame, labels: DataFrame, size: tuple[int, int] = (192, 192)) -> DataFrame:
    """One row per row of ``cases`` (``case_id, pos, image, label``, the manifest in list order).

    ``headers`` (``case_id, img_shape, lbl_shape, img_affine, lbl_affine, spacing``) has a row where a file was found,
    NULL where one of them could not be read, and then ``error`` tells why. Slices of both kinds carry
    ``case_id, slice_idx, height, width, pixels``. A case that failed keeps its names, what exists, and the defaults.
    """
    found = cases.join(headers, "case_id", "left")
    whole = F.col("img_shape").isNotNull() & F.col("lbl_shape").isNotNull()
    read = cut_lineage(found.where(whole).select("case_id", "pos", "img_shape", "lbl_shape", "img_affine", "lbl_affine", "spacing"))
    # a case counts as read in full or not at all
    images, labels = (attach(s, read.select("case_id"), ["case_id"], ["slice_idx"]) for s in (images, labels))
    checks = integrity(read.drop("pos", "spacing"), images, labels).drop("problems")
    nan = F.col("img_has_nan")
    stats = intensity_stats(images).select("case_id", *[F.col(c).alias(f"img_{c}_HU") for c in ("min", "max", "mean", "std", "p5", "p95")])
    mm3 = scalars.voxel_volume(F.col("spacing"))
    steps = read.select("case_id", mm3.alias("voxel_mm3"))
    parts = _components(labels, steps).select(
        "case_id", F.col("n_components").alias("num_connected_components_3d"), F.col("largest_voxels").alias("largest_component_voxels"),
        F.col("largest_mm3").alias("largest_component_vol_mm3"), F.col("largest_pct").alias("largest_component_ratio_pct"))
    loss = resize_loss(labels.withColumn("pixels", F.transform("pixels", lambda v: (v > 0).cast("double"))), *size).select(
        "case_id", F.col("pos_slices_lost").alias("pos_slices_lost_after_resize"), F.col("voxels_after").cast("bigint").alias("tumor_voxels_after_resize"),
        F.col("voxels_diff").alias("tumor_voxels_diff"), F.col("volume_change_pct").alias("tumor_volume_change_pct"), F.col("dice_ceiling").alias("preprocessing_pre_post_dice_3d"))
    copies = []
    for kind, slices in (("img", images), ("lbl", labels)):
        prints = fingerprint_volumes(slices).join(read.select("case_id", "pos"), "case_id")
        copies.append(duplicates(prints).select("case_id", F.col("duplicate_of").alias(f"{kind}_duplicate_of")))
    rows = read.join(checks, "case_id")
    for part in (stats, _label_figures(labels), parts, loss, *copies):
        rows = rows.join(part, "case_id", "left")
    total = scalars.voxel_volume(F.col("img_shape"))
    depth = F.element_at("img_shape", 3)
    named = {
        "width": F.element_at("img_shape", 1), "height": F.element_at("img_shape", 2), "num_slices": depth,
        "img_shape": scalars.format_shape(F.col("img_shape")), "lbl_shape": scalars.format_shape(F.col("lbl_shape")),
        **{f"spacing_{a}": F.element_at("spacing", i + 1) for i, a in enumerate("xyz")}, "voxel_vol_mm3": mm3,
        # one NaN makes every figure of the image NaN
        **{f"img_{c}_HU": F.when(nan, F.lit(float("nan"))).otherwise(F.col(f"img_{c}_HU")) for c in ("min", "max", "mean", "std", "p5", "p95")},
        "tumor_volume_mm3": F.col("tumor_voxels") * mm3, "tumor_ratio_percent": scalars.safe_ratio(F.col("tumor_voxels") * 100.0, total),
        "negative_slices": depth - F.col("positive_slices"), "tumor_z_min": F.col("_low"), "tumor_z_max": F.col("_high"),
        "tumor_z_center_rel": (F.col("_low") + F.col("_high")) / 2.0 / depth,
    }
    full = rows.select("case_id", *[named.get(c, F.col(c) if c in rows.columns else F.lit(None)).alias(c) for c in DEFAULTS if c not in ("img_exists", "lbl_exists")])
    exists = found.select(*NAMES, F.col("img_shape").isNotNull().alias("img_exists"), F.col("lbl_shape").isNotNull().alias("lbl_exists"), "error")
    joined = exists.join(full, "case_id", "left")
    return joined.select(*NAMES, *[F.coalesce(c, F.lit(d)).alias(c) if d is not None else F.col(c) for c, d in DEFAULTS.items()], "error")


def audit_totals(table: DataFrame) -> DataFrame:
    """The figures of the report, one row. ``*_codes`` are counts of the orientations, most frequent first."""
    def share(c: str):
        return F.count_if(F.col(c))

    def span(c: str, name: str):
        return [F.min(c).alias(f"{name}_min"), F.avg(c).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max")]

    row = table.agg(
        F.count("*").alias("n_cases"), share("img_exists").alias("n_images"), share("lbl_exists").alias("n_labels"), share("shape_match").alias("n_shape"), share("affine_match").alias("n_affine"),
        F.max("max_affine_diff").alias("max_affine_diff"), share("orientation_match").alias("n_orientation"), *span("spacing_x", "sx"), *span("spacing_y", "sy"), *span("spacing_z", "sz"),
        F.countDistinct("spacing_z").alias("n_sz"), share("is_mask_binary").alias("n_binary"), *[share(c).alias(f"n_{c}") for c in ("img_has_nan", "img_has_inf", "lbl_has_nan", "lbl_has_inf", "is_empty_image", "is_empty_mask")],
        F.count("img_duplicate_of").alias("n_img_copies"), F.count("lbl_duplicate_of").alias("n_lbl_copies"), *span("tumor_volume_mm3", "volume"),
        F.sum("num_slices").alias("n_slices"), F.sum("positive_slices").alias("n_positive"), *span("num_connected_components_3d", "parts"),
        F.avg("largest_component_ratio_pct").alias("largest_mean"), F.min("largest_component_ratio_pct").alias("largest_min"),
        F.sum("pos_slices_lost_after_resize").alias("n_lost"), F.count_if(F.col("pos_slices_lost_after_resize") > 0).alias("n_losing"),
        F.avg("tumor_volume_change_pct").alias("change_mean"), F.avg("preprocessing_pre_post_dice_3d").alias("ceiling_mean"), F.min("preprocessing_pre_post_dice_3d").alias("ceiling_min"),
    ).withColumn("positive_pct", scalars.safe_ratio(F.col("n_positive") * 100.0, F.col("n_slices")))
    for kind in ("img", "lbl"):
        # at most 48 orientations
        codes = table.where(F.col(f"{kind}_orientation").isNotNull()).groupBy(f"{kind}_orientation").agg(F.count("*").alias("n"))
        text = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(f"{kind}_orientation").alias("o")))), lambda s: F.concat(s["o"], F.lit(": "), (-s["n"]).cast("string")))
        row = row.join(codes.agg(F.array_join(text, ", ").alias(f"{kind}_codes")))
    return row
