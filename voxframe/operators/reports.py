"""Grouped reports over per-case tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import SIZE_CLASSES
from .skew import exact_quantiles

# Metrics of the reports.
STRATA_METRICS = ("dice_3d", "iou_3d", "sensitivity_3d", "precision_3d", "hd95_3d", "asd_3d")
DELTA_METRICS = ("dice_3d", "iou_3d", "sensitivity_3d", "precision_3d", "hd95_3d", "asd_3d", "fp_components")


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]))
    return df.select(*keys, pairs.alias("_p")).select(*keys, f"_p.{name}", f"_p.{value}")


def stratified_report(metrics: DataFrame, columns: Sequence[str] = STRATA_METRICS) -> DataFrame:
    """Per size class and metric: mean, median, population std; failure rate.

    The three classes always appear; an empty one has ``n_patients = 0`` and no
    statistics. Other categories are left out.
    """
    spark = metrics.sparkSession
    inside = metrics.where(F.col("tumor_category").isin(*SIZE_CLASSES))
    long = unpivot(inside, ["tumor_category"], columns)
    keys = ["tumor_category", "metric"]
    stats = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    medians = exact_quantiles(long, keys, "value", {"median": 0.5})
    sizes = inside.groupBy("tumor_category").agg(
        F.count("*").alias("n_patients"),
        (F.avg(F.col("is_failure").cast("double")) * 100.0).alias("failure_rate_pct"),
    )
    frame = spark.createDataFrame([(c, m) for c in SIZE_CLASSES for m in columns], "tumor_category string, metric string")
    return (
        frame.join(sizes, "tumor_category", "left")
        .join(stats, keys, "left")
        .join(medians, keys, "left")
        .fillna(0, ["n_patients"])
        .select(*keys, "n_patients", "mean", "median", "std", "failure_rate_pct")
    )


def run_summary(metrics: DataFrame) -> DataFrame:
    """One row: mean and median Dice, means, failures."""
    n = F.greatest(F.count("*"), F.lit(1))
    fails = F.coalesce(F.sum(F.col("is_failure").cast("int")), F.lit(0))
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ("dice_3d", "iou_3d", "sensitivity_3d", "precision_3d", "specificity_3d")]
    extra = [F.avg(c).alias(f"mean_{c}") for c in ("hd95_3d", "asd_3d", "fp_components", "inference_time_sec") if c in metrics.columns]
    totals = metrics.agg(
        F.lit(0).alias("_one"), F.count("*").alias("n_patients"), *means, *extra,
        fails.alias("failure_count"), (fails * 100.0 / n).alias("failure_rate_percent"),
        F.sum(F.col("gt_empty").cast("int")).alias("gt_empty_count"), F.sum(F.col("pred_empty").cast("int")).alias("pred_empty_count"),
    )
    median = exact_quantiles(metrics, [], "dice_3d", {"median_dice_3d": 0.5}).withColumn("_one", F.lit(0))
    return totals.join(median, "_one", "left").drop("_one")


def postproc_delta(metrics: DataFrame) -> DataFrame:
    """Raw, filtered and delta of each mean, plus the failure counts."""
    aggs = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for m in DELTA_METRICS for c in (m, f"pp_{m}")]
    fails = [F.sum(F.col(c).cast("double")).alias(c) for c in ("is_failure", "pp_is_failure")]
    totals = metrics.agg(*aggs, *fails, F.avg("pp_components_removed").alias("removed"))
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("raw"), F.col(f"pp_{m}").alias("filtered")) for m in DELTA_METRICS]
    rows.append(F.struct(F.lit("failures").alias("metric"), F.col("is_failure").alias("raw"), F.col("pp_is_failure").alias("filtered")))
    return totals.select(F.explode(F.array(*rows)).alias("r"), F.col("removed").alias("mean_removed")).select(
        "r.metric", "r.raw", "r.filtered", (F.col("r.filtered") - F.col("r.raw")).alias("delta"), "mean_removed"
    )


def multi_seed_summary(seeds: DataFrame) -> DataFrame:
    """Mean and population std over seeds per experiment; fewer than two seeds give no row.

    ``seeds``: one row per (run_id, seed) with dice, hd95, sensitivity, precision.
    """
    cols = ("dice", "hd95", "sensitivity", "precision")
    return seeds.groupBy("run_id").agg(
        F.count("*").alias("n_seeds"),
        *[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
    ).where("n_seeds >= 2")


def seed_means(scores: DataFrame) -> DataFrame:
    """Per (run, seed) means over cases: the per-seed map in long form."""
    return scores.groupBy("run_id", "seed").agg(*[F.avg(c).alias(c) for c in ("dice", "hd95", "sensitivity", "precision")])


def paired_test(scores: DataFrame, baseline: int | str) -> DataFrame:
    """Per-case difference to the mean of the baseline's seeds; t and wins per run."""
    base = scores.where(F.col("run_id") == baseline).groupBy("case_id").agg(F.avg("dice").alias("base_dice"))
    mine = scores.where(F.col("run_id") != baseline).groupBy("run_id", "case_id").agg(F.avg("dice").alias("dice"))
    diffs = mine.join(base, "case_id").select("run_id", (F.col("dice") - F.col("base_dice")).alias("diff"))
    stats = diffs.groupBy("run_id").agg(
        F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd"),
        F.sum((F.col("diff") > 0).cast("int")).alias("wins"),
    )
    return stats.select("run_id", "n", "mean_diff", F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt(F.col("n").cast("double")))).alias("t"), "wins")


def retention(cells: DataFrame, matched: str, changed: str) -> DataFrame:
    """Score under the changed condition over the score under the matched one."""
    wide = cells.groupBy("run_id").pivot("condition", [matched, changed]).agg(F.avg("score"))
    return wide.select("run_id", F.col(matched).alias("matched"), F.col(changed).alias("changed"),
                       F.when(F.col(matched) > 0, F.col(changed) / F.col(matched)).alias("retention"))


def rescore_delta(recomputed: DataFrame, reported: DataFrame, filtering: bool = False) -> DataFrame:
    """Recomputed minus reported Dice where the threshold is the reported one and filtering is off."""
    joined = recomputed.join(reported, ["run_id", "case_id"], "left")
    same = (F.abs(F.col("threshold") - F.col("reported_threshold")) < 1e-9) & F.lit(not filtering)
    return joined.select("run_id", "case_id", "dice", F.when(same, F.col("dice") - F.col("reported_dice")).alias("delta"))


def worst_first(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """Cases by ascending score; one without a score counts as 1.0; stable on list order."""
    joined = cases.join(scores, "case_id", "left").select("pos", "case_id", F.coalesce("score", F.lit(1.0)).alias("score"))
    return joined.orderBy("score", "pos")


def split_summary(cases: DataFrame) -> DataFrame:
    """Per split: sizes, volume range and median, slices, category counts and percents."""
    per_split = cases.groupBy("split").agg(
        F.count("*").alias("n"), F.min("volume").alias("volume_min"), F.avg("volume").alias("volume_mean"),
        F.max("volume").alias("volume_max"), F.min("positive_slices").alias("pos_min"), F.avg("positive_slices").alias("pos_mean"),
        F.max("positive_slices").alias("pos_max"),
        *[F.sum((F.col("tumor_category") == c).cast("int")).alias(f"n_{c}") for c in SIZE_CLASSES],
    )
    medians = exact_quantiles(cases, ["split"], "volume", {"volume_median": 0.5})
    pct = [(F.col(f"n_{c}") * 100.0 / F.col("n")).alias(f"pct_{c}") for c in SIZE_CLASSES]
    return per_split.join(medians, "split").select("*", *pct)
