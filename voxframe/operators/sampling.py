"""Epoch sampling of negative slices.

Slice rows: ``case_id, slice_idx, is_positive, is_body``. Draws are hash
ordered, so an epoch and a seed always give the same sample on any cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.draws import draw_key
from ..functions.registry import SAMPLING_MODES, check_evaluation, one_of
from .skew import attach, rank_by_hash


def flag_slices(slices: DataFrame, body_above: float = 0.05) -> DataFrame:
    """Positive and body flags from a foreground count and a mean intensity."""
    return slices.select(
        "case_id", "slice_idx", (F.col("n_pos") > 0).alias("is_positive"), (F.col("slice_mean") > body_above).alias("is_body"), "n_pos"
    )


def case_index(flags: DataFrame) -> DataFrame:
    """Per case: slices, positives, body slices, foreground and positive range."""
    positive = F.col("is_positive")
    return flags.groupBy("case_id").agg(
        F.count("*").alias("n_slices"),
        F.count_if(positive).alias("n_positive"),
        F.count_if("is_body").alias("n_body"),
        F.sum("n_pos").alias("tumor_voxels"),
        F.min(F.when(positive, F.col("slice_idx"))).alias("first_positive"),
        F.max(F.when(positive, F.col("slice_idx"))).alias("last_positive"),
    )


def negatives(flags: DataFrame) -> DataFrame:
    """Body slices that hold no foreground."""
    return flags.where("is_body and not is_positive").select("case_id", "slice_idx")


def split_near_far(flags: DataFrame) -> DataFrame:
    """Negatives with ``near``: within max(10, extent) slices of the positive range."""
    span = flags.where("is_positive").groupBy("case_id").agg(
        F.count("*").alias("n_pos_slices"), F.min("slice_idx").alias("lo"), F.max("slice_idx").alias("hi")
    )
    rows = attach(negatives(flags), span, ["case_id"], ["slice_idx"])
    margin = F.greatest(F.lit(10), F.col("hi") - F.col("lo"))
    near = (F.col("slice_idx") >= F.col("lo") - margin) & (F.col("slice_idx") <= F.col("hi") + margin)
    distance = F.greatest(F.col("lo") - F.col("slice_idx"), F.col("slice_idx") - F.col("hi"), F.lit(0))
    return rows.select("case_id", "slice_idx", "n_pos_slices", near.alias("near"), distance.alias("to_positive"))


def draw_negatives(flags: DataFrame, mode: str, epoch: int = 0, seed: int = 42) -> DataFrame:
    """The negatives kept in one epoch; cases without positives keep none."""
    pool = split_near_far(flags).withColumn("_key", draw_key(seed, epoch, F.col("case_id"), F.col("slice_idx")))
    if mode == "balanced":
        ranked = rank_by_hash(pool, ["case_id"], "_key", ["slice_idx"])
        return ranked.where(F.col("rank") <= F.col("n_pos_slices")).select("case_id", "slice_idx", "to_positive")
    ranked = rank_by_hash(pool, ["case_id", "near"], "_key", ["slice_idx"])
    sizes = pool.groupBy("case_id").agg(F.count_if("near").alias("n_near_pool"))
    ranked = attach(ranked, sizes, ["case_id"], ["slice_idx"])
    n_near = F.least(F.col("n_near_pool"), F.floor(F.lit(0.7) * F.col("n_pos_slices")))
    quota = F.when(F.col("near"), n_near).otherwise(F.col("n_pos_slices") - n_near)
    return ranked.where(F.col("rank") <= quota).select("case_id", "slice_idx", "to_positive")


def sample_epoch(flags: DataFrame, mode: str = "all", epoch: int = 0, seed: int = 42, split: str = "train") -> DataFrame:
    """Slices of one training epoch: every positive plus the drawn negatives."""
    one_of("sampling mode", mode, SAMPLING_MODES)
    check_evaluation(split, sampling=mode)
    if mode == "all":
        return flags.select("case_id", "slice_idx")
    positives = flags.where("is_positive").select("case_id", "slice_idx")
    return positives.unionByName(draw_negatives(flags, mode, epoch, seed).select("case_id", "slice_idx"))


def sampling_stats(flags: DataFrame, mode: str, epoch: int = 0, seed: int = 42) -> DataFrame:
    """Median distance of drawn negatives to the positive range, the share
    within 20 slices and the foreground per sampled slice."""
    from .skew import exact_quantiles

    drawn = draw_negatives(flags, mode, epoch, seed)
    near = drawn.agg(
        F.lit(0).alias("_one"), F.count("*").alias("n_negatives"), F.avg((F.col("to_positive") <= 20).cast("double")).alias("share_within_20")
    )
    median = exact_quantiles(drawn, [], "to_positive", {"median_distance": 0.5}).withColumn("_one", F.lit(0))
    positives = flags.where("is_positive").agg(F.lit(0).alias("_one"), F.count("*").alias("n_positives"), F.sum("n_pos").alias("_fg"))
    joined = near.join(median, "_one", "left").join(positives, "_one")
    return joined.select(
        "n_negatives", "share_within_20", "median_distance", "n_positives",
        (F.col("_fg") / (F.col("n_positives") + F.col("n_negatives"))).alias("positive_density"),
    )


def spread_picks(flags: DataFrame, n_samples: int) -> DataFrame:
    """Up to three evenly spaced positives per case, all first picks before any second.

    The final ``n_samples`` cut is the report's size.
    """
    index = case_index(flags).where("n_positive > 0").select("case_id", "n_positive")
    # ranks of the positives: pieces of 1024 slices stay small in every case
    from .skew import rank_in_ranges

    positives = flags.where("is_positive").select("case_id", "slice_idx")
    ranked = rank_in_ranges(positives, ["case_id"], F.floor(F.col("slice_idx") / 1024), ["slice_idx"])
    picks = F.least(F.lit(3), F.col("n_positive"))
    step = F.when(picks > 1, (F.col("n_positive") - 1) / (picks - 1)).otherwise(F.lit(0.0))
    wanted = index.select(
        "case_id", F.explode(F.transform(F.sequence(F.lit(0), (picks - 1).cast("int")), lambda k: F.struct(k.alias("round"), (F.floor(k * step) + 1).alias("rank")))).alias("w")
    ).select("case_id", "w.round", "w.rank")
    chosen = ranked.join(wanted, ["case_id", "rank"])
    return chosen.select("case_id", "slice_idx", "round").orderBy("round", "case_id").limit(n_samples)
