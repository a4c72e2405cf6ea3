"""Training-run monitors over history tables ``(run_id, epoch, ...)``.

Epochs of a run are consecutive integers. A run may be very long, so the
monitors use small look-aheads, blocked running maxima and per-run minima. The
early-stopping state, whose steps depend on each other, is worked out block by
block; a walk over the blocks passes on one number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalars import binarize
from ..session import cut_lineage
from .batches import map_sorted_groups
from .skew import running_before

# Default settings of the monitors.
MIN_DELTA, PATIENCE, MIN_EPOCHS = 1e-4, 10, 15
COLLAPSE_PEAK, COLLAPSE_PATIENCE, ZERO_TOLERANCE = 0.10, 3, 1e-6
BLOCK = 4096


def epoch_loss(batches: DataFrame) -> DataFrame:
    """Size-weighted mean over finite batches and the number of others."""
    finite = ~F.isnan("loss") & (F.abs("loss") != F.lit(float("inf"))) & F.col("loss").isNotNull()
    sums = batches.groupBy("run_id", "epoch").agg(
        F.coalesce(F.sum(F.when(finite, F.col("loss") * F.col("size"))), F.lit(0.0)).alias("_total"),
        F.coalesce(F.sum(F.when(finite, F.col("size"))), F.lit(0)).alias("_n"),
        F.count_if(~finite).alias("nonfinite"), F.count("*").alias("batches"),
    )
    return sums.select("run_id", "epoch", (F.col("_total") / F.greatest("_n", F.lit(1))).alias("train_loss"), "nonfinite", "batches")


def divergence(epochs: DataFrame) -> DataFrame:
    """First epoch of each run in which every batch was non-finite."""
    dead = (F.col("batches") > 0) & (F.col("nonfinite") == F.col("batches"))
    return epochs.where(dead).groupBy("run_id").agg(F.min("epoch").alias("diverged_epoch"))


def best_so_far(history: DataFrame) -> DataFrame:
    """Running best and ``is_best`` on a strict increase; NaN is never best."""
    score = F.when(~F.isnan("score"), F.col("score"))
    rows = running_before(history, ["run_id"], "epoch", score, "_before")
    return rows.select(
        "run_id", "epoch", "score", F.greatest(score, "_before").alias("best_score"),
        (score.isNotNull() & (F.col("_before").isNull() | (score > F.col("_before")))).alias("is_best"),
    )


def improvements(history: DataFrame, min_delta: float = MIN_DELTA, block: int = BLOCK) -> DataFrame:
    """Epochs that raise the best score by more than ``min_delta``.

    Such an epoch always exceeds every earlier score, so only running records matter,
    and what a stretch of them does to the best score is a step function of the score
    that it is entered with. Blocks of epochs work out theirs on their own (chains of
    accepted records soon run together, so it has few steps), one walk over the blocks
    of a run finds the score each is entered with, and the blocks then name their epochs.
    """
    kind = history.schema["run_id"].dataType.simpleString()
    records = cut_lineage(best_so_far(history).where("is_best").select("run_id", F.col("epoch").cast("int"), "score", F.floor(F.col("epoch") / block).cast("bigint").alias("block")))

    def follow(scores: np.ndarray) -> np.ndarray:
        """The next record accepted after each; as many as there are for none."""
        return np.searchsorted(scores, scores + min_delta, side="right")

    def steps(table: pa.Table, starts: np.ndarray):
        scores, rows = table.column("score").to_numpy(), []
        for start, end in zip(starts.tolist(), np.append(starts[1:], table.num_rows).tolist()):
            own = scores[start:end]
            after, leaves = follow(own).tolist(), own.tolist()
            for i in range(len(own) - 1, -1, -1):
                if after[i] < len(own):
                    leaves[i] = leaves[after[i]]
            last = np.flatnonzero(np.append(np.diff(leaves) != 0, True))
            rows.append((own[last].tolist(), np.array(leaves)[last].tolist()))
        keys = table.select(["run_id", "block"]).take(pa.array(starts))
        yield from keys.append_column("tops", pa.array([r[0] for r in rows], pa.list_(pa.float64()))).append_column("leaves", pa.array([r[1] for r in rows], pa.list_(pa.float64()))).to_batches()

    def enter(table: pa.Table, starts: np.ndarray):
        ends, entry = np.append(starts[1:], table.num_rows), np.zeros(table.num_rows)
        tops, leaves = table.column("tops"), table.column("leaves")
        for start, end in zip(starts.tolist(), ends.tolist()):
            best = -np.inf
            for row in range(start, end):
                entry[row] = best
                own = np.array(tops[row].as_py())
                step = int(np.searchsorted(own, best + min_delta, side="right"))
                if step < len(own):
                    best = leaves[row][step].as_py()
        yield from table.select(["run_id", "block"]).append_column("entry", pa.array(entry)).to_batches()

    def name(table: pa.Table, starts: np.ndarray):
        scores, entry, keep = table.column("score").to_numpy(), table.column("entry").to_numpy(), []
        for start, end in zip(starts.tolist(), np.append(starts[1:], table.num_rows).tolist()):
            own = scores[start:end]
            after, at = follow(own), int(np.searchsorted(own, entry[start] + min_delta, side="right"))
            while at < len(own):
                keep.append(start + at)
                at = int(after[at])
        yield from table.select(["run_id", "epoch", "score"]).take(pa.array(keep, pa.int64())).to_batches()

    functions = map_sorted_groups(records, ["run_id", "block"], ["epoch"], f"run_id {kind}, block bigint, tops array<double>, leaves array<double>", steps)
    entries = map_sorted_groups(functions, ["run_id"], ["block"], f"run_id {kind}, block bigint, entry double", enter)
    entered = records.join(entries, ["run_id", "block"])
    return map_sorted_groups(entered, ["run_id", "block"], ["epoch"], f"run_id {kind}, epoch int, score double", name)


def early_stopping(history: DataFrame, patience: int = PATIENCE, min_delta: float = MIN_DELTA, min_epochs: int = MIN_EPOCHS) -> DataFrame:
    """Per run: the stop epoch (null if none) and the best accepted score up to it.

    After an accepted epoch ``a`` the counter reaches ``patience`` at
    ``a + patience``; the run stops there, or at ``min_epochs`` if later,
    unless another epoch is accepted first.
    """
    last = history.groupBy("run_id").agg(F.max("epoch").alias("last_epoch"))
    accepted = improvements(history, min_delta)
    # accepted scores differ by min_delta, so their number is bounded by the score range
    following = W.partitionBy("run_id").orderBy("epoch")
    spans = accepted.withColumn("_next", F.lead("epoch").over(following)).join(last, "run_id")
    candidate = F.greatest(F.col("epoch") + patience, F.lit(min_epochs))
    before_next = F.coalesce(F.col("_next"), F.col("last_epoch") + 1)
    spans = spans.withColumn("_stop", F.when(candidate < before_next, candidate))
    stops = spans.groupBy("run_id").agg(F.min("_stop").alias("stop_epoch"))
    best = spans.join(stops, "run_id").where("stop_epoch is null or epoch <= stop_epoch")
    return best.groupBy("run_id").agg(F.max("stop_epoch").cast("int").alias("stop_epoch"), F.max("score").alias("best_score"), F.max("epoch").alias("best_epoch"))


def collapse(history: DataFrame, min_peak: float = COLLAPSE_PEAK, patience: int = COLLAPSE_PATIENCE, tolerance: float = ZERO_TOLERANCE) -> DataFrame:
    """First epoch ending ``patience`` consecutive zeros after the peak was passed.

    Each zero epoch is counted for itself and the ``patience - 1`` epochs after
    it; an epoch that collects ``patience`` counts ends such a streak.
    """
    armed = history.where(binarize(F.col("score"), min_peak)).groupBy("run_id").agg(F.min("epoch").alias("armed_epoch"))
    zeros = history.where(F.col("score") <= tolerance).select("run_id", "epoch")
    votes = zeros.select("run_id", "epoch", F.explode(F.sequence(F.col("epoch"), F.col("epoch") + patience - 1)).alias("end"))
    # a zero before the arming epoch cannot be in a streak that ends after it without passing it
    streaks = votes.groupBy("run_id", "end").agg(F.count("*").alias("n"), F.min("epoch").alias("start"), F.max("epoch").alias("last"))
    done = streaks.where((F.col("n") == patience) & (F.col("last") == F.col("end")))
    return done.join(armed, "run_id").where("start > armed_epoch").groupBy("run_id").agg(F.min("end").alias("collapse_epoch"))


def run_stop(diverged: DataFrame, collapsed: DataFrame, stopped: DataFrame) -> DataFrame:
    """Earliest stop of each run; divergence before collapse before early stop on ties."""
    reasons = (
        diverged.select("run_id", F.col("diverged_epoch").alias("epoch"), F.lit(0).alias("rank"), F.lit("diverged").alias("reason"))
        .unionByName(collapsed.select("run_id", F.col("collapse_epoch").alias("epoch"), F.lit(1).alias("rank"), F.lit("collapsed").alias("reason")))
        .unionByName(stopped.where("stop_epoch is not null").select("run_id", F.col("stop_epoch").alias("epoch"), F.lit(2).alias("rank"), F.lit("early_stop").alias("reason")))
    )
    first = reasons.groupBy("run_id").agg(F.min(F.struct("epoch", "rank", "reason")).alias("s"))
    return first.select("run_id", F.col("s.epoch").alias("epoch"), F.col("s.reason").alias("reason"))
