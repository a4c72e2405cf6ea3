"""Runs: monitors, losses, cross-run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import losses, monitors, reports
from . import fixtures as fx
from .catalog import query, with_ctes

PATIENCE, MIN_EPOCHS = 5, 8
PEAK = 0.1


def history(spark, sf):
    """Scores below 0.02 read as zero, so that runs can collapse."""
    return fx.history(spark, sf).withColumn("score", F.when(F.col("score") < 0.02, 0.0).otherwise(F.col("score")))


HIST = "hist as (select run_id, epoch, case when score < 0.02 then 0.0::double else score end as score, nonfinite from f5)"
# the state machine epoch by epoch
ES = f"""es(run_id, epoch, best, best_epoch, counter, stopped) as (select run_id, 1, score, 1, 0, false from hist where epoch = 1 union all
  select h.run_id, h.epoch, case when h.score > e.best + 1e-4 then h.score else e.best end, case when h.score > e.best + 1e-4 then h.epoch else e.best_epoch end,
   case when h.score > e.best + 1e-4 then 0 else e.counter + 1 end, h.score <= e.best + 1e-4 and e.counter + 1 >= {PATIENCE} and h.epoch >= {MIN_EPOCHS}
  from es e join hist h on h.run_id = e.run_id and h.epoch = e.epoch + 1 where not e.stopped),
 stops as (select run_id, min(epoch) filter (stopped) as stop_epoch, max_by(best, epoch) as best_score, max_by(best_epoch, epoch) as best_epoch from es group by 1)"""
COL = f"""arm as (select run_id, min(epoch) as armed from hist where score > {PEAK} group by 1),
 zz as (select h.run_id, h.epoch, h.score <= 1e-6 as zero, h.epoch - row_number() over (partition by h.run_id, h.score <= 1e-6 order by h.epoch) as island from hist h join arm on arm.run_id = h.run_id where h.epoch > armed),
 zc as (select run_id, epoch, row_number() over (partition by run_id, island order by epoch) as streak from zz where zero),
 col as (select run_id, min(epoch) as collapse_epoch from zc where streak >= 3 group by 1)"""
EPOCHS = "ep as (select run_id, cast((epoch - 1) // 3 + 1 as int) as epoch, score + 0.5::double as loss, 1 + epoch % 4 as size, nonfinite from f5)"
DIV = "dv as (select run_id, min(epoch) as diverged_epoch from (select run_id, epoch from ep group by 1, 2 having count(*) = sum(nonfinite)) group by 1)"


def batches(spark, sf):
    """Three history rows make one epoch's batches; error rows have no finite loss."""
    h = fx.history(spark, sf)
    return h.select(
        "run_id", F.floor((F.col("epoch") - 1) / 3).cast("int") + 1, F.when(F.col("nonfinite") == 1, float("nan")).otherwise(F.col("score") + 0.5), 1 + F.col("epoch") % 4
    ).toDF("run_id", "epoch", "loss", "size")


@query("a31_epoch_loss", with_ctes(fx.F5, EPOCHS, body="""select run_id, epoch, coalesce(sum(loss * size) filter (nonfinite = 0), 0.0) / greatest(coalesce(sum(size) filter (nonfinite = 0), 0), 1) as train_loss,
 count(*) filter (nonfinite = 1) as nonfinite, count(*) as batches from ep group by 1, 2"""))
def _(spark, sf):
    return monitors.epoch_loss(batches(spark, sf))


@query("st04_divergence", with_ctes(fx.F5, EPOCHS, DIV, body="select * from dv"))
def _(spark, sf):
    return monitors.divergence(monitors.epoch_loss(batches(spark, sf)))


@query("w05_best_so_far", with_ctes(fx.F5, HIST, body="""select run_id, epoch, score, max(score) over (partition by run_id order by epoch) as best_score,
 coalesce(score > max(score) over (partition by run_id order by epoch rows between unbounded preceding and 1 preceding), true) as is_best from hist"""))
def _(spark, sf):
    return monitors.best_so_far(history(spark, sf))


@query("st02_early_stopping", with_ctes(fx.F5, HIST, ES, body="select * from stops"))
def _(spark, sf):
    return monitors.early_stopping(history(spark, sf), PATIENCE, min_epochs=MIN_EPOCHS)


@query("st03_collapse", with_ctes(fx.F5, HIST, COL, body="select * from col"))
def _(spark, sf):
    return monitors.collapse(history(spark, sf), PEAK)


@query("st05_run_stop", with_ctes(fx.F5, HIST, ES, COL, EPOCHS, DIV, """al as (select run_id, diverged_epoch as epoch, 0 as k, 'diverged' as reason from dv union all select run_id, collapse_epoch, 1, 'collapsed' from col
 union all select run_id, stop_epoch, 2, 'early_stop' from stops where stop_epoch is not null)""", body="select run_id, epoch, reason from al qualify row_number() over (partition by run_id order by epoch, k) = 1"))
def _(spark, sf):
    h = history(spark, sf)
    diverged = monitors.divergence(monitors.epoch_loss(batches(spark, sf)))
    return monitors.run_stop(diverged, monitors.collapse(h, PEAK), monitors.early_stopping(h, PATIENCE, min_epochs=MIN_EPOCHS))


@query("w08_cosine_lr", with_ctes(fx.F5, body="select run_id, epoch, 0.00001 + (0.001 - 0.00001) * (1 + cos(pi() * least(epoch, 50) / 50.0::double)) / 2 as lr from f5"))
def _(spark, sf):
    return fx.history(spark, sf).select("run_id", "epoch", scalars.cosine_lr(F.col("epoch"), 50, 0.001).alias("lr"))


LOSS = """pt as (select case_id, z as slice_idx, prob as p, gt::double as g, case when gt = 1 then prob else 1 - prob end as r from f1),
 pc as (select *, least(-ln(greatest(r, 1e-300)), 100.0) as ce from pt),
 ps as (select case_id, slice_idx, sum(p * g) as pg, sum(p) as p, sum(g) as g, sum(ce) as ce, sum(pow(1 - r, 2) * ce) as fo from pc group by 1, 2),
 pl as (select case_id, slice_idx, 1 - 2 * pg / (p + g + 1e-5) as dice, ce / 256 as ce, fo / 256 as focal, 1 - pg / (pg + 0.3::double * (p - pg) + 0.7::double * (g - pg) + 1e-5) as tversky from ps)"""
_LOSS_SQL = {
    "l01_dice_ce": ("dice_ce", "avg(dice) + avg(ce)"),
    "l02_dice_focal": ("dice_focal", "avg(dice) + avg(focal)"),
    "l03_tversky": ("tversky", "avg(tversky)"),
    "l04_focal_tversky": ("focal_tversky", "pow(greatest(avg(tversky), 1e-7), 0.75)"),
}
for _name, (_loss, _expr) in _LOSS_SQL.items():
    query(_name, with_ctes(fx.F1, LOSS, body=f"select case_id, {_expr} as loss from pl group by 1"))(
        lambda spark, sf, n=_loss: losses.loss(fx.scored_voxels(spark, sf).withColumnRenamed("z", "slice_idx"), n, area=fx.NX * fx.NY)
    )


_SEEDS = 'sd as (select run_id, seed, avg(dice) as dice, avg(hd95) as hd95, avg(sensitivity) as sensitivity, avg("precision") as "precision" from f8 group by 1, 2)'
_SC = ("dice", "hd95", "sensitivity", "precision")


@query("a16_multi_seed_summary", with_ctes(fx.F8, _SEEDS, body="select run_id, count(*) as n_seeds, " + ", ".join(f'avg("{c}") as mean_{c}, stddev_pop("{c}") as std_{c}' for c in _SC) + " from sd group by 1 having count(*) >= 2"))
def _(spark, sf):
    return reports.multi_seed_summary(reports.seed_means(fx.run_scores(spark, sf)))


@query("a16_seed_means", with_ctes(fx.F8, _SEEDS, body="select * from sd"))
def _(spark, sf):
    return reports.seed_means(fx.run_scores(spark, sf))


_PAIR = """base as (select case_id, avg(dice) as b from f8 where run_id = 1 group by 1), mine as (select run_id, case_id, avg(dice) as dice from f8 where run_id <> 1 group by 1, 2),
 df as (select run_id, case_id, dice - b as diff from mine join base using (case_id))"""


@query("a26_paired_test", with_ctes(fx.F8, _PAIR, body="select run_id, count(*) as n, avg(diff) as mean_diff, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) as t, count(*) filter (diff > 0) as wins from df group by 1"))
def _(spark, sf):
    return reports.paired_test(fx.run_scores(spark, sf), 1)


@query("j11_run_vs_baseline", with_ctes(fx.F8, "b as (select seed, case_id, dice as base_dice from f8 where run_id = 1)", body="select f8.run_id, f8.seed, f8.case_id, dice, base_dice from f8 join b on b.seed = f8.seed and b.case_id = f8.case_id where run_id <> 1"))
def _(spark, sf):
    scores = fx.run_scores(spark, sf)
    base = scores.where("run_id = 1").select("seed", "case_id", F.col("dice").alias("base_dice"))
    return scores.where("run_id <> 1").select("run_id", "seed", "case_id", "dice").join(base, ["seed", "case_id"])


@query("a27_retention", with_ctes(fx.F8, body="""select run_id, avg(dice) filter (seed = 42) as matched, avg(dice) filter (seed = 43) as changed,
 case when avg(dice) filter (seed = 42) > 0 then avg(dice) filter (seed = 43) / avg(dice) filter (seed = 42) end as retention from f8 group by 1"""))
def _(spark, sf):
    cells = fx.run_scores(spark, sf).select("run_id", F.when(F.col("seed") == 42, "full").otherwise("sliding").alias("condition"), F.col("dice").alias("score"))
    return reports.retention(cells, "full", "sliding")


_RES = "rec as (select run_id, case_id, avg(dice) as dice, 0.5::double + (run_id % 2) * 0.25::double as threshold from f8 group by 1, 2), rep as (select run_id, case_id, dice as reported_dice, 0.5::double as reported_threshold from f8 where seed = 42)"


@query("a32_rescore_delta", with_ctes(fx.F8, _RES, body="select rec.run_id, rec.case_id, dice, case when abs(threshold - reported_threshold) < 1e-9 then dice - reported_dice end as delta from rec left join rep on rep.run_id = rec.run_id and rep.case_id = rec.case_id"))
def _(spark, sf):
    scores = fx.run_scores(spark, sf)
    rec = scores.groupBy("run_id", "case_id").agg(F.avg("dice").alias("dice")).withColumn("threshold", 0.5 + (F.col("run_id") % 2) * 0.25)
    rep = scores.where("seed = 42").select("run_id", "case_id", F.col("dice").alias("reported_dice"), F.lit(0.5).alias("reported_threshold"))
    return reports.rescore_delta(rec, rep)


_WORST = "cs as (select s_suppkey as case_id, s_suppkey * 7 % 1000 as pos from supplier), sc as (select case_id, avg(dice) as score from f8 where case_id % 9 <> 4 group by 1)"


def worst(spark, sf):
    cases = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case_id"), (F.col("s_suppkey") * 7 % 1000).alias("pos"))
    scores = fx.run_scores(spark, sf).where("case_id % 9 <> 4").groupBy("case_id").agg(F.avg("dice").alias("score"))
    return cases, scores


@query("j12_scores_to_cases", with_ctes(fx.F8, _WORST, body="select pos, cs.case_id, coalesce(score, 1.0) as score from cs left join sc on sc.case_id = cs.case_id"))
def _(spark, sf):
    cases, scores = worst(spark, sf)
    return cases.join(scores, "case_id", "left").select("pos", "case_id", F.coalesce("score", F.lit(1.0)).alias("score"))


@query("t02_worst_first", with_ctes(fx.F8, _WORST, body="select pos, cs.case_id, coalesce(score, 1.0) as score from cs left join sc on sc.case_id = cs.case_id order by score, pos"))
def _(spark, sf):
    return reports.worst_first(*worst(spark, sf))


@query("p06_safe_ratio", with_ctes(fx.F2, body="""select case_id, slice_idx, case when n_pos > 0 then slice_mean / n_pos else 0.0 end as ratio, case when slice_mean > 0 then (n_pos - slice_mean) * 100.0::double / slice_mean else 0.0 end as change_pct,
 slice_mean / greatest(n_pos, 1) as per_positive from f2"""))
def _(spark, sf):
    n, m = F.col("n_pos"), F.col("slice_mean")
    return fx.slices(spark, sf).select(
        "case_id", "slice_idx", scalars.safe_ratio(m, n).alias("ratio"), scalars.change_pct(n, m).alias("change_pct"), scalars.ratio_to_at_least_one(m, n).alias("per_positive")
    )
