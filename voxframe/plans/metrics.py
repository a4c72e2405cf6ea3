"""Overlap metrics, sweep, joins and evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import evaluate, masks, overlap, reports, sweep
from ..session import cut_lineage
from ..sources import tables
from . import fixtures as fx
from .catalog import query, with_ctes

CONF = f"""conf as (select c.case_id, cast(coalesce(sum(pred * gt), 0) as bigint) as tp, cast(coalesce(sum(pred * (1 - gt)), 0) as bigint) as fp,
  cast(coalesce(sum((1 - pred) * gt), 0) as bigint) as fn from cases c left join mask m on m.case_id = c.case_id group by 1),
 conf4 as (select case_id, tp, fp, fn, cast({fx.N_VOXELS} - tp - fp - fn as bigint) as tn from conf)"""

RULES = {
    "dice_3d": "case when tp + fp + fn = 0 then 1.0 when tp + fp = 0 or tp + fn = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end",
    "iou_3d": "case when tp + fp + fn = 0 then 1.0 else tp / (tp + fp + fn) end",
    "sensitivity_3d": "case when tp + fn = 0 then 1.0 else tp / (tp + fn) end",
    "precision_3d": "case when tp + fp + fn = 0 then 1.0 when tp + fp = 0 then 0.0 else tp / (tp + fp) end",
    "specificity_3d": "case when tn + fp = 0 then 1.0 else tn / (tn + fp) end",
}
MET = "met as (select *, " + ", ".join(f"cast({v} as double) as {k}" for k, v in RULES.items()) + " from conf4)"
FLAGS = """flagged as (select *, dice_3d < 0.1 and tp + fn > 0 as is_failure, tp + fn = 0 as gt_empty, tp + fp = 0 as pred_empty from met)"""
BASE = (fx.F1, fx.VOXEL_CASES, fx.MASK, CONF, MET, FLAGS)

# Components of a voxel set by reachability: a label only moves to voxels with a higher raster index.
NB = "nb as (select * from (values (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(dx,dy,dz))"


def components_sql(source: str, out: str, ny: int = fx.NY, nz: int = fx.NZ) -> str:
    rid = f"(x * {ny} + y) * {nz} + z"
    pid = f"(p.x * {ny} + p.y) * {nz} + p.z"
    return f"""{out}_reach(case_id, x, y, z, label) as (select case_id, x, y, z, cast({rid} as bigint) from {source} union
  select p.case_id, p.x, p.y, p.z, r.label from {out}_reach r, nb, {source} p
  where p.case_id = r.case_id and p.x = r.x + dx and p.y = r.y + dy and p.z = r.z + dz and r.label < {pid}),
 {out} as (select case_id, x, y, z, min(label) as label from {out}_reach group by all)"""


def distance_sql(mask: str, out: str) -> str:
    def skin(flag):
        return f"""{out}_{flag} as (select p.case_id, p.x, p.y, p.z from {mask} p cross join nb
  left join {mask} q on q.case_id = p.case_id and q.x = p.x + dx and q.y = p.y + dy and q.z = p.z + dz and q.{flag} = 1
  where p.{flag} = 1 group by all having count(q.x) < 6)"""

    def side(query, target, name):
        return f"""select s.case_id, '{name}' as direction, s.x, s.y, s.z,
  min(sqrt(pow((s.x - t.x) * sx, 2) + pow((s.y - t.y) * sy, 2) + pow((s.z - t.z) * sz, 2))) as distance
  from {out}_{query} s join {mask} t on t.case_id = s.case_id and t.{target} = 1 join cases c on c.case_id = s.case_id group by all"""

    return f"{skin('pred')},\n {skin('gt')},\n {out} as ({side('pred', 'gt', 'p2g')} union all {side('gt', 'pred', 'g2p')})"


def hd_asd_sql(dist: str, out: str) -> str:
    return f"""{out}_d as (select case_id, quantile_cont(distance, 0.95) as hd, (avg(distance) filter (direction = 'p2g') + avg(distance) filter (direction = 'g2p')) / 2 as ad
  from {dist} group by 1),
 {out} as (select c.case_id, coalesce(hd, 100.0) as hd95_3d, coalesce(ad, 100.0) as asd_3d from cases c left join {out}_d d on d.case_id = c.case_id)"""


PRED = "pred as (select case_id, x, y, z from mask where pred = 1)"
PCOMP = components_sql("pred", "pcomp")
FPC = """fpc as (select case_id, cast(sum(case when hit = 0 then 1 else 0 end) as bigint) as fp_components from (
  select p.case_id, p.label, max(coalesce(m.gt, 0)) as hit from pcomp p join mask m on m.case_id = p.case_id and m.x = p.x and m.y = p.y and m.z = p.z group by all) group by 1)"""
SURF = (distance_sql("mask", "dist"), hd_asd_sql("dist", "hda"))
FULL = (*BASE, NB, PRED, PCOMP, FPC, *SURF,
        "full_met as (select f.*, coalesce(fp_components, 0) as fp_components, hd95_3d, asd_3d from flagged f left join fpc using (case_id) join hda using (case_id))")


def mask(spark, sf):
    return masks.pair_from_scores(fx.scored_voxels(spark, sf))


def full_metrics(spark, sf):
    """The whole bundle; the paired mask feeds several branches, so it is written once."""
    return evaluate.case_metrics(cut_lineage(mask(spark, sf)), fx.voxel_cases(spark, sf))


def confusion(spark, sf):
    return overlap.confusion(mask(spark, sf), fx.voxel_cases(spark, sf))


def overlap_rows(spark, sf):
    return overlap.overlap_metrics(confusion(spark, sf))


def categories(spark, sf):
    """Size class of each F1 case by its true physical volume."""
    cases = fx.voxel_cases(spark, sf)
    volume = fx.scored_voxels(spark, sf).where("gt = 1").groupBy("case_id").agg(F.count("*").alias("n"))
    joined = cases.join(volume, "case_id").where("case_id % 7 <> 3")
    return joined.select("case_id", scalars.classify_size(F.col("n") * F.col("voxel_mm3") * F.lit(8.0)).alias("tumor_category"))


CATS = """cats as (select c.case_id, case when n * voxel_mm3 * 8.0 < 1000 then 'small' when n * voxel_mm3 * 8.0 < 5000 then 'medium' else 'large' end as tumor_category
  from cases c join (select case_id, count(*) as n from f1 where gt = 1 group by 1) v on v.case_id = c.case_id where c.case_id % 7 <> 3)"""


@query("p03_binarize", with_ctes(fx.F1, body="select case_id, count(*) filter (prob > 0.5) as above, count(*) filter (gt > 0) as positive from f1 group by 1"))
def _(spark, sf):
    v = fx.scored_voxels(spark, sf)
    return v.groupBy("case_id").agg(F.count_if(scalars.binarize(F.col("prob"))).alias("above"), F.count_if(F.col("gt") > 0).alias("positive"))


@query("j01_align_masks", with_ctes(fx.F1, body="""select coalesce(p.case_id, g.case_id) as case_id, coalesce(p.x, g.x) as x, coalesce(p.y, g.y) as y, coalesce(p.z, g.z) as z,
 case when p.case_id is null then 0 else 1 end as pred, case when g.case_id is null then 0 else 1 end as gt
 from (select * from f1 where prob > 0.5) p full join (select * from f1 where gt = 1) g on p.case_id = g.case_id and p.x = g.x and p.y = g.y and p.z = g.z"""))
def _(spark, sf):
    v = fx.scored_voxels(spark, sf)
    return masks.align_masks(v.where("prob > 0.5"), v.where("gt = 1"))


@query("a01_confusion", with_ctes(*BASE, body="select * from conf4"))
def _(spark, sf):
    return confusion(spark, sf)


for _id, _name in (("a02", "dice"), ("a03", "iou"), ("a04", "sensitivity"), ("a05", "precision"), ("a06", "specificity")):
    query(f"{_id}_{_name}", with_ctes(*BASE, body=f"select case_id, {_name}_3d from met"))(
        lambda spark, sf, n=_name: overlap_rows(spark, sf).select("case_id", f"{n}_3d")
    )


@query("a07_failures", with_ctes(*BASE, body="select case_id, is_failure from flagged"))
def _(spark, sf):
    return overlap_rows(spark, sf).select("case_id", "is_failure")


@query("a08_empty_flags", with_ctes(*BASE, body="select count(*) as n, count(*) filter (gt_empty) as gt_empty, count(*) filter (pred_empty) as pred_empty from flagged"))
def _(spark, sf):
    return overlap_rows(spark, sf).agg(F.count("*").alias("n"), F.count_if("gt_empty").alias("gt_empty"), F.count_if("pred_empty").alias("pred_empty"))


@query("a09_case_metrics", with_ctes(*FULL, body="select * from full_met"))
def _(spark, sf):
    return full_metrics(spark, sf)


@query("a10_macro_average", with_ctes(*FULL, body="select " + ", ".join(f"avg({c}) as {c}" for c in evaluate.METRIC_COLUMNS) + " from full_met"))
def _(spark, sf):
    return overlap.macro_average(full_metrics(spark, sf), evaluate.METRIC_COLUMNS)


_MICRO = """pool as (select cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, cast(sum(tn) as bigint) as tn from conf4)"""


@query("a11_micro_average", with_ctes(*BASE, _MICRO, body="""select tp, fp, fn, tn, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 1.0 end as dice_3d,
 case when tp + fp + fn > 0 then tp / (tp + fp + fn) else 1.0 end as iou_3d, case when tp + fn > 0 then tp / (tp + fn) else 1.0 end as sensitivity_3d,
 case when tp + fp > 0 then tp / (tp + fp) else 1.0 end as precision_3d, case when tn + fp > 0 then tn / (tn + fp) else 1.0 end as specificity_3d from pool"""))
def _(spark, sf):
    return overlap.micro_average(confusion(spark, sf))


_TS = ", ".join(f"({t}::double)" for t in sweep.DEFAULT_THRESHOLDS)
_SWEEP = f"""ts as (select * from (values {_TS}) t(threshold)),
 per as (select case_id, threshold, count(*) filter (prob > threshold) as pred, count(*) filter (prob > threshold and gt = 1) as inter, cast(sum(gt) as bigint) as gt
  from f1, ts group by 1, 2),
 swept as (select *, case when pred = 0 and gt = 0 then 1.0 when pred = 0 or gt = 0 then 0.0 else 2.0 * inter / (pred + gt) end as dice from per),
 means as (select threshold, round(cast(sum(cast(dice as decimal(28,15))) as double) / count(*), 6) as mean_dice from swept group by 1)"""


# the candidate in thousandths is an exact key; many means are equal
_CANDIDATE = "select cast(round(threshold * 1000) as int) as candidate, mean_dice from means"


@query("a12_threshold_sweep", with_ctes(fx.F1, _SWEEP, body=_CANDIDATE))
def _(spark, sf):
    scored = fx.scored_voxels(spark, sf)
    swept = sweep.threshold_sweep(scored, truth_cases=scored.where("gt is not null").select("case_id").distinct())
    return swept.select(F.round(F.col("threshold") * 1000).cast("int").alias("candidate"), "mean_dice")


@query("a12_best_threshold", with_ctes(fx.F1, _SWEEP, body="select threshold as best_threshold, mean_dice as best_dice from means order by mean_dice desc, threshold limit 1"))
def _(spark, sf):
    return sweep.best_threshold(sweep.threshold_sweep(fx.scored_voxels(spark, sf)))


@query("j10_sweep_by_case", with_ctes(fx.F1, _SWEEP, body="select case_id, threshold, pred, inter, gt, dice from swept"))
def _(spark, sf):
    return sweep.sweep_by_case(fx.scored_voxels(spark, sf))


@query("w06_suffix_sums", with_ctes(fx.F1, body="""select case_id, cast(floor(prob * 10) as bigint) as bucket, cast(sum(count(*)) over (partition by case_id order by floor(prob * 10) desc) as bigint) as at_or_above
 from f1 group by case_id, floor(prob * 10)"""))
def _(spark, sf):
    from pyspark.sql import Window as W

    hist = fx.scored_voxels(spark, sf).groupBy("case_id", F.floor(F.col("prob") * 10).alias("bucket")).agg(F.count("*").alias("n"))
    above = W.partitionBy("case_id").orderBy("bucket").rowsBetween(W.currentRow, W.unboundedFollowing)
    return hist.select("case_id", "bucket", F.sum("n").over(above).alias("at_or_above"))


@query("f7_metrics_by_language", with_ctes(fx.F7, """conf as (select case_id, cast(sum(case when prob > 0.5 and gt = 1 then 1 else 0 end) as bigint) as tp,
  cast(sum(case when prob > 0.5 and gt = 0 then 1 else 0 end) as bigint) as fp, cast(sum(case when prob <= 0.5 and gt = 1 then 1 else 0 end) as bigint) as fn,
  cast(sum(case when prob <= 0.5 and gt = 0 then 1 else 0 end) as bigint) as tn from f7 group by 1)""", MET.replace("conf4", "conf"), body="select * from met"))
def _(spark, sf):
    items = fx.scored_items(spark, sf)
    cases = items.groupBy("case_id").agg(F.count("*").alias("n_voxels"))
    flagged = items.select("case_id", (F.col("prob") > 0.5).cast("int").alias("pred"), "gt")
    return overlap.overlap_metrics(overlap.confusion(flagged, cases)).drop("is_failure", "gt_empty", "pred_empty")


_STRATA_COLS = reports.STRATA_METRICS
_LONG = " union all ".join(f"select tumor_category, '{m}' as metric, {m} as value, is_failure from joined" for m in _STRATA_COLS)


@query("a13_stratified_report", with_ctes(*FULL, CATS, "joined as (select f.*, coalesce(tumor_category, 'unknown') as tumor_category from full_met f left join cats using (case_id))",
    f"long as ({_LONG})", "frame as (select * from (values ('small'),('medium'),('large')) a(tumor_category), (values " + ",".join(f"('{m}')" for m in _STRATA_COLS) + ") b(metric))",
    body="""select frame.tumor_category, frame.metric, count(value) as n_patients, avg(value) as mean, quantile_cont(value, 0.5) as median, stddev_pop(value) as std,
 case when count(value) > 0 then avg(case when is_failure then 100.0::double else 0.0::double end) end as failure_rate_pct
 from frame left join long on long.tumor_category = frame.tumor_category and long.metric = frame.metric group by 1, 2"""))
def _(spark, sf):
    metrics = full_metrics(spark, sf)
    return reports.stratified_report(evaluate.with_category(metrics, categories(spark, sf)))


@query("a14_run_summary", with_ctes(*FULL, body="""select count(*) as n_patients, avg(dice_3d) as mean_dice_3d, avg(iou_3d) as mean_iou_3d, avg(sensitivity_3d) as mean_sensitivity_3d,
 avg(precision_3d) as mean_precision_3d, avg(specificity_3d) as mean_specificity_3d, avg(hd95_3d) as mean_hd95_3d, avg(asd_3d) as mean_asd_3d, avg(fp_components) as mean_fp_components,
 count(*) filter (is_failure) as failure_count, count(*) filter (is_failure) * 100.0::double / count(*) as failure_rate_percent,
 count(*) filter (gt_empty) as gt_empty_count, count(*) filter (pred_empty) as pred_empty_count, median(dice_3d) as median_dice_3d from full_met"""))
def _(spark, sf):
    return reports.run_summary(full_metrics(spark, sf))


@query("a17_fast_dice", with_ctes(fx.F1, """s as (select case_id, sum(case when prob > 0.5 and gt = 1 then 1 else 0 end) as ih, sum(case when prob > 0.5 then 1 else 0 end) as ph,
  sum(prob * gt) as isf, sum(prob) as psf, sum(gt) as g from f1 group by 1)""", body="""select case_id, case when ph = 0 and g = 0 then 1.0 when ph = 0 or g = 0 then 0.0 else 2.0 * ih / (ph + g) end as dice_hard,
 case when psf = 0 and g = 0 then 1.0 when psf = 0 or g = 0 then 0.0 else 2.0 * isf / (psf + g) end as dice_soft from s"""))
def _(spark, sf):
    return overlap.fast_dice(fx.scored_voxels(spark, sf))


@query("a18_inference_time", """with b as (select floor(event_id / 16) as batch, user_id as case_id, value / 1000 as seconds from events),
 n as (select batch, count(*) as size, max(seconds) as secs from b group by 1)
 select case_id, sum(secs / size) as inference_time_sec from b join n using (batch) group by 1""")
def _(spark, sf):
    rows = fx.table(spark, sf, "events").select(F.floor(F.col("event_id") / 16).alias("batch"), F.col("user_id").alias("case_id"), (F.col("value") / 1000).alias("s"))
    sizes = rows.groupBy("batch").agg(F.count("*").alias("batch_size"), F.max("s").alias("batch_seconds"))
    return overlap.inference_time(rows.join(sizes.hint("merge"), "batch"))  # both sides grow with the input


_SLICE = """sl as (select case_id, z as slice_idx, cast(sum(gt) as bigint) as gt_count, cast(sum(pred) as bigint) as pred_count, cast(sum(pred * gt) as bigint) as overlap from mask group by 1, 2),
 sd as (select *, case when gt_count + pred_count > 0 then 2.0 * overlap / (gt_count + pred_count) else 0.0 end as dice from sl)"""


@query("a28_slice_overlap", with_ctes(fx.F1, fx.MASK, _SLICE, body="select * from sd"))
def _(spark, sf):
    return masks.slice_overlap(mask(spark, sf))


def _target(name, value, where="true"):
    return f"select case_id, '{name}' as target, slice_idx, cast({value} as double) as amount from sd where {where} and {value} > 0 qualify row_number() over (partition by case_id order by {value} desc, slice_idx) = 1"


@query("t01_notable_slices", with_ctes(fx.F1, fx.MASK, _SLICE, body="select * from (" + ") union all select * from (".join([
    _target("largest_truth", "gt_count"), _target("best_match", "dice", "gt_count > 0"),
    _target("largest_miss", "(gt_count - overlap)", "gt_count > 0"), _target("largest_false_positive", "(pred_count - overlap)")]) + ")"))
def _(spark, sf):
    return masks.notable_slices(mask(spark, sf))


@query("t03_peak_slice", with_ctes(fx.F2, """depth as (select case_id, max(slice_idx) + 1 as n_slices from f2 group by 1),
 top as (select case_id, slice_idx from f2 where n_pos > 0 qualify row_number() over (partition by case_id order by n_pos desc, slice_idx) = 1)""",
    body="select d.case_id, coalesce(t.slice_idx, n_slices // 2) as peak_slice from depth d left join top t on t.case_id = d.case_id"))
def _(spark, sf):
    s = fx.slices(spark, sf)
    return masks.peak_slice(s, s.groupBy("case_id").agg((F.max("slice_idx") + 1).alias("n_slices")))


@query("t05_z_profile", with_ctes(fx.F1, fx.VOXEL_CASES, fx.MASK, _SLICE, body=f"""select c.case_id, s.i as slice_idx, coalesce(gt_count, 0) as gt_count, coalesce(pred_count, 0) as pred_count
 from cases c cross join (select unnest(range(0, {fx.NZ})) as i) s left join sl on sl.case_id = c.case_id and sl.slice_idx = s.i"""))
def _(spark, sf):
    return masks.z_profile(mask(spark, sf), fx.voxel_cases(spark, sf))


@query("t05_z_ranges", with_ctes(fx.F1, fx.MASK, _SLICE, body="""select case_id, min(slice_idx) filter (gt_count > 0) as gt_first, max(slice_idx) filter (gt_count > 0) as gt_last,
 count(*) filter (gt_count > 0) as gt_slices, min(slice_idx) filter (pred_count > 0) as pred_first, max(slice_idx) filter (pred_count > 0) as pred_last,
 count(*) filter (pred_count > 0) as pred_slices from sl group by 1"""))
def _(spark, sf):
    return masks.z_ranges(mask(spark, sf))


@query("j02_slice_labels", with_ctes(fx.F2, fx.F10, body="select f10.case_id, f10.slice_idx, f10.n_pos as pred, f2.n_pos as label from f10 join f2 on f2.case_id = f10.case_id and f2.slice_idx = f10.slice_idx"))
def _(spark, sf):
    labels = fx.slices(spark, sf).select("case_id", "slice_idx", F.col("n_pos").alias("label"))
    return fx.turns(spark, sf).withColumnRenamed("n_pos", "pred").join(labels, ["case_id", "slice_idx"])


@query("j03_missing_truth", "select doc_id as case_id from documents where doc_id not in (select doc_id from labels) order by 1 limit 5")
def _(spark, sf):
    preds = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"))
    truth = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"))
    return sweep.missing_truth(preds, truth)


@query("j04_with_metadata", with_ctes(fx.F2, fx.F9, body="""select f2.case_id, f2.slice_idx, n_pos, flip_x, sp_xy from f2 join f9 on f9.case_id = f2.case_id where f9.case_id % 10 <> 0"""))
def _(spark, sf):
    meta = fx.case_geometry(spark, sf).where("case_id % 10 <> 0").select("case_id", "flip_x", "sp_xy")
    return fx.slices(spark, sf).select("case_id", "slice_idx", "n_pos").join(meta, "case_id")


@query("j04_without_metadata", with_ctes(fx.F2, fx.F9, body="select distinct case_id from f2 where case_id not in (select case_id from f9 where case_id % 10 <> 0)"))
def _(spark, sf):
    meta = fx.case_geometry(spark, sf).where("case_id % 10 <> 0")
    return tables.without_metadata(fx.slices(spark, sf), meta)


@query("j06_size_category", with_ctes(*BASE, CATS, body="select case_id, coalesce(tumor_category, 'unknown') as tumor_category, dice_3d from met left join cats using (case_id)"))
def _(spark, sf):
    named = evaluate.with_category(overlap_rows(spark, sf), categories(spark, sf))
    return named.select("case_id", "tumor_category", "dice_3d")


@query("j07_index_filter", with_ctes(fx.F2, fx.F9, body="select case_id, slice_idx, n_pos from f2 where case_id in (select case_id from f9 where flip_x = 1)"))
def _(spark, sf):
    index = fx.case_geometry(spark, sf).where("flip_x = 1")
    return fx.slices(spark, sf).select("case_id", "slice_idx", "n_pos").join(index, "case_id", "left_semi")


@query("snk01_case_metrics", with_ctes(*FULL, CATS, body="""select case_id, coalesce(tumor_category, 'unknown') as tumor_category, dice_3d, iou_3d, sensitivity_3d, precision_3d, specificity_3d,
 hd95_3d, asd_3d, fp_components, is_failure, cast(null as double) as inference_time_sec from full_met left join cats using (case_id) order by case_id"""))
def _(spark, sf):
    metrics = full_metrics(spark, sf)
    return evaluate.export_frame(metrics, categories(spark, sf))


@query("t04_sorted_export", with_ctes(*BASE, body="select case_id, dice_3d from met order by case_id"))
def _(spark, sf):
    return overlap_rows(spark, sf).select("case_id", "dice_3d").orderBy("case_id")
