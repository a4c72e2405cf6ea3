"""Components, filtering, surfaces, distances and body boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, distance, evaluate, geometry, masks, overlap, reports
from ..session import cut_lineage
from . import fixtures as fx
from .catalog import query, with_ctes
from .metrics import BASE, CONF, FLAGS, FULL, MET, NB, PCOMP, PRED, components_sql, distance_sql, hd_asd_sql, mask

TRUTH = "truth as (select case_id, x, y, z from f1 where gt = 1)"
TCOMP = components_sql("truth", "tcomp")


def truth(spark, sf):
    return fx.scored_voxels(spark, sf).where("gt = 1").select(*masks.VOXEL)


def truth_components(spark, sf):
    return components.connected_components(truth(spark, sf), fx.NY, fx.NZ)


def pred_components(spark, sf):
    return components.connected_components(mask(spark, sf).where("pred = 1").select(*masks.VOXEL), fx.NY, fx.NZ)


@query("c01_connected_components", with_ctes(fx.F1, NB, TRUTH, TCOMP, body="select * from tcomp"))
def _(spark, sf):
    return truth_components(spark, sf)


@query("c01_components_small_blocks", with_ctes(fx.F1, fx.MASK, NB, PRED, PCOMP, body="select * from pcomp"))
def _(spark, sf):
    """The same operator cut into 4-voxel cubes, so that labels meet across faces, and joined by stars."""
    return components.connected_components(mask(spark, sf).where("pred = 1").select(*masks.VOXEL), fx.NY, fx.NZ, block=4, local_edges=0)


@query("c02_component_stats", with_ctes(fx.F1, fx.VOXEL_CASES, NB, TRUTH, TCOMP, """sz as (select case_id, label, count(*) as size from tcomp group by 1, 2),
 agg as (select case_id, count(*) as n, max(size) as top, sum(size) as total from sz group by 1)""",
    body="""select c.case_id, coalesce(n, 0) as n_components, coalesce(top, 0) as largest_voxels, coalesce(top, 0) * voxel_mm3 as largest_mm3,
 case when total > 0 then top * 100.0::double / total else 0.0 end as largest_pct from cases c left join agg a on a.case_id = c.case_id"""))
def _(spark, sf):
    return components.component_stats(truth_components(spark, sf), fx.voxel_cases(spark, sf))


@query("c03_fp_components", with_ctes(*FULL, body="select * from fpc"))
def _(spark, sf):
    return components.fp_components(pred_components(spark, sf), truth(spark, sf))


_FATE = """sz as (select case_id, label, count(*) as size from pcomp group by 1, 2),
 fate as (select case_id, label, size, size >= 0.1::double * max(size) over (partition by case_id)
   or row_number() over (partition by case_id order by size desc, label) = 1 as keep from sz)"""


@query("c04_component_fate", with_ctes(fx.F1, fx.MASK, NB, PRED, PCOMP, _FATE, body="select * from fate"))
def _(spark, sf):
    return components.component_fate(pred_components(spark, sf))


@query("c04_filter_components", with_ctes(fx.F1, fx.MASK, NB, PRED, PCOMP, _FATE, body="select p.* from pcomp p join fate f on f.case_id = p.case_id and f.label = p.label where keep"))
def _(spark, sf):
    return components.filter_components(pred_components(spark, sf))


_PP = (*FULL, _FATE, "kept as (select p.case_id, p.x, p.y, p.z, p.label from pcomp p join fate f on f.case_id = p.case_id and f.label = p.label where keep)",
       """mask2 as (select m.case_id, m.x, m.y, m.z, case when k.label is null then 0 else 1 end as pred, m.gt from mask m left join kept k
  on k.case_id = m.case_id and k.x = m.x and k.y = m.y and k.z = m.z where m.gt = 1 or k.label is not null)""",
       CONF.replace("conf4", "conf4b").replace("conf as", "confb as").replace("from conf)", "from confb)").replace("join mask m", "join mask2 m"),
       MET.replace("met as", "metb as").replace("conf4", "conf4b"), FLAGS.replace("flagged as", "flaggedb as").replace("from met", "from metb"),
       """fpcb as (select case_id, cast(sum(case when hit = 0 then 1 else 0 end) as bigint) as fp_components from (
  select k.case_id, k.label, max(m.gt) as hit from kept k join mask2 m on m.case_id = k.case_id and m.x = k.x and m.y = k.y and m.z = k.z group by all) group by 1)""",
       distance_sql("mask2", "distb"), hd_asd_sql("distb", "hdb"),
       "removed as (select case_id, cast(count(*) filter (not keep) as bigint) as pp_components_removed from fate group by 1)",
       """pp as (select f.case_id, f.dice_3d as pp_dice_3d, f.iou_3d as pp_iou_3d, f.sensitivity_3d as pp_sensitivity_3d, f.precision_3d as pp_precision_3d,
  f.specificity_3d as pp_specificity_3d, h.hd95_3d as pp_hd95_3d, h.asd_3d as pp_asd_3d, coalesce(b.fp_components, 0) as pp_fp_components, f.is_failure as pp_is_failure,
  coalesce(pp_components_removed, 0) as pp_components_removed from flaggedb f left join fpcb b using (case_id) join hdb h using (case_id) left join removed using (case_id))""")


@query("c05_pp_metrics", with_ctes(*_PP, body="select * from pp"))
def _(spark, sf):
    both, _ = evaluate.evaluate(cut_lineage(mask(spark, sf)), fx.voxel_cases(spark, sf))
    drop = {"pp_tp", "pp_fp", "pp_fn", "pp_tn"}
    return both.select("case_id", *[c for c in both.columns if c.startswith("pp_") and c not in drop])


_DELTA = " union all ".join(f"select '{m}' as metric, avg({m}) as raw, avg(pp_{m}) as filtered from both_sets" for m in reports.DELTA_METRICS)


@query("a15_postproc_delta", with_ctes(*_PP, "both_sets as (select * from full_met join pp using (case_id))",
    f"rows_ as ({_DELTA} union all select 'failures', count(*) filter (is_failure), count(*) filter (pp_is_failure) from both_sets)",
    body="select metric, raw, filtered, filtered - raw as delta, (select avg(pp_components_removed) from both_sets) as mean_removed from rows_"))
def _(spark, sf):
    both, _ = evaluate.evaluate(cut_lineage(mask(spark, sf)), fx.voxel_cases(spark, sf))
    return reports.postproc_delta(both)


@query("a11_micro_average_filtered", with_ctes(*_PP, "pool as (select cast(sum(tp) as bigint) tp, cast(sum(fp) as bigint) fp, cast(sum(fn) as bigint) fn, cast(sum(tn) as bigint) tn from conf4b)",
    body="""select tp, fp, fn, tn, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 1.0 end as dice_3d,
 case when tp + fp + fn > 0 then tp / (tp + fp + fn) else 1.0 end as iou_3d, case when tp + fn > 0 then tp / (tp + fn) else 1.0 end as sensitivity_3d,
 case when tp + fp > 0 then tp / (tp + fp) else 1.0 end as precision_3d, case when tn + fp > 0 then tn / (tn + fp) else 1.0 end as specificity_3d from pool"""))
def _(spark, sf):
    pair = mask(spark, sf)
    kept = components.filter_components(pred_components(spark, sf))
    filtered = masks.align_masks(kept, pair.where("gt = 1"))
    return overlap.micro_average(overlap.confusion(filtered, fx.voxel_cases(spark, sf)))


@query("s06_export_columns", with_ctes(*_PP, body="select case_id, dice_3d, null::double as pp_dice_3d from full_met where case_id % 2 = 0 union all select case_id, dice_3d, pp_dice_3d from full_met join pp using (case_id) where case_id % 2 = 1"))
def _(spark, sf):
    """Runs with and without filtered columns under one schema."""
    both, _ = evaluate.evaluate(cut_lineage(mask(spark, sf)), fx.voxel_cases(spark, sf))
    plain = both.where("case_id % 2 = 0").select("case_id", "dice_3d")
    return plain.unionByName(both.where("case_id % 2 = 1").select("case_id", "dice_3d", "pp_dice_3d"), allowMissingColumns=True)


@query("g19_surface", with_ctes(fx.F1, fx.VOXEL_CASES, fx.MASK, NB, distance_sql("mask", "dist"),
    body="""select coalesce(p.case_id, g.case_id) as case_id, coalesce(p.x, g.x) as x, coalesce(p.y, g.y) as y, coalesce(p.z, g.z) as z,
 case when p.x is null then 0 else 1 end as pred_surface, case when g.x is null then 0 else 1 end as gt_surface
 from dist_pred p full join dist_gt g on p.case_id = g.case_id and p.x = g.x and p.y = g.y and p.z = g.z"""))
def _(spark, sf):
    return masks.surface(mask(spark, sf)).drop("in_pred", "in_gt")


@query("d01_surface_distances", with_ctes(fx.F1, fx.VOXEL_CASES, fx.MASK, NB, distance_sql("mask", "dist"), body="select case_id, direction, distance from dist"))
def _(spark, sf):
    return distance.surface_distances(mask(spark, sf), fx.voxel_cases(spark, sf))


@query("d02_hd95", with_ctes(fx.F1, fx.VOXEL_CASES, fx.MASK, NB, distance_sql("mask", "dist"), hd_asd_sql("dist", "h"), body="select case_id, hd95_3d from h"))
def _(spark, sf):
    cases = fx.voxel_cases(spark, sf)
    return distance.hd95(distance.surface_distances(mask(spark, sf), cases), cases)


@query("d03_asd", with_ctes(fx.F1, fx.VOXEL_CASES, fx.MASK, NB, distance_sql("mask", "dist"), hd_asd_sql("dist", "h"), body="select case_id, asd_3d from h"))
def _(spark, sf):
    cases = fx.voxel_cases(spark, sf)
    return distance.asd(distance.surface_distances(mask(spark, sf), cases), cases)


@query("j08_nearest_foreground", with_ctes(fx.F1, fx.VOXEL_CASES, fx.MASK, NB, distance_sql("mask", "dist"),
    body="select case_id, direction, count(*) as n, max(distance) as farthest, avg(distance) as mean_distance from dist group by 1, 2"))
def _(spark, sf):
    d = distance.surface_distances(mask(spark, sf), fx.voxel_cases(spark, sf))
    return d.groupBy("case_id", "direction").agg(F.count("*").alias("n"), F.max("distance").alias("farthest"), F.avg("distance").alias("mean_distance"))


@query("j09_voxel_adjacency", with_ctes(fx.F1, NB, TRUTH, body="""select a.case_id, a.x, a.y, a.z, b.x as nx, b.y as ny, b.z as nz from truth a, nb, truth b
 where b.case_id = a.case_id and b.x = a.x + dx and b.y = a.y + dy and b.z = a.z + dz and dx + dy + dz = 1"""))
def _(spark, sf):
    return masks.adjacency(truth(spark, sf))


_BBOX = f"""sz as (select case_id, label, count(*) as size from tcomp group by 1, 2),
 body as (select case_id, label from sz qualify row_number() over (partition by case_id order by size desc, label) = 1),
 ext as (select t.case_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from tcomp t join body b on b.case_id = t.case_id and b.label = t.label group by 1),
 bbox as (select c.case_id, coalesce(greatest(0, x0 - 1), 0) as x_min, coalesce(least({fx.NX}, x1 + 2), {fx.NX}) as x_max, coalesce(greatest(0, y0 - 1), 0) as y_min,
  coalesce(least({fx.NY}, y1 + 2), {fx.NY}) as y_max, coalesce(greatest(0, z0 - 1), 0) as z_min, coalesce(least({fx.NZ}, z1 + 2), {fx.NZ}) as z_max
  from cases c left join ext e on e.case_id = c.case_id)"""
_BOX = (fx.F1, fx.VOXEL_CASES, NB, TRUTH, TCOMP, _BBOX)


def boxes(spark, sf):
    return geometry.body_bbox(truth_components(spark, sf), fx.voxel_cases(spark, sf).withColumnRenamed("n_slices", "nz"), margin=1)


@query("g09_body_bbox", with_ctes(*_BOX, body="select * from bbox"))
def _(spark, sf):
    return boxes(spark, sf)


@query("g10_crop", with_ctes(*_BOX, body="""select f1.case_id, x - x_min as x, y - y_min as y, z - z_min as z, prob, gt from f1 join bbox b on b.case_id = f1.case_id
 where x >= x_min and x < x_max and y >= y_min and y < y_max and z >= z_min and z < z_max"""))
def _(spark, sf):
    return geometry.crop(fx.scored_voxels(spark, sf), boxes(spark, sf))


@query("g11_uncrop", with_ctes(*_BOX, body="""select f1.case_id, x, y, z, prob, gt from f1 join bbox b on b.case_id = f1.case_id
 where x >= x_min and x < x_max and y >= y_min and y < y_max and z >= z_min and z < z_max"""))
def _(spark, sf):
    box = boxes(spark, sf)
    return geometry.uncrop(geometry.crop(fx.scored_voxels(spark, sf), box), box)
