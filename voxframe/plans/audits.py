"""The assembled audit over arrays with broken values, missing labels and copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit_table
from ..session import cut_lineage, scratch_path
from ..sources import sinks
from . import fixtures as fx
from .auditing import _DN, _N, _UP, LABEL_ABOVE, volumes
from .catalog import query, with_ctes
from .metrics import NB, components_sql

STATS = ("min", "max", "mean", "std", "p5", "p95")


def image_slices(spark, sf):
    """F4 with a NaN or an infinite pixel in the first slice of some cases."""
    k, first = F.col("case_id"), F.col("slice_idx") == 0
    odd = F.when(first & (k % 19 == 3), F.lit(float("nan"))).when(first & (k % 23 == 4), F.lit(float("inf")))
    return volumes(spark, sf).withColumn("pixels", F.transform("pixels", lambda v, i: F.when((i == 5) & odd.isNotNull(), odd).otherwise(v)))


def label_slices(spark, sf):
    """Masks of F4; some hold a 2, a NaN or nothing, and every third pair of cases has equal ones."""
    k, first = F.col("case_id"), F.col("slice_idx") == 0
    odd = F.when(first & (k % 29 == 5), F.lit(2.0)).when(first & (k % 31 == 6), F.lit(float("nan")))
    full = F.col("case_id") % 17 != 0
    mask = volumes(spark, sf).withColumn("pixels", F.transform("pixels", lambda v: F.when(full & (v > LABEL_ABOVE), 1.0).otherwise(0.0)))
    return mask.withColumn("pixels", F.transform("pixels", lambda v, i: F.when((i == 5) & odd.isNotNull(), odd).otherwise(v)))


def headers(spark, sf):
    """Header rows; a case has a label if the label table knows a document of its number."""
    k = F.col("case_id")
    known = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("case_id")).distinct().withColumn("known", F.lit(True))
    depth = volumes(spark, sf).groupBy("case_id").agg(F.count("*").cast("int").alias("n")).join(known, "case_id", "left")
    zero, sx, sz = F.lit(0.0), 0.5 + (k % 5) * 0.125, 1.0 + (k % 4) * 0.5

    def affine(y, extra):
        return F.array(F.array(-sx, zero, zero, F.lit(7.0) + extra), F.array(zero, sx * y, zero, zero), F.array(zero, zero, sz, zero), F.array(zero, zero, zero, F.lit(1.0)))

    labelled = lambda c: F.when(F.col("known"), c)
    return depth.select(
        "case_id", F.array(F.lit(8), F.lit(8), F.col("n")).alias("img_shape"), labelled(F.array(F.lit(8), F.lit(8), F.col("n") + F.when(k % 11 == 0, 1).otherwise(0))).alias("lbl_shape"),
        affine(F.lit(1.0), zero).alias("img_affine"), labelled(affine(F.when(k % 13 == 0, -1.0).otherwise(1.0), F.when(k % 7 == 0, 0.001).otherwise(0.0))).alias("lbl_affine"),
        F.array(sx, sx, sz).alias("spacing"), F.when(F.col("known").isNull(), F.lit("no label")).alias("error"),
    )


def table(spark, sf):
    cases = volumes(spark, sf).select("case_id").distinct().select(
        "case_id", F.col("case_id").alias("pos"), F.concat(F.lit("images/c"), F.col("case_id").cast("string")).alias("image"), F.concat(F.lit("labels/c"), F.col("case_id").cast("string")).alias("label"))
    images, labels = cut_lineage(image_slices(spark, sf)), cut_lineage(label_slices(spark, sf))
    return audit_table.audit_table(cases, headers(spark, sf), images, labels, (_N, _N))


_ODD = f"""dp as (select case_id, count(*) as n, 0.5::double + (case_id % 5) * 0.125::double as sx, 1.0::double + (case_id % 4) * 0.5::double as sz from f4 group by 1),
 im as (select case_id, slice_idx, p, case when slice_idx = 0 and p = 5 and case_id % 19 = 3 then 'nan'::double when slice_idx = 0 and p = 5 and case_id % 23 = 4 then 'inf'::double else v end as v from px),
 la as (select case_id, slice_idx, p, r, c, case when slice_idx = 0 and p = 5 and case_id % 29 = 5 then 2.0::double when slice_idx = 0 and p = 5 and case_id % 31 = 6 then 'nan'::double
   when case_id % 17 <> 0 and v > {LABEL_ABOVE}::double then 1.0::double else 0.0::double end as g from px),
 lb as (select case_id, slice_idx, p, r, c, case when g > 0 then 1.0::double else 0.0::double end as g from la),
 known as (select distinct doc_id as case_id from labels where doc_id in (select case_id from dp)),
 ist as (select case_id, bool_or(isnan(v)) as has_nan, bool_or(isinf(v)) as has_inf, min(v) as lo, max(v) as hi, avg(v) filter (not isnan(v)) as m, quantile_cont(v, 0.05) as p5, quantile_cont(v, 0.95) as p95,
   stddev_pop(v) filter (isfinite(v)) as sd, string_agg(slice_idx || ':' || p || ':' || v, ',' order by slice_idx, p) as content from im join known using (case_id) group by 1),
 lst as (select case_id, bool_or(isnan(g)) as has_nan, bool_or(g not in (0.0, 1.0)) as odd, cast(count(*) filter (g > 0) as bigint) as vox, '[' || string_agg(distinct lower(g::varchar), ', ' order by lower(g::varchar)) || ']' as vals,
   string_agg(slice_idx || ':' || p || ':' || g, ',' order by slice_idx, p) as content from la join known using (case_id) group by 1),
 sl as (select case_id, slice_idx, sum(g) as k from lb join known using (case_id) group by 1, 2),
 zs as (select case_id, count(*) filter (k > 0) as np, min(slice_idx) filter (k > 0) as z0, max(slice_idx) filter (k > 0) as z1 from sl group by 1),
 tv as (select case_id, r as x, c as y, slice_idx as z from lb join known using (case_id) where g > 0)"""
_PARTS = """csz as (select case_id, label, count(*) as size from tc group by 1, 2), cst as (select case_id, count(*) as nc, max(size) as top from csz group by 1)"""
_LOSS = (f"dn as (select i, {_DN} as j from range(0, {_N}) t(i))", f"up as (select i, {_UP} as j from range(0, 8) t(i))",
         "small as (select case_id, slice_idx, a.i as r, b.i as c, g from lb join dn a on a.j = lb.r join dn b on b.j = lb.c)",
         "back as (select case_id, slice_idx, a.i as r, b.i as c, g from small join up a on a.j = small.r join up b on b.j = small.c)",
         """ss as (select case_id, slice_idx, sum(g) as small from small group by 1, 2),
 bb as (select b.case_id, b.slice_idx, sum(b.g) as back, sum(b.g * l.g) as common from back b join lb l on l.case_id = b.case_id and l.slice_idx = b.slice_idx and l.r = b.r and l.c = b.c group by 1, 2),
 lo as (select case_id, count(*) filter (k > 0 and small = 0) as lost, sum(k) as before, sum(small) as small, sum(back) as back, sum(common) as common
  from sl join ss using (case_id, slice_idx) join bb using (case_id, slice_idx) group by 1)""")
_FULL = f"""au as (select d.case_id, d.case_id as pos, 'images/c' || d.case_id as image, 'labels/c' || d.case_id as label, true as img_exists, k.case_id is not null as lbl_exists,
  coalesce(k.case_id % 11 <> 0, false) as shape_match, coalesce(k.case_id % 13 <> 0 and k.case_id % 7 <> 0, false) as affine_match,
  coalesce(greatest(case when k.case_id % 13 = 0 then 2 * sx else 0.0::double end, case when k.case_id % 7 = 0 then 0.001::double else 0.0::double end), 0.0) as max_affine_diff,
  case when k.case_id is null then 0 else 8 end as width, case when k.case_id is null then 0 else 8 end as height, case when k.case_id is null then 0 else n end as num_slices,
  case when k.case_id is not null then '8x8x' || n end as img_shape, case when k.case_id is not null then '8x8x' || (n + case when d.case_id % 11 = 0 then 1 else 0 end) end as lbl_shape,
  case when k.case_id is not null then 'LAS' end as img_orientation, case when k.case_id is not null then case when d.case_id % 13 = 0 then 'LPS' else 'LAS' end end as lbl_orientation, coalesce(k.case_id % 13 <> 0, false) as orientation_match,
  case when k.case_id is null then 0.0::double else sx end as spacing_x, case when k.case_id is null then 0.0::double else sx end as spacing_y, case when k.case_id is null then 0.0::double else sz end as spacing_z,
  case when k.case_id is null then 0.0::double else sx * sx * sz end as voxel_vol_mm3,
  case when k.case_id is null then 0.0::double when not i.has_nan then lo end as "img_min_HU", case when k.case_id is null then 0.0::double when not i.has_nan and not i.has_inf then hi end as "img_max_HU",
  case when k.case_id is null then 0.0::double when not i.has_nan and not i.has_inf then m end as "img_mean_HU", case when k.case_id is null then 0.0::double when not i.has_nan and not i.has_inf then sd end as "img_std_HU",
  case when k.case_id is null then 0.0::double when not i.has_nan then p5 end as "img_p5_HU", case when k.case_id is null then 0.0::double when not i.has_nan then p95 end as "img_p95_HU",
  coalesce(l.vox, 0) as tumor_voxels, coalesce(l.vox * sx * sx * sz, 0.0) as tumor_volume_mm3, coalesce(l.vox * 100.0::double / (64 * n), 0.0) as tumor_ratio_percent,
  coalesce(np, 0) as positive_slices, coalesce(n - np, 0) as negative_slices, l.vals as mask_unique_values, coalesce(not l.odd, true) as is_mask_binary,
  coalesce(i.has_nan, false) as img_has_nan, coalesce(i.has_inf, false) as img_has_inf, coalesce(l.has_nan, false) as lbl_has_nan, false as lbl_has_inf,
  coalesce(hi - lo < 1e-5, false) as is_empty_image, coalesce(l.vox = 0, false) as is_empty_mask,
  case when first_value(i.case_id) over (partition by i.content order by d.case_id) <> i.case_id then first_value(i.case_id) over (partition by i.content order by d.case_id) end as img_duplicate_of,
  case when first_value(l.case_id) over (partition by l.content order by d.case_id) <> l.case_id then first_value(l.case_id) over (partition by l.content order by d.case_id) end as lbl_duplicate_of,
  coalesce(nc, 0) as num_connected_components_3d, coalesce(top, 0) as largest_component_voxels, coalesce(top * sx * sx * sz, 0.0) as largest_component_vol_mm3, coalesce(top * 100.0::double / l.vox, 0.0) as largest_component_ratio_pct,
  coalesce(z0, -1) as tumor_z_min, coalesce(z1, -1) as tumor_z_max, coalesce((z0 + z1) / 2.0::double / n, 0.0) as tumor_z_center_rel,
  coalesce(lost, 0) as pos_slices_lost_after_resize, cast(coalesce(small, 0) as bigint) as tumor_voxels_after_resize, coalesce(small * 64.0::double / {_N * _N} - before, 0.0) as tumor_voxels_diff,
  coalesce(case when before > 0 then (small * 64.0::double / {_N * _N} - before) * 100.0::double / before else 0.0 end, 0.0) as tumor_volume_change_pct,
  coalesce(case when before = 0 and back = 0 then 1.0::double when before = 0 or back = 0 then 0.0::double else 2.0 * common / (before + back) end, 1.0::double) as preprocessing_pre_post_dice_3d,
  case when k.case_id is null then 'no label' end as error
  from dp d left join known k on k.case_id = d.case_id left join ist i on i.case_id = d.case_id left join lst l on l.case_id = d.case_id left join zs on zs.case_id = d.case_id
  left join cst on cst.case_id = d.case_id left join lo on lo.case_id = k.case_id)"""
AUDIT = (fx.F4, NB, _ODD, components_sql("tv", "tc", 8, 64), _PARTS, *_LOSS, _FULL)


@query("a20_audit_table", with_ctes(*AUDIT, body="select * from au"))
def _(spark, sf):
    rows = table(spark, sf)
    # NaN and infinite figures as NULL, so that both engines can be compared
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c)
    return rows.select(*[finite(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def _span(c, name):
    return f"min({c}) as {name}_min, avg({c}) as {name}_mean, max({c}) as {name}_max"


_TOTALS = f"""select count(*) as n_cases, count(*) filter (img_exists) as n_images, count(*) filter (lbl_exists) as n_labels, count(*) filter (shape_match) as n_shape, count(*) filter (affine_match) as n_affine,
 max(max_affine_diff) as max_affine_diff, count(*) filter (orientation_match) as n_orientation, {_span('spacing_x', 'sx')}, {_span('spacing_y', 'sy')}, {_span('spacing_z', 'sz')}, count(distinct spacing_z) as n_sz,
 count(*) filter (is_mask_binary) as n_binary, """ + ", ".join(f"count(*) filter ({c}) as n_{c}" for c in ("img_has_nan", "img_has_inf", "lbl_has_nan", "lbl_has_inf", "is_empty_image", "is_empty_mask")) + f""",
 count(img_duplicate_of) as n_img_copies, count(lbl_duplicate_of) as n_lbl_copies, {_span('tumor_volume_mm3', 'volume')}, cast(sum(num_slices) as bigint) as n_slices, cast(sum(positive_slices) as bigint) as n_positive,
 {_span('num_connected_components_3d', 'parts')}, avg(largest_component_ratio_pct) as largest_mean, min(largest_component_ratio_pct) as largest_min, cast(sum(pos_slices_lost_after_resize) as bigint) as n_lost,
 count(*) filter (pos_slices_lost_after_resize > 0) as n_losing, avg(tumor_volume_change_pct) as change_mean, avg(preprocessing_pre_post_dice_3d) as ceiling_mean, min(preprocessing_pre_post_dice_3d) as ceiling_min,
 case when sum(num_slices) > 0 then sum(positive_slices) * 100.0::double / sum(num_slices) else 0.0 end as positive_pct,
 """ + ", ".join(f"(select string_agg(o || ': ' || n, ', ' order by n desc, o) from (select {k}_orientation as o, count(*) as n from au where {k}_orientation is not null group by 1)) as {k}_codes" for k in ("img", "lbl")) + " from au"


@query("a24_audit_totals", with_ctes(*AUDIT, body=_TOTALS))
def _(spark, sf):
    return audit_table.audit_totals(cut_lineage(table(spark, sf)))


def _line_sql(text, columns):
    # DuckDB's printf follows C; a percent sign is doubled in both
    return f"printf('{text}', {', '.join(columns)})" if columns else f"'{text}'"


@query("snk04_audit_text", with_ctes(*AUDIT, f"totals as ({_TOTALS})", body="select unnest([" + ", ".join(_line_sql(t, c) for t, c in sinks.AUDIT_LINES) + "]) as value from totals"))
def _(spark, sf):
    path = scratch_path(spark, "audit-text")
    sinks.write_documents(sinks.markdown_report(audit_table.audit_totals(cut_lineage(table(spark, sf))), sinks.AUDIT_LINES), path)
    return spark.read.text(path)
