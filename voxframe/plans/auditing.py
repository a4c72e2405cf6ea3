"""Audit statistics, integrity, duplicates and slice reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from . import fixtures as fx
from .catalog import query, with_ctes

LABEL_ABOVE = 0.1
_LBL = f"lb as (select *, case when case_id % 17 <> 0 and v > {LABEL_ABOVE}::double then 1.0::double else 0.0::double end as g from px)"


def volumes(spark, sf):
    return fx.pixel_slices(spark, sf).select("case_id", "slice_idx", "pixels", F.lit(8).alias("height"), F.lit(8).alias("width"))


def label_slices(spark, sf):
    """0/1 masks from the pixel arrays; every seventeenth case is empty."""
    keep = F.col("case_id") % 17 != 0
    return volumes(spark, sf).withColumn("pixels", F.transform("pixels", lambda v: F.when(keep & (v > LABEL_ABOVE), 1.0).otherwise(0.0)))


@query("a19_intensity_stats", with_ctes(fx.F4, body="""select case_id, min(v) as min, max(v) as max, avg(v) as mean, stddev_pop(v) as std, quantile_cont(v, 0.05) as p5, quantile_cont(v, 0.95) as p95 from px group by 1"""))
def _(spark, sf):
    return audit.intensity_stats(volumes(spark, sf))


def headers(spark, sf):
    k = F.col("case_id")
    depth = volumes(spark, sf).groupBy("case_id").agg(F.count("*").cast("int").alias("n"))
    flip = F.when(k % 13 == 0, -1.0).otherwise(1.0)
    shift = F.when(k % 7 == 0, 0.001).otherwise(0.0)

    def affine(sign, extra):
        zero = F.lit(0.0)
        return F.array(
            F.array(F.lit(-0.5), zero, zero, F.lit(10.0) + extra), F.array(zero, F.lit(0.5) * sign, zero, F.lit(-4.0)),
            F.array(zero, zero, F.lit(2.0), F.lit(1.0)), F.array(zero, zero, zero, F.lit(1.0)),
        )

    return depth.select(
        "case_id", F.array(F.lit(8), F.lit(8), F.col("n")).alias("img_shape"),
        F.array(F.lit(8), F.lit(8), F.col("n") + F.when(k % 11 == 0, 1).otherwise(0)).alias("lbl_shape"),
        affine(F.lit(1.0), F.lit(0.0)).alias("img_affine"), affine(flip, shift).alias("lbl_affine"),
    )


@query("a20_integrity", with_ctes(fx.F4, _LBL, """s as (select case_id, count(distinct slice_idx) as n, min(v) as lo, max(v) as hi, count(*) filter (g > 0) as pos from lb group by 1),
 f as (select *, case_id % 11 <> 0 as shape_match, greatest(case when case_id % 13 = 0 then 1.0::double else 0.0::double end, case when case_id % 7 = 0 then 0.001::double else 0.0::double end) as max_affine_diff,
  'LAS' as img_orientation, case when case_id % 13 = 0 then 'LPS' else 'LAS' end as lbl_orientation from s)""",
    body="""select case_id, shape_match, max_affine_diff, max_affine_diff < 1e-4 as affine_match, img_orientation, lbl_orientation, img_orientation = lbl_orientation as orientation_match,
 true as is_mask_binary, false as img_has_nan, false as img_has_inf, false as lbl_has_nan, false as lbl_has_inf, hi - lo < 1e-5 as is_empty_image, pos = 0 as is_empty_mask,
 concat_ws('; ', case when not shape_match then 'image and label differ in shape: 8x8x' || n || ' vs 8x8x' || (n + 1) end, case when max_affine_diff > 1e-4 then 'image and label lie differently in space' end,
  case when img_orientation <> lbl_orientation then 'axis codes differ: LAS vs LPS' end, case when hi = lo then 'all image values are equal' end, case when pos = 0 then 'nothing is labelled' end) as problems from f"""))
def _(spark, sf):
    return audit.integrity(headers(spark, sf), volumes(spark, sf), label_slices(spark, sf))


@query("a21_slice_stats", with_ctes(fx.F2, body="""select case_id, max(slice_idx) + 1 as n_slices, count(*) filter (n_pos > 0) as positive_slices, max(slice_idx) + 1 - count(*) filter (n_pos > 0) as negative_slices,
 cast(sum(n_pos) as bigint) as tumor_voxels, count(*) filter (n_pos > 0) * 100.0::double / (max(slice_idx) + 1) as positive_pct from f2 group by 1"""))
def _(spark, sf):
    s = fx.slices(spark, sf)
    return audit.slice_stats(s, depth_of(s))


def depth_of(slices):
    return slices.groupBy("case_id").agg((F.max("slice_idx") + 1).alias("n_slices"))


@query("a22_z_extent", with_ctes(fx.F2, body="""select case_id, coalesce(min(slice_idx) filter (n_pos > 0), -1) as z_min, coalesce(max(slice_idx) filter (n_pos > 0), -1) as z_max,
 coalesce((min(slice_idx) filter (n_pos > 0) + max(slice_idx) filter (n_pos > 0)) / 2.0::double / (max(slice_idx) + 1), 0.0) as z_center_rel from f2 group by 1"""))
def _(spark, sf):
    s = fx.slices(spark, sf)
    return audit.z_extent(s, depth_of(s))


_N = 5
_DN = f"cast(floor(i * (7::double / {_N - 1}) + 0.5) as int)"
_UP = f"cast(floor(i * ({_N - 1}::double / 7) + 0.5) as int)"


@query("a23_resize_loss", with_ctes(fx.F4, _LBL, f"dn as (select i, {_DN} as j from range(0, {_N}) t(i))", f"up as (select i, {_UP} as j from range(0, 8) t(i))",
    "small as (select case_id, slice_idx, a.i as r, b.i as c, g from lb join dn a on a.j = lb.r join dn b on b.j = lb.c)",
    "back as (select case_id, slice_idx, a.i as r, b.i as c, g from small join up a on a.j = small.r join up b on b.j = small.c)",
    """sl as (select case_id, slice_idx, sum(g) as before from lb group by 1, 2), ss as (select case_id, slice_idx, sum(g) as small from small group by 1, 2),
 bb as (select b.case_id, b.slice_idx, sum(b.g) as back, sum(b.g * l.g) as common from back b join lb l on l.case_id = b.case_id and l.slice_idx = b.slice_idx and l.r = b.r and l.c = b.c group by 1, 2),
 t as (select case_id, count(*) filter (before > 0 and small = 0) as pos_slices_lost, sum(before) as before, sum(small) as small, sum(back) as back, sum(common) as common
  from sl join ss using (case_id, slice_idx) join bb using (case_id, slice_idx) group by 1)""",
    body=f"""select case_id, pos_slices_lost, small as voxels_after, small * 64.0::double / {_N * _N} - before as voxels_diff,
 case when before > 0 then (small * 64.0::double / {_N * _N} - before) * 100.0::double / before else 0.0 end as volume_change_pct,
 case when before = 0 and back = 0 then 1.0 when before = 0 or back = 0 then 0.0 else 2.0 * common / (before + back) end as dice_ceiling from t"""))
def _(spark, sf):
    return audit.resize_loss(label_slices(spark, sf), _N, _N)


@query("a24_audit_summary", with_ctes(fx.F3, body="""select count(*) as n_cases, bool_and(volume > 0) as all_has_volume, bool_and(n_components > 0) as all_has_component, count(*) filter (n_components > 0) as n_has_component,
 min(volume) as min_volume, avg(volume) as mean_volume, max(volume) as max_volume, min(positive_slices) as min_positive_slices, avg(positive_slices) as mean_positive_slices,
 max(positive_slices) as max_positive_slices, count(distinct n_components) as distinct_n_components from f3"""))
def _(spark, sf):
    rows = fx.case_stats(spark, sf).withColumns({"has_volume": F.col("volume") > 0, "has_component": F.col("n_components") > 0})
    return audit.audit_summary(rows, ["has_volume", "has_component"], ["has_component"], ["volume", "positive_slices"], ["n_components"])


@query("a24_value_counts", "select source, count(*) as n from documents group by 1")
def _(spark, sf):
    return audit.value_counts(fx.fingerprints(spark, sf), "source")


@query("s05_value_domain", with_ctes(fx.F4, _LBL, body="select distinct g as value from lb"))
def _(spark, sf):
    return audit.value_domain(label_slices(spark, sf))


@query("a30_duplicates", with_ctes(fx.F6, body="""select case_id, case_id as pos, fingerprint, count(*) over (partition by fingerprint) as copies,
 case when first_value(case_id) over (partition by fingerprint order by case_id) <> case_id then first_value(case_id) over (partition by fingerprint order by case_id) end as duplicate_of from f6"""))
def _(spark, sf):
    return audit.duplicates(fx.fingerprints(spark, sf).select("case_id", "pos", "fingerprint"))


@query("w01_first_seen", with_ctes(fx.F6, body="select fingerprint, min(case_id) as first_case, count(*) as copies from f6 group by 1"))
def _(spark, sf):
    return fx.fingerprints(spark, sf).groupBy("fingerprint").agg(F.min_by("case_id", "pos").alias("first_case"), F.count("*").alias("copies"))


@query("a30_volume_duplicates", with_ctes(fx.F4, _LBL, """h as (select case_id, string_agg(slice_idx || ':' || p || ':' || g, ',' order by slice_idx, p) as content from lb group by 1)""",
    body="select count(*) as n_cases, count(distinct content) as n_distinct from h"))
def _(spark, sf):
    prints = audit.fingerprint_volumes(label_slices(spark, sf))
    per = prints.groupBy("fingerprint").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_cases"), F.count("*").alias("n_distinct"))
