"""Preparation of slice arrays: body boxes, inversion, quality rows and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bodies, prepare, reconstruct
from ..session import cut_lineage
from . import fixtures as fx
from .auditing import _LBL, label_slices, volumes
from .catalog import query, with_ctes
from .metrics import NB, components_sql

# pixel values of F4 as intensities, the prepared size, and the margin around the body
SCALE, OFFSET, SIZE, MARGIN = 3000.0, -1000.0, 8, 1


def canonical(slices):
    """F4 slices with depth and unit spacing, so that resampling to 1 mm changes nothing."""
    depth = slices.groupBy("case_id").agg(F.count("*").cast("int").alias("n_slices"))
    one = {f"s{a}": F.lit(1.0) for a in "xyz"}
    return slices.join(depth, "case_id").withColumns(one)


def image_slices(spark, sf):
    return canonical(volumes(spark, sf)).withColumn("pixels", F.transform("pixels", lambda v: v * SCALE + OFFSET))


def headers(spark, sf):
    """Flipped in x, with some labels that differ in depth, orientation or place."""
    k = F.col("case_id")
    depth = volumes(spark, sf).groupBy("case_id").agg(F.count("*").cast("int").alias("n"))
    zero, one = F.lit(0.0), F.lit(1.0)

    def affine(y, extra):
        return F.array(F.array(-one, zero, zero, F.lit(7.0) + extra), F.array(zero, y, zero, zero), F.array(zero, zero, one, zero), F.array(zero, zero, zero, one))

    return depth.select(
        "case_id", F.array(F.lit(8), F.lit(8), F.col("n")).alias("img_shape"), F.array(F.lit(8), F.lit(8), F.col("n") + F.when(k % 11 == 0, 1).otherwise(0)).alias("lbl_shape"),
        affine(one, zero).alias("img_affine"), affine(F.when(k % 13 == 0, -1.0).otherwise(1.0), F.when(k % 7 == 0, 0.001).otherwise(0.0)).alias("lbl_affine"),
        F.array(one, one, one).alias("spacing"),
    )


def truth(spark, sf):
    """Label voxels where they lie before the flip is undone."""
    cells = label_slices(spark, sf).select("case_id", "slice_idx", F.posexplode("pixels").alias("p", "v")).where("v > 0.5")
    return cells.select("case_id", (7 - F.floor(F.col("p") / 8)).cast("int").alias("x"), (F.col("p") % 8).cast("int").alias("y"), F.col("slice_idx").alias("z"))


def prepared(spark, sf):
    # read by the search, the checks and the cut
    images, labels = cut_lineage(image_slices(spark, sf)), cut_lineage(canonical(label_slices(spark, sf)))
    return prepare.prepare(headers(spark, sf), images, labels, truth(spark, sf), (SIZE, SIZE), margin=MARGIN)


_BODY = f"body as (select case_id, r as x, c as y, slice_idx as z from px where v * {SCALE}::double + {OFFSET}::double > -500)"
_BOX = f"""dp as (select case_id, count(*) as n from f4 group by 1),
 bsz as (select case_id, label, count(*) as size from bcomp group by 1, 2),
 bfirst as (select case_id, label from bsz qualify row_number() over (partition by case_id order by size desc, label) = 1),
 bext as (select b.case_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from bcomp b join bfirst f on f.case_id = b.case_id and f.label = b.label group by 1),
 box as (select dp.case_id, n, coalesce(greatest(0, x0 - {MARGIN}), 0) as x_min, coalesce(least(8, x1 + {MARGIN + 1}), 8) as x_max, coalesce(greatest(0, y0 - {MARGIN}), 0) as y_min,
  coalesce(least(8, y1 + {MARGIN + 1}), 8) as y_max, coalesce(greatest(0, z0 - {MARGIN}), 0) as z_min, coalesce(least(n, z1 + {MARGIN + 1}), n) as z_max from dp left join bext e on e.case_id = dp.case_id)"""
BOXES = (fx.F4, NB, _BODY, components_sql("body", "bcomp", 8, 64), _BOX)


def _axis(src: str, out: str, axis: str, n_in: str, n_out: str) -> str:
    """Linear resampling of one axis of rows (case_id, h, w, s, r, c, v)."""
    cols = ", ".join("o.i as " + a if a == axis else a for a in ("s", "r", "c"))
    step = f"(case when {n_out} > 1 then cast({n_in} - 1 as double) / ({n_out} - 1) else 0.0 end)"
    return f"""{out} as (select case_id, h, w, {cols}, sum(v * (1 - abs(o.i * {step} - {axis}))) as v from {src}, (select unnest(range(0, 16)) as i) o
  where o.i < {n_out} and abs(o.i * {step} - {axis}) < 1 group by all)"""


_CHAIN = ("""cl as (select lb.case_id, x_max - x_min as h, y_max - y_min as w, slice_idx - z_min as s, r - x_min as r, c - y_min as c, g as v from lb join box on box.case_id = lb.case_id
  where r >= x_min and r < x_max and c >= y_min and c < y_max and slice_idx >= z_min and slice_idx < z_max)""",
          _axis("cl", "l1", "r", "h", str(SIZE)), _axis("l1", "l2", "c", "w", str(SIZE)), "pl as (select case_id, h, w, s, r, c, case when v > 0.5 then 1.0::double else 0.0::double end as v from l2)",
          _axis("pl", "b1", "r", str(SIZE), "h"), _axis("b1", "b2", "c", str(SIZE), "w"),
          "rc as (select b2.case_id, r + x_min as r, c + y_min as c, s + z_min as s from b2 join box on box.case_id = b2.case_id where v > 0.5)",
          """cmp as (select case_id, sum(t * b) as both_, sum(t) as own, sum(b) as back from (
   select coalesce(l.case_id, rc.case_id) as case_id, case when l.case_id is null then 0 else 1 end as t, case when rc.case_id is null then 0 else 1 end as b
   from (select * from lb where g = 1) l full join rc on rc.case_id = l.case_id and rc.r = l.r and rc.c = l.c and rc.s = l.slice_idx) group by 1)""",
          """rt as (select box.case_id, coalesce(own, 0) as own, coalesce(back, 0) as back, case when coalesce(own, 0) + coalesce(back, 0) = 0 then 1.0::double else 2.0::double * coalesce(both_, 0) / (coalesce(own, 0) + coalesce(back, 0)) end as dice
   from box left join cmp on cmp.case_id = box.case_id)""")
CHAIN = (*BOXES, _LBL, *_CHAIN)

_SL = """so as (select case_id, count(*) filter (k > 0) as n from (select case_id, slice_idx, sum(g) as k from lb group by 1, 2) group by 1),
 sc as (select case_id, count(*) filter (k > 0) as n, sum(k) as vox from (select case_id, s, sum(v) as k from cl group by 1, 2) group by 1),
 sp as (select case_id, count(*) filter (k > 0) as n from (select case_id, s, sum(v) as k from pl group by 1, 2) group by 1),
 rg as (select case_id, min(v) as lo, max(v) as hi from px group by 1)"""
_QC = """qc as (select b.case_id, 'LAS' as orientation, b.case_id % 11 <> 0 as shape_match, greatest(case when b.case_id % 13 = 0 then 2.0::double else 0.0::double end, case when b.case_id % 7 = 0 then 0.001::double else 0.0::double end) as affine_max_diff,
  '8x8x' || b.n as original_shape, '1.000x1.000x1.000' as original_spacing, '8x8x' || b.n as resampled_shape, (x_max - x_min) || 'x' || (y_max - y_min) || 'x' || (z_max - z_min) as cropped_shape,
  cast(round_even(100.0::double * (x_max - x_min) * (y_max - y_min) * (z_max - z_min) / (64 * b.n), 2) as double) as crop_retained_pct, z_max - z_min as n_slices_kept, cast(own as bigint) as n_tumor_voxels_original, cast(coalesce(sc.vox, 0) as bigint) as n_tumor_voxels_cropped,
  so.n as n_pos_slices_original, coalesce(sc.n, 0) as n_pos_slices_before_resize, coalesce(sp.n, 0) as n_pos_slices_after_resize, coalesce(sc.n, 0) - coalesce(sp.n, 0) as pos_slices_lost_to_resize,
  cast(own as double) as tumor_volume_original_mm3, cast(back as double) as tumor_volume_reconstructed_mm3, case when own > 0 then cast(round_even(100.0::double * (back - own) / own, 3) as double) else 0.0::double end as tumor_volume_change_pct,
  cast(round_even(dice, 4) as double) as roundtrip_dice,
  concat_ws('; ', case when b.case_id % 11 = 0 then 'image and label differ in shape: 8x8x' || b.n || ' vs 8x8x' || (b.n + 1) end, case when b.case_id % 13 = 0 or b.case_id % 7 = 0 then 'image and label lie differently in space' end,
   case when b.case_id % 13 = 0 then 'axis codes differ: LAS vs LPS' end, case when hi = lo then 'all image values are equal' end, case when own = 0 then 'nothing is labelled' end) as problems
  from box b join rt on rt.case_id = b.case_id join so on so.case_id = b.case_id left join sc on sc.case_id = b.case_id left join sp on sp.case_id = b.case_id join rg on rg.case_id = b.case_id)"""
QUALITY = (*CHAIN, _SL, _QC)


@query("g09_body_box_of_arrays", with_ctes(*BOXES, body="select case_id, x_min, x_max, y_min, y_max, z_min, z_max from box"))
def _(spark, sf):
    images = image_slices(spark, sf)
    shapes = images.groupBy("case_id").agg(F.first("height").alias("nx"), F.first("width").alias("ny"), F.first("n_slices").alias("nz"))
    return bodies.body_box(images, shapes, MARGIN)


@query("g09_body_components", with_ctes(*BOXES, body="select case_id, size, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from bcomp join bsz using (case_id, label) group by case_id, label, size"))
def _(spark, sf):
    return bodies.body_components(image_slices(spark, sf)).drop("label")


@query("g14_roundtrip_qc", with_ctes(*CHAIN, body="select case_id, dice as roundtrip_dice, dice < 0.8 as flagged from rt"))
def _(spark, sf):
    images, labels = image_slices(spark, sf), canonical(label_slices(spark, sf))
    small, prepared_labels, shaped = reconstruct.preprocess(images, labels, (SIZE, SIZE), margin=MARGIN)
    metadata = prepare.inversion_records(headers(spark, sf), shaped, (SIZE, SIZE), 1.0)
    return reconstruct.roundtrip_qc(prepared_labels, metadata, truth(spark, sf))


@query("snk02_qc_row", with_ctes(*QUALITY, body="select * from qc"))
def _(spark, sf):
    return prepared(spark, sf).qc


@query("snk02_preparation_cost", with_ctes(*QUALITY, body="""select count(*) as n_cases, avg(roundtrip_dice) as mean_roundtrip_dice, min(roundtrip_dice) as min_roundtrip_dice, max(roundtrip_dice) as max_roundtrip_dice,
 cast(sum(pos_slices_lost_to_resize) as bigint) as positive_slices_lost, count(*) filter (pos_slices_lost_to_resize > 0) as cases_affected, avg(tumor_volume_change_pct) as mean_volume_change_pct,
 avg(crop_retained_pct) as mean_crop_retained_pct, min(roundtrip_dice) < 0.8 as low_roundtrip from qc"""))
def _(spark, sf):
    return prepare.preparation_cost(prepared(spark, sf).qc)


@query("src05_prepared_index", with_ctes(*CHAIN, """im as (select px.case_id, x_max - x_min as h, y_max - y_min as w, slice_idx - z_min as s, r - x_min as r, c - y_min as c,
   (least(greatest(v * 3000.0::double - 1000.0::double, -1000), 400) + 1000) / 1400.0::double as v from px join box on box.case_id = px.case_id
   where r >= x_min and r < x_max and c >= y_min and c < y_max and slice_idx >= z_min and slice_idx < z_max)""", _axis("im", "i1", "r", "h", str(SIZE)), _axis("i1", "i2", "c", "w", str(SIZE)),
    """fl as (select i.case_id, i.s, m, k from (select case_id, s, avg(v) as m from i2 group by 1, 2) i join (select case_id, s, sum(v) as k from pl group by 1, 2) l on l.case_id = i.case_id and l.s = i.s)""",
    body="""select case_id, count(*) as n_slices, coalesce(string_agg(cast(s as varchar), ',' order by s) filter (k > 0), '') as positive_slices, coalesce(string_agg(cast(s as varchar), ',' order by s) filter (m > 0.05), '') as body_slices,
 cast(sum(k) as bigint) as tumor_voxels from fl group by 1"""))
def _(spark, sf):
    index = prepared(spark, sf).index
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return index.select("case_id", "n_slices", text("positive_slices"), text("body_slices"), "tumor_voxels")
