"""Slice arrays, geometry, augmentation and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import orientation as ori
from ..functions import registry, scalars
from ..operators import augment, geometry, inference, masks, reconstruct, resample
from ..operators.skew import attach, pieces_of
from . import fixtures as fx
from .auditing import _LBL, depth_of, label_slices, volumes
from .catalog import query, with_ctes

SEED, EPOCH = 42, 3


def hu_slices(spark, sf):
    return volumes(spark, sf).withColumn("pixels", F.transform("pixels", lambda v: v * 2000.0 - 300.0))


_HU = "hu as (select case_id, slice_idx, p, v * 2000.0::double - 300.0::double as h from px)"


@query("p01_hu_window", with_ctes(fx.F4, _HU, body="select case_id, slice_idx, p, (least(greatest(h, -1000), 400) + 1000) / 1400.0::double as v from hu"))
def _(spark, sf):
    return hu_slices(spark, sf).select("case_id", "slice_idx", F.posexplode(scalars.hu_window(F.col("pixels"))).alias("p", "v"))


@query("p02_window_presets", with_ctes(fx.F4, _HU, "ext as (select case_id, min(h) as lo, max(h) as hi from hu group by 1)", body="""select hu.case_id, slice_idx, sum(least(greatest(h, -1000), 400)) as lung, sum(least(greatest(h, -150), 250)) as mediastinum,
 sum(least(greatest(h, lo), hi)) as raw from hu join ext on ext.case_id = hu.case_id group by 1, 2"""))
def _(spark, sf):
    s = hu_slices(spark, sf)
    extent = s.groupBy("case_id").agg(F.min(F.array_min("pixels")).alias("lo"), F.max(F.array_max("pixels")).alias("hi"))
    rows = attach(s, extent, ["case_id"], ["slice_idx"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return rows.select(
        "case_id", "slice_idx", total(scalars.clip_window(F.col("pixels"), *scalars.LUNG_WINDOW)).alias("lung"),
        total(scalars.clip_window(F.col("pixels"), *scalars.MEDIASTINUM_WINDOW)).alias("mediastinum"),
        total(scalars.clip_window(F.col("pixels"), F.col("lo"), F.col("hi"))).alias("raw"),
    )


@query("p05_volumes", with_ctes(fx.F9, body="select case_id, sp_xy * sp_xy * sp_z as voxel_mm3, nx * ny * nz * sp_xy * sp_xy * sp_z as volume_mm3 from f9"))
def _(spark, sf):
    mm3 = scalars.voxel_volume(F.array("sp_xy", "sp_xy", "sp_z"))
    return fx.case_geometry(spark, sf).select("case_id", mm3.alias("voxel_mm3"), (F.col("nx") * F.col("ny") * F.col("nz") * mm3).alias("volume_mm3"))


@query("p07_formats", with_ctes(fx.F9, body="select case_id, nx || 'x' || ny || 'x' || nz as shape, printf('%.3fx%.3fx%.3f', sp_xy, sp_xy, sp_z) as spacing from f9"))
def _(spark, sf):
    return fx.case_geometry(spark, sf).select(
        "case_id", scalars.format_shape(F.array("nx", "ny", "nz")).alias("shape"), scalars.format_spacing(F.array("sp_xy", "sp_xy", "sp_z")).alias("spacing"))


@query("p08_round_half_even", with_ctes(fx.F9, body="select case_id, cast(round_even(sp_xy * 10, 0) as double) as tens, cast(round_even(sp_xy * sp_xy * sp_z, 2) as double) as mm3 from f9"))
def _(spark, sf):
    a, z = F.col("sp_xy"), F.col("sp_z")
    return fx.case_geometry(spark, sf).select("case_id", scalars.round_half_even(a * 10).alias("tens"), scalars.round_half_even(a * a * z, 2).alias("mm3"))


def case_affine():
    zero = F.lit(0.0)
    return F.array(
        F.array(F.col("flip_x") * F.col("sp_xy"), zero, zero, F.lit(10.0)), F.array(zero, F.col("flip_y") * F.col("sp_xy"), zero, F.lit(-5.0)),
        F.array(zero, zero, F.col("flip_z") * F.col("sp_z"), F.lit(2.0)), F.array(zero, zero, zero, F.lit(1.0)),
    )


def case_orientation():
    """Flips of F9 with an axis order that depends on the case."""
    k = F.col("case_id") % 3
    order = [F.when(k == 0, a).when(k == 1, b).otherwise(c) for a, b, c in ((0, 1, 1), (1, 0, 2), (2, 2, 0))]
    return F.array(*[F.array(o.cast("int"), F.col(f)) for o, f in zip(order, ("flip_x", "flip_y", "flip_z"))])


@query("g01_orientation", with_ctes(fx.F9, body="""select case_id, case when flip_x = -1 then 'L' else 'R' end || case when flip_y = -1 then 'P' else 'A' end || 'S' as codes,
 '0:' || flip_x || ' 1:' || flip_y || ' 2:1' as pairs from f9"""))
def _(spark, sf):
    text = F.array_join(F.transform(ori.orientation(case_affine()), lambda p: F.array_join(p.cast("array<string>"), ":")), " ")
    return fx.case_geometry(spark, sf).select("case_id", ori.axis_codes(case_affine()).alias("codes"), text.alias("pairs"))


@query("g02_invert_orientation", with_ctes(fx.F9, body="""select case_id, case case_id % 3 when 0 then '0:' || flip_x || ' 1:' || flip_y || ' 2:' || flip_z when 1 then '1:' || flip_y || ' 0:' || flip_x || ' 2:' || flip_z
 else '2:' || flip_z || ' 0:' || flip_x || ' 1:' || flip_y end as inverse from f9"""))
def _(spark, sf):
    text = F.array_join(F.transform(ori.invert_orientation(case_orientation()), lambda p: F.array_join(p.cast("array<string>"), ":")), " ")
    return fx.case_geometry(spark, sf).select("case_id", text.alias("inverse"))


@query("g04_canonical_affine", with_ctes(fx.F9, body="""select case_id, flip_x * sp_xy * flip_x as a00, flip_y * sp_xy * flip_y as a11, sp_z as a22,
 flip_x * sp_xy * (case when flip_x < 0 then nx - 1 else 0 end) + 10 as a03, flip_y * sp_xy * (case when flip_y < 0 then ny - 1 else 0 end) - 5 as a13, 2.0::double as a23 from f9"""))
def _(spark, sf):
    rows = fx.case_geometry(spark, sf).withColumn("affine", case_affine())
    out = ori.canonical_affine(F.col("affine"), F.array("nx", "ny", "nz"), ori.orientation(F.col("affine")))
    at = lambda r, c: F.element_at(F.element_at("m", r + 1), c + 1).alias(f"a{r}{c}")
    return rows.select("case_id", out.alias("m")).select("case_id", at(0, 0), at(1, 1), at(2, 2), at(0, 3), at(1, 3), at(2, 3))


def orientation_table(spark, sf):
    return fx.case_geometry(spark, sf).select("case_id", case_orientation().alias("ornt"), F.array("nx", "ny", "nz").alias("shape"))


_FLIPPED = """fl as (select f1.case_id, case when flip_x = -1 then nx - 1 - x else x end as a, case when flip_y = -1 then ny - 1 - y else y end as b, case when flip_z = -1 then nz - 1 - z else z end as c, prob
  from f1 join f9 on f9.case_id = f1.case_id)"""


@query("g03_reorient", with_ctes(fx.F1, fx.F9, _FLIPPED, body="""select case_id, case case_id % 3 when 0 then a when 1 then b else c end as x, case case_id % 3 when 0 then b when 1 then a else a end as y,
 case case_id % 3 when 0 then c when 1 then c else b end as z, prob from fl"""))
def _(spark, sf):
    return geometry.reorient(fx.scored_voxels(spark, sf).drop("gt"), orientation_table(spark, sf), pieces_of(fx.table(spark, sf, "lineitem")))


@query("g03_restore", with_ctes(fx.F1, fx.F9, body="select f1.case_id, x, y, z, prob from f1 join f9 on f9.case_id = f1.case_id"))
def _(spark, sf):
    geo, pieces = orientation_table(spark, sf), pieces_of(fx.table(spark, sf, "lineitem"))
    return geometry.restore_orientation(geometry.reorient(fx.scored_voxels(spark, sf).drop("gt"), geo, pieces), geo, pieces)


@query("g05_permute_spacing", with_ctes(fx.F9, body="""select case_id, case case_id % 3 when 2 then sp_z else sp_xy end as sx, case case_id % 3 when 0 then sp_xy when 1 then sp_xy else sp_xy end as sy,
 case case_id % 3 when 2 then sp_xy else sp_z end as sz from f9"""))
def _(spark, sf):
    rows = fx.case_geometry(spark, sf).select("case_id", ori.permute_axes(F.array("sp_xy", "sp_xy", "sp_z"), case_orientation()).alias("s"))
    return rows.select("case_id", *[F.element_at("s", i + 1).alias(f"s{a}") for i, a in enumerate("xyz")])


for _order, _label in ((1, "linear"), (0, "nearest")):
    _pos = "i * (63::double / 23)"
    _value = ("embedding[cast(floor(pos) as int) + 1]::double * (1 - (pos - floor(pos))) + embedding[least(cast(floor(pos) as int) + 1, 63) + 1]::double * (pos - floor(pos))"
              if _order else "embedding[cast(floor(pos + 0.5) as int) + 1]::double")
    query(f"g06_resample_1d_{_label}", f"select vec_id, i as p, {_value} as v from (select vec_id, embedding, i, {_pos} as pos from embeddings, range(0, 24) t(i))")(
        lambda spark, sf, o=_order: fx.table(spark, sf, "embeddings").select(
            "vec_id", F.posexplode(resample.resample_array(F.col("embedding").cast("array<double>"), 64, 24, o)).alias("p", "v"))
    )


def axis_sql(src: str, out: str, axis: str, n_in: str, n_out: str) -> str:
    """Linear resampling of one axis of rows (case_id, n, s, r, c, v)."""
    cols = ", ".join("o.i as " + a if a == axis else a for a in ("s", "r", "c"))
    step = f"(case when {n_out} > 1 then cast({n_in} - 1 as double) / ({n_out} - 1) else 0.0 end)"
    return f"""{out} as (select case_id, n, {cols}, sum(v * (1 - abs(o.i * {step} - {axis}))) as v from {src}, (select unnest(range(0, 64)) as i) o
  where o.i < {n_out} and abs(o.i * {step} - {axis}) < 1 group by all)"""


_VOL = "vol as (select px.case_id, n, slice_idx as s, r, c, v from px join (select case_id, count(*) as n from f4 group by 1) d on d.case_id = px.case_id)"


def deep(spark, sf):
    s = volumes(spark, sf)
    return attach(s, s.groupBy("case_id").agg(F.count("*").cast("int").alias("n_slices")), ["case_id"], ["slice_idx"])


def pixels_out(slices, *extra):
    return slices.select("case_id", F.col("slice_idx").cast("int").alias("slice_idx"), *extra, F.posexplode("pixels").alias("p", "v"))


@query("g06_resample_volume", with_ctes(fx.F4, _VOL, axis_sql("vol", "v1", "r", "8", "6"), axis_sql("v1", "v2", "c", "8", "6"), axis_sql("v2", "v3", "s", "n", "cast(round_even(n * 1.5, 0) as int)"),
    body="select case_id, s as slice_idx, r * 6 + c as p, v from v3"))
def _(spark, sf):
    rows = deep(spark, sf).withColumns({"sx": F.lit(0.75), "sy": F.lit(0.75), "sz": F.lit(1.5)})
    return pixels_out(resample.resample(rows, 1.0))


@query("g07_resample_to_shape", with_ctes(fx.F4, _VOL, axis_sql("vol", "v1", "r", "8", "5"), axis_sql("v1", "v2", "c", "8", "11"), axis_sql("v2", "v3", "s", "n", "n + 3"),
    body="select case_id, s as slice_idx, r * 11 + c as p, v from v3"))
def _(spark, sf):
    rows = deep(spark, sf).withColumns({"h2": F.lit(5), "w2": F.lit(11), "d2": F.col("n_slices") + 3})
    return pixels_out(resample.resample_to_shape(rows, "h2", "w2", "d2"))


@query("g08_resize_slices", with_ctes(fx.F4, _VOL, axis_sql("vol", "v1", "r", "8", "12"), axis_sql("v1", "v2", "c", "8", "12"), body="select case_id, s as slice_idx, r * 12 + c as p, v from v2"))
def _(spark, sf):
    return pixels_out(resample.resize_slices(volumes(spark, sf), 12, 12))


@query("g08_resize_labels", with_ctes(fx.F4, _LBL, "vol as (select case_id, 8 as n, slice_idx as s, r, c, g as v from lb)", axis_sql("vol", "v1", "r", "8", "5"), axis_sql("v1", "v2", "c", "8", "5"),
    body="select case_id, s as slice_idx, r * 5 + c as p, case when v > 0.5 then 1.0::double else 0.0::double end as v from v2"))
def _(spark, sf):
    return pixels_out(resample.resize_slices(label_slices(spark, sf), 5, 5, label=True))


def inverse_metadata(spark, sf):
    """Prepared 8x8 slices came from 6x7xn boxes in 9x10x(n+2) volumes of 7x8x(n+5) canonical voxels."""
    n = F.col("n")
    depth = volumes(spark, sf).groupBy("case_id").agg(F.count("*").cast("int").alias("n"))
    ints = lambda *v: F.array(*[x if not isinstance(x, int) else F.lit(x) for x in v])
    return depth.select(
        "case_id", ints(6, 7, n).alias("cropped_shape"), ints(9, 10, n + 2).alias("resampled_shape"), ints(7, 8, n + 5).alias("canonical_shape"),
        ints(8, 7, n + 5).alias("original_shape"), F.array(ints(1, -1), ints(0, 1), ints(2, -1)).alias("ornt"),
        F.struct(*[F.lit(v).alias(k) for k, v in (("x_min", 1), ("y_min", 2), ("z_min", 1))]).alias("crop_bbox"),
    )


@query("g12_reconstruct", with_ctes(fx.F4, _VOL, axis_sql("vol", "v1", "r", "8", "6"), axis_sql("v1", "v2", "c", "8", "7"),
    "pasted as (select case_id, n, s + 1 as s, r + 1 as r, c + 2 as c, v from v2)", axis_sql("pasted", "v3", "r", "9", "7"), axis_sql("v3", "v4", "c", "10", "8"), axis_sql("v4", "v5", "s", "(n + 2)", "(n + 5)"),
    body="select case_id, 7 - c as x, r as y, n + 4 - s as z from v5 where v > 0.05"))
def _(spark, sf):
    return reconstruct.reconstruct(volumes(spark, sf), inverse_metadata(spark, sf), threshold=0.05)


@query("g13_stack_slices", with_ctes(fx.F10, """d as (select case_id, max(slice_idx) + 3 as n from f10 group by 1), g as (select case_id, n, unnest(range(0, n)) as i from d)""",
    body="select g.case_id, cast(i as int) as slice_idx, coalesce(n_pos, 0) as n_pos from g left join (select * from f10 where slice_idx % 3 <> 1) f on f.case_id = g.case_id and f.slice_idx = i"))
def _(spark, sf):
    t = fx.turns(spark, sf)
    depth = t.groupBy("case_id").agg((F.max("slice_idx") + 3).alias("n_slices"))
    return masks.stack_slices(t.where("slice_idx % 3 <> 1"), depth, "n_pos", 0)


def u_sql(what: str, case="case_id", slice_="slice_idx") -> str:
    return f"(('0x' || substr(md5('{SEED}|{EPOCH}|' || {case} || '|' || {slice_} || '|{what}'), 1, 13))::bigint / 4503599627370496.0::double)"


def int_sql(low: int, high: int, what: str) -> str:
    return f"cast({low} + floor({u_sql(what)} * {high - low + 1}) as int)"


_STD = f"""st as (select case_id, slice_idx, {u_sql('flip_last')} > 0.5 as fl, {u_sql('flip_rows')} > 0.5 as fr, case when {u_sql('turn')} > 0.5 then {int_sql(1, 3, 'turns')} else 0 end as k from f4)"""


@query("g15_augment_standard", with_ctes(fx.F4, _STD, "m1 as (select px.case_id, px.slice_idx, k, case when fr then 7 - r else r end as r, case when fl then 7 - c else c end as c, v from px join st on st.case_id = px.case_id and st.slice_idx = px.slice_idx)",
    body="select case_id, slice_idx, k as turns, case k when 0 then r * 8 + c when 1 then (7 - c) * 8 + r when 2 then (7 - r) * 8 + 7 - c else c * 8 + 7 - r end as p, v from m1"))
def _(spark, sf):
    return pixels_out(augment.augment_standard(volumes(spark, sf), SEED, EPOCH), "turns")


def between_sql(low: float, high: float, what: str) -> str:
    return f"({low} + {high - low} * {u_sql(what)})"


_ANA = f"""an as (select case_id, slice_idx, radians({between_sql(-15.0, 15.0, 'angle')}) as angle, {between_sql(0.9, 1.1, 'scale')} as scale, {between_sql(-0.08, 0.08, 'shift_y')} * 8 as shift_y,
  {between_sql(-0.08, 0.08, 'shift_x')} * 8 as shift_x, case when {u_sql('gamma_coin')} > 0.5 then {between_sql(0.8, 1.25, 'gamma')} end as gamma, {u_sql('noise_coin')} > 0.5 as noisy from f4)"""


@query("g16_anatomic_parameters", with_ctes(fx.F4, _ANA, body="select * from an"))
def _(spark, sf):
    rows = augment.anatomic_parameters(volumes(spark, sf), SEED, EPOCH)
    return rows.select("case_id", "slice_idx", "angle", "scale", "shift_y", "shift_x", "gamma", F.col("noise_seed").isNotNull().alias("noisy"))


_WARP = """src as (select case_id, slice_idx, i // 8 as r, i % 8 as c, cos(angle) / scale as ca, sin(angle) / scale as sa, shift_y, shift_x from an, range(0, 64) t(i)),
 at0 as (select *, ca * r - sa * c + 4 - (ca * 4 - sa * 4) + shift_y as y, sa * r + ca * c + 4 - (sa * 4 + ca * 4) + shift_x as x from src),
 wp as (select a.case_id, a.slice_idx, a.r * 8 + a.c as p, case when any_value(y) between 0 and 7 and any_value(x) between 0 and 7 then coalesce(sum(v * (1 - abs(y - px.r)) * (1 - abs(x - px.c))), 0.0) else 0.0 end as v
  from at0 a left join px on px.case_id = a.case_id and px.slice_idx = a.slice_idx and abs(y - px.r) < 1 and abs(x - px.c) < 1 group by a.case_id, a.slice_idx, a.r, a.c)"""


@query("g16_anatomic_warp", with_ctes(fx.F4, _ANA, _WARP, body="select * from wp"))
def _(spark, sf):
    return pixels_out(augment.warp_slices(augment.anatomic_parameters(volumes(spark, sf), SEED, EPOCH)))


@query("g16_augment_anatomic")
def _(spark, sf):
    """With gamma and seeded noise: rows only."""
    return pixels_out(augment.augment_anatomic(volumes(spark, sf), SEED, EPOCH))


WIDE, CROP = 64, 32
_WIDE = f"""w as (select distinct l_suppkey as case_id, cast(l_partkey % {WIDE} as int) as x, cast(l_orderkey % {WIDE} as int) as y, cast(l_linenumber - 1 as int) as z from lineitem where l_returnflag = 'R' and l_tax >= 0.07 and l_discount >= 0.08),
 ws as (select distinct l_suppkey as case_id, cast(l_linenumber - 1 as int) as slice_idx from lineitem),
 ce as (select ws.case_id, ws.slice_idx, avg(x) as my, avg(y) as mx from ws left join w on w.case_id = ws.case_id and w.z = ws.slice_idx group by 1, 2),
 wi as (select case_id, slice_idx, least(greatest(coalesce(cast(trunc(my) as int) + {int_sql(-8, 8, 'jitter_y')}, {int_sql(16, 48, 'centre_y')}) - 16, 0), 32) as top,
  least(greatest(coalesce(cast(trunc(mx) as int) + {int_sql(-8, 8, 'jitter_x')}, {int_sql(16, 48, 'centre_x')}) - 16, 0), 32) as "left" from ce)"""


def wide_mask(spark, sf):
    """A sparse 64x64x7 mask; slices without a voxel get uniform windows."""
    t = fx.table(spark, sf, "lineitem")
    case = F.col("l_suppkey").alias("case_id")
    mask = t.where("l_returnflag = 'R' and l_tax >= 0.07 and l_discount >= 0.08").select(
        case, (F.col("l_partkey") % WIDE).cast("int").alias("x"), (F.col("l_orderkey") % WIDE).cast("int").alias("y"), (F.col("l_linenumber") - 1).cast("int").alias("z")).distinct()
    return mask, t.select(case, (F.col("l_linenumber") - 1).cast("int").alias("slice_idx")).distinct()


@query("g17_crop_windows", with_ctes(_WIDE, body="select * from wi"))
def _(spark, sf):
    mask, slices = wide_mask(spark, sf)
    return augment.crop_windows(slices, mask, WIDE, WIDE, CROP, SEED, EPOCH)


@query("g17_crop_on_mask", with_ctes(_WIDE, body="""select w.case_id, x - top as x, y - "left" as y, z from w join wi on wi.case_id = w.case_id and wi.slice_idx = w.z where x >= top and x < top + 32 and y >= "left" and y < "left" + 32"""))
def _(spark, sf):
    mask, slices = wide_mask(spark, sf)
    return augment.crop_voxels(mask, augment.crop_windows(slices, mask, WIDE, WIDE, CROP, SEED, EPOCH), CROP)


_NB = "nbr as (select case_id, slice_idx, n_pos, count(*) over (partition by case_id) as n from f10)"


@query("g18_neighbour_stack", with_ctes(fx.F10, _NB, body="select a.case_id, a.slice_idx, " + ", ".join(
    f"(select n_pos from f10 b where b.case_id = a.case_id and b.slice_idx = least(greatest(a.slice_idx + {k - 2}, 0), a.n - 1)) as c{k}" for k in range(5)) + " from nbr a"))
def _(spark, sf):
    t = fx.turns(spark, sf)
    return geometry.neighbour_stack(t, depth_of(t), "n_pos", 5)


@query("w04_neighbour_frame", with_ctes(fx.F10, body="""select case_id, slice_idx, coalesce(lag(n_pos) over w, n_pos) as c0, n_pos as c1, coalesce(lead(n_pos) over w, n_pos) as c2 from f10 window w as (partition by case_id order by slice_idx)"""))
def _(spark, sf):
    t = fx.turns(spark, sf)
    return geometry.neighbour_stack(t, depth_of(t), "n_pos", 3)


@query("u01_score", with_ctes(fx.F4, body="select case_id, slice_idx, p, 1 / (1 + exp(-(v * 4 - 0.5::double))) as v from px"))
def _(spark, sf):
    scored = inference.score(volumes(spark, sf), inference.MODELS["linear"](4.0, -0.5))
    return scored.select("case_id", "slice_idx", F.posexplode("prob").alias("p", "v"))


ROI = 4
_TILES = "tl as (select case_id, slice_idx, a.o as top, b.o as \"left\", (r - a.o) * 4 + c - b.o as p, r, c, v from px, (values (0), (2), (4)) a(o), (values (0), (2), (4)) b(o) where r >= a.o and r < a.o + 4 and c >= b.o and c < b.o + 4)"


@query("u02_tile", with_ctes(fx.F4, _TILES, body='select case_id, slice_idx, top, "left", p, v from tl'))
def _(spark, sf):
    return pixels_out(inference.tile(volumes(spark, sf), 8, 8, ROI), "top", "left")


_W = "greatest(exp(-(pow(r - top - 1.5, 2) + pow(c - \"left\" - 1.5, 2)) / 0.5), 0.001)"


@query("u03_blend", with_ctes(fx.F4, _TILES, body=f"select case_id, slice_idx, r * 8 + c as p, sum({_W} / (1 + exp(-(v * 4 - 0.5::double)))) / sum({_W}) as v from tl group by 1, 2, 3"))
def _(spark, sf):
    tiles = inference.tile(volumes(spark, sf), 8, 8, ROI)
    scored = inference.score(tiles, inference.MODELS["linear"](4.0, -0.5))
    blended = inference.blend(scored, 8, 8, ROI)
    return blended.select("case_id", "slice_idx", F.posexplode("prob").alias("p", "v"))


@query("u04_models", with_ctes(fx.F4, body="select case_id, slice_idx, 'linear' as model, p, 1 / (1 + exp(-(v * 4 - 0.5::double))) as v from px union all select case_id, slice_idx, 'quadratic', p, 1 / (1 + exp(-(v * v * 4 - 0.5::double))) from px"))
def _(spark, sf):
    """Every registered model, by name."""
    rows = [inference.score(volumes(spark, sf), inference.make_model(name, 4.0, -0.5)).select("case_id", "slice_idx", F.lit(name).alias("model"), F.posexplode("prob").alias("p", "v")) for name in sorted(inference.MODELS)]
    return rows[0].unionByName(rows[1])


_CONFIGS = """cf as (select l_orderkey, l_linenumber, case l_returnflag when 'R' then 'balanced' when 'A' then 'all' else 'some' end as sampling, case when l_linestatus = 'F' then 'standard' else 'anatomic' end as augment,
  case l_partkey % 5 when 0 then 'tumor' when 1 then null else 'none' end as crop, cast(l_linenumber as int) as neighbours, cast(l_quantity as int) * 8 as crop_size from lineitem)"""


@query("p10_config_problems", with_ctes(_CONFIGS, body="""select l_orderkey, l_linenumber, case when sampling = 'some' then 'unknown sampling mode: some' when crop is null then 'unknown crop mode: nothing'
 when neighbours % 2 = 0 then 'neighbour count must be odd, got ' || neighbours when crop = 'tumor' and crop_size > 192 then 'too large a crop: ' || crop_size
 when crop = 'tumor' and (crop_size % 16 <> 0 or crop_size < 32) then 'no crop size: ' || crop_size end as problem from cf"""))
def _(spark, sf):
    t = fx.table(spark, sf, "lineitem")
    sampling = F.when(F.col("l_returnflag") == "R", "balanced").when(F.col("l_returnflag") == "A", "all").otherwise("some")
    crop = F.when(F.col("l_partkey") % 5 == 0, "tumor").when(F.col("l_partkey") % 5 != 1, "none")
    augment_mode = F.when(F.col("l_linestatus") == "F", "standard").otherwise("anatomic")
    size = F.col("l_quantity").cast("int") * 8
    return t.select("l_orderkey", "l_linenumber", registry.config_problem(sampling, augment_mode, crop, F.col("l_linenumber").cast("int"), size, F.lit(192), F.lit(192)).alias("problem"))
