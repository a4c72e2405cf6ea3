"""Splits, set checks and epoch sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import reports, sampling, split
from ..operators.skew import attach
from ..session import cut_lineage
from . import fixtures as fx
from .catalog import query, with_ctes

SEED = 42


def targets(cases):
    """70 / 14 / 16 percent of the cases, train taking the rest."""
    n = cases.agg(F.count("*")).scalar()
    val, test = F.floor(n * 0.14), F.floor(n * 0.16)
    return n - val - test, val, test


CATS3 = "c3 as (select *, case when volume < 1000 then 'small' when volume < 5000 then 'medium' else 'large' end as tumor_category from f3)"
SPLIT = f"""tot as (select count(*) as n, cast(floor(count(*) * 0.14) as bigint) as tb, cast(floor(count(*) * 0.16) as bigint) as tc from f3),
 tgt as (select n, n - tb - tc as ta, tb, tc from tot),
 rk as (select *, row_number() over (partition by tumor_category order by md5('{SEED}|' || case_id), case_id) as rank, count(*) over (partition by tumor_category) as m from c3),
 q0 as (select rk.*, ta, tb, tc, greatest(1, cast(round_even(m * tc / n, 0) as bigint)) as t0, greatest(1, cast(round_even(m * tb / n, 0) as bigint)) as v0 from rk, tgt),
 q1 as (select *, case when m - t0 - v0 < 1 and m >= 3 then least(v0, (m - 1) // 2) else least(m - least(m, t0), v0) end as v1 from q0),
 q2 as (select *, case when m - t0 - v0 < 1 and m >= 3 then m - 1 - v1 else least(m, t0) end as t1 from q1),
 q3 as (select *, case when rank <= t1 then 'test' when rank <= t1 + v1 then 'val' else 'train' end as split,
   case tumor_category when 'small' then 0 when 'medium' then 1 else 2 end as cat_no from q2),
 sp as (select *, row_number() over (partition by split order by cat_no, rank) as list_pos from q3)"""
ADJUST = """cnt as (select count(*) filter (split = 'train') as a, count(*) filter (split = 'val') as b, count(*) filter (split = 'test') as c from sp),
 mv1 as (select cnt.*, ta, tb, tc, least(greatest(0, a - ta), greatest(0, tb - b)) as train_val, least(greatest(0, ta - a), greatest(0, b - tb)) as val_train from cnt, tgt),
 mv2 as (select *, least(greatest(0, a - ta) - train_val, greatest(0, tc - c)) as train_test, least(greatest(0, ta - a) - val_train, greatest(0, c - tc)) as test_train from mv1),
 mv3 as (select *, b + train_val - val_train as b2, c + train_test - test_train as c2 from mv2),
 mv as (select *, least(greatest(0, b2 - tb), greatest(0, tc - c2)) as val_test, least(greatest(0, c2 - tc), greatest(0, tb - b2)) as test_val from mv3),
 fin as (select case_id, volume, positive_slices, n_components, tumor_category, case split
   when 'train' then case when a - list_pos < train_val then 'val' when a - list_pos < train_val + train_test then 'test' else split end
   when 'val' then case when b - list_pos < val_train then 'train' when b - list_pos < val_train + val_test then 'test' else split end
   else case when c - list_pos < test_train then 'train' when c - list_pos < test_train + test_val then 'val' else split end end as split from sp, mv)"""
_SP = (fx.F3, CATS3, SPLIT)


def first_split(spark, sf):
    cases = fx.case_stats(spark, sf)
    return split.stratified_split(cases, *targets(cases), seed=SEED)


def final_split(spark, sf):
    cases = fx.case_stats(spark, sf)
    return split.adjust_split(first_split(spark, sf), *targets(cases))


@query("p04_classify_size", with_ctes(fx.F3, CATS3, body="select case_id, tumor_category from c3"))
def _(spark, sf):
    return fx.case_stats(spark, sf).select("case_id", scalars.classify_size(F.col("volume")).alias("tumor_category"))


@query("sp01_stratified_split", with_ctes(*_SP, body="select case_id, tumor_category, split, list_pos from sp"))
def _(spark, sf):
    return first_split(spark, sf).select("case_id", "tumor_category", "split", "list_pos")


@query("sp02_adjust_split", with_ctes(*_SP, ADJUST, body="select case_id, tumor_category, split from fin"))
def _(spark, sf):
    return final_split(spark, sf).select("case_id", "tumor_category", "split")


@query("w02_rank_in_stratum", with_ctes(*_SP, body="select case_id, tumor_category, rank from rk"))
def _(spark, sf):
    from ..functions.draws import draw_key
    from ..operators.skew import rank_by_hash

    rows = fx.case_stats(spark, sf).select("case_id", scalars.classify_size(F.col("volume")).alias("tumor_category"))
    return rank_by_hash(rows.withColumn("k", draw_key(SEED, F.col("case_id"))), ["tumor_category"], "k", ["case_id"]).drop("k")


@query("s01_validate_split", with_ctes(*_SP, ADJUST, body="""select 'overlapping' as "check", (select count(*) from (select case_id from fin group by 1 having count(distinct split) > 1)) as n
 union all select 'missing', (select count(*) from f3 where case_id not in (select case_id from fin)) union all select 'foreign', (select count(*) from fin where case_id not in (select case_id from f3))
 union all select 'wrong_size', (select cast(a0 <> ta as bigint) + cast(b0 <> tb as bigint) + cast(c0 <> tc as bigint) from tgt,
  (select count(*) filter (split = 'train') as a0, count(*) filter (split = 'val') as b0, count(*) filter (split = 'test') as c0 from fin))"""))
def _(spark, sf):
    cases = fx.case_stats(spark, sf)
    a, b, c = targets(cases)
    names = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), t.alias("target")) for s, t in zip(split.SPLITS, (a, b, c))]))
    wanted = spark.range(1).select(names.alias("r")).select("r.split", "r.target")
    return split.validate_split(cut_lineage(final_split(spark, sf)), cases, wanted)


_CATN = ", ".join(f"count(*) filter (tumor_category = '{c}') as n_{c}" for c in scalars.SIZE_CLASSES)
_CATP = ", ".join(f"count(*) filter (tumor_category = '{c}') * 100.0::double / count(*) as pct_{c}" for c in scalars.SIZE_CLASSES)


@query("a25_split_summary", with_ctes(*_SP, ADJUST, body=f"""select split, count(*) as n, min(volume) as volume_min, avg(volume) as volume_mean, max(volume) as volume_max, min(positive_slices) as pos_min,
 avg(positive_slices) as pos_mean, max(positive_slices) as pos_max, {_CATN}, median(volume) as volume_median, {_CATP} from fin group by 1"""))
def _(spark, sf):
    return reports.split_summary(cut_lineage(final_split(spark, sf)))


@query("a25_split_cube", with_ctes(*_SP, ADJUST, body="select coalesce(split, 'all') as split, coalesce(tumor_category, 'all') as tumor_category, count(*) as n, cast(sum(positive_slices) as bigint) as positive_slices from fin group by cube (split, tumor_category)"))
def _(spark, sf):
    cube = final_split(spark, sf).cube("split", "tumor_category").agg(F.count("*").alias("n"), F.sum("positive_slices").alias("positive_slices"))
    return cube.fillna("all", ["split", "tumor_category"])


@query("j05_cases_with_split", with_ctes(*_SP, ADJUST, fx.F2, body="select f2.case_id, slice_idx, n_pos, split from f2 join fin on fin.case_id = f2.case_id"))
def _(spark, sf):
    members = final_split(spark, sf).select("case_id", "split")
    return attach(fx.slices(spark, sf).select("case_id", "slice_idx", "n_pos"), members, ["case_id"], ["slice_idx"])


@query("j05_cases_without_split", with_ctes(*_SP, ADJUST, fx.F2, body="select distinct case_id from f2 where case_id not in (select case_id from fin)"))
def _(spark, sf):
    return fx.slices(spark, sf).select("case_id").distinct().join(final_split(spark, sf), "case_id", "left_anti")


BODY_ABOVE = 0.5
FLAGS2 = f"fl as (select case_id, slice_idx, n_pos > 0 as is_positive, slice_mean > {BODY_ABOVE}::double as is_body, n_pos from f2)"
POOL = """span as (select case_id, count(*) as np, min(slice_idx) as lo, max(slice_idx) as hi from fl where is_positive group by 1),
 pool as (select fl.case_id, fl.slice_idx, np, slice_idx between lo - greatest(10, hi - lo) and hi + greatest(10, hi - lo) as near, greatest(lo - slice_idx, slice_idx - hi, 0) as to_positive
   from fl join span on span.case_id = fl.case_id where is_body and not is_positive)"""


def keyed(epoch: int) -> str:
    return f"md5('{SEED}|{epoch}|' || case_id || '|' || slice_idx)"


def balanced_sql(epoch: int, name: str = "bal") -> str:
    return f"{name} as (select case_id, slice_idx, to_positive from pool qualify row_number() over (partition by case_id order by {keyed(epoch)}, slice_idx) <= np)"


def hard_sql(epoch: int, name: str = "hard") -> str:
    return f"""hr as (select *, row_number() over (partition by case_id, near order by {keyed(epoch)}, slice_idx) as rn, least(count(*) filter (near) over (partition by case_id), floor(0.7 * np)) as nn from pool),
 {name} as (select case_id, slice_idx, to_positive from hr where rn <= case when near then nn else np - nn end)"""


def flags(spark, sf):
    return sampling.flag_slices(fx.slices(spark, sf), BODY_ABOVE)


_FL = (fx.F2, FLAGS2)
_POS = "select case_id, slice_idx from fl where is_positive union all select case_id, slice_idx from "


@query("p09_body_slices", with_ctes(*_FL, body="select case_id, slice_idx from fl where is_body"))
def _(spark, sf):
    return flags(spark, sf).where("is_body").select("case_id", "slice_idx")


@query("src05_slice_flags", with_ctes(*_FL, body="select * from fl"))
def _(spark, sf):
    return flags(spark, sf)


@query("src05_case_index", with_ctes(*_FL, body="""select case_id, count(*) as n_slices, count(*) filter (is_positive) as n_positive, count(*) filter (is_body) as n_body, cast(sum(n_pos) as bigint) as tumor_voxels,
 min(slice_idx) filter (is_positive) as first_positive, max(slice_idx) filter (is_positive) as last_positive from fl group by 1"""))
def _(spark, sf):
    return sampling.case_index(flags(spark, sf))


@query("s02_negatives", with_ctes(*_FL, body="select case_id, slice_idx from fl where is_body and not is_positive"))
def _(spark, sf):
    return sampling.negatives(flags(spark, sf))


@query("s03_near_far", with_ctes(*_FL, POOL, body="select case_id, slice_idx, near, to_positive from pool"))
def _(spark, sf):
    return sampling.split_near_far(flags(spark, sf)).drop("n_pos_slices")


@query("s04_chosen_sorted", with_ctes(*_FL, POOL, balanced_sql(0), body=f"select * from ({_POS} bal) order by case_id, slice_idx"))
def _(spark, sf):
    return sampling.sample_epoch(flags(spark, sf), "balanced", 0, SEED).orderBy("case_id", "slice_idx")


@query("w03_top_k_draw", with_ctes(*_FL, POOL, balanced_sql(3), body="select * from bal"))
def _(spark, sf):
    return sampling.draw_negatives(flags(spark, sf), "balanced", 3, SEED)


@query("sp03_sample_all", with_ctes(*_FL, body="select case_id, slice_idx from fl"))
def _(spark, sf):
    return sampling.sample_epoch(flags(spark, sf), "all")


@query("sp04_sample_balanced", with_ctes(*_FL, POOL, balanced_sql(1), body=_POS + "bal"))
def _(spark, sf):
    return sampling.sample_epoch(flags(spark, sf), "balanced", 1, SEED)


@query("sp05_sample_hard_negatives", with_ctes(*_FL, POOL, hard_sql(1), body=_POS + "hard"))
def _(spark, sf):
    return sampling.sample_epoch(flags(spark, sf), "hard_negatives", 1, SEED)


@query("sp06_epoch_redraw", with_ctes(*_FL, POOL, balanced_sql(1, "e1"), balanced_sql(2, "e2"), body="select count(*) as kept, count(*) filter (e2.case_id is not null) as again from e1 left join e2 on e1.case_id = e2.case_id and e1.slice_idx = e2.slice_idx"))
def _(spark, sf):
    one, two = (sampling.draw_negatives(flags(spark, sf), "balanced", e, SEED).select("case_id", "slice_idx") for e in (1, 2))
    joined = one.join(two.withColumn("again", F.lit(1)), ["case_id", "slice_idx"], "left")
    return joined.agg(F.count("*").alias("kept"), F.count("again").alias("again"))


@query("a29_sampling_stats", with_ctes(*_FL, POOL, hard_sql(1), body="""select (select count(*) from hard) as n_negatives, (select avg(case when to_positive <= 20 then 1.0::double else 0.0::double end) from hard) as share_within_20,
 (select median(to_positive) from hard) as median_distance, count(*) as n_positives, sum(n_pos) / (count(*) + (select count(*) from hard)) as positive_density from fl where is_positive"""))
def _(spark, sf):
    return sampling.sampling_stats(flags(spark, sf), "hard_negatives", 1, SEED)


@query("w07_round_robin", with_ctes(*_FL, """pr as (select case_id, slice_idx, row_number() over (partition by case_id order by slice_idx) as rn, count(*) over (partition by case_id) as n from fl where is_positive),
 want as (select distinct case_id, k as round, cast(floor(case when n > 1 then k * (n - 1)::double / (least(3, n) - 1) else 0 end) as bigint) + 1 as rn from pr, (values (0), (1), (2)) t(k) where k < least(3, n))""",
    body="select case_id, slice_idx, round from pr join want using (case_id, rn) order by round, case_id limit 40"))
def _(spark, sf):
    return sampling.spread_picks(flags(spark, sf), 40)
