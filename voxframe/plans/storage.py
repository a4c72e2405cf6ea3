"""Stored tables, documents, path resolution and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sweep
from ..session import cut_lineage, scratch_path
from ..sources import manifest, sinks, tables, volumes as volume_files
from ..streaming import running
from . import fixtures as fx
from .auditing import volumes
from .catalog import query, with_ctes
from .metrics import _CANDIDATE, _SWEEP, BASE, overlap_rows
from .runs import ES, COL, HIST, MIN_EPOCHS, PATIENCE, PEAK, history

_PATHS = """w as (select page_id as case_id, './pages/' || (page_id % 7) || '/p' || page_id || '.nii.gz' as path, page_id % 7 as d from pages),
 fl as (select case page_id % 6 when 0 then 'pages/' || (page_id % 7) || '/p' || page_id || '.nii.gz' when 1 then 'pages/' || (page_id % 7) || '/p' || page_id || '.nii'
  when 2 then 'pages/' || (page_id % 7) || '/p' || page_id || '.nii/p' || page_id || '.nii' when 3 then 'pages/' || (page_id % 7) || '/p' || page_id || '.nii.gz/p' || page_id || '.nii.gz'
  when 4 then 'pages/' || (page_id % 7) || '/extra/p' || page_id || '_copy.nii' else 'elsewhere/p' || page_id || '.nii' end as path from pages)"""


def path_tables(spark, sf):
    k = F.col("page_id")
    folder = F.concat(F.lit("pages/"), (k % 7).cast("string"), F.lit("/p"), k.cast("string"))
    name = F.concat(F.lit("/p"), k.cast("string"))
    pages = fx.table(spark, sf, "pages").select("page_id")
    wanted = pages.select(k.alias("case_id"), F.concat(F.lit("./"), folder, F.lit(".nii.gz")).alias("path"))
    extra = F.concat(F.lit("pages/"), (k % 7).cast("string"), F.lit("/extra/p"), k.cast("string"), F.lit("_copy.nii"))
    layout = (
        F.when(k % 6 == 0, F.concat(folder, F.lit(".nii.gz"))).when(k % 6 == 1, F.concat(folder, F.lit(".nii")))
        .when(k % 6 == 2, F.concat(folder, F.lit(".nii"), name, F.lit(".nii"))).when(k % 6 == 3, F.concat(folder, F.lit(".nii.gz"), name, F.lit(".nii.gz")))
        .when(k % 6 == 4, extra).otherwise(F.concat(F.lit("elsewhere/p"), k.cast("string"), F.lit(".nii")))
    )
    return wanted, pages.select(layout.alias("path"))


@query("src02_resolve_paths", with_ctes(_PATHS, """c as (select case_id, w.path, f.path as hit, case when f.path = substr(w.path, 3) then 1 when f.path = replace(substr(w.path, 3), '.nii.gz', '.nii') then 2
   when f.path = replace(substr(w.path, 3), '.nii.gz', '.nii') || '/p' || case_id || '.nii' then 3 when f.path = substr(w.path, 3) || '/p' || case_id || '.nii.gz' then 4 else 5 end as rule
  from w left join fl f on f.path like 'pages/' || d || '/%' and regexp_extract(f.path, '[^/]*$') like 'p' || case_id || '%')""",
    body="select case_id, path, hit as resolved, case when hit is not null then rule end as rule from c qualify row_number() over (partition by case_id order by rule, hit) = 1"))
def _(spark, sf):
    return manifest.resolve_paths(*path_tables(spark, sf))


@query("src04_slice_subset", with_ctes(fx.F4, body="select case_id, slice_idx, case when case_id % 5 = 0 then 'test' else 'train' end as split, sum(v) as total from px where case_id % 5 = 0 and slice_idx between 2 and 4 group by 1, 2, 3"))
def _(spark, sf):
    """Whole volumes written once, then one split and a slice range read back."""
    path = scratch_path(spark, "slices")
    named = volumes(spark, sf).withColumn("split", F.when(F.col("case_id") % 5 == 0, "test").otherwise("train"))
    tables.write_slices(named, path)
    rows = tables.read_slices(spark, path, "test", 2, 4)
    return rows.select("case_id", "slice_idx", "split", F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("total"))


_AVG = "a as (select avg(dice_3d) as d, avg(iou_3d) as i, count(*) as n, count(*) filter (is_failure) as f from flagged)"


@query("snk03_report_json", with_ctes(*BASE, _AVG, body="select n as n_cases, d as dice, i as iou, f as failures from a"))
def _(spark, sf):
    """The nested report document, read back by its scalar leaves."""
    totals = overlap_rows(spark, sf).agg(F.count("*").alias("n"), F.avg("dice_3d").alias("d"), F.avg("iou_3d").alias("i"), F.count_if("is_failure").alias("f"))
    doc = sinks.report_json(totals, {"n_cases": F.col("n"), "macro": {"dice_3d": F.col("d"), "iou_3d": F.col("i")}, "failures": {"count": F.col("f")}})
    back = F.from_json("value", "n_cases bigint, macro struct<dice_3d:double,iou_3d:double>, failures struct<count:bigint>")
    return doc.select(back.alias("r")).select("r.n_cases", F.col("r.macro.dice_3d").alias("dice"), F.col("r.macro.iou_3d").alias("iou"), F.col("r.failures.count").alias("failures"))


@query("snk03_sweep_json", with_ctes(fx.F1, _SWEEP, body=_CANDIDATE))
def _(spark, sf):
    doc = sinks.sweep_json(sweep.threshold_sweep(fx.scored_voxels(spark, sf)))
    parsed = doc.select(F.from_json("value", "best_threshold double, sweep_results map<string,double>").alias("r"))
    return parsed.select(F.explode("r.sweep_results").alias("k", "mean_dice")).select(F.round(F.col("k").cast("double") * 1000).cast("int").alias("candidate"), "mean_dice")


def stream_of(df, name: str, parts: list[str], per_batch: int = 8):
    """Write ``df`` in the given order of conditions and stream the files."""
    path, df = scratch_path(df.sparkSession, name), cut_lineage(df)  # read once a condition
    for condition in parts:
        df.where(condition).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


@query("st01_streaming_dice", with_ctes(fx.F1, """s as (select case_id, sum(case when prob > 0.5 and gt = 1 then 1 else 0 end) as ih, sum(case when prob > 0.5 then 1 else 0 end) as ph,
  sum(prob * gt) as isf, sum(prob) as psf, sum(gt) as g from f1 group by 1)""", body="""select case_id, case when ph = 0 and g = 0 then 1.0 when ph = 0 or g = 0 then 0.0 else 2.0 * ih / (ph + g) end as dice_hard,
 case when psf = 0 and g = 0 then 1.0 when psf = 0 or g = 0 then 0.0 else 2.0 * isf / (psf + g) end as dice_soft from s"""))
def _(spark, sf):
    stream = stream_of(fx.scored_voxels(spark, sf), "voxels", ["z < 4", "z >= 4"])
    written = running.run_updates(running.running_sums(stream), scratch_path(spark, "running-dice"))
    return running.latest_dice(written)


def run_events(spark, sf):
    # late rows: two thirds of the epochs come after later ones
    stream = stream_of(history(spark, sf), "history", ["epoch % 3 = 2", "epoch % 3 = 0", "epoch % 3 = 1"])
    events = running.run_events(stream, PATIENCE, min_epochs=MIN_EPOCHS, min_peak=PEAK)
    return running.run_to_files(events, scratch_path(spark, "run-events"))


@query("st02_streaming_early_stop", with_ctes(fx.F5, HIST, ES, body="select run_id, stop_epoch from stops where stop_epoch is not null"))
def _(spark, sf):
    return run_events(spark, sf).where("reason = 'early_stop'").select("run_id", F.col("epoch").alias("stop_epoch"))


@query("st03_streaming_collapse", with_ctes(fx.F5, HIST, COL, body="select * from col"))
def _(spark, sf):
    return run_events(spark, sf).where("reason = 'collapsed'").select("run_id", F.col("epoch").alias("collapse_epoch"))


_FLOATS = "select cast(case_id as varchar) as case_id, slice_idx, 8 as height, 8 as width, n as n_slices, sum(v) as total, sum(v * p) as weighted from px join (select case_id as k, cast(count(*) as int) as n from f4 group by 1) d on k = px.case_id"


@query("src03_slice_range", with_ctes(fx.F4, body=f"{_FLOATS} where slice_idx between 2 and 4 group by all"))
def _(spark, sf):
    """Volume files written from F4; three slices of each are read by their bytes."""
    path = scratch_path(spark, "volume-files")
    volume_files.write_volumes(volumes(spark, sf).withColumns({f"s{a}": F.lit(1.0) for a in "xyz"}), path)
    rows = volume_files.read_slice_range(spark, path, 2, 4, block=2).withColumn("pixels", F.col("pixels").cast("array<double>"))
    weighted = F.aggregate(F.transform("pixels", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return rows.where("error is null").select("case_id", "slice_idx", "height", "width", "n_slices", F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("total"), weighted.alias("weighted"))


@query("src03_headers", with_ctes(fx.F4, body="select cast(case_id as varchar) as case_id, 8 as height, 8 as width, count(*) as depth, 1.0::double as spacing_z from f4 group by 1"))
def _(spark, sf):
    path = scratch_path(spark, "volume-headers")
    volume_files.write_volumes(volumes(spark, sf).withColumns({f"s{a}": F.lit(1.0) for a in "xyz"}), path)
    h = volume_files.read_headers(spark, path)
    return h.where("error is null").select("case_id", F.col("shape")[0].alias("height"), F.col("shape")[1].alias("width"), F.col("shape")[2].cast("bigint").alias("depth"), F.col("spacing")[2].alias("spacing_z"))


@query("src04_bucketed_join", with_ctes(fx.F2, fx.F3, body="select f2.case_id, count(*) as n_slices, cast(sum(n_pos) as bigint) as n_pos, max(volume) as volume from f2 join f3 on f3.case_id = f2.case_id group by 1"))
def _(spark, sf):
    """Two tables stored in buckets of cases, joined and grouped without a shuffle."""
    slices = tables.write_bucketed(fx.slices(spark, sf), scratch_path(spark, "bucketed-slices"), 8)
    stats = tables.write_bucketed(fx.case_stats(spark, sf), scratch_path(spark, "bucketed-stats"), 8)
    return slices.join(stats, "case_id").groupBy("case_id").agg(F.count("*").alias("n_slices"), F.sum("n_pos").alias("n_pos"), F.max("volume").alias("volume"))
