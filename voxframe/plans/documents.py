"""Tables and documents written by the sinks and read back by the sources, and the whole evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, evaluate, overlap, run_report, sweep, training
from ..session import cut_lineage, scratch_path
from ..sources import manifest, sinks, tables
from . import fixtures as fx
from .auditing import volumes
from .catalog import query, with_ctes
from .dense import EPOCH, SEED, _STD
from .metrics import _CANDIDATE, _SWEEP, CATS, categories, mask
from .topology import _PP

_LINE = "'o' || l_orderkey || '_' || l_linenumber"


@query("src01_manifest", f"""select case when l_returnflag = 'N' then 'test' else 'training' end as role,
 cast(row_number() over (partition by l_suppkey, l_returnflag = 'N' order by l_orderkey, l_linenumber) - 1 as int) as pos, {_LINE} as case_id,
 'images/' || {_LINE} || '.nii.gz' as image, case when l_returnflag <> 'N' then 'labels/' || {_LINE} || '.nii.gz' end as label from lineitem""")
def _(spark, sf):
    """One manifest per supplier, a line each; its order lines are the cases."""
    name = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(".nii.gz"))
    item = F.struct("l_orderkey", "l_linenumber", F.concat(F.lit("images/"), name).alias("image"), F.concat(F.lit("labels/"), name).alias("label"))
    held = F.col("l_returnflag") == "N"
    lists = fx.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.array_sort(F.collect_list(F.when(~held, item))).alias("training"), F.array_sort(F.collect_list(F.when(held, item))).alias("test"))
    pairs = F.transform("training", lambda c: F.struct(c["image"].alias("image"), c["label"].alias("label"))).alias("training")
    document = F.to_json(F.struct(pairs, F.transform("test", lambda c: c["image"]).alias("test")))
    path = scratch_path(spark, "manifests")
    sinks.write_documents(lists.select(document.alias("value")), path)
    return manifest.read_manifest(spark, path, lines=True)


@query("src06_metadata", with_ctes(fx.F9, body="""select cast(case_id as varchar) as case_id, flip_x * sp_xy as a00, sp_z as spacing_z, flip_x, flip_y,
 nz as depth, cast(case_id % 16 as int) as x_max, -160.0::double as hu_min from f9"""))
def _(spark, sf):
    """One reconstruction document per case, a line each."""
    geometry = fx.case_geometry(spark, sf)
    zero, one = F.lit(0.0), F.lit(1.0)
    affine = F.array(F.array(F.col("flip_x") * F.col("sp_xy"), zero, zero, zero), F.array(zero, F.col("flip_y") * F.col("sp_xy"), zero, zero),
                     F.array(zero, zero, F.col("sp_z"), zero), F.array(zero, zero, zero, one))
    axes = F.array(*[F.array(F.lit(float(k)), F.col(f"flip_{a}").cast("double")) for k, a in enumerate("xyz")])
    box = F.struct(*[(F.lit(0) if end == "min" else (F.col("case_id") % 16).cast("int")).alias(f"{a}_{end}") for a in "xyz" for end in ("min", "max")])
    shape, spacing = F.array("nx", "ny", "nz"), F.array("sp_xy", "sp_xy", "sp_z")
    document = F.struct(
        F.col("case_id").cast("string").alias("case_id"), affine.alias("original_affine"), shape.alias("original_shape"), spacing.alias("original_spacing"),
        axes.alias("ornt"), box.alias("crop_bbox"), F.lit(-160.0).alias("hu_min"), F.lit(240.0).alias("hu_max"))
    path = scratch_path(spark, "metadata")
    sinks.write_documents(geometry.select(F.to_json(document).alias("value")), path)
    return tables.read_metadata(spark, path, lines=True).select(
        "case_id", F.col("original_affine")[0][0].alias("a00"), F.col("original_spacing")[2].alias("spacing_z"), F.col("ornt")[0][1].alias("flip_x"),
        F.col("ornt")[1][1].alias("flip_y"), F.col("original_shape")[2].alias("depth"), F.col("crop_bbox.x_max").alias("x_max"), "hu_min")


@query("src07_case_stats", with_ctes(fx.F3, body="select * from f3"))
def _(spark, sf):
    path = scratch_path(spark, "case-stats")
    sinks.write_ordered_csv(fx.case_stats(spark, sf), path, "case_id")
    return tables.read_csv(spark, path, "case_id bigint, volume double, positive_slices bigint, n_components bigint")


@query("snk02_history", with_ctes(fx.F5, body="select * from f5"))
def _(spark, sf):
    path = scratch_path(spark, "history")
    sinks.write_ordered_csv(fx.history(spark, sf), path, "run_id", "epoch")
    return tables.read_csv(spark, path, "run_id bigint, epoch int, score double, nonfinite int")


_CHECKED = """checked as (select *, positive_slices > 0 as shape_match, n_components <= positive_slices as affine_match, volume > 0 as orientation_match,
  volume < 1000 as is_empty_image, n_components = 0 as is_empty_mask from f3),
 totals as (select count(*) as n, bool_and(shape_match) as s, bool_and(affine_match) as a, bool_and(orientation_match) as o, count(*) filter (is_empty_image) as ei,
  count(*) filter (is_empty_mask) as em, min(volume) as low, max(volume) as high, avg(volume) as mid from checked)"""


@query("snk04_markdown_report", with_ctes(fx.F3, _CHECKED, body="""select unnest(['# Dataset audit', printf('- Cases: %d', n),
 printf('- Shape match: %s; affine match: %s; orientation match: %s', s::varchar, a::varchar, o::varchar), printf('- Empty images: %d; empty masks: %d', ei, em),
 printf('- Volume range: %.2f to %.2f mm3 (mean %.2f)', low, high, mid)]) as value from totals"""))
def _(spark, sf):
    checks = {"shape_match": F.col("positive_slices") > 0, "affine_match": F.col("n_components") <= F.col("positive_slices"), "orientation_match": F.col("volume") > 0,
              "is_empty_image": F.col("volume") < 1000, "is_empty_mask": F.col("n_components") == 0}
    rows = fx.case_stats(spark, sf).withColumns(checks)
    summary = audit.audit_summary(rows, ["shape_match", "affine_match", "orientation_match"], ["is_empty_image", "is_empty_mask"], ["volume"])
    path = scratch_path(spark, "report")
    sinks.write_documents(sinks.markdown_report(summary), path)
    return spark.read.text(path)


@query("snk05_regenerate", with_ctes(fx.F4, body="""select case when case_id % 3 = 0 then 'test' else 'train' end as split, count(*) as n_slices,
 count(distinct case_id) as n_cases from f4 group by 1"""))
def _(spark, sf):
    """Written under one split, then under another: no stale copy is left."""
    path = scratch_path(spark, "regenerated")
    for every in (5, 3):
        tables.write_slices(volumes(spark, sf).withColumn("split", F.when(F.col("case_id") % every == 0, "test").otherwise("train")), path)
    return tables.read_slices(spark, path).groupBy("split").agg(F.count("*").alias("n_slices"), F.countDistinct("case_id").alias("n_cases"))


@query("snk06_masks", with_ctes(fx.F1, fx.VOXEL_CASES, fx.MASK, body=f"""select case_id, count(*) as n_voxels, cast(sum(x) as bigint) as sum_x, cast(sum(z) as bigint) as sum_z,
 max(sx) as a00, {fx.NZ} as depth from mask join cases using (case_id) where pred = 1 group by 1"""))
def _(spark, sf):
    """Predicted voxels with the affine table of their cases."""
    zero = F.lit(0.0)
    affine = F.array(F.array("sx", zero, zero, zero), F.array(zero, F.col("sy"), zero, zero), F.array(zero, zero, F.col("sz"), zero), F.array(zero, zero, zero, F.lit(1.0)))
    metadata = fx.voxel_cases(spark, sf).select("case_id", affine.alias("original_affine"), F.array("nx", "ny", "n_slices").alias("original_shape"))
    path = scratch_path(spark, "masks")
    sinks.write_masks(mask(spark, sf).where("pred = 1"), metadata, path)
    counted = spark.read.parquet(f"{path}/raw").groupBy("case_id").agg(F.count("*").alias("n_voxels"), F.sum("x").alias("sum_x"), F.sum("z").alias("sum_z"))
    return counted.join(spark.read.parquet(f"{path}/affines"), "case_id").select(
        "case_id", "n_voxels", "sum_x", "sum_z", F.col("original_affine")[0][0].alias("a00"), F.col("original_shape")[2].alias("depth"))


def failing(spark, sf):
    """Case statistics where a case without components has failed."""
    rows = fx.case_stats(spark, sf)
    bad = F.col("n_components") == 0
    return rows.withColumns({"error": F.when(bad, "no component"), "volume": F.when(~bad, F.col("volume"))})


@query("a33_failures_kept", with_ctes(fx.F3, body="""select case_id, case when n_components = 0 then 0.0 else volume end as volume, positive_slices, n_components,
 case when n_components = 0 then 'no component' end as error from f3"""))
def _(spark, sf):
    good, failed = audit.split_failures(failing(spark, sf), True, {"volume": 0.0})
    return good.join(failed, "case_id", "left")


@query("a33_failures_dropped", with_ctes(fx.F3, body="select * from f3 where n_components > 0"))
def _(spark, sf):
    return audit.split_failures(failing(spark, sf), False)[0]


@query("sp07_training_slices", with_ctes(fx.F4, _STD, """depth as (select case_id, max(slice_idx) as top from f4 group by 1),
 ch as (select st.case_id, st.slice_idx, k, fr, fl, channel, least(greatest(st.slice_idx + channel - 1, 0), top) as source
  from st join depth using (case_id), (select unnest(range(3)) as channel)),
 m1 as (select ch.case_id, ch.slice_idx, ch.channel, k, case when fr then 7 - r else r end as r, case when fl then 7 - c else c end as c, v
  from ch join px on px.case_id = ch.case_id and px.slice_idx = ch.source)""",
    body="""select case_id, slice_idx, cast(channel as int) as channel, case k when 0 then r * 8 + c when 1 then (7 - c) * 8 + r when 2 then (7 - r) * 8 + 7 - c else c * 8 + 7 - r end as p, v from m1"""))
def _(spark, sf):
    """Three channels and a label, augmented by name; the label is that of the slice's own pixels."""
    rows = volumes(spark, sf).withColumn("label", F.transform("pixels", lambda v: (v > 0).cast("double")))
    sample = training.training_slices(rows, "train", 3, "standard", seed=SEED, epoch=EPOCH).where(F.col("channel") != training.LABEL)
    return sample.select("case_id", "slice_idx", "channel", F.posexplode("pixels").alias("p", "v"))


_TIMES = """batches as (select floor(event_id / 16) as batch, user_id as case_id, value / 1000 as seconds from events),
 slowest as (select batch, count(*) as size, max(seconds) as secs from batches group by 1),
 times as (select case_id, sum(secs / size) as inference_time_sec from batches join slowest using (batch) group by 1)"""


@query("e01_evaluate", with_ctes(*_PP, CATS, _TIMES, body="""select f.case_id, coalesce(tumor_category, 'unknown') as tumor_category, dice_3d, iou_3d, sensitivity_3d, precision_3d, specificity_3d,
 hd95_3d, asd_3d, fp_components, is_failure, inference_time_sec, pp.* exclude (case_id) from full_met f join pp on pp.case_id = f.case_id
 left join cats on cats.case_id = f.case_id left join times on times.case_id = f.case_id"""))
def _(spark, sf):
    """Paired masks, raw and filtered metrics, size class and inference time, exported."""
    events = fx.table(spark, sf, "events").select(F.floor(F.col("event_id") / 16).alias("batch"), F.col("user_id").alias("case_id"), (F.col("value") / 1000).alias("s"))
    sizes = events.groupBy("batch").agg(F.count("*").alias("batch_size"), F.max("s").alias("batch_seconds"))
    metrics, _ = evaluate.evaluate(cut_lineage(mask(spark, sf)), fx.voxel_cases(spark, sf))
    timed = evaluate.with_inference_time(metrics, overlap.inference_time(events.join(sizes.hint("merge"), "batch")))
    return evaluate.export_frame(timed, categories(spark, sf))


_COLS = ("dice_3d", "iou_3d", "sensitivity_3d", "precision_3d", "hd95_3d", "asd_3d")
_SWEPT = "sw as (" + _CANDIDATE + ")"


def _long(section, name, pairs, source):
    """Leaves from named expressions over a source."""
    return " union all ".join(f"select '{section}' as section, {name} as name, '{leaf}' as leaf, cast({value} as double) as value from {source}" for leaf, value in pairs)


_POOLED = [(c, f"sum({c})") for c in ("tp", "fp", "fn", "tn")] + [("dice_3d", "2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))"), ("iou_3d", "sum(tp) / (sum(tp) + sum(fp) + sum(fn))"), ("sensitivity_3d", "sum(tp) / (sum(tp) + sum(fn))"),
           ("precision_3d", "sum(tp) / (sum(tp) + sum(fp))"), ("specificity_3d", "sum(tn) / (sum(tn) + sum(fp))")]
_FILTERED = [("dice_3d", "2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))"), ("iou_3d", "sum(tp) / (sum(tp) + sum(fp) + sum(fn))"), ("sensitivity", "sum(tp) / (sum(tp) + sum(fn))"), ("precision", "sum(tp) / (sum(tp) + sum(fp))"), ("specificity", "sum(tn) / (sum(tn) + sum(fp))")]
_EVERY = [*"tp fp fn tn dice_3d iou_3d sensitivity_3d precision_3d specificity_3d hd95_3d asd_3d fp_components".split(), "is_failure", "gt_empty", "pred_empty"]
_PPCOLS = [f"pp_{c}" for c in "dice_3d iou_3d sensitivity_3d precision_3d specificity_3d hd95_3d asd_3d fp_components is_failure components_removed".split()]
_REPORT = " union all ".join([
    _long("run", "'all'", [("n_events", "count(*)"), ("n_runs", "count(distinct user_id)")], "events"),
    "select 'run', 'all', 'optimal_threshold', cast(arg_max(candidate, mean_dice) as double) / 1000 from (select * from sw order by mean_dice desc, candidate limit 1)",
    "select 'threshold_sweep', printf('%.3f', candidate / 1000.0::double), 'mean_dice', mean_dice from sw",
    _long("test_metrics_summary", "'all'", [("mean_dice_3d", "avg(dice_3d)"), ("median_dice_3d", "median(dice_3d)"), ("mean_iou_3d", "avg(iou_3d)"), ("mean_hd95_mm", "avg(hd95_3d)"), ("mean_asd_mm", "avg(asd_3d)"), ("mean_sensitivity", "avg(sensitivity_3d)"),
        ("mean_precision", "avg(precision_3d)"), ("mean_specificity", "avg(specificity_3d)"), ("mean_fp_components", "avg(fp_components)"), ("failure_count", "count(*) filter (is_failure)"), ("failure_rate_percent", "count(*) filter (is_failure) * 100.0::double / count(*)")], "bm"),
    _long("macro_average", "'all'", [(c, f"avg({c})") for c in evaluate.METRIC_COLUMNS], "bm"),
    _long("micro_average", "'all'", _POOLED, "bm"),
    *[_long("stratified_report", "c", [(f"{n}_{m}", f"{f}") for n, f in (("mean", f"avg({m})"), ("median", f"median({m})"), ("std", f"stddev_pop({m})"))], "bm join (values ('small'), ('medium'), ('large')) k(c) on c = tumor_category group by c") for m in _COLS],
    "select 'stratified_report', c, 'n_patients', count(case_id) from (values ('small'), ('medium'), ('large')) k(c) left join bm on c = tumor_category group by c",
    "select 'stratified_report', c, 'failure_rate_pct', avg(case when is_failure then 100.0::double else 0.0::double end) from bm join (values ('small'), ('medium'), ('large')) k(c) on c = tumor_category group by c",
    *[f"select 'per_patient_test_metrics', case_id::varchar, '{c}', cast({c} as double) from bm" for c in (*_EVERY, *_PPCOLS)],
    *[f"select 'per_patient_test_metrics', case_id::varchar, 'pp_{c}', cast({c} as double) from conf4b" for c in ("tp", "fp", "fn", "tn")],
    _long("postprocessed", "'all'", [("min_fraction", "max(0.1)"), ("mean_components_removed", "avg(pp_components_removed)"), ("failure_count", "count(*) filter (pp_is_failure)"), ("failure_rate_percent", "count(*) filter (pp_is_failure) * 100.0::double / count(*)")], "bm"),
    _long("postprocessed", "'macro'", [(k, f"avg({c})") for k, c in run_report.FILTERED_MACRO.items()], "bm"),
    _long("postprocessed", "'micro'", _FILTERED, "conf4b"),
])


@query("snk03_run_report", with_ctes(*_PP, _SWEEP, _SWEPT, CATS, "bm as (select f.*, pp.* exclude (case_id), coalesce(tumor_category, 'unknown') as tumor_category from full_met f join pp on pp.case_id = f.case_id left join cats on cats.case_id = f.case_id)",
    body=f"select * from ({_REPORT}) where value is not null"))
def _(spark, sf):
    """All sections, written as JSON lines and read back."""
    metrics, _ = evaluate.evaluate(cut_lineage(mask(spark, sf)), fx.voxel_cases(spark, sf))
    named = evaluate.with_category(metrics, categories(spark, sf))
    run = fx.table(spark, sf, "events").agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_runs"))
    leaves = run_report.run_report(run, sweep.threshold_sweep(fx.scored_voxels(spark, sf)), named)
    path = scratch_path(spark, "run-report")
    sinks.write_documents(sinks.report_lines(leaves), path)
    text = F.when(F.col("section") == "threshold_sweep", F.format_string("%.3f", F.col("name").cast("double"))).otherwise(F.col("name"))
    return tables.read_report(spark, path).withColumn("name", text)


_RUNS = """rs as (select l_linenumber as run_id, case when l_linestatus = 'F' then 42 else 43 end as seed, l_suppkey as case_id, avg(l_discount) * 10 as dice from lineitem group by 1, 2, 3),
 per as (select run_id, seed, count(*) as n_cases, avg(dice) as mean_dice, min(dice) as worst_dice from rs group by 1, 2)"""


@query("src08_run_overview", with_ctes(_RUNS, body="""select 'run' || run_id as run_id, seed as run_seed, 'unet' || (run_id % 3) as model_type, 0.001::double * run_id as lr, cast(run_id * 2 + 1 as int) as n_adjacent,
 case when run_id <> seed - 40 then mean_dice end as reported_dice, n_cases, mean_dice, worst_dice from per"""))
def _(spark, sf):
    """Run folders with configuration, report and scores per case, found and joined. One run of each seed has no report."""
    scores = fx.run_scores(spark, sf).select("run_id", "seed", "case_id", "dice")
    root = scratch_path(spark, "runs")
    folder = F.concat(F.lit("run"), F.col("run_id").cast("string"))
    runs = [(r["run_id"], r["seed"]) for r in scores.select("run_id", "seed").distinct().orderBy("run_id", "seed").collect()]  # 14 runs
    scores = cut_lineage(scores.withColumn("exp", folder))
    for run, seed in runs:
        own = scores.where((F.col("run_id") == run) & (F.col("seed") == seed))
        path = f"{root}/experiments/run{run}/seed_{seed}"
        own.select(F.col("case_id").cast("string").alias("case_id"), F.col("dice").alias("dice_3d")).coalesce(1).write.csv(f"{path}/test_results_per_patient.csv", header=True)
        config = own.select("run_id", "seed").distinct().select(F.to_json(F.struct(
            F.concat(F.lit("run"), F.col("run_id").cast("string")).alias("exp_name"), "seed", F.concat(F.lit("unet"), (F.col("run_id") % 3).cast("string")).alias("model_type"), (F.col("run_id") * 2 + 1).alias("n_adjacent"),
            (F.lit(0.001) * F.col("run_id")).alias("lr"))).alias("value"))
        sinks.write_documents(config.coalesce(1), f"{path}/config.json")
        if run != seed - 40:
            mean = own.agg(F.avg("dice").alias("value")).select(F.lit("test_metrics_summary").alias("section"), F.lit("all").alias("name"), F.lit("mean_dice_3d").alias("leaf"), "value")
            sinks.write_documents(sinks.report_lines(mean), f"{path}/benchmark_report.json")
    return tables.run_overview(spark, root).select("run_id", "run_seed", "model_type", "lr", "n_adjacent", "reported_dice", "n_cases", "mean_dice", "worst_dice")
