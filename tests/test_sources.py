import json
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F
from shapes import write_nifti

from voxframe.functions import scalars
from voxframe.operators import audit
from voxframe.session import scratch_path
from voxframe.sources import manifest, sinks, tables, volumes


def test_manifest_order_and_optional_test_list(spark, tmp_path):
    doc = {"name": "x", "labels": {"0": "background"}, "training": [{"image": "./i/lung_010.nii.gz", "label": "./l/lung_010.nii.gz"}, {"image": "./i/lung_002.nii", "label": "./l/lung_002.nii"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    rows = manifest.read_manifest(spark, str(tmp_path / "a.json")).orderBy("pos").collect()
    assert [(r.role, r.case_id) for r in rows] == [("training", "lung_010"), ("training", "lung_002")]
    doc["test"] = ["./t/lung_003.nii.gz"]
    (tmp_path / "b.json").write_text(json.dumps(doc))
    tests = manifest.read_manifest(spark, str(tmp_path / "b.json")).where("role = 'test'").collect()
    assert [(r.case_id, r.label) for r in tests] == [("lung_003", None)]


def test_path_rules_in_order(spark):
    cases = spark.createDataFrame([(n, f"./d/{n}.nii.gz") for n in ("a", "b", "c", "e", "lung_1", "none")], "case_id string, path string")
    files = ["d/a.nii.gz", "d/a.nii", "d/b.nii", "d/c.nii/c.nii", "d/c.nii.gz/c.nii.gz", "d/e.nii.gz/e.nii.gz", "d/deep/lung_10.nii", "d/lung_12.nii.gz", "d/lung_1.txt", "x/none.nii"]
    resolved = manifest.resolve_paths(cases, spark.createDataFrame([(f,) for f in files], "path string"))
    got = {r.case_id: (r.rule, r.resolved) for r in resolved.collect()}
    assert got == {"a": (1, "d/a.nii.gz"), "b": (2, "d/b.nii"), "c": (3, "d/c.nii/c.nii"), "e": (4, "d/e.nii.gz/e.nii.gz"), "lung_1": (5, "d/deep/lung_10.nii"), "none": (None, None)}
    with pytest.raises(FileNotFoundError, match="none"):
        manifest.require_resolved(resolved)


@pytest.mark.parametrize("name,dtype,big", [("a.nii", "int16", False), ("a.nii.gz", "float32", False), ("a.nii.gz", "uint8", True), ("a.nii", "float64", True)])
def test_volume_reader(spark, tmp_path, name, dtype, big):
    data = np.arange(3 * 4 * 5).reshape(3, 4, 5).astype(dtype)
    affine = np.array([[0, 0, -2.0, 4], [1.5, 0, 0, -3], [0, 3.0, 0, 9], [0, 0, 0, 1]])
    write_nifti(tmp_path / name, data, affine, big)
    (tmp_path / "broken.nii").write_bytes(b"nothing")
    assert volumes.list_volumes(spark, str(tmp_path)).count() == 2
    head = {r.case_id: r for r in volumes.read_headers(spark, str(tmp_path)).collect()}
    assert head["a"].shape == [3, 4, 5] and head["a"].spacing == [1.5, 3.0, 2.0] and head["a"].affine == affine.tolist()
    assert head["broken"].error and head["broken"].shape is None
    rows = {r.slice_idx: np.array(r.pixels).reshape(r.height, r.width) for r in volumes.read_volumes(spark, str(tmp_path)).where("error is null").collect()}
    assert all(np.array_equal(rows[z], data[:, :, z]) for z in range(5))
    turned = volumes.read_volumes(spark, str(tmp_path), canonical=True).where("error is null").collect()
    stack = np.stack([np.array(r.pixels).reshape(r.height, r.width) for r in sorted(turned, key=lambda r: r.slice_idx)], axis=2)
    assert np.array_equal(stack, np.transpose(data[:, :, ::-1], (2, 0, 1))) and (turned[0].sx, turned[0].sy, turned[0].sz) == (2.0, 1.5, 3.0)


def test_header_scan_leaves_contents(spark, tmp_path):
    folder = tmp_path / "some scans"
    folder.mkdir()
    noise = np.random.default_rng(1).integers(0, 255, (64, 64, 20)).astype("uint8")
    write_nifti(folder / "a b.nii.gz", noise, np.eye(4))
    write_nifti(folder / "c%20d.nii", noise, np.eye(4))
    headers = volumes.read_headers(spark, str(folder))
    assert {(r.case_id, tuple(r.shape)) for r in headers.collect()} == {("a b", (64, 64, 20)), ("c%20d", (64, 64, 20))}
    plan = headers._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "content" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_runs_keep_their_whole_configuration(spark, tmp_path):
    folder = tmp_path / "experiments" / "base" / "seed_7"
    folder.mkdir(parents=True)
    (folder / "config.json").write_text(json.dumps({"exp_name": "base", "lr": 0.01, "depth": 5, "window": {"low": -1}}, indent=1))
    row = tables.discover_runs(spark, str(tmp_path)).first()
    assert (row.run_id, row.run_seed, row.exp_name, row.lr, row.loss_type) == ("base", 7, "base", 0.01, None)
    assert row.config == {"exp_name": "base", "lr": "0.01", "depth": "5", "window": '{"low":-1}'}


def test_failures_are_reported_and_isolated(spark):
    rows = spark.createDataFrame([("a", 5.0, None), ("b", None, "bad file")], "case_id string, volume double, error string")
    good, failed = audit.split_failures(rows, keep_defaults=True, defaults={"volume": 0.0})
    assert {(r.case_id, r.volume) for r in good.collect()} == {("a", 5.0), ("b", 0.0)} and failed.first().error == "bad file"
    good, _ = audit.split_failures(rows, keep_defaults=False)
    assert [r.case_id for r in good.collect()] == ["a"]


def test_slices_are_replaced_when_a_case_moves(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(c, s, sp, [float(s)]) for c, sp in (("a", "train"), ("b", "val")) for s in range(4)]
    schema = "case_id string, slice_idx int, split string, pixels array<double>"
    tables.write_slices(spark.createDataFrame(rows, schema), path)
    moved = [(c, s, "test", p) for c, s, _, p in rows]
    tables.write_slices(spark.createDataFrame(moved, schema), path)
    assert tables.read_slices(spark, path, "train").count() == 0 and tables.read_slices(spark, path, "test", 1, 2).count() == 4


def test_slice_scan_prunes(spark, tmp_path):
    path = str(tmp_path / "s")
    tables.write_slices(spark.createDataFrame([("a", 1, "val", [0.5])], "case_id string, slice_idx int, split string, pixels array<double>"), path)
    plan = tables.read_slices(spark, path, "val", 1).select("case_id")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(split" in plan and "GreaterThanOrEqual(slice_idx,1)" in plan and "pixels" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_split_and_index_documents(spark, tmp_path):
    (tmp_path / "split.json").write_text(json.dumps({"train": ["a", "b"], "val": ["c"], "test": []}))
    assert {(r.case_id, r["split"]) for r in tables.read_split(spark, str(tmp_path / "split.json")).collect()} == {("a", "train"), ("b", "train"), ("c", "val")}
    index = {"splits": {"train": ["a"], "val": [], "test": []}, "cases": {"a": {"split": "train", "n_slices": 3, "positive_slices": [1], "body_slices": [0, 1], "tumor_voxels": 7}}}
    (tmp_path / "index.json").write_text(json.dumps(index))
    assert [(r.case_id, r["split"]) for r in tables.read_split(spark, str(tmp_path / "index.json")).collect()] == [("a", "train")]
    flags = tables.index_flags(tables.read_index(spark, str(tmp_path / "index.json"))).orderBy("slice_idx").collect()
    assert [(r.is_positive, r.is_body) for r in flags] == [(False, True), (True, True), (False, False)]
    with pytest.raises(Exception):
        tables.read_split(spark, str(tmp_path / "absent.json")).count()


def test_metadata_and_missing_ones(spark, tmp_path):
    meta = {"case_id": "a", "original_affine": np.eye(4).tolist(), "original_shape": [4, 5, 6], "original_spacing": [1.0, 1.0, 2.0], "ornt": [[0.0, -1.0], [1.0, 1.0], [2.0, 1.0]],
            "canonical_shape": [4, 5, 6], "canonical_spacing": [1.0, 1.0, 2.0], "target_spacing": [1.0, 1.0, 1.0], "resampled_shape": [4, 5, 12],
            "crop_bbox": {"x_min": 0, "x_max": 4, "y_min": 0, "y_max": 5, "z_min": 0, "z_max": 12}, "cropped_shape": [4, 5, 12], "target_slice_size": [192, 192], "hu_min": -1000.0, "hu_max": 400.0}
    (tmp_path / "a.json").write_text(json.dumps(meta, indent=2))
    rows = tables.read_metadata(spark, str(tmp_path / "*.json"))
    got = rows.first()
    assert got.ornt == [[0, -1], [1, 1], [2, 1]] and got.crop_bbox.z_max == 12
    cases = spark.createDataFrame([("a",), ("b",), ("b",)], "case_id string")
    assert [r.case_id for r in tables.without_metadata(cases, rows).collect()] == ["b"]


def test_runs_are_discovered_by_folder(spark, tmp_path):
    for exp, seed, dice in (("base", 42, 0.5), ("base", 43, 0.6), ("other", 1, 0.1)):
        folder = tmp_path / "experiments" / exp / f"seed_{seed}"
        folder.mkdir(parents=True)
        (folder / "config.json").write_text(json.dumps({"exp_name": "old name", "seed": seed, "lr": 0.001}))
        (folder / "results.csv").write_text(f"case_id,dice_3d\na,{dice}\n")
    runs = {(r.run_id, r.run_seed) for r in tables.discover_runs(spark, str(tmp_path)).collect()}
    assert runs == {("base", 42), ("base", 43), ("other", 1)}
    scores = tables.read_run_table(spark, str(tmp_path), "results.csv", "case_id string, dice_3d double")
    assert {(r.run_id, r.seed): r.dice_3d for r in scores.collect()}[("base", 43)] == 0.6


def test_exports(spark, tmp_path):
    schema = "case_id string, dice_3d double, is_failure boolean, pp_iou_3d double, pp_dice_3d double"
    rows = spark.createDataFrame([("b", 0.5, False, 0.1, 0.2), ("a", None, True, 0.3, 0.4)], schema)
    cats = spark.createDataFrame([("a", "small")], "case_id string, tumor_category string")
    assert sinks.write_case_metrics(rows, str(tmp_path / "m"), cats)
    lines = [line for f in sorted((tmp_path / "m").glob("part-*")) for line in f.read_text().splitlines()]
    header, body = lines[0], [line for line in lines if not line.startswith("case_id")]
    assert header.endswith("inference_time_sec,pp_dice_3d,pp_iou_3d") and body[0].startswith("a,small,,") and body[1].startswith("b,unknown,0.5")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert not sinks.write_case_metrics(rows.limit(0), str(tmp_path / "none"))
    assert seen and not (tmp_path / "none").exists()
    sinks.write_ordered_csv(rows, str(tmp_path / "q"), "case_id")
    back = tables.read_csv(spark, str(tmp_path / "q"), schema)
    assert back.count() == 2


def test_documents(spark, tmp_path):
    sweep = spark.createDataFrame([(0.5, 0.8), (0.3, 0.8), (0.9, 0.1)], "threshold double, mean_dice double")
    doc = json.loads(sinks.sweep_json(sweep).first().value)
    assert doc == {"best_threshold": 0.3, "sweep_results": {"0.3": 0.8, "0.5": 0.8, "0.9": 0.1}}
    summary = spark.createDataFrame([(63, True, True, False, 0, 1, 1.0, 9.5, 4.25)], "n_cases int, all_shape_match boolean, all_affine_match boolean, all_orientation_match boolean, n_is_empty_image int, n_is_empty_mask int, min_volume double, max_volume double, mean_volume double")
    text = sinks.markdown_report(summary).first().value
    assert "- Cases: 63" in text and "1.00 to 9.50 mm3 (mean 4.25)" in text and "orientation match: false" in text
    sinks.write_documents(sinks.report_json(summary, {"n": F.col("n_cases"), "range": {"low": F.col("min_volume")}}), str(tmp_path / "doc"))
    assert json.loads(spark.read.text(str(tmp_path / "doc")).first().value) == {"n": 63, "range": {"low": 1.0}}


def test_masks_carry_the_affine(spark, tmp_path):
    voxels = spark.createDataFrame([("a", 1, 2, 3)], "case_id string, x int, y int, z int")
    meta = spark.createDataFrame([("a", np.eye(4).tolist(), [4, 5, 6])], "case_id string, original_affine array<array<double>>, original_shape array<int>")
    for variant in ("raw", "filtered"):
        sinks.write_masks(voxels, meta, str(tmp_path / "p"), variant)
    assert spark.read.parquet(str(tmp_path / "p/raw")).join(spark.read.parquet(str(tmp_path / "p/affines")), "case_id").first().original_affine == np.eye(4).tolist()
    assert spark.read.parquet(str(tmp_path / "p/filtered")).count() == 1


def test_size_classes_at_the_bounds(spark):
    df = spark.createDataFrame([(999.9,), (1000.0,), (4999.9,), (5000.0,)], "v double")
    assert [r.c for r in df.select(scalars.classify_size(F.col("v")).alias("c")).collect()] == ["small", "medium", "medium", "large"]


def test_half_even_and_windows(spark):
    df = spark.createDataFrame([(2.5, -2000.0), (3.5, 1000.0)], "a double, h double")
    got = df.select(scalars.round_half_even(F.col("a")).alias("r"), scalars.window_value(F.col("h")).alias("w")).collect()
    assert [(r.r, r.w) for r in got] == [(2.0, 0.0), (4.0, 1.0)]


@pytest.mark.parametrize("suffix", [".nii", ".nii.gz"])
def test_slice_range_reads_the_slices_only(spark, tmp_path, suffix):
    rng = np.random.default_rng(0)
    volume = rng.integers(-900, 900, (7, 5, 40)).astype(np.int16)
    write_nifti(tmp_path / f"one{suffix}", volume, np.diag([1.0, 1.0, 2.0, 1.0]))
    (tmp_path / "broken.nii").write_bytes(b"not a volume")
    for first, last, want in ((None, None, range(40)), (17, 17, [17]), (30, 99, range(30, 40)), (38, None, [38, 39]), (50, 60, [])):
        rows = volumes.read_slice_range(spark, str(tmp_path), first, last, block=8).collect()
        good = {r.slice_idx: np.array(r.pixels).reshape(7, 5) for r in rows if r.error is None}
        assert sorted(good) == list(want) and all((good[z] == volume[:, :, z]).all() for z in good)
        assert [r.case_id for r in rows if r.error] == ["broken"]


def test_written_volumes_come_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    arrays = {"a": rng.random((4, 3, 5)).astype(np.float32), "b": rng.random((2, 6, 1)).astype(np.float32)}
    rows = [(c, z, v.shape[0], v.shape[1], 1.0, 2.0, 3.0, v[:, :, z].ravel().tolist()) for c, v in arrays.items() for z in range(v.shape[2])]
    df = spark.createDataFrame(rows, "case_id string, slice_idx int, height int, width int, sx double, sy double, sz double, pixels array<float>").repartition(3)
    volumes.write_volumes(df, str(tmp_path / "out"))
    for reader in (volumes.read_volumes, volumes.read_slice_range):
        got = {(r.case_id, r.slice_idx): r for r in reader(spark, str(tmp_path / "out")).collect()}
        assert len(got) == 6 and all(got[c, z].pixels == v[:, :, z].ravel().tolist() and got[c, z].sz == 3.0 for c, v in arrays.items() for z in range(v.shape[2]))


@pytest.mark.parametrize("name", ["src01_manifest", "src06_metadata"])
def test_documents_of_many_cases_share_files(spark, monkeypatch, name):
    """A file for each case made the files grow with the cases."""
    import __spark_entry__ as entry
    from voxframe.plans import documents

    paths = []
    monkeypatch.setattr(documents, "scratch_path", lambda s, n: paths.append(scratch_path(s, n)) or paths[-1])
    assert entry.queries()[name](spark, entry.SMOKE_DIR).count() > 0
    files = spark.read.text(paths[0]).select("_metadata.file_path").distinct().count()
    assert files <= int(spark.conf.get("spark.sql.shuffle.partitions")) < spark.read.text(paths[0]).count()


def test_report_text_rounds_ties_to_even(spark):
    from voxframe.sources import sinks

    values = [177.625, 177.375, -0.125, 0.375, 2.5, 40.18, 0.0, 1e12 + 0.125, float("nan"), float("inf")]
    df = spark.createDataFrame([(v, 3, "a") for v in values], "v double, n int, s string")
    text = sinks.markdown_report(df, (("- %d: %.2f of %s (%.2f %%), %.6e", ("n", "v", "s", "v", "v")), ("- %.0f", ("v",)), ("end", ())))
    got = [r.value for r in text.collect()]
    assert got[:8] == ["- 3: %.2f of a (%.2f %%), %.6e\n- %.0f\nend" % (v, v, v, v) for v in values[:8]]
    assert [g.splitlines()[1] for g in got[8:]] == ["- NaN", "- Infinity"]
