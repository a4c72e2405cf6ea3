import numpy as np
import pytest
from shapes import brute_distances, case_table, cube, paired

from voxframe.operators import evaluate, overlap, reports, sweep
from voxframe.operators.masks import align_masks
from voxframe.session import cut_lineage

S = (50, 50, 50)
EMPTY = np.zeros(S, dtype=np.uint8)


@pytest.fixture(scope="module")
def scenarios(spark):
    a = cube(10, 20)
    cases = {0: (a, a), 1: (a, cube(30, 40)), 2: (EMPTY, EMPTY), 3: (a, EMPTY), 4: (EMPTY, a), 5: (a, cube(15, 25))}
    mask = paired(spark, cases)
    table = case_table(spark, {c: S for c in cases})
    metrics, filtered = evaluate.evaluate(mask, table)
    return mask, table, {r.case_id: r.asDict() for r in metrics.collect()}, metrics


def test_equal_masks(scenarios):
    m = scenarios[2][0]
    assert (m["dice_3d"], m["iou_3d"], m["sensitivity_3d"], m["precision_3d"], m["specificity_3d"]) == (1, 1, 1, 1, 1)
    assert (m["hd95_3d"], m["asd_3d"], m["fp_components"], m["is_failure"]) == (0, 0, 0, False)


def test_disjoint_masks(scenarios):
    m = scenarios[2][1]
    assert m["dice_3d"] == 0 and m["iou_3d"] == 0 and m["fp_components"] == 1 and m["is_failure"]
    assert m["hd95_3d"] > 10


def test_both_empty(scenarios):
    m = scenarios[2][2]
    assert (m["dice_3d"], m["sensitivity_3d"], m["precision_3d"], m["iou_3d"]) == (1, 1, 1, 1)
    assert m["hd95_3d"] == 100 and m["asd_3d"] == 100 and m["fp_components"] == 0 and not m["is_failure"]


def test_false_alarm_and_miss(scenarios):
    alarm, miss = scenarios[2][3], scenarios[2][4]
    assert (alarm["dice_3d"], alarm["sensitivity_3d"], alarm["precision_3d"], alarm["fp_components"]) == (0, 1, 0, 1)
    assert not alarm["is_failure"] and alarm["gt_empty"]
    assert (miss["dice_3d"], miss["sensitivity_3d"], miss["precision_3d"], miss["fp_components"]) == (0, 0, 0, 0)
    assert miss["is_failure"] and miss["pred_empty"] and miss["hd95_3d"] == 100


def test_shifted_cube(scenarios):
    m = scenarios[2][5]
    assert m["dice_3d"] == 0.125 and m["tn"] == 50**3 - 1875 and m["fp_components"] == 0
    pooled = np.concatenate([brute_distances(cube(10, 20), cube(15, 25), (1, 1, 1)), brute_distances(cube(15, 25), cube(10, 20), (1, 1, 1))])
    assert m["hd95_3d"] == pytest.approx(np.percentile(pooled, 95))


def test_without_surface_only_distances_change(spark, scenarios):
    mask, table, full, _ = scenarios
    fast = {r.case_id: r.asDict() for r in evaluate.case_metrics(mask, table, surface_metrics=False).collect()}
    for case, row in fast.items():
        for key, value in row.items():
            if key in ("hd95_3d", "asd_3d"):
                assert np.isnan(value)
            else:
                assert value == full[case][key]


def test_micro_rule_differs_from_case_rule(spark):
    table = case_table(spark, {0: S})
    mask = paired(spark, {0: (EMPTY, cube(10, 20))})
    counts = overlap.confusion(mask, table)
    assert overlap.overlap_metrics(counts).first().precision_3d == 0.0
    assert overlap.micro_average(counts).first().precision_3d == 1.0


def test_macro_of_nothing_and_of_nan(spark):
    empty = spark.createDataFrame([], "dice_3d double")
    assert overlap.macro_average(empty, ["dice_3d"]).first().dice_3d == 0.0
    nan = spark.createDataFrame([(1.0,), (float("nan"),)], "dice_3d double")
    assert np.isnan(overlap.macro_average(nan, ["dice_3d"]).first().dice_3d)


def test_strata_always_present(scenarios, spark):
    cats = spark.createDataFrame([(0, "small"), (1, "small"), (5, "large")], "case_id bigint, tumor_category string")
    rows = {(r.tumor_category, r.metric): r for r in reports.stratified_report(evaluate.with_category(scenarios[3], cats)).collect()}
    assert rows[("medium", "dice_3d")].n_patients == 0 and rows[("medium", "dice_3d")]["mean"] is None
    small = rows[("small", "dice_3d")]
    assert (small.n_patients, small["mean"], small.median, small.std, small.failure_rate_pct) == (2, 0.5, 0.5, 0.5, 50.0)


def test_pp_columns_only_when_filtering(spark, scenarios):
    mask, table, full, metrics = scenarios
    off, same = evaluate.evaluate(mask, table, min_fraction=0, surface_metrics=False)
    assert same is mask and not [c for c in off.columns if c.startswith("pp_")]
    assert evaluate.export_frame(off).columns == list(evaluate.BASE_EXPORT)
    extra = evaluate.export_frame(metrics).columns[len(evaluate.BASE_EXPORT):]
    assert extra == sorted(extra) and "pp_dice_3d" in extra


def test_alignment_equals_full_join(spark):
    p = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 1)], "case_id int, x int, y int, z int")
    g = spark.createDataFrame([(1, 0, 0, 1), (2, 0, 0, 0)], "case_id int, x int, y int, z int")
    got = {tuple(r) for r in align_masks(p, g).collect()}
    assert got == {(1, 0, 0, 0, 1, 0), (1, 0, 0, 1, 1, 1), (2, 0, 0, 0, 0, 1)}


def planted(spark, background, lesion, decoy=None):
    rows = []
    for z in range(10):
        for r in range(16):
            for c in range(16):
                inside = 3 <= z <= 6 and 4 <= r < 8 and 4 <= c < 8
                p = lesion if inside else background
                if decoy and 3 <= z <= 6 and 10 <= r < 13 and 10 <= c < 13:
                    p = decoy
                rows.append((0, float(p), int(inside)))
    return cut_lineage(spark.createDataFrame(rows, "case_id bigint, prob double, gt int"))


def test_sweep_finds_the_planted_optimum(spark):
    result = sweep.threshold_sweep(planted(spark, 0.05, 0.8, 0.62))
    scores = {r.threshold: r.mean_dice for r in result.collect()}
    best = sweep.best_threshold(result).first()
    assert best.best_threshold == 0.65 and best.best_dice == 1.0  # ties go to the lowest
    assert len(scores) == 21 and len(set(scores.values())) > 1 and min(scores) == 0.1 and max(scores) == 0.99


def test_sweep_reaches_beyond_ninety(spark):
    assert sweep.best_threshold(sweep.threshold_sweep(planted(spark, 0.93, 0.999))).first().best_threshold > 0.90


def test_sweep_equals_direct_dice(spark):
    df = planted(spark, 0.05, 0.8, 0.62)
    for r in sweep.sweep_by_case(df).where("threshold in (0.3, 0.65)").collect():
        direct = overlap.fast_dice(df, r.threshold).first()
        assert r.dice == direct.dice_hard


def test_sweep_refuses_test_and_missing_truth(spark):
    with pytest.raises(ValueError):
        sweep.threshold_sweep(spark.createDataFrame([], "case_id int, prob double, gt int"), split="test")
    a = spark.createDataFrame([(i,) for i in range(9)], "case_id int")
    with pytest.raises(ValueError, match=r"\[2, 3, 4, 5, 6\]"):
        sweep.require_truth(a, a.where("case_id < 2"))
    sweep.require_truth(a, a)


def test_seed_summary_matches_published_numbers(spark):
    # Three seeds of one experiment with their published mean and spread.
    dice = [0.5069428254976003, 0.47512534958617725, 0.47368543744271524]
    rows = [("a", s, d, d, d, d) for s, d in zip((42, 43, 44), dice)] + [("single", 1, 0.5, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "run_id string, seed int, dice double, hd95 double, sensitivity double, precision double")
    got = reports.multi_seed_summary(df).collect()
    assert len(got) == 1
    assert got[0].mean_dice == pytest.approx(0.4852512041754976) and got[0].std_dice == pytest.approx(0.015349552945310761)


def test_retention_on_published_cells(spark):
    # Two models under their own and under the other field of view.
    cells = spark.createDataFrame([("a", "full", 0.5069), ("a", "sliding", 0.1961), ("b", "full", 0.1398), ("b", "sliding", 0.3666)], "run_id string, condition string, score double")
    got = {r.run_id: r.retention for r in reports.retention(cells, "full", "sliding").collect()}
    assert got["a"] == pytest.approx(0.3869, abs=1e-4) and got["b"] > 1


def test_worst_first_is_stable(spark):
    cases = spark.createDataFrame([("c", 0), ("a", 1), ("b", 2), ("d", 3)], "case_id string, pos int")
    scores = spark.createDataFrame([("a", 0.2), ("b", 0.2), ("d", 1.0)], "case_id string, score double")
    assert [r.case_id for r in reports.worst_first(cases, scores).collect()] == ["a", "b", "c", "d"]


def test_paired_test_uses_the_baseline_mean(spark):
    rows = [(0, 1, c, d) for c, d in enumerate((0.4, 0.5, 0.6))] + [(0, 2, c, d) for c, d in enumerate((0.6, 0.7, 0.6))] + [(9, 1, c, d) for c, d in enumerate((0.4, 0.7, 0.5))]
    got = reports.paired_test(spark.createDataFrame(rows, "run_id int, seed int, case_id int, dice double"), 0).first()
    diff = np.array([-0.1, 0.1, -0.1])
    assert got.mean_diff == pytest.approx(diff.mean()) and got.wins == 1
    assert got.t == pytest.approx(diff.mean() / (diff.std(ddof=1) / np.sqrt(3)))
