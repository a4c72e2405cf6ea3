"""NaN follows IEEE comparisons, and tied candidates give the lowest threshold."""

import gzip
import math

import numpy as np
import pytest

from voxframe.operators import masks, monitors, overlap, sweep
from voxframe.sources import volumes


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_tied_candidates_give_the_lowest(spark, partitions):
    rows = [(case, 0.97 if k < 3 else 0.2 + case / 100, int(k < 2)) for case in range(37) for k in range(9)]
    df = spark.createDataFrame(rows, "case_id int, prob double, gt int").repartition(partitions)
    swept = sweep.threshold_sweep(df)
    assert swept.count() == len(sweep.DEFAULT_THRESHOLDS)
    best = sweep.best_threshold(swept).first()
    means = {r.threshold: r.mean_dice for r in swept.collect()}
    assert best.best_threshold == min(t for t, m in means.items() if m == max(means.values()))


def test_sweep_without_cases_and_without_truth(spark):
    df = spark.createDataFrame([], "case_id int, prob double, gt int")
    assert {r.mean_dice for r in sweep.threshold_sweep(df).collect()} == {0.0}
    some = spark.createDataFrame([(1, 0.7, 1)], "case_id int, prob double, gt int")
    with pytest.raises(ValueError):
        sweep.threshold_sweep(some, truth_cases=some.where("false").select("case_id"))


def test_nan_is_no_positive(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, float("nan"), 1.0), (1, 0, 0, 1, 0.9, 1.0)], "case_id int, x int, y int, z int, prob double, gt double")
    assert sorted((r.z, r.pred) for r in masks.pair_from_scores(df).collect()) == [(0, 0), (1, 1)]
    assert all(r.pred == 1 for r in sweep.sweep_by_case(df).where("threshold < 0.9").collect())
    assert overlap.fast_dice(df).first().dice_hard == pytest.approx(2 / 3)


def plain_best(scores):
    best, out = None, []
    for s in scores:
        better = not math.isnan(s) and (best is None or s > best)
        best = s if better else best
        out.append((best, better))
    return out


def test_nan_is_never_best_and_never_arms(spark):
    nan = float("nan")
    scores = [0.2, nan, 0.3, 0.4, nan, 0.5, 0.6, 0.7]
    df = spark.createDataFrame([(1, e + 1, s) for e, s in enumerate(scores)], "run_id int, epoch int, score double")
    got = [(r.best_score, r.is_best) for r in monitors.best_so_far(df).orderBy("epoch").collect()]
    assert got == plain_best(scores)
    assert monitors.early_stopping(df, patience=3, min_epochs=1).first().stop_epoch is None
    dead = spark.createDataFrame([(1, e + 1, s) for e, s in enumerate([nan, 0.0, 0.0, 0.0])], "run_id int, epoch int, score double")
    assert monitors.collapse(dead).count() == 0


def test_gzip_members_are_joined_and_cut_files_refused():
    body = gzip.compress(b"a" * 300) + gzip.compress(b"b" * 300)
    assert volumes._unpacked(body) == b"a" * 300 + b"b" * 300
    assert volumes._unpacked(body, 348) == b"a" * 300 + b"b" * 48
    with pytest.raises(ValueError):
        volumes._unpacked(body[:-9])


def test_intensity_stats_with_nan_and_large_offset(spark):
    from voxframe.operators import audit

    rng = np.random.default_rng(1)
    volumes = {1: [1e8 + rng.normal(0, 1, 50) for _ in range(7)], 2: [np.array([1.0, np.nan, 3.0]), np.array([0.5])], 3: [np.array([4.0])]}
    rows = [(c, i, [float(x) for x in v]) for c, vs in volumes.items() for i, v in enumerate(vs)] + [(4, 0, []), (4, 1, None)]
    df = spark.createDataFrame(rows, "case_id bigint, slice_idx int, pixels array<double>").repartition(3)
    got = {r.case_id: r for r in audit.intensity_stats(df).collect()}
    full = np.concatenate(volumes[1])
    assert got[1].mean == pytest.approx(full.mean(), rel=1e-14) and got[1]["std"] == pytest.approx(full.std(), rel=1e-6)
    assert (got[1].min, got[1].max) == (full.min(), full.max()) and got[1].p5 == pytest.approx(np.quantile(full, 0.05), rel=1e-14)
    assert got[2].min == 0.5 and all(np.isnan(got[2][c]) for c in ("max", "mean", "std", "p5", "p95"))
    assert (got[3].min, got[3]["std"], got[3].p95) == (4.0, 0.0, 4.0) and 4 not in got
