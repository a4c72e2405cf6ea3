import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions.scalars import cosine_lr
from voxframe.operators import losses, monitors
from voxframe.streaming import running


def history(spark, runs):
    rows = [(r, e, float(s)) for r, scores in runs.items() for e, s in enumerate(scores, 1)]
    return spark.createDataFrame(rows, "run_id string, epoch int, score double")


def stop_by_loop(scores, patience, min_delta, min_epochs):
    best, counter = -np.inf, 0
    for epoch, score in enumerate(scores, 1):
        if score > best + min_delta:
            best, counter = score, 0
        else:
            counter += 1
            if counter >= patience and epoch >= min_epochs:
                return epoch
    return None


def collapse_by_loop(scores, peak=0.10, patience=3, tol=1e-6):
    armed, counter = False, 0
    for epoch, score in enumerate(scores, 1):
        armed = armed or score > peak
        if armed:
            counter = counter + 1 if score <= tol else 0
            if counter >= patience:
                return epoch
    return None


def random_runs():
    rng = np.random.default_rng(11)
    runs = {f"r{i}": np.round(np.maximum(0, rng.normal(0.2, 0.3, rng.integers(1, 60))), 3) for i in range(60)}
    runs["creep"] = np.arange(40) * 0.5e-4  # every record is below min_delta
    runs["steady"] = np.arange(40) * 1e-2
    runs["flat"] = np.zeros(30)
    return runs


@pytest.mark.parametrize("patience,min_epochs", [(3, 1), (5, 15), (10, 15)])
def test_early_stopping_equals_the_loop(spark, patience, min_epochs):
    runs = random_runs()
    got = {r.run_id: r.stop_epoch for r in monitors.early_stopping(history(spark, runs), patience, min_epochs=min_epochs).collect()}
    assert got == {k: stop_by_loop(v, patience, 1e-4, min_epochs) for k, v in runs.items()}


def test_collapse_series(spark):
    climb = [0.01 * i for i in range(17)]
    runs = {"falls": climb + [0, 0, 0], "recovers": climb + [0, 0, 0.2, 0, 0], "never_armed": [0.0] * 10, "again": climb + [0, 0, 0.2, 0, 0, 0, 0]}
    runs |= random_runs()
    got = {r.run_id: r.collapse_epoch for r in monitors.collapse(history(spark, runs)).collect()}
    assert got == {k: collapse_by_loop(v) for k, v in runs.items() if collapse_by_loop(v)}
    assert got["falls"] == 20 and "recovers" not in got and "never_armed" not in got


def test_stream_equals_batch(spark, tmp_path):
    runs = {k: v for k, v in random_runs().items() if k < "r3"}
    df = history(spark, runs)
    for condition in ("epoch <= 7", "epoch between 8 and 25", "epoch > 25"):
        df.where(condition).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events = running.run_to_files(running.run_events(stream, patience=3, min_epochs=5), str(tmp_path / "out")).collect()
    stops = {r.run_id: r.epoch for r in events if r.reason == "early_stop"}
    assert stops == {k: s for k, v in runs.items() if (s := stop_by_loop(v, 3, 1e-4, 5))}
    falls = {r.run_id: r.epoch for r in events if r.reason == "collapsed"}
    assert falls == {k: s for k, v in runs.items() if (s := collapse_by_loop(v))}


def test_epoch_loss_and_divergence(spark):
    nan = float("nan")
    rows = [("a", 1, nan, 2)] * 3 + [("b", 1, 1.0, 2), ("b", 1, 4.0, 1), ("b", 1, float("inf"), 2)]
    epochs = monitors.epoch_loss(spark.createDataFrame(rows, "run_id string, epoch int, loss double, size int"))
    got = {r.run_id: (r.train_loss, r.nonfinite, r.batches) for r in epochs.collect()}
    assert got == {"a": (0.0, 3, 3), "b": (2.0, 1, 3)}
    assert [tuple(r) for r in monitors.divergence(epochs).collect()] == [("a", 1)]


def test_run_stop_order_on_ties(spark):
    d = spark.createDataFrame([("a", 5)], "run_id string, diverged_epoch int")
    c = spark.createDataFrame([("a", 5), ("b", 7)], "run_id string, collapse_epoch int")
    e = spark.createDataFrame([("a", 5), ("b", 7), ("c", 9), ("d", None)], "run_id string, stop_epoch int")
    got = {r.run_id: (r.epoch, r.reason) for r in monitors.run_stop(d, c, e).collect()}
    assert got == {"a": (5, "diverged"), "b": (7, "collapsed"), "c": (9, "early_stop")}


def test_best_so_far_is_strict(spark):
    got = [(r.is_best, r.best_score) for r in monitors.best_so_far(history(spark, {"a": [0.1, 0.1, 0.3, 0.2]})).orderBy("epoch").collect()]
    assert got == [(True, 0.1), (False, 0.1), (True, 0.3), (False, 0.3)]


def test_learning_rate_is_held_at_the_floor(spark):
    rates = [r.lr for r in spark.range(1, 7).select(cosine_lr(F.col("id"), 2, 1e-3).alias("lr"), "id").orderBy("id").collect()]
    assert rates == sorted(rates, reverse=True) and rates[-1] == pytest.approx(1e-5) and rates[1] == pytest.approx(1e-5)
    first = spark.range(1, 2).select(cosine_lr(F.col("id"), 50, 1e-3).alias("lr")).first().lr
    assert round(first, 8) == 0.00099902


def pixels(spark, prob, gt):
    rows = [("a", s, float(p), int(g)) for s, (ps, gs) in enumerate(zip(prob, gt)) for p, g in zip(ps, gs)]
    return spark.createDataFrame(rows, "case_id string, slice_idx int, prob double, gt int")


def test_losses_of_an_empty_slice(spark):
    p = 1 / (1 + np.exp(1.0))  # logit -1 everywhere
    df = pixels(spark, [[p] * 50], [[0] * 50])
    got = {n: losses.loss(df, n).first().loss for n in losses.LOSS_NAMES}
    assert got["dice_ce"] == pytest.approx(1.3133, abs=1e-4) and got["dice_focal"] == pytest.approx(1.0227, abs=1e-4)
    assert got["tversky"] == pytest.approx(1.0) and got["focal_tversky"] == pytest.approx(1.0)


def test_loss_properties(spark):
    rng = np.random.default_rng(2)
    prob, gt = rng.random((3, 40)), (rng.random((3, 40)) < 0.3).astype(int)
    df = pixels(spark, prob, gt)
    even = losses.slice_losses(df, alpha=0.5, beta=0.5)
    for r in even.collect():
        p, g = prob[r.slice_idx], gt[r.slice_idx]
        assert r.dice == pytest.approx(1 - 2 * (p * g).sum() / (p.sum() + g.sum()), abs=1e-5)
        assert r.tversky == pytest.approx(r.dice, abs=1e-5)
        assert r.ce == pytest.approx(-np.log(np.where(g, p, 1 - p)).mean())
    mean = losses.loss(df, "tversky").first().loss
    assert losses.loss(df, "focal_tversky").first().loss == pytest.approx(mean**0.75)
    perfect = pixels(spark, [[1.0, 0.0]], [[1, 0]])
    assert losses.loss(perfect, "dice_ce").first().loss == pytest.approx(0, abs=1e-4)
    with pytest.raises(ValueError):
        losses.loss(df, "other")


def test_confident_background_does_not_vanish(spark):
    p = 1 / (1 + np.exp(20.0))
    r = losses.slice_losses(pixels(spark, [[p] * 1000], [[0] * 1000])).first()
    assert 0 < r.ce < 1e-8 and r.dice == pytest.approx(1.0)


@pytest.mark.parametrize("block", [1, 3, 16, 4096])
def test_accepted_epochs_equal_a_walk(spark, block):
    rng = np.random.default_rng(9)
    runs, delta = {}, 0.05
    for run in range(12):
        steps = rng.choice([-0.03, 0.0, 0.01, 0.04, 0.049, 0.051, 0.2], 200, p=[0.2, 0.1, 0.3, 0.2, 0.1, 0.05, 0.05])
        scores = np.round(np.cumsum(steps), 6)
        if run == 3:
            scores[:] = 0.5
        if run == 4:
            scores[rng.random(200) < 0.3] = np.nan
        runs[run] = scores.tolist()
    rows = [(r, e + 1, s) for r, scores in runs.items() for e, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "run_id bigint, epoch int, score double").repartition(5)
    want = []
    for r, scores in runs.items():
        best = -np.inf
        for e, s in enumerate(scores):
            if s > best + delta:
                best = s
                want.append((r, e + 1, s))
    assert sorted(tuple(r) for r in monitors.improvements(df, delta, block).collect()) == want
    assert monitors.improvements(df.limit(0), delta, block).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_late_epochs_give_the_batch_result(spark, tmp_path, seed):
    runs = random_runs()
    rows = [(k, e, float(s)) for k, scores in runs.items() for e, s in enumerate(scores, 1)]
    random.Random(seed).shuffle(rows)
    source = str(tmp_path / "in")
    schema = "run_id string, epoch int, score double"
    for i in range(7):
        part = rows[i::7] + (rows[:3] if i == 6 else [])  # some rows come twice
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    events = running.run_to_files(running.run_events(stream, patience=3, min_epochs=5), str(tmp_path / "out")).collect()
    stops = {r.run_id: r.epoch for r in events if r.reason == "early_stop"}
    assert stops == {k: stop_by_loop(v, 3, 1e-4, 5) for k, v in runs.items() if stop_by_loop(v, 3, 1e-4, 5)}
    assert {r.run_id: r.epoch for r in events if r.reason == "collapsed"} == {k: collapse_by_loop(v) for k, v in runs.items() if collapse_by_loop(v)}


def test_repeated_batches_replace_themselves(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(c), float(p), int(g)) for c, p, g in zip(rng.integers(0, 5, 300), rng.random(300), rng.integers(0, 2, 300))]
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame(rows[i::3], "case_id int, prob double, gt int").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("case_id int, prob double, gt int").option("maxFilesPerTrigger", 1).parquet(source)
    written = running.run_updates(running.running_sums(stream), path)
    assert written.select("version").distinct().count() == 3
    # the last batch once more, as after a failure between sink and checkpoint
    last = spark.createDataFrame(written.where("version = 2").drop("version").collect(), written.drop("version").schema)
    last.write.mode("overwrite").parquet(f"{path}/rows/version=2")
    from voxframe.operators.overlap import fast_dice

    want = {r.case_id: (r.dice_hard, r.dice_soft) for r in fast_dice(spark.createDataFrame(rows, "case_id int, prob double, gt int")).collect()}
    got = {r.case_id: (r.dice_hard, r.dice_soft) for r in running.latest_dice(spark.read.parquet(f"{path}/rows")).collect()}
    assert set(got) == set(want) and all(got[c] == pytest.approx(want[c]) for c in want)


def test_buckets_join_without_a_shuffle(spark, tmp_path):
    from voxframe.sources import tables

    left = spark.range(500).selectExpr("id % 40 as case_id", "id as v")
    right = spark.range(40).selectExpr("id as case_id", "id * 2 as w")
    a, b = (tables.write_bucketed(d, str(tmp_path / f"{n}_{tmp_path.name}"), 4) for n, d in (("left", left), ("right", right)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, "case_id").groupBy("case_id").agg(F.sum("v").alias("v"), F.max("w").alias("w"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in joined.collect()) == sorted((c, sum(range(c, 500, 40)), 2 * c) for c in range(40))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_runs_share_a_state(spark, tmp_path):
    """A state for each run cost several milliseconds a batch; runs of one bucket stay apart, also one without a name."""
    from voxframe.streaming import running

    rng = np.random.default_rng(11)
    runs = {k: [float(rng.choice([0.0, 0.2, 0.3, 0.5])) if rng.random() < 0.6 else 0.0 for _ in range(20)] for k in (None, *range(12))}
    rows = [(k, e, v[e - 1]) for k, v in runs.items() for e in range(1, 21)]
    source, schema = str(tmp_path / "in"), "run_id bigint, epoch int, score double"
    for i in (1, 0, 2):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = running.run_events(stream, patience=3, min_epochs=5, buckets=2)
    events = running.run_to_files(found, str(tmp_path / "out")).collect()
    assert {r.run_id: r.epoch for r in events if r.reason == "early_stop"} == {k: stop_by_loop(v, 3, 1e-4, 5) for k, v in runs.items() if stop_by_loop(v, 3, 1e-4, 5)}
    assert {r.run_id: r.epoch for r in events if r.reason == "collapsed"} == {k: collapse_by_loop(v) for k, v in runs.items() if collapse_by_loop(v)}
