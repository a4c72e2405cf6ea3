import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions.draws import draw_key, integer_between, uniform
from voxframe.operators.skew import attach, exact_quantiles, rank_by_hash, running_before


@pytest.fixture(scope="module")
def skewed(spark):
    """Case 0 holds most rows, with many ties; case 3 a single row."""
    rng = np.random.default_rng(5)
    rows = [(0, float(v)) for v in np.round(rng.normal(0, 1, 5000), 2)] + [(1, float(v)) for v in rng.random(37)]
    rows += [(2, 7.0)] * 11 + [(3, 0.25)]
    return spark.createDataFrame(rows, "k int, v double"), rows


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_quantiles_equal_numpy(skewed, q):
    df, rows = skewed
    got = {r.k: r.q for r in exact_quantiles(df, ["k"], "v", {"q": q}).collect()}
    for k in range(4):
        assert got[k] == pytest.approx(np.percentile([v for c, v in rows if c == k], q * 100), abs=1e-12)


def test_quantiles_without_keys_and_several_at_once(skewed):
    df, rows = skewed
    got = exact_quantiles(df, [], "v", {"lo": 0.1, "hi": 0.9}).first()
    values = [v for _, v in rows]
    assert (got.lo, got.hi) == pytest.approx((np.percentile(values, 10), np.percentile(values, 90)))


def test_quantiles_nan_and_null(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 3.0), (2, float("nan")), (2, 1.0)], "k int, v double")
    got = {r.k: r.q for r in exact_quantiles(df, ["k"], "v", {"q": 0.5}).collect()}
    assert got[1] == 2.0 and np.isnan(got[2])


def test_rank_by_hash_is_row_number(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id").withColumn("h", draw_key(1, F.col("id")))
    got = {(r.k, r.id): r["rank"] for r in rank_by_hash(df, ["k"], "h", ["id"]).collect()}
    for k in (0, 1):
        ids = sorted((i for i in range(3000) if (i % 3 == 0) == bool(k)), key=lambda i: hashlib.md5(f"1|{i}".encode()).hexdigest())
        assert all(got[(k, i)] == n + 1 for n, i in enumerate(ids))


def test_running_before_spans_blocks(spark):
    rng = np.random.default_rng(0)
    scores = rng.random(500)
    df = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores)], "k int, i int, s double")
    got = {r.i: r.b for r in running_before(df, ["k"], "i", F.col("s"), "b", block=7).collect()}
    assert got[0] is None
    assert all(got[i] == scores[:i].max() for i in range(1, 500))


def test_attach_keeps_every_row(spark):
    rows = spark.range(1000).select(F.lit(1).alias("k"), "id")
    keys = spark.createDataFrame([(1, "a")], "k int, name string")
    out = attach(rows, keys, ["k"], ["id"])
    assert out.count() == 1000 and out.select("id").distinct().count() == 1000


def test_draws_are_uniform_and_repeatable(spark):
    df = spark.range(20000).select(uniform(3, F.col("id")).alias("u"), integer_between(-2, 2, 3, F.col("id")).alias("i"))
    a, b = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.countDistinct("i"), F.min("i"), F.max("i")).first(), df.agg(F.avg("u")).first()
    assert a[0] == pytest.approx(0.5, abs=0.01) and a[0] == pytest.approx(b[0]) and 0 <= a[1] and a[2] < 1
    assert a[3:] == (5, -2, 2)


@pytest.mark.parametrize("most", [1, 5, 40])
def test_quantiles_by_narrowing(spark, most):
    rng = np.random.default_rng(3)
    groups = {k: np.round(rng.normal(0, 3, n), d) for k, (n, d) in enumerate([(1, 3), (2, 0), (500, 3), (500, 0), (37, 1)])}
    rows = [(k, float(v), int(w)) for k, vs in groups.items() for v, w in zip(vs, rng.integers(1, 4, len(vs)))]
    df = spark.createDataFrame(rows, "k int, v double, w int")
    got = {r.k: (r.a, r.b) for r in exact_quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.73}, weight="w", splits=4, most=most).collect()}
    for k in groups:
        full = np.repeat([v for g, v, _ in rows if g == k], [w for g, _, w in rows if g == k])
        assert got[k] == pytest.approx(tuple(np.quantile(full, [0.05, 0.73])))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_heavy_keys_only_are_repeated(spark, monkeypatch):
    from voxframe.operators import components, skew
    from voxframe.session import cut_lineage

    monkeypatch.setattr(skew, "HEAVY", 10)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 10), (4, 1)) for i in range(n)], "k int, i int")
    keys = cut_lineage(spark.createDataFrame([(1, "a", 50), (2, "b", 3), (3, "c", 10)], "k int, name string, n int"))
    for how in ("inner", "left"):
        found = skew.attach(rows, keys, ["k"], ["i"], how, heavy="n")
        assert found.columns == ["k", "i", "name"]
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, rows.join(keys.drop("n"), "k", how).collect()), key=str)
    # stored components are nearly as many as voxels: repeating and broadcasting them took the driver's memory
    labelled = cut_lineage(spark.range(2000).selectExpr("0L as case_id", "cast(id as int) as x", "0 as y", "0 as z", "id as label"))
    kept = components.filter_components(labelled)
    assert "SortMergeJoin" in _plan(kept)
    assert kept.count() == 2000


def test_quantiles_of_small_groups_join_nothing(spark):
    from voxframe.operators.skew import exact_quantiles

    rows = spark.range(1000).selectExpr("id % 7 as k", "cast(id as double) as v").unionAll(spark.sql("select 8L, double('NaN')"))
    found = exact_quantiles(rows, ["k"], "v", {"q": 0.95})
    assert "Join" not in _plan(found)
    got = {r.k: r.q for r in found.collect()}
    import numpy as np
    for k in range(7):
        assert abs(got[k] - np.quantile(np.arange(k, 1000, 7), 0.95)) < 1e-9
    assert np.isnan(got[8])
    split = {r.k: r.q for r in exact_quantiles(rows, ["k"], "v", {"q": 0.95}, splits=4, most=10).collect()}
    assert {k: v for k, v in split.items() if k < 8} == {k: v for k, v in got.items() if k < 8} and np.isnan(split[8])


def test_labels_meet_their_voxels_once(spark):
    """The labels of small cubes are nearly as many as voxels; they were repeated 16 times."""
    from voxframe.operators import components

    mask = spark.range(512).selectExpr("0L as case_id", "cast(id div 64 as int) as x", "cast(id div 8 % 8 as int) as y", "cast(id % 8 as int) as z")
    labelled = components.connected_components(mask, 8, 8, block=2, local_edges=0)
    assert "Generate" not in _plan(labelled)
    assert labelled.where("label <> 0").count() == 0 and labelled.count() == 512


def test_components_are_not_broadcast_for_their_fate(spark):
    """Stored components take a few bytes a row, so the inner join broadcast them all instead of the few cases."""
    from voxframe.operators import components
    from voxframe.session import cut_lineage

    sizes = cut_lineage(spark.range(3000).selectExpr("id % 1500 as case_id", "id as label", "id % 5 + 1 as size").unionAll(spark.sql("select null, 1L, 1L")))
    fate = components.fate_of_sizes(sizes, 0.5)
    assert "LeftOuter" in _plan(fate) and "BuildLeft" not in _plan(fate)
    held = sorted(((r.case_id, r.label, r.size) for r in sizes.collect() if r.case_id is not None))
    top = {}
    for case, label, size in held:
        top[case] = max(top.get(case, (0, 0)), (size, -label))
    want = [(case, label, size, size >= 0.5 * top[case][0] or label == -top[case][1]) for case, label, size in held]
    assert sorted(map(tuple, fate.collect())) == want


def test_batches_and_their_sizes_meet_without_a_broadcast(spark):
    import __spark_entry__

    assert "Broadcast" not in _plan(__spark_entry__.queries()["a18_inference_time"](spark, __spark_entry__.SMOKE_DIR))


def test_augmentation_runs_its_functions_once(spark):
    """An explode of the pixels pushed a filter below that ran both functions again, in workers of their own."""
    import __spark_entry__

    assert _plan(__spark_entry__.queries()["g16_augment_anatomic"](spark, __spark_entry__.SMOKE_DIR)).count("ArrowEvalPython") == 2


def test_voxels_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    from __spark_entry__ import SMOKE_DIR, queries
    from voxframe.operators import skew

    restore = queries()["g03_restore"]
    few = restore(spark, SMOKE_DIR)
    monkeypatch.setattr(skew, "TASK_ROWS", 100, raising=False)
    many = restore(spark, SMOKE_DIR)
    assert many.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SMOKE_DIR}/lineitem.parquet").count() // 100) > few.rdd.getNumPartitions()
    assert sorted(many.collect()) == sorted(few.collect())
