import numpy as np
import pytest
from shapes import brute_distances, case_table, cube, flood, paired, voxels

from voxframe.operators import components, distance, evaluate, masks
from voxframe.operators.geometry import body_bbox


def labels_of(df):
    return {(r.case_id, r.x, r.y, r.z): r.label for r in df.collect()}


@pytest.mark.parametrize("block,local_edges", [(3, 0), (3, 40), (5, 10**6), (64, 0)])
def test_components_equal_flood_fill(spark, block, local_edges):
    """Label graphs joined in tasks, by star joins, and some cases each way."""
    rng = np.random.default_rng(block)
    arrays = {c: (rng.random((11, 9, 13)) < p).astype(int) for c, p in enumerate((0.15, 0.32, 0.5))}
    got = labels_of(components.connected_components(voxels(spark, arrays), 9, 13, block=block, local_edges=local_edges))
    want = {(c, *p): label for c, m in arrays.items() for p, label in flood(m).items()}
    assert got == want


def test_long_chain_through_many_blocks(spark):
    snake = np.zeros((40, 6, 2), dtype=int)
    for i in range(0, 40, 2):
        snake[i, :, 0] = 1
        if i + 1 < 40:
            snake[i + 1, 5 if (i // 2) % 2 == 0 else 0, 0] = 1
    for local_edges in (0, 10**6):
        got = labels_of(components.connected_components(voxels(spark, {7: snake}), 6, 2, block=2, local_edges=local_edges))
        assert set(got.values()) == {0}


def test_diagonal_is_not_connected(spark):
    m = np.zeros((3, 3, 3), dtype=int)
    m[0, 0, 0] = m[1, 1, 0] = 1
    assert len(set(labels_of(components.connected_components(voxels(spark, {0: m}), 3, 3)).values())) == 2


def test_no_wrap_around_inside_a_block(spark):
    m = np.zeros((4, 4, 4), dtype=int)
    m[0, 0, 3] = m[0, 1, 0] = 1  # neighbours in raster order only
    assert len(set(labels_of(components.connected_components(voxels(spark, {0: m}), 4, 4, block=4)).values())) == 2


def satellites():
    m = np.zeros((40, 40, 40), dtype=int)
    m[5:15, 5:15, 5:15] = 1
    m[30, 30, 30] = m[35, 5, 5] = 1
    m[20:22, 20:22, 20:22] = 1
    return m


def run_filter(spark, mask, **options):
    labelled = components.connected_components(voxels(spark, {0: mask}), *mask.shape[1:])
    fate = components.component_fate(labelled, **options)
    kept = components.filter_components(labelled, fate=fate).count()
    return kept, components.removed_components(fate).first().components_removed


def test_filter_drops_satellites(spark):
    assert run_filter(spark, satellites()) == (1000, 3)


def test_filter_keeps_multifocal(spark):
    m = np.zeros((40, 40, 40), dtype=int)
    m[2:12, 2:12, 2:12] = 1
    m[20:28, 20:28, 20:28] = 1
    assert run_filter(spark, m) == (1512, 0)


def test_largest_always_stays(spark):
    assert run_filter(spark, cube(3, 5, (20, 20, 20)), min_voxels=10_000) == (8, 0)
    two = np.zeros((20, 20, 20), dtype=int)
    two[1:3, 1, 1] = two[10:12, 1, 1] = 1  # equal sizes: the first in raster order stays
    labelled = components.connected_components(voxels(spark, {0: two}), 20, 20)
    kept = components.filter_components(labelled, min_fraction=0.1, min_voxels=100)
    assert {r.x for r in kept.collect()} == {1, 2}


def test_filter_off_and_idempotent(spark):
    assert run_filter(spark, satellites(), min_fraction=0) == (1010, 0)
    labelled = components.connected_components(voxels(spark, {0: satellites()}), 40, 40)
    once = components.filter_components(labelled)
    assert components.filter_components(once).count() == once.count()


def test_distant_blob_sets_hd95_until_filtered(spark):
    gt = np.zeros((90, 90, 90), dtype=np.uint8)
    gt[5:29, 5:29, 5:29] = 1
    pred = gt.copy()
    pred[70:80, 70:80, 70:80] = 1
    metrics, _ = evaluate.evaluate(paired(spark, {0: (pred, gt)}), case_table(spark, {0: gt.shape}))
    row = metrics.first()
    assert row.hd95_3d > 50 and row.pp_hd95_3d == 0 and row.fp_components == 1
    assert row.pp_fp_components == 0 and row.pp_components_removed == 1 and row.pp_dice_3d == 1


@pytest.mark.parametrize("spacing", [(1.0, 1.0, 1.0), (0.7, 1.3, 2.5)])
def test_distances_equal_brute_force(spark, spacing):
    rng = np.random.default_rng(3)
    cases = {c: tuple((rng.random((9, 8, 7)) < p).astype(int) for p in ps) for c, ps in enumerate(((0.1, 0.2), (0.5, 0.05), (0.02, 0.9)))}
    got = {}
    for r in distance.surface_distances(paired(spark, cases), case_table(spark, {c: (9, 8, 7) for c in cases}, spacing)).collect():
        got.setdefault((r.case_id, r.direction), []).append(r.distance)
    for c, (p, g) in cases.items():
        assert sorted(got[(c, "p2g")]) == pytest.approx(sorted(brute_distances(p, g, spacing)))
        assert sorted(got[(c, "g2p")]) == pytest.approx(sorted(brute_distances(g, p, spacing)))


def test_spacing_raises_hd95(spark):
    a, b = np.zeros((30, 30, 30), dtype=int), np.zeros((30, 30, 30), dtype=int)
    a[5:15, 5:15, 5:15] = 1
    b[5:15, 5:15, 7:17] = 1
    mask = paired(spark, {0: (a, b)})
    values = []
    for spacing in ((1.0, 1.0, 1.0), (1.0, 1.0, 5.0)):
        table = case_table(spark, {0: a.shape}, spacing)
        values.append(distance.hd95(distance.surface_distances(mask, table), table).first().hd95_3d)
    assert values[1] > values[0]


def test_surface_of_a_cube_counts_border_as_background(spark):
    full = np.ones((4, 4, 4), dtype=int)
    out = masks.surface(paired(spark, {0: (full, full)}))
    assert out.where("pred_surface = 1").count() == 64 - 8


def test_body_box_ignores_the_table(spark):
    m = np.zeros((80, 80, 40), dtype=int)
    m[20:60, 25:55, 5:35] = 1
    m[70:78, 25:55, 5:35] = 1
    cases = spark.createDataFrame([(0, 80, 80, 40), (1, 10, 11, 12)], "case_id bigint, nx int, ny int, nz int")
    labelled = components.connected_components(voxels(spark, {0: m}), 80, 40)
    got = {r.case_id: r for r in body_bbox(labelled, cases, margin=0).collect()}
    assert tuple(got[0])[1:] == (20, 60, 25, 55, 5, 35)
    assert tuple(got[1])[1:] == (0, 10, 0, 11, 0, 12)  # no body: full extent
    wide = {r.case_id: r for r in body_bbox(labelled, cases, margin=6).collect()}
    assert (wide[0].z_min, wide[0].z_max) == (0, 40)


def test_cubes_that_hold_only_a_rim_are_not_filled(spark):
    import pyarrow as pa

    from voxframe.operators.cubes import map_cubes

    # a voxel on three faces of its cube reaches three cubes beyond, which hold nothing themselves
    mask = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 5, 5, 5, 1), (2, 15, 15, 15, 1), (2, 16, 15, 15, 1)], "case_id bigint, x int, y int, z int, pred int")

    def rows(case, cube, core, skin):
        yield pa.RecordBatch.from_arrays([case, pa.array((core > 0).sum(axis=1)), pa.array((skin > 0).sum(axis=1))], names=["case_id", "core", "skin"])

    got = sorted(tuple(r) for r in map_cubes(mask, ["pred"], "case_id bigint, core bigint, skin bigint", rows).collect())
    assert got == [(1, 2, 2), (2, 1, 1), (2, 1, 1)]
