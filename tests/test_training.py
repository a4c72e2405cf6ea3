"""Training slices by name, refused outside the training split."""

import pytest

from voxframe.operators import training

SIDE = 48


@pytest.fixture(scope="module")
def slices(spark):
    rows = []
    for z in range(3):
        pixels = [float(z + 1) if 30 <= p // SIDE < 34 and 5 <= p % SIDE < 9 else 0.0 for p in range(SIDE * SIDE)]
        rows.append((1, z, SIDE, SIDE, pixels, [float(v > 0 and z == 1) for v in pixels]))
    return spark.createDataFrame(rows, "case_id int, slice_idx int, height int, width int, pixels array<double>, label array<double>")


def test_channels_repeat_the_edges(slices):
    rows = {(r.slice_idx, r.channel): max(r.pixels) for r in training.training_slices(slices, "val", 3).collect()}
    assert [rows[0, k] for k in range(3)] == [1.0, 1.0, 2.0] and [rows[2, k] for k in range(3)] == [2.0, 3.0, 3.0]
    assert [rows[z, training.LABEL] for z in range(3)] == [0.0, 1.0, 0.0]


@pytest.mark.parametrize("augmentation", ["none", "standard"])
def test_crop_moves_channels_and_label_alike(slices, augmentation):
    out = training.training_slices(slices, "train", 1, augmentation, "tumor", 32, SIDE, SIDE).where("slice_idx = 1").collect()
    image, label = sorted(out, key=lambda r: -r.channel)
    assert image.height == image.width == 32 and len(image.pixels) == 32 * 32
    assert [v > 0 for v in image.pixels] == [v > 0 for v in label.pixels] and sum(label.pixels) > 0


def test_anatomic_keeps_labels_binary(slices):
    out = training.training_slices(slices, "train", 3, "anatomic").collect()
    assert len(out) == 12
    assert all(set(r.pixels) <= {0.0, 1.0} for r in out if r.channel == training.LABEL)
    assert all(0.0 <= v <= 1.0 for r in out if r.channel != training.LABEL for v in r.pixels)


@pytest.mark.parametrize("split", ["val", "test"])
@pytest.mark.parametrize("choice", [{"augmentation": "standard"}, {"augmentation": "anatomic"}, {"crop": "tumor"}])
def test_evaluation_is_untouched(slices, split, choice):
    with pytest.raises(ValueError):
        training.training_slices(slices, split, **choice)


def test_unknown_names(slices):
    for choice in ({"augmentation": "twirl"}, {"crop": "half"}, {"neighbours": 2}):
        with pytest.raises(ValueError):
            training.training_slices(slices, "train", **choice)
