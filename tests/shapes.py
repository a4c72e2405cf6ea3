"""Small masks, brute-force checks and a volume writer for the tests."""

import gzip
import struct
from collections import deque

import numpy as np

STEPS = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def cube(lo, hi, shape=(50, 50, 50)):
    mask = np.zeros(shape, dtype=np.uint8)
    mask[lo:hi, lo:hi, lo:hi] = 1
    return mask


def voxels(spark, masks, value=None):
    """{case: array} -> sparse voxel rows."""
    rows = [(c, *map(int, p)) for c, m in masks.items() for p in np.argwhere(m)]
    return spark.createDataFrame(rows, "case_id bigint, x int, y int, z int")


def paired(spark, cases):
    """{case: (pred, gt)} -> paired mask and case table inputs."""
    rows = []
    for c, (pred, gt) in cases.items():
        for p in np.argwhere((pred > 0) | (gt > 0)):
            x, y, z = map(int, p)
            rows.append((c, x, y, z, int(pred[x, y, z] > 0), int(gt[x, y, z] > 0)))
    return spark.createDataFrame(rows, "case_id bigint, x int, y int, z int, pred int, gt int")


def case_table(spark, shapes, spacing=(1.0, 1.0, 1.0)):
    rows = [(c, int(np.prod(s)), s[0], s[1], s[2], *spacing, float(np.prod(spacing))) for c, s in shapes.items()]
    return spark.createDataFrame(rows, "case_id bigint, n_voxels int, nx int, ny int, n_slices int, sx double, sy double, sz double, voxel_mm3 double")


def flood(mask):
    """Component label (lowest raster index) by breadth-first search."""
    labels = {}
    ny, nz = mask.shape[1:]
    for p in map(tuple, np.argwhere(mask)):
        if p in labels:
            continue
        label = (p[0] * ny + p[1]) * nz + p[2]
        labels[p] = label
        queue = deque([p])
        while queue:
            q = queue.popleft()
            for s in STEPS:
                n = tuple(a + b for a, b in zip(q, s))
                if all(0 <= a < b for a, b in zip(n, mask.shape)) and mask[n] and n not in labels:
                    labels[n] = label
                    queue.append(n)
    return labels


def surface_points(mask):
    padded = np.pad(mask.astype(bool), 1)
    core = padded[1:-1, 1:-1, 1:-1].copy()
    inner = core.copy()
    for axis in range(3):
        for shift in (1, -1):
            inner &= np.roll(padded, shift, axis)[1:-1, 1:-1, 1:-1]
    return np.argwhere(core & ~inner)


def brute_distances(a, b, spacing):
    """Surface of ``a`` to the nearest voxel of ``b``."""
    targets = np.argwhere(b) * np.array(spacing)
    return np.array([np.sqrt((((p * np.array(spacing)) - targets) ** 2).sum(axis=1).min()) for p in surface_points(a)])


def write_nifti(path, data, affine, big_endian=False):
    """A minimal single-file volume."""
    codes = {"uint8": 2, "int16": 4, "float32": 16, "float64": 64}
    order = ">" if big_endian else "<"
    header = bytearray(352)
    struct.pack_into(order + "i", header, 0, 348)
    struct.pack_into(order + "8h", header, 40, 3, *data.shape, 1, 1, 1, 1)
    struct.pack_into(order + "2h", header, 70, codes[data.dtype.name], data.dtype.itemsize * 8)
    struct.pack_into(order + "8f", header, 76, 1.0, *np.sqrt((np.asarray(affine)[:3, :3] ** 2).sum(axis=0)), 0, 0, 0, 0)
    struct.pack_into(order + "3f", header, 108, 352.0, 1.0, 0.0)
    struct.pack_into(order + "2h", header, 252, 0, 1)
    struct.pack_into(order + "12f", header, 280, *np.asarray(affine)[:3].ravel())
    header[344:348] = b"n+1\0"
    body = bytes(header) + data.astype(data.dtype.newbyteorder(order)).tobytes(order="F")
    with (gzip.open if str(path).endswith(".gz") else open)(path, "wb") as f:
        f.write(body)
