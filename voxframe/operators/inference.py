"""Batch scoring with a user function, tiling and blending."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.registry import one_of
from .batches import map_sorted_groups

# Width of the blending weights and their floor.
GAUSSIAN_SIGMA, WEIGHT_FLOOR = 0.125, 1e-3


def score(slices: DataFrame, load_model: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 16) -> DataFrame:
    """Logit function over batches of slices; the sigmoid is applied outside the model.

    ``load_model`` runs once per task. Rows give the probabilities and the
    slice's share of its batch's wall time.
    """
    keep = [c for c in slices.columns if c != "pixels"]

    def run(batches):
        model = load_model()
        for pdf in batches:
            # slices of one shape go through the model together
            shapes = pdf["pixels"].map(len)
            for _, group in pdf.groupby(shapes, sort=False):
                for at in range(0, len(group), batch_size):
                    part = group.iloc[at : at + batch_size]
                    start = time.perf_counter()
                    logits = model(np.stack([np.asarray(p, dtype=np.float64) for p in part["pixels"]]))
                    prob = 1.0 / (1.0 + np.exp(-logits))
                    share = (time.perf_counter() - start) / len(part)
                    yield part[keep].assign(prob=list(prob), seconds=share)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slices.schema if f.name != "pixels")
    return slices.mapInPandas(run, f"{fields}, prob array<double>, seconds double")


def tile_starts(size: int, roi: int, overlap: float) -> list[int]:
    """Origins of one axis; the last tile is moved back inside."""
    if roi >= size:
        return [0]
    step = max(1, int(roi * (1 - overlap)))
    count = -(-(size - roi) // step) + 1
    return [min(i * step, size - roi) for i in range(count)]


def tile(slices: DataFrame, height: int, width: int, roi: int = 96, overlap: float = 0.5) -> DataFrame:
    """Fixed grid of overlapping windows over every slice; no truth is looked at."""
    grid = [(t, l) for t in tile_starts(height, roi, overlap) for l in tile_starts(width, roi, overlap)]
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("top"), F.lit(l).alias("left")) for t, l in grid]))
    rows = slices.withColumn("t", cells)
    line = lambda r: F.slice("pixels", r * F.lit(width) + F.col("t.left") + 1, F.lit(min(roi, width)))
    cut = F.flatten(F.transform(F.sequence(F.col("t.top"), F.col("t.top") + min(roi, height) - 1), line))
    return rows.select("case_id", "slice_idx", F.col("t.top").alias("top"), F.col("t.left").alias("left"), cut.alias("pixels"))


def gaussian_weights(rows: int, cols: int) -> np.ndarray:
    """Centre-weighted blending map, floored so that no weight vanishes."""
    def axis(n):
        at = np.arange(n) - (n - 1) / 2.0
        return np.exp(-(at**2) / (2.0 * (GAUSSIAN_SIGMA * n) ** 2))

    weights = np.outer(axis(rows), axis(cols))
    return np.maximum(weights, max(weights.min(), WEIGHT_FLOOR))


def blend(tiles: DataFrame, height: int, width: int, roi: int) -> DataFrame:
    """Weighted mean of tile probabilities per pixel.

    A slice has a fixed number of tiles, so the groups are small whatever the
    case's depth.
    """
    rows, cols = min(roi, height), min(roi, width)
    weights = gaussian_weights(rows, cols)

    def mix(table: pa.Table, starts: np.ndarray):
        ends = np.append(starts[1:], table.num_rows)
        top, left = table.column("top").to_numpy(), table.column("left").to_numpy()
        prob = table.column("prob").combine_chunks()
        prob = prob.chunk(0) if isinstance(prob, pa.ChunkedArray) else prob
        flat = prob.flatten().to_numpy().reshape(-1, rows, cols)
        out = np.empty((len(starts), height * width))
        for g, (start, end) in enumerate(zip(starts, ends)):
            total, norm = np.zeros((height, width)), np.zeros((height, width))
            for i in range(start, end):
                window = (slice(top[i], top[i] + rows), slice(left[i], left[i] + cols))
                total[window] += weights * flat[i]
                norm[window] += weights
            out[g] = (total / norm).ravel()
        head = table.take(pa.array(starts)).select(["case_id", "slice_idx"])
        offsets = pa.array(np.arange(0, out.size + 1, height * width, dtype=np.int32))
        result = head.append_column("prob", pa.ListArray.from_arrays(offsets, pa.array(out.ravel())))
        yield from result.combine_chunks().to_batches()

    kind = tiles.schema["case_id"].dataType.simpleString()
    return map_sorted_groups(tiles.select("case_id", "slice_idx", "top", "left", "prob"), ["case_id", "slice_idx"], ["top", "left"],
                             f"case_id {kind}, slice_idx int, prob array<double>", mix)


def linear_model(weight: float, bias: float):
    """The simplest pluggable model: one weight and a bias on every pixel."""
    def load():
        return lambda pixels: pixels * weight + bias

    return load


def quadratic_model(weight: float, bias: float):
    """A weight on every squared pixel and a bias."""
    def load():
        return lambda pixels: pixels * pixels * weight + bias

    return load


MODELS = {"linear": linear_model, "quadratic": quadratic_model}


def make_model(name: str, *parameters: float):
    """The loader of a model by its name; an unknown name raises an error that lists the known ones."""
    return MODELS[one_of("model", name, MODELS)](*parameters)
