"""Separable linear and nearest resampling.

Output index ``i`` of an axis reads input position ``i * (n_in - 1) / (n_out - 1)``.
In-plane work happens inside one slice row (Arrow batches and small weight
matrices); the depth axis is one shuffle in which every output slice receives
at most two weighted input slices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def output_length(n: Column, zoom: Column) -> Column:
    return F.bround(n * zoom, 0).cast("int")


def axis_weights(n_in: int, n_out: int, order: int = 1) -> np.ndarray:
    """``n_out x n_in`` matrix of one axis."""
    weights = np.zeros((n_out, n_in))
    at = np.arange(n_out) * ((n_in - 1) / (n_out - 1) if n_out > 1 else 0.0)
    rows = np.arange(n_out)
    if order == 0:
        weights[rows, np.minimum(np.floor(at + 0.5).astype(int), n_in - 1)] = 1.0
        return weights
    low = np.minimum(np.floor(at).astype(int), n_in - 1)
    high = np.minimum(low + 1, n_in - 1)
    np.add.at(weights, (rows, low), 1.0 - (at - low))
    np.add.at(weights, (rows, high), at - low)
    return weights


def resample_array(pixels: Column, n_in: int, n_out: int, order: int = 1) -> Column:
    """One array along its only axis, inside the JVM."""
    step = (n_in - 1) / (n_out - 1) if n_out > 1 else 0.0

    def value(i: Column) -> Column:
        at = i * F.lit(step)
        if order == 0:
            return F.element_at(pixels, F.least(F.floor(at + 0.5), F.lit(n_in - 1)).cast("int") + 1)
        low = F.least(F.floor(at), F.lit(n_in - 1)).cast("int")
        frac = at - low
        return F.element_at(pixels, low + 1) * (1 - frac) + F.element_at(pixels, F.least(low + 1, F.lit(n_in - 1)) + 1) * frac

    return F.transform(F.sequence(F.lit(0), F.lit(n_out - 1)), value)


def _resize_batch(pixels: pd.Series, dims: pd.DataFrame, order: int) -> pd.Series:
    """Resize each slice of a batch; slices of equal dimensions share one product."""
    out = pd.Series([None] * len(pixels), index=pixels.index, dtype=object)
    for (h, w, h2, w2), rows in dims.groupby(["h", "w", "h2", "w2"], sort=False).groups.items():
        stack = np.stack([np.asarray(p, dtype=np.float64) for p in pixels.loc[rows]]).reshape(-1, h, w)
        done = stack if (h, w) == (h2, w2) else axis_weights(h, h2, order) @ stack @ axis_weights(w, w2, order).T
        out.loc[rows] = pd.Series(list(done.reshape(len(rows), -1)), index=rows, dtype=object)
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _resize_linear(pixels: pd.Series, h: pd.Series, w: pd.Series, h2: pd.Series, w2: pd.Series) -> pd.Series:
    return _resize_batch(pixels, pd.DataFrame({"h": h, "w": w, "h2": h2, "w2": w2}), 1)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _resize_nearest(pixels: pd.Series, h: pd.Series, w: pd.Series, h2: pd.Series, w2: pd.Series) -> pd.Series:
    return _resize_batch(pixels, pd.DataFrame({"h": h, "w": w, "h2": h2, "w2": w2}), 0)


def resize_slices(slices: DataFrame, height, width, order: int = 1, label: bool = False) -> DataFrame:
    """Every slice to ``height x width`` (numbers or columns).

    Label slices are resized linearly and then cut at 0.5, so thin structures
    survive better than with nearest sampling.
    """
    resize = _resize_linear if order == 1 or label else _resize_nearest
    h2 = height if isinstance(height, Column) else F.lit(height)
    w2 = width if isinstance(width, Column) else F.lit(width)
    pixels = resize("pixels", "height", "width", h2, w2)
    if label:
        pixels = F.transform(pixels, lambda v: (v > 0.5).cast("double"))
    return slices.withColumns({"pixels": pixels, "height": h2.cast("int"), "width": w2.cast("int")})


def _depth_shares(n_in: Column, n_out: Column, order: int) -> Column:
    """Output slices an input slice contributes to, with weights."""
    step = F.when(n_out > 1, (n_in - 1).cast("double") / (n_out - 1)).otherwise(F.lit(0.0))
    s = F.col("slice_idx")
    # outputs whose position lies within one input step; all of them when the step is 0
    low = F.when(step > 0, F.greatest(F.lit(0), F.floor((s - 1) / step))).otherwise(F.lit(0)).cast("int")
    high = F.when(step > 0, F.least(n_out - 1, F.ceil((s + 1) / step))).otherwise(n_out - 1).cast("int")

    def share(k: Column) -> Column:
        at = k * step
        if order == 0:
            hit = (F.least(F.floor(at + 0.5), (n_in - 1).cast("bigint")) == s).cast("double")
            return F.struct(k.alias("k"), hit.alias("w"))
        return F.struct(k.alias("k"), F.greatest(F.lit(0.0), 1.0 - F.abs(at - s)).alias("w"))

    return F.filter(F.transform(F.sequence(low, high), share), lambda e: e["w"] > 0)


def resample_depth(slices: DataFrame, n_in: str, n_out: str, order: int = 1) -> DataFrame:
    """Resample along the slice axis; ``n_in`` and ``n_out`` name columns.

    Each output slice sums at most two inputs, so groups stay tiny whatever
    the case's size. Missing input slices count as zero.
    """
    keep = [c for c in slices.columns if c not in ("slice_idx", "pixels")]
    spread = slices.select(
        *keep, "pixels", F.explode(_depth_shares(F.col(n_in), F.col(n_out), order)).alias("s")
    ).select(*keep, F.col("s.k").alias("slice_idx"), F.struct(F.col("s.w").alias("w"), F.col("pixels").alias("p")).alias("part"))
    constant = [c for c in keep if c != "case_id"]
    parts = spread.groupBy("case_id", "slice_idx").agg(
        F.collect_list("part").alias("parts"), *[F.first(c).alias(c) for c in constant]
    )
    first = F.element_at("parts", 1)
    scaled = F.transform(first["p"], lambda v: v * first["w"])
    second = F.element_at("parts", 2)
    both = F.zip_with(first["p"], second["p"], lambda a, b: a * first["w"] + b * second["w"])
    return parts.select(
        "case_id", "slice_idx", *constant, F.when(F.size("parts") == 1, scaled).otherwise(both).alias("pixels")
    ).select(*slices.columns)


def resample(slices: DataFrame, target: float = 1.0, order: int = 1) -> DataFrame:
    """Resample to ``target`` spacing; order 1 for intensities, 0 for masks (then > 0.5).

    Rows need ``height, width, n_slices`` and spacings ``sx, sy, sz``.
    """
    zoom = {a: F.col(f"s{a}") / F.lit(float(target)) for a in "xyz"}
    planes = slices.withColumn("_depth_out", output_length(F.col("n_slices"), zoom["z"]))
    planes = resize_slices(planes, output_length(F.col("height"), zoom["x"]), output_length(F.col("width"), zoom["y"]), order)
    out = resample_depth(planes, "n_slices", "_depth_out", order)
    if order == 0:
        out = out.withColumn("pixels", F.transform("pixels", lambda v: (v > 0.5).cast("double")))
    return out.withColumn("n_slices", F.col("_depth_out")).drop("_depth_out")


def resample_to_shape(slices: DataFrame, height: str, width: str, depth: str, order: int = 1) -> DataFrame:
    """Exactly the shape named by three columns; equal shapes pass through unchanged."""
    planes = resize_slices(slices, F.col(height), F.col(width), order)
    return resample_depth(planes, "n_slices", depth, order).withColumn("n_slices", F.col(depth))
