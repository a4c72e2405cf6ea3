"""A quality classifier out of two zstandard dictionaries.

One dictionary is built from texts labelled good, one from texts labelled bad.
A text is compressed with both, in fixed chunks so that a long text cannot teach
the compressor its own words, and ``(bad bytes - good bytes) / text bytes`` is
its normalised difference: positive where good text explains it better, near
zero where neither dictionary helps, as in endless repetition or noise. A
logistic curve fitted to other labelled texts than those in the dictionaries
turns the difference into the probability of the good label.

:func:`fit` sees a bounded sample: of each label the ``sample`` documents with
the least hash of their id, half for the dictionaries (``SAMPLE_CHUNKS`` evenly
spaced chunks of each) and half, as whole texts, for the curve, which is
weighted back to the counts of all usable labels. Scoring is one pass over
whole texts with built-in state of a few hundred kilobytes.

NULL and empty texts have the difference 0. A document with both labels counts
for neither, a repeated id once, NULL ids and NULL labels not at all. Without
texts of both labels every score is 0.5. An empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .common import text_bytes

CHUNK, LEVEL = 2048, 3
# documents of each label that are looked at, chunks of each for a dictionary, and bytes of a dictionary
SAMPLE, SAMPLE_CHUNKS, DICTIONARY = 4096, 8, 112_640
# zstandard refuses to build a dictionary from too little
LEAST_CHUNKS, LEAST_BYTES = 16, 4096


class Model(NamedTuple):
    """Dictionaries (None without texts of both labels) and the curve ``1 / (1 + exp(-(slope * difference + offset)))``."""

    good: bytes | None
    bad: bytes | None
    slope: float
    offset: float


def dictionary(chunks: list[bytes], size: int = DICTIONARY) -> bytes | None:
    """A trained dictionary; few or very uniform chunks serve as raw content."""
    chunks = [c for c in chunks if c]
    total = sum(map(len, chunks))
    if not total:
        return None
    if len(chunks) >= LEAST_CHUNKS and total >= LEAST_BYTES:
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 4)), chunks, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too uniform for the trainer
            pass
    return b"".join(chunks)[-size:]


class Sizer:
    """Compressed sizes of texts under both dictionaries of a model."""

    def __init__(self, model: Model, chunk: int = CHUNK):
        self.chunk, self.pair = chunk, []
        for data in (model.good, model.bad):
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))

    def sizes(self, text: bytes) -> tuple[int, int]:
        parts = [text[at : at + self.chunk] for at in range(0, len(text), self.chunk)]
        good, bad = (sum(len(z.compress(p)) for p in parts) for z in self.pair)
        return good, bad


def _differences(good: np.ndarray, bad: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (bad - good) / np.maximum(size, 1)


def calibrate(difference: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 100, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve, by Newton's method with a slight pull to zero."""
    scale = float(difference.std()) or 1.0
    x = np.stack([difference / scale, np.ones(len(difference))], axis=1)
    weight = weight / weight.sum()
    at = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        gradient = x.T @ (weight * (label - p)) - ridge * at
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        at = at + step
        if np.abs(step).max() < 1e-10:
            break
    return float(at[0] / scale), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE, chunk: int = CHUNK,
        doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The model of the labelled documents whose id passes ``usable``, a condition on ``_id``."""
    named = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    if usable is not None:
        named = named.where(usable)
    clear = named.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).where("_label = _other").drop("_other")
    counts = {r["_label"]: r["n"] for r in clear.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(None, None, 0.0, 0.0)
    ranked = [clear.where(F.col("_label") == k).withColumn("_draw", F.xxhash64("_id")).orderBy("_draw", "_id").limit(sample) for k in (0, 1)]
    chosen = ranked[0].unionByName(ranked[1]).withColumn("_half", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)))
    # at most 2 * sample ids
    rows = docs.select(F.col(doc_id).alias("_id"), text_bytes(text).alias("body")).join(F.broadcast(chosen), "_id")
    # a repeated id brings one text, the one with the least hash
    one = rows.groupBy("_id", "_label", "_draw", "_half").agg(F.min_by("body", F.xxhash64("body")).alias("body"))
    learning = one.where("_half = 0").select("_label", "_draw", "body")

    def parts(batches):
        for batch in batches:
            out = []
            for name, draw, data in zip(*[c.to_pylist() for c in batch.columns]):
                starts = range(0, len(data), chunk)
                out += [(name, draw, at, data[at : at + chunk]) for at in starts[:: max(1, len(starts) // SAMPLE_CHUNKS)][:SAMPLE_CHUNKS]]
            yield pa.RecordBatch.from_pylist([dict(zip(("label", "draw", "place", "part"), r)) for r in out], schema=pa.schema(
                [("label", pa.int32()), ("draw", pa.int64()), ("place", pa.int64()), ("part", pa.binary())]))

    pieces = sorted(tuple(r) for r in learning.mapInArrow(parts, "label int, draw bigint, place bigint, part binary").collect())
    good, bad = (dictionary([bytes(p[3]) for p in pieces if p[0] == k]) for k in (1, 0))
    if good is None or bad is None:
        return Model(None, None, 0.0, 0.0)
    raw = Model(good, bad, 0.0, 0.0)
    seen = one.where("_half = 1").select("_id", "_label", F.octet_length("body").alias("n"), sizes("body", raw, chunk).alias("s")).select("_label", "n", "s.*").collect()
    if len({r["_label"] for r in seen}) < 2:
        return raw
    label_, n, small, large = np.array([tuple(r) for r in seen], np.float64).T
    each = {k: counts[k] / (label_ == k).sum() for k in (0, 1)}
    return Model(good, bad, *calibrate(_differences(small, large, n), label_, np.where(label_ == 1, each[1], each[0])))


def sizes(text: str, model: Model, chunk: int = CHUNK) -> Column:
    """``struct<good_bytes bigint, bad_bytes bigint>`` of a text column, as the dictionaries compress it."""

    def measure(texts: pa.Array) -> pa.Array:
        sizer = Sizer(model, chunk)
        found = np.array([sizer.sizes(t.as_py()) for t in texts], np.int64).reshape(-1, 2)
        pa.default_memory_pool().release_unused()
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["good_bytes", "bad_bytes"])

    return arrow_udf(measure, "good_bytes bigint, bad_bytes bigint")(text_bytes(text))


def score(docs: DataFrame, model: Model, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, good_bytes, bad_bytes, score)`` for every row of ``docs``."""
    size = F.octet_length(text_bytes(text)).cast("bigint").alias("n_bytes")
    if model.good is None or model.bad is None:
        none = F.lit(0).cast("bigint")
        return docs.select(F.col(doc_id).alias("doc_id"), size, none.alias("good_bytes"), none.alias("bad_bytes"), F.lit(0.5).alias("score"))
    measured = docs.select(F.col(doc_id).alias("doc_id"), size, sizes(text, model, chunk).alias("s")).select("doc_id", "n_bytes", "s.*")
    difference = (F.col("bad_bytes") - F.col("good_bytes")) / F.greatest(F.col("n_bytes"), F.lit(1))
    return measured.withColumn("score", 1.0 / (1.0 + F.exp(-(difference * model.slope + model.offset))))
