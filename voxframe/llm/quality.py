"""Quality rules with compression bands.

Besides word, symbol and repetition counts, a text is compressed with zstandard
as a whole and in fixed chunks. Repetitive text compresses too well, random
text too badly; how well clean text compresses depends on its length, so every
length class has limits of its own. A chunk is compressed by itself, the rest at
the end too; a text fails when more than half of its chunks lie outside theirs.

:func:`fit` takes the limits from all texts that are labelled as clean: quantiles
for each third of an octave of length, for whole texts and for chunks. A language has limits of its own where it has enough
labelled texts of that length, else wider ones from all languages, and much wider
ones if it has no labels. Where no text is labelled the broad :data:`BANDS` hold.

NULL and empty texts have no words and fail the base rules. Nothing is cut:
texts of any length are measured whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import arrow_udf

from .common import Words, blocks, hand_back, rolling, text_bytes

# upper length in bytes, least and greatest compressed share of a clean text
BANDS = ((512, 0.30, 0.95), (1024, 0.25, 0.90), (2048, 0.22, 0.85), (4096, 0.20, 0.80), (8192, 0.18, 0.75), (16384, 0.16, 0.72), (None, 0.14, 0.70))
CHUNK = 4096
CHUNK_LIMITS = (0.18, 0.85)
LEVEL = 3
# ratios told apart from 0 to 1, room for the ratios of one length, and the texts that limits need
BINS, MOST_BINS, LEAST = 4096, 1 << 20, 40
# share of clean texts beyond either limit; margins (low, high) of own limits, of those from all languages, and without labels
TAIL, OWN, POOLED, UNLABELLED = 0.002, (0.99, 1.01), (0.98, 1.02), (0.6, 1.35)
# below this many bytes a chunk without fitted limits is never too random: the frame alone takes some of it
SHORT = 256
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, ratio double, n_chunks bigint, n_odd_chunks bigint, base_failed boolean, kept boolean"


def _ratio(zstd: zstandard.ZstdCompressor, data: bytes) -> float:
    return len(zstd.compress(data)) / len(data)


def length_class(size: int) -> int:
    """Thirds of an octave of length in bytes."""
    return math.floor(3 * math.log2(size))


def _limits(limits: dict, part: bool, lang: str, size: int, broad: tuple[float, float]) -> tuple[float, float]:
    own = limits.get((part, lang, length_class(size)))
    if own:
        return own[0] * OWN[0], own[1] * OWN[1]
    pooled = limits.get((part, None, length_class(size)))
    if not pooled:
        return broad
    low, high = POOLED if (False, lang, None) in limits else UNLABELLED
    return pooled[0] * low, pooled[1] * high


def compression(data: bytes, zstd: zstandard.ZstdCompressor, bands: Sequence = BANDS, chunk: int = CHUNK,
                chunk_limits: tuple[float, float] = CHUNK_LIMITS, limits: dict | None = None, lang: str | None = None) -> tuple[float | None, int, int, bool]:
    """Whole-text ratio, chunks, chunks outside their limits, and the verdict. ``limits`` (see :func:`fit`) go before the bands."""
    if not data:
        return None, 0, 0, False
    limits, lang = limits or {}, lang or ""

    def band(size: int) -> tuple[float, float]:
        return next((a, b) for top, a, b in bands if top is None or size < top)

    ratio, odd = _ratio(zstd, data), 0
    low, high = _limits(limits, False, lang, len(data), band(len(data)))
    for at in range(0, len(data), chunk):
        part = data[at : at + chunk]
        broad = chunk_limits if len(part) == chunk else (band(len(part))[0], math.inf if len(part) < SHORT else band(len(part))[1])
        least, most = _limits(limits, True, lang, len(part), broad)
        odd += not least <= _ratio(zstd, part) <= most
    chunks = -(-len(data) // chunk)
    return ratio, chunks, odd, low <= ratio <= high and 2 * odd <= chunks


def fit(docs: DataFrame, labels: DataFrame, chunk: int = CHUNK, least: int = LEAST,
        doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> dict:
    """Limits from all labelled clean documents and all their chunks.

    ``(part, language, length class)`` to the quantiles of the ratio, where ``part`` tells chunks from whole texts and
    language None stands for all; ``(False, language, None)`` marks a language with ``least`` labelled texts.
    Every text is measured where it lies and only its ratios meet the labels; a row for each key comes back.
    """
    key = F.col(doc_id).alias("_id")
    clean = labels.where((F.col("quality") == 1) & F.col(doc_id).isNotNull()).select(key).distinct()
    named = F.coalesce(F.col(lang), F.lit("")) if lang in docs.columns else F.lit("")

    def ratios(bodies: pa.Array) -> pa.Array:
        zstd, out = zstandard.ZstdCompressor(level=LEVEL), []
        for part in blocks(bodies, 256):
            for data in bodies.slice(*part).to_pylist():
                parts = [(0, data)] if data else []
                parts += [(1, data[at : at + chunk]) for at in range(0, len(data), chunk)]
                out.append([(2 * length_class(len(d)) + part) * MOST_BINS + round(BINS * _ratio(zstd, d)) for part, d in parts])
        found = pa.array(out, pa.list_(pa.int32()))
        del out
        hand_back()
        return found

    measured = docs.where(F.col(doc_id).isNotNull()).select(key, named.alias("lang"), arrow_udf(ratios, "array<int>")(text_bytes(text)).alias("codes"))
    codes = measured.join(clean, "_id", "left_semi").select("lang", F.explode("codes").alias("code"))
    counted = codes.groupBy("lang", "code").count().select(F.explode(F.array("lang", F.lit(None).cast("string"))).alias("lang"), "code", "count")
    bins = counted.groupBy("lang", F.floor(F.col("code") / MOST_BINS).alias("where"), (F.col("code") % MOST_BINS).alias("bin")).agg(F.sum("count").alias("n"))
    group = W.partitionBy("lang", "where")
    placed = bins.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "total": F.sum("n").over(group)})
    cut = F.floor(F.col("total") * TAIL)
    ends = placed.groupBy("lang", "where").agg(
        F.max("total").alias("total"), F.min(F.when(F.col("upto") > cut, F.col("bin"))).alias("low"), F.min(F.when(F.col("upto") > F.col("total") - 1 - cut, F.col("bin"))).alias("high"))
    limits, texts = {}, defaultdict(int)
    for r in ends.collect():
        size, part = divmod(r["where"], 2)
        texts[r.lang] += 0 if part or r.lang is None else r.total
        if r.total >= least:
            limits[bool(part), r.lang, size] = r.low / BINS, r.high / BINS
    return limits | {(False, name, None): () for name, n in texts.items() if name is not None and n >= least}


def _repeated(hashes: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(hashes) < 4:
        return 0
    _, inverse, counts = np.unique(rolling(hashes, 3), return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(hashes), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def measures(text: str = "text", bands: Sequence = BANDS, chunk: int = CHUNK, chunk_limits: tuple[float, float] = CHUNK_LIMITS,
             min_words: int = 50, max_repeat_percent: int = 50, limits: dict | None = None, lang: str | None = None) -> Column:
    """Struct column of :data:`FIELDS` for every text; ``limits`` come from :func:`fit`, ``lang`` names the column of the language."""

    def measure(texts: pa.Array, langs: pa.Array) -> pa.Array:
        zstd = zstandard.ZstdCompressor(level=LEVEL)
        out = {name.split()[0]: [] for name in FIELDS.split(", ")}
        for part in blocks(texts, 512):
            block = texts.slice(*part).to_pylist()
            names = langs.slice(*part).to_pylist()
            words = Words(block)
            for i, data in enumerate(block):
                n = int(words.counts[i])
                repeat = _repeated(words.hashes[words.starts[i] : words.ends[i]])
                lines = [line for line in data.split(b"\n") if line.strip(BLANKS)]
                ratio, full, odd, fits = compression(data, zstd, bands, chunk, chunk_limits, limits, names[i])
                failed = n < min_words or 100 * repeat > max_repeat_percent * n
                row = (
                    n,
                    len(b"".join(words.words[i]).decode("utf-8", "replace")),
                    len(data) - len(data.translate(None, SYMBOLS)),
                    len(lines) - len(set(lines)),
                    repeat, ratio, full, odd, failed, not failed and fits,
                )
                for column, value in zip(out.values(), row):
                    column.append(value)
        types = [pa.bool_() if " boolean" in f else pa.float64() if " double" in f else pa.int64() for f in FIELDS.split(", ")]
        found = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))
        out.clear()
        hand_back()
        return found

    return arrow_udf(measure, f"struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")(text_bytes(text), F.col(lang) if lang else F.lit(None).cast("string"))
