"""Language-model scores by deleted interpolation.

A token's probability mixes maximum-likelihood estimates: of the pair with its
context, of the token alone, and a uniform floor over the vocabulary and one
unknown. The weights depend on how often the context occurs (buckets by powers
of two). They are learned by expectation-maximisation on held-out counts: for
the training documents of one fold, estimates come from counts from which those
of the documents' own chunk are deleted.

All counts cover all training documents. Chunks of documents send every
distinct token and pair once, with its count in the chunk, to hash buckets and
get the totals back in the same order; chunk and totals are written once, and
both the learning and the scoring read them without another shuffle. A frequent
word is one entry per chunk.

A document trains unless its remainder (crc32 of the id as text, modulo
``folds``) is 0; a NULL id never trains. NULL and empty texts are one end
token. An empty training set scores by the floor alone. Repeated rows are
scored each on their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import MULTIPLIER, Words, bucket_of, chunked, id_array, mix, pack_documents, runs, shuffle_partitions, unpack_documents

END, BEGIN = np.uint64(0x1F0E33A9C5D2B871), np.uint64(0x7C15F39CC0605CED)
MESSAGE = "bucket int, chunk int, data binary"
PREPARED = "chunk int, documents binary, totals binary"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
STATISTICS = -1  # the chunk number under which bucket statistics travel
PAIR_BYTES = 6
RANGES = 8  # value ranges a bucket is summed in
LEVELS = 40  # context buckets: powers of two


class Tokens:
    """Tokens of a chunk's documents: lower-cased words, then one end each."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, texts: list[bytes], folds: int):
        words = Words([t.lower() for t in texts])
        n = len(texts)
        self.counts = words.counts + 1
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.total = int(self.counts.sum())
        self.doc = np.repeat(np.arange(n), self.counts)
        self.values = np.full(self.total, END, np.uint64)
        is_word = np.ones(self.total, bool)
        is_word[self.ends - 1] = False
        self.values[is_word] = words.hashes
        context = np.empty_like(self.values)
        context[1:] = self.values[:-1]
        context[self.starts] = BEGIN
        self.context = context
        self.pairs = mix(context * MULTIPLIER + self.values)
        self.fold = np.array([zlib.crc32(str(i).encode()) % folds if k else 0 for i, k in zip(ids.tolist(), known.tolist())], np.int64)
        train = (self.fold > 0)[self.doc]
        self.train = train.astype(np.int64)
        self.single = Grouped(np.append(self.values, BEGIN), np.append(self.train, int((self.fold > 0).sum())))
        self.double = Grouped(self.pairs, self.train)


class Grouped:
    """Distinct values, ascending, with summed weights; ``of`` maps items to them."""

    def __init__(self, values: np.ndarray, weights: np.ndarray):
        order = np.argsort(values)
        ordered = values[order]
        first = runs(ordered)
        self.values = ordered[first]
        self.sums = np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)
        self.of = np.empty(len(values), np.int64)
        self.of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ordered))))


def _counts(values: np.ndarray) -> bytes:
    """One byte per count; 255 marks those that follow in eight bytes."""
    large = values >= 255
    return np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype(np.int64).tobytes()


def _uncount(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    small = np.frombuffer(data, np.uint8, n, at)
    values, large = small.astype(np.int64), np.flatnonzero(small == 255)
    values[large] = np.frombuffer(data, np.int64, len(large), at + n)
    return values, at + n + 8 * len(large)


def _low_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :PAIR_BYTES]).tobytes()


def _within(values: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Values of a bucket as 48 bits that keep their order: the distance to its lower bound."""
    bound = np.uint64(-(-(bucket << 32) // buckets) << 32)
    return (values - bound) >> np.uint64(max(0, 17 - buckets.bit_length()))


def _from_low_bytes(data: bytes, n: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :PAIR_BYTES] = np.frombuffer(data, np.uint8, n * PAIR_BYTES, at).reshape(-1, PAIR_BYTES)
    return out.reshape(-1).view(np.uint64)


def _totals(values: list[np.ndarray], counts: list[np.ndarray], apart=None, ranges: int = RANGES) -> tuple[list[np.ndarray], int, int]:
    """Per block, each of ascending values, the total of every entry; then the
    sum and the number of the totals, over values other than ``apart``.

    Works through one value range after another, so what it needs beside its
    input and output is a part of a bucket.
    """
    totals = [np.empty(len(v), np.int64) for v in values]
    low = min((v[0] for v in values if len(v)), default=np.uint64(0))
    high = max((v[-1] for v in values if len(v)), default=np.uint64(0))
    step = (int(high) - int(low)) // ranges + 1
    cuts = np.array([min(int(low) + k * step, int(high)) for k in range(1, ranges)], np.uint64)
    edges = [[0, *np.searchsorted(v, cuts).tolist(), len(v)] for v in values]
    total = distinct = 0
    for k in range(ranges):
        grouped = Grouped(np.concatenate([v[e[k] : e[k + 1]] for v, e in zip(values, edges)]), np.concatenate([c[e[k] : e[k + 1]] for c, e in zip(counts, edges)]))
        each, at = grouped.sums[grouped.of], 0
        for t, e in zip(totals, edges):
            t[e[k] : e[k + 1]] = each[at : at + e[k + 1] - e[k]]
            at += e[k + 1] - e[k]
        counted = grouped.sums if apart is None else grouped.sums[grouped.values != apart]
        total, distinct = total + int(counted.sum()), distinct + int(np.count_nonzero(counted))
    return totals, total, distinct


def prepare(docs: DataFrame, folds: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks with the corpus totals of all their tokens and pairs, written once."""
    parts = shuffle_partitions(docs)
    buckets = parts
    chunks = chunked(docs, 4 * parts, doc_id, text)

    def tokens_of(table: pa.Table) -> Tokens:
        return Tokens(*unpack_documents(table.column("block").to_pylist()), folds)

    def edges_of(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(bucket_of(values, buckets), np.arange(buckets + 1))

    def send(table: pa.Table) -> pa.Table:
        tokens = tokens_of(table)
        one, two = edges_of(tokens.single.values), edges_of(tokens.double.values)
        names, data = [], []
        for k in range(buckets):
            (a, b), (c, d) = one[k : k + 2], two[k : k + 2]
            if b > a or d > c:
                names.append(k)
                data.append(np.array([b - a, d - c], np.int64).tobytes() + tokens.single.values[a:b].tobytes() + _low_bytes(_within(tokens.double.values[c:d], k, buckets))
                            + _counts(tokens.single.sums[a:b]) + _counts(tokens.double.sums[c:d]))
        return pa.table({"bucket": pa.array(names, pa.int32()), "chunk": pa.array([table.column("chunk")[0].as_py()] * len(names), pa.int32()), "data": pa.array(data, pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        rows = table.column("data").to_pylist()
        sizes = [np.frombuffer(d, np.int64, 2).tolist() for d in rows]
        singles, doubles, counts1, counts2 = [], [], [], []
        for data, (n, m) in zip(rows, sizes):
            singles.append(np.frombuffer(data, np.uint64, n, 16))
            doubles.append(_from_low_bytes(data, m, 16 + 8 * n))
            c, at = _uncount(data, n, 16 + 8 * n + PAIR_BYTES * m)
            counts1.append(c)
            counts2.append(_uncount(data, m, at)[0])
        sums1, total, distinct = _totals(singles, counts1, BEGIN)
        sums2, _, _ = _totals(doubles, counts2)
        data = [np.array([n, m], np.int64).tobytes() + _counts(a) + _counts(b) for (n, m), a, b in zip(sizes, sums1, sums2)]
        data.append(np.array([total, distinct], np.int64).tobytes())
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket] * len(data), pa.int32()), "chunk": pa.array([*table.column("chunk").to_pylist(), STATISTICS], pa.int32()), "data": pa.array(data, pa.binary())})

    def gather(documents: pa.Table, answers: pa.Table) -> pa.Table:
        if not documents.num_rows:
            sums = np.sum([np.frombuffer(d, np.int64) for d in answers.column("data").to_pylist()], axis=0)
            return pa.table({"chunk": pa.array([STATISTICS], pa.int32()), "documents": pa.array([None], pa.binary()), "totals": pa.array([sums.tobytes()], pa.binary())})
        singles, doubles = [], []
        for data in answers.sort_by("bucket").column("data").to_pylist():  # ascending values, as the chunk sent them
            n, m = np.frombuffer(data, np.int64, 2).tolist()
            c, at = _uncount(data, n, 16)
            singles.append(c)
            doubles.append(_uncount(data, m, at)[0])
        zstd = zstandard.ZstdCompressor(level=3)
        totals = zstd.compress(_counts(np.concatenate(singles)) + _counts(np.concatenate(doubles)))
        block = pack_documents(*unpack_documents(documents.column("block").to_pylist()), zstd)
        return pa.table({"chunk": documents.column("chunk").slice(0, 1), "documents": pa.array([block], pa.binary()), "totals": pa.array([totals], pa.binary())})

    answers = chunks.groupBy("chunk").applyInArrow(send, MESSAGE).groupBy("bucket").applyInArrow(total, MESSAGE)
    return cut_lineage(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(gather, PREPARED))


def _load(row: dict, folds: int) -> tuple[np.ndarray, np.ndarray, Tokens, np.ndarray, np.ndarray]:
    ids, known, texts = unpack_documents([row["documents"]])
    tokens = Tokens(ids, known, texts, folds)
    data = zstandard.ZstdDecompressor().decompress(row["totals"])
    single, at = _uncount(data, len(tokens.single.values), 0)
    double, _ = _uncount(data, len(tokens.double.values), at)
    return ids, known, tokens, single, double


def _level(context_counts: np.ndarray) -> np.ndarray:
    """Bucket of a context count: 0 for none, else 1 + floor(log2)."""
    return np.where(context_counts > 0, np.frexp(context_counts.astype(np.float64))[1], 0).astype(np.int64)


def _single_of(tokens: Tokens, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each token and of each token's context."""
    of = tokens.single.of
    counts = single[of[:-1]]
    before = np.empty_like(counts)
    before[1:] = counts[:-1]
    before[tokens.starts] = single[of[-1]]
    return counts, before


def learn(prepared: DataFrame, n_tokens: int, n_types: int, folds: int = 10, held_out_fold: int = 1, rounds: int = 12) -> np.ndarray:
    """Weights ``[level, (pair, token, floor)]`` by expectation-maximisation."""

    def observe(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, _, tokens, single, double = _load(row, folds)
                chosen = (tokens.fold == held_out_fold)[tokens.doc]
                counts, before = _single_of(tokens, single - tokens.single.sums)
                pairs = (double - tokens.double.sums)[tokens.double.of]
                seen = np.stack([pairs[chosen], before[chosen], counts[chosen]])
                rest = n_tokens - int(tokens.train.sum())
                found, times = np.unique(seen, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found] + [pa.array(np.full(len(times), rest)), pa.array(times)],
                                                 names=["pair", "context", "token", "tokens", "n"])

    seen = cut_lineage(prepared.where(F.col("chunk") >= 0).mapInArrow(observe, "pair bigint, context bigint, token bigint, tokens bigint, n bigint"))
    estimates = seen.select(
        "n",
        F.when(F.col("context") > 0, F.floor(F.log2("context") + 1e-9) + 1).otherwise(0).cast("int").alias("level"),
        F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0).alias("p2"),
        F.when(F.col("tokens") > 0, F.col("token") / F.col("tokens")).otherwise(0.0).alias("p1"),
    )
    weights = np.full((LEVELS, 3), 1 / 3)
    floor = 1.0 / (n_types + 1)
    for _ in range(rounds):
        table = F.array(*[F.array(*map(F.lit, row)) for row in weights.tolist()])
        w = estimates.withColumn("w", table[F.col("level")])
        parts = [F.col("w")[0] * F.col("p2"), F.col("w")[1] * F.col("p1"), F.col("w")[2] * F.lit(floor)]
        mixed = parts[0] + parts[1] + parts[2]
        shares = w.groupBy("level").agg(*[F.sum(F.col("n") * p / mixed).alias(f"s{i}") for i, p in enumerate(parts)]).collect()
        updated = np.full((LEVELS, 3), 1 / 3)
        for row in shares:  # at most one row per level; one pseudo-count each keeps every weight positive
            sums = np.array([row.s0, row.s1, row.s2]) + 1
            updated[row.level] = sums / sums.sum()
        moved = np.abs(updated - weights).max()
        weights = updated
        if moved < 1e-4:
            break
    return weights


def score(docs: DataFrame, folds: int = 10, rounds: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``; scores are sums of log10."""
    prepared = prepare(docs, folds, doc_id, text)
    row = prepared.where(F.col("chunk") == STATISTICS).select("totals").first()
    n_tokens, n_types = np.frombuffer(bytes(row[0]), np.int64).tolist() if row else (0, 0)
    weights = learn(prepared, n_tokens, n_types, folds, rounds=rounds)

    def evaluate(batches):
        for batch in batches:
            for chunk in batch.to_pylist():
                ids, known, tokens, single, double = _load(chunk, folds)
                counts, before = _single_of(tokens, single)
                pairs = double[tokens.double.of]
                base = np.log10((counts + 0.1) / (n_tokens + 0.1 * (n_types + 1)))
                w = weights[np.minimum(_level(before), LEVELS - 1)]
                mixed = w[:, 0] * pairs / np.maximum(before, 1) + w[:, 1] * counts / max(n_tokens, 1) + w[:, 2] / (n_types + 1)
                sums = [np.add.reduceat(v, tokens.starts) for v in ((counts > 0).astype(np.int64), base, np.log10(mixed))]
                yield pa.RecordBatch.from_arrays(
                    [id_array(ids, known), pa.array(tokens.fold == 0), pa.array(tokens.counts), *map(pa.array, sums)],
                    names=[f.split()[0] for f in SCORES.split(", ")],
                )

    scored = prepared.where(F.col("chunk") >= 0).mapInArrow(evaluate, SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
