"""Ranked lexical search with the Best Position Algorithm.

Documents are indexed in blocks: for each query term the documents that hold it
and how often. A block's list of a term, ordered by impact, is the term's
contribution to the score of each document, and a document's score is the sum
over the lists. For a query, all lists are read from the top in turns; a
document met in one list is looked up in all others (direct access), and every
place that it has in a list is marked as seen. A list's best position is the end
of the stretch from the top in which everything is seen, however it was seen, so
it lies at or below the last place read. No document still unseen can score more
than the sum of the impacts at the best positions, and reading ends when that sum
lies strictly below the k-th score so far: at equality a document of lower id
might still come. The k-th score is carried from block to block inside a task.

Corpus figures come first, from all documents: how many have a term, how many
terms they have, and in how many documents each query term occurs. Every task
hands on k documents for each query at most, so the last ranking reads little.
Queries are handled in blocks of ``ITEMS`` (and ``ITEM_CHARS`` characters), each
with one index written to the shared folder; only the queries, never documents,
pass through the driver.

Terms are the runs of ASCII letters and digits and non-ASCII characters, with
A-Z in lower case. NULL and empty texts have no terms and rank nowhere. A NULL
document id comes after all others of its score; rows repeated in full rank as
often as they occur, and so do queries. Empty tables give no rows.
"""

from __future__ import annotations

import math
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .common import runs, shuffle_partitions, text_bytes

TOP = 20
ITEMS, ITEM_CHARS = 4096, 1 << 24
BLOCK_BYTES = 16 << 20
FIRST_STEP = 32
# every ASCII character but letters and digits parts terms; capitals become small
PARTING = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
INDEX = "ids array<bigint>, lengths array<bigint>, terms array<int>, held array<int>, places array<int>, counts array<int>, n_docs bigint, n_terms bigint"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(PARTING).split()


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of documents: their ids and lengths, and for each term of ``vocabulary`` in it
    how many documents hold it, which (``places``, ascending) and how often."""

    def build(batches):
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.append(np.flatnonzero(np.diff(sizes // block_bytes)) + 1, len(sizes)) if len(sizes) else []
            for low, high in zip(np.append(0, cuts[:-1]), cuts):
                yield _block(batch.slice(int(low), int(high - low)), vocabulary)
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), text_bytes(text).alias("body"))
    return rows.mapInArrow(build, INDEX)


def _block(batch: pa.RecordBatch, vocabulary: dict[bytes, int]) -> pa.RecordBatch:
    n, lengths, keys = batch.num_rows, np.zeros(batch.num_rows, np.int64), []
    for at, body in enumerate(batch.column(1)):
        terms = terms_of(body.as_py())
        lengths[at] = len(terms)
        known = np.fromiter(map(vocabulary.get, terms, repeat(-1)), np.int64, len(terms))
        keys.append(known[known >= 0] * n + at)
    pairs, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    terms = pairs // n if n else pairs
    first = runs(terms)

    def one(values, kind):
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))

    return pa.RecordBatch.from_arrays(
        [one(batch.column(0), pa.int64()), one(lengths, pa.int64()), one(terms[first].astype(np.int32), pa.int32()), one(np.diff(np.append(first, len(terms))).astype(np.int32), pa.int32()),
         one((pairs % n if n else pairs).astype(np.int32), pa.int32()), one(counts.astype(np.int32), pa.int32()), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())])],
        names=["ids", "lengths", "terms", "held", "places", "counts", "n_docs", "n_terms"])


class ImpactList(NamedTuple):
    """Documents of a block by falling impact, and the way back from a document to its place."""

    documents: np.ndarray
    impacts: np.ndarray
    ascending: np.ndarray
    rank: np.ndarray


def impact_list(documents: np.ndarray, impacts: np.ndarray) -> ImpactList:
    """``documents`` ascend; equal impacts keep that order."""
    order = np.argsort(-impacts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return ImpactList(documents[order], impacts[order], documents, rank)


class Best:
    """The k best documents of a query so far, by falling score, then ascending id, NULL last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def kth(self) -> int:
        """A score below this one does not matter."""
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def offer(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        good = (score >= self.kth()) & (score > 0)
        if not good.any():
            return
        self.score, self.id, self.known = (np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.id, ids), (self.known, known)))
        order = np.lexsort([self.id, ~self.known, -self.score])[: self.k]
        self.score, self.id, self.known = self.score[order], self.id[order], self.known[order]


def best_positions(lists: list[tuple[ImpactList, int]], best: Best, ids: np.ndarray, known: np.ndarray, step: int = FIRST_STEP) -> int:
    """Offers to ``best`` what the lists of one block, each with its factor, may add; returns how many documents were looked up."""
    met = np.zeros(len(ids), bool)
    seen = [np.zeros(len(x.documents), bool) for x, _ in lists]
    position = [0] * len(lists)
    while True:
        fresh = [x.documents[p : p + step][~s[p : p + step]] for (x, _), s, p in zip(lists, seen, position)]
        new = np.unique(np.concatenate(fresh)) if fresh else np.zeros(0, np.int64)
        if not len(new):
            return int(met.sum())
        met[new] = True
        total = np.zeros(len(new), np.int64)
        for (x, factor), s in zip(lists, seen):
            at = np.minimum(np.searchsorted(x.ascending, new), len(x.ascending) - 1)
            hit = x.ascending[at] == new
            place = x.rank[at[hit]]
            s[place] = True
            total[hit] += factor * x.impacts[place]
        best.offer(total, ids[new], known[new])
        limit = 0
        for j, ((x, factor), s) in enumerate(zip(lists, seen)):
            p = position[j]
            # a window of a few steps shows where the seen stretch ends, else the rest does
            for end in (p + 4 * step, len(s)):
                gap = s[p:end].argmin() if p < len(s) else 0
                if p >= len(s) or not s[p + gap]:
                    break
            else:
                gap = len(s) - p
            position[j] = p + int(gap)
            if position[j] < len(s):
                limit += factor * int(x.impacts[position[j] - 1])
        if len(best.score) == best.k and limit < best.kth():
            return int(met.sum())
        step *= 2


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           items_a_block: int = ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents with a score above 0 for each item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), text_bytes(item_text).alias("body"))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("b")).first()
    blocks = max(1, math.ceil(size.n / items_a_block), math.ceil((size.b or 0) / ITEM_CHARS))
    kind = items.schema[item_id].dataType.simpleString()
    found = None
    for block in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)) == block)
        rows = mine.orderBy("item_id", "body").collect()
        some = _search(docs, [terms_of(bytes(r.body)) for r in rows], k, doc_id, text, block_bytes)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        named = some.join(names, "item").select("item_id", "rank", "doc_id", "score")
        found = named if found is None else found.unionByName(named)
    return found


def _search(docs: DataFrame, items: list[list[bytes]], k: int, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    vocabulary = {term: i for i, term in enumerate(sorted(set(chain.from_iterable(items))))}
    index = cut_lineage(build_index(docs, vocabulary, doc_id, text, block_bytes))
    figures = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = figures.n or 0, figures.l or 0
    # one row a query term
    spread = index.select(F.inline(F.arrays_zip("terms", "held"))).groupBy("terms").agg(F.sum("held").alias("df")).collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for row in spread:
        weights[row.terms] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row.df + 1)))
    wanted = []
    for terms in items:
        number, times = np.unique(np.array([vocabulary[t] for t in terms], np.int64), return_counts=True)
        good = weights[number] > 0
        wanted.append(list(zip(number[good].tolist(), times[good].tolist())))

    def rank(batches):
        best: dict[int, Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, terms, held, places, counts = (batch.column(c)[row].values for c in range(6))
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                numbers = ids.fill_null(0).to_numpy()
                damping = 75 + 25 * lengths.to_numpy() * n_docs // n_terms if n_terms else lengths.to_numpy()
                terms, held, places, counts = (x.to_numpy().astype(np.int64) for x in (terms, held, places, counts))
                ends = np.cumsum(held)
                where = dict(zip(terms.tolist(), zip((ends - held).tolist(), ends.tolist())))
                lists: dict[int, ImpactList] = {}
                for item, pairs in enumerate(wanted):
                    mine = []
                    for term, times in pairs:
                        if term in where:
                            if term not in lists:
                                a, b = where[term]
                                tf = counts[a:b]
                                lists[term] = impact_list(places[a:b], weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * damping[places[a:b]])))
                            mine.append((lists[term], times))
                    if mine:
                        best_positions(mine, best.setdefault(item, Best(k)), numbers, known)
        for item, top in best.items():
            n = len(top.score)
            yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int32()), pa.array(top.id, pa.int64(), mask=~top.known), pa.array(top.score, pa.int64())], names=["item", "doc_id", "score"])

    some = index.select("ids", "lengths", "terms", "held", "places", "counts").mapInArrow(rank, "item int, doc_id bigint, score bigint")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    groups = max(1, math.isqrt(shuffle_partitions(docs)))
    # first in groups of documents, so that no task sorts what all tasks hand on for an item
    part = W.partitionBy("item", "part").orderBy(*order)
    few = some.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(groups))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return few.drop("part").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")
