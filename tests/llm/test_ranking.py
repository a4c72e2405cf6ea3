"""Ranked search against scores of all documents, and the best positions themselves."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from voxframe.llm import queries, ranking

from . import messy

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    """(item, rank, doc, score) from every document."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in held:
            m = 75 + 25 * len(t) * n_docs // n_terms
            score = 0
            for x in terms(text):
                tf = t.count(x)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes, items_a_block", [(1 << 24, 4096), (3000, 2)])
def test_awkward_rows(spark, block_bytes, items_a_block):
    items = [(1, "Alpha beta BETA épsilon"), (2, None), (3, ""), (4, "nowhere zzz"), (5, "shared1 shared2 日本 nu s"), (None, "kappa mu 3 5"), (6, "theta " * 40 + "iota"), (6, "Theta")]
    odd = messy.table(spark)
    asked = spark.createDataFrame([(a, b, "clash") for a, b in items], "item_id bigint, text string, doc_id string")
    got = ranking.search(odd, asked, block_bytes=block_bytes, items_a_block=items_a_block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == brute([r[:2] for r in messy.rows()], items)
    assert ranking.search(odd.limit(0), asked).count() == 0
    assert ranking.search(odd, asked.limit(0)).count() == 0


def test_ties_take_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(90, 0, -1)] + [(100 + i, "filler text only") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    asked = spark.createDataFrame([(1, "same words")], "item_id bigint, text string")
    got = ranking.search(frame, asked).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 21)) and [r["rank"] for r in got] == list(range(1, 21))


def test_query_on_the_table(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = queries.op11_ranked_search(spark, SF)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows_of(got) == want and len(want) > 100


def _lists(rng, n_docs, n_lists):
    made = []
    for _ in range(n_lists):
        held = np.sort(rng.choice(n_docs, rng.integers(1, n_docs), replace=False))
        made.append((ranking.impact_list(held, rng.integers(1, 50, len(held)) ** 3), int(rng.integers(1, 3))))
    return made


@pytest.mark.parametrize("step", [1, 2, 32])
def test_best_positions_are_exact(step):
    for seed in range(120):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(1, 400))
        lists = _lists(rng, n, int(rng.integers(1, 6)))
        total = np.zeros(n, np.int64)
        for x, factor in lists:
            total[x.documents] += factor * x.impacts
        best = ranking.Best(7)
        ids = rng.permutation(n).astype(np.int64)
        ranking.best_positions(lists, best, ids, np.ones(n, bool), step)
        want = sorted(((-s, i) for s, i in zip(total.tolist(), ids.tolist()) if s > 0))[:7]
        assert list(zip((-best.score).tolist(), best.id.tolist())) == want


def test_reading_stops_at_best_positions():
    # every list is led by the same few documents: after them all places are seen and the rest cannot reach them
    n, rng = 20_000, np.random.default_rng(1)
    lists = []
    for _ in range(4):
        impacts = rng.integers(1, 100, n)
        impacts[:40] += 10_000
        lists.append((ranking.impact_list(np.arange(n), impacts), 1))
    best = ranking.Best(20)
    looked = ranking.best_positions(lists, best, np.arange(n), np.ones(n, bool))
    assert looked < 400 and set(best.id.tolist()) <= set(range(40))
    # at equality with the k-th score reading goes on, so that a smaller id is not missed
    flat = [(ranking.impact_list(np.arange(n), np.full(n, 5)), 1)]
    best = ranking.Best(3)
    ids = np.arange(n)[::-1].copy()
    assert ranking.best_positions(flat, best, ids, np.ones(n, bool)) == n and best.id.tolist() == [0, 1, 2]
