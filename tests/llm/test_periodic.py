"""Periodic runs against a scan of every period."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from voxframe.llm import periodic, queries
from voxframe.llm.common import Words

from . import messy

SF = "/root/testdata/sf0.001"


def brute(words, least=24, power=3):
    """(start, length, period) of all runs."""
    n, best = len(words), {}
    for p in range(1, n // power + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, power * p):
                best.setdefault((i, j - i + p), p)
            i = max(j, i) + 1
    return sorted((s, length, p) for (s, length), p in best.items())


def kept(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def by_tiles(words, octaves):
    """The fragments of all tiles of one text, stitched in place."""
    text = Words([b" ".join(words)])
    seen = []
    for (_, spacing, number), (a, b) in periodic._tiles(text, octaves).items():
        local = {}
        w = [local.setdefault(x, len(local)) for x in words[a:b]]
        for low, high in ([(1, octaves.base)] if spacing == octaves.base > 1 else []) + [(spacing, 2 * spacing)]:
            seen += [(p, a + s, a + e) for p, s, e in periodic.fragments(w, spacing, low, high, octaves.base)]
    joined = {}
    for p, s, e in sorted(seen):
        last = joined.setdefault(p, [])
        if last and s <= last[-1][1] - p:
            last[-1][1] = max(last[-1][1], e)
        else:
            last.append([s, e])
    best = {}
    for p in sorted(joined):
        for s, e in joined[p]:
            if e - s >= max(octaves.least, octaves.power * p):
                best.setdefault((s, e - s), p)
    return sorted((s, length, p) for (s, length), p in best.items())


def random_words(rng, n):
    """Stretches of periodic, nearly periodic and random words."""
    out = []
    while len(out) < n:
        p = rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40, 64, 65, 130])
        unit = [rng.choice([b"a", b"b", b"c"]) if rng.random() < 0.7 else b"w%d" % rng.randrange(9) for _ in range(p)]
        body = (unit * (rng.randrange(1, 9) + 1))[: rng.randrange(1, 8 * p + 2)]
        if rng.random() < 0.3 and body:
            body[rng.randrange(len(body))] = b"x"
        out += body
    return out[:n]


@pytest.mark.parametrize("least, power, tile", [(24, 3, 1), (24, 3, 2048), (9, 3, 1), (6, 2, 1), (48, 3, 64)])
def test_tiles_find_every_run(least, power, tile):
    octaves, total = periodic.Octaves(least, power, tile), 0
    for seed in range(250):
        rng = random.Random(seed)
        words = random_words(rng, rng.choice([0, 1, 23, 24, 25, 60, 200, 700]))
        want = brute(words, least, power)
        assert by_tiles(words, octaves) == want, seed
        total += len(want)
    assert total > 50


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=120), st.integers(1, 12))
def test_two_words_only(words, times):
    words = (words * times)[:400]
    assert by_tiles(words, periodic.Octaves(24, 3, 1)) == brute(words)


def test_z_values():
    s = [1, 1, 2, 1, 1, 2, 1, 3]
    assert periodic.z_values(s, 7)[1:] == [1, 0, 4, 1, 0, 1, 0]


def test_equal_windows_inside_a_period():
    x = [b"x%d" % i for i in range(20)]
    words = (x + [b"l"] + x + [b"l"] + x + [b"m", b"m"] + x + [b"m", b"m"]) * 4
    assert by_tiles(words, periodic.Octaves(tile=1)) == brute(words) != []


def expected(doc_id, text, least=24, power=3):
    words = (text or "").encode().split()
    runs = brute(words, least, power)
    return doc_id, len(words), tuple(runs), b" ".join(kept(words, runs)).decode()


def got_rows(df):
    return sorted(((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.kept_text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("tile", [1, 2048])
def test_awkward_rows(spark, tile):
    loop = "tick tock tack " * 400 + "end " + "again " * 50
    rows = messy.rows() + [(7001, loop, "en", None, 1, "x", "y", "z", "w")] * 3 + [(7002, loop + "x", "en", None, 1, "x", "y", "z", "w"), (None, loop, "en", None, 1, "x", "y", "z", "w")]
    got = got_rows(periodic.find_runs(messy.table(spark, rows), tile=tile))
    assert got == sorted((expected(r[0], r[1]) for r in rows), key=repr)
    assert periodic.find_runs(messy.table(spark, rows).limit(0)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(5)
    unit = [f"u{rng.randrange(10**6)}" for _ in range(3000)]
    text = " ".join([f"v{i}" for i in range(5000)] + unit * 7 + unit[:1234] + ["z"] + ["q", "r"] * 9000)
    row = periodic.find_runs(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), tile=1).first()
    assert [tuple(r) for r in row.runs] == [(5000, 22234, 3000), (27235, 18000, 2)]
    assert row.n_words == 45235 and len(row.kept_text.split()) == 45235 - 22234 + 3000 - 18000 + 2


def test_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    changed = 0
    for d in docs:
        words, h = (d.text or "").encode().split(), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs, r = brute(words), got[d.doc_id]
        assert r.n_runs == len(runs) and r.n_words == len(words)
        top = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        assert (r.start, r.length, r.period) == top
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept(words, runs))).hexdigest()
    assert changed > 5
