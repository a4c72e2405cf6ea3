"""Substring dedup, near duplicates, scores, shards and decontamination against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from . import messy
from voxframe.llm import decontaminate, neardup, scoring, sharding, substrings
from voxframe.llm.common import Words


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_repeats(rows, window):
    last = 1 << 63
    least = {}
    for i, text in rows:
        w = words_of(text)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, last), last if i is None else i)
    out = []
    for i, text in rows:
        w, gone = words_of(text), set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (last if i is None else i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("window", [5, 13])
def test_substrings(spark, window):
    docs = messy.table(spark)
    want = plain_repeats([(r.doc_id, r.text) for r in docs.collect()], window)
    assert Counter(map(tuple, substrings.remove_repeats(docs, window=window).collect())) == want
    assert any(removed for _, _, removed, _ in want)
    assert substrings.remove_repeats(messy.table(spark, [])).count() == 0


def test_substrings_shifted_passages(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]  # so small that repeats of every length and shift occur
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 90)))) for i in range(300)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (4, 5, 6, 9, 30)]
    rows += [(1000 + i, f"{rows[i][1]} {rng.choice(passages)} {rows[i + 20][1]}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert Counter(map(tuple, substrings.remove_repeats(df, window=5).collect())) == plain_repeats(rows, 5)


def plain_print(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(text)]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Rows of (id, print) to the smallest id in reach."""
    distinct = sorted(set(p for _, p in prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if bin(a ^ b).count("1") <= 4:
                parent[root(a)] = root(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return Counter((i, p, least.get(root(p))) for i, p in prints)


def test_near_duplicates(spark):
    docs = messy.table(spark)
    want = plain_components([(r.doc_id, plain_print(r.text)) for r in docs.collect()])
    got = neardup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == want
    assert neardup.near_duplicates(messy.table(spark, [])).count() == 0


@pytest.mark.parametrize("blocks, distance", [(4, 4), (2, 4), (4, 3), (2, 5)])
def test_vantage_trees_lose_no_link(spark, blocks, distance):
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 2**63, 250, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 250, dtype=np.uint64)
    points = list(base)
    for fp in base[:150]:
        for flips in (1, distance, distance, distance + 1):
            for bit in rng.choice(64, flips, replace=False):
                fp = fp ^ np.uint64(1 << int(bit))
            points.append(fp)
    points = np.unique(np.array(points, np.uint64))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    got = {r.fp: r.root for r in neardup.components(df, blocks, distance).collect()}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= distance
    label = np.arange(len(points))
    while True:
        lower = np.where(near, label[None, :], len(points)).min(axis=1)
        if (lower == label).all():
            break
        label = lower
    ids = points.view(np.int64).tolist()
    want, have = defaultdict(set), defaultdict(set)
    for p, c in zip(ids, label.tolist()):
        want[c].add(p)
    for p in ids:
        have[got[p]].add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_link_shard_with_small_leaves():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2**16, 400).astype(np.uint64))  # dense: all links in one block
    roots = neardup.link_shard(fps, np.ones(len(fps), bool), 0, 4, 4, leaf=64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 1
    for i, j in zip(*np.nonzero(near)):
        assert roots[i] == roots[j]
    assert len(set(roots)) > 1


def plain_scores(rows, weights):
    """The model's sums with given weights, from plain counters."""
    def tokens(text):
        return [*[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(text)], "</s>"]

    train = [tokens(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    single = Counter(t for doc in train for t in doc)
    pairs = Counter((a, b) for doc in train for a, b in zip(["<s>", *doc], doc))
    before = Counter(a for doc in train for a in ["<s>", *doc[:-1]])
    n, v = sum(single.values()), len(single)
    out = []
    for i, text in rows:
        doc = tokens(text)
        base = sum(math.log10((single[t] + 0.1) / (n + 0.1 * (v + 1))) for t in doc)
        total = 0.0
        for a, b in zip(["<s>", *doc], doc):
            level = before[a].bit_length()
            pair = pairs[a, b] / before[a] if before[a] else 0.0
            total += math.log10(weights[level][0] * pair + weights[level][1] * single[b] / max(n, 1) + weights[level][2] / (v + 1))
        held = i is None or zlib.crc32(str(i).encode()) % 10 == 0
        out.append((i, held, len(doc), sum(single[t] > 0 for t in doc), n, round(base, 6), round(total, 6)))
    return Counter(out), n, v


def test_scores(spark):
    docs = messy.table(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prepared = scoring.prepare(docs)
    _, n, v = plain_scores(rows, np.full((40, 3), 1 / 3))
    stats = np.frombuffer(bytes(prepared.where("chunk = -1").first().totals), np.int64).tolist()
    assert stats == [n, v]
    weights = scoring.learn(prepared, n, v)
    assert (weights > 0).all() and np.allclose(weights.sum(axis=1), 1)
    want, _, _ = plain_scores(rows, weights)
    got = scoring.score(docs).collect()
    assert Counter((*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert scoring.score(messy.table(spark, [])).count() == 0


def test_learned_weights_raise_held_out_likelihood(spark):
    rng = random.Random(11)
    follow = {w: [f"v{rng.randrange(40)}" for _ in range(3)] for w in [f"v{i}" for i in range(40)]}
    rows = []
    for i in range(400):
        word, out = f"v{rng.randrange(40)}", []
        for _ in range(60):
            out.append(word)
            word = rng.choice(follow[word]) if rng.random() < 0.9 else f"v{rng.randrange(40)}"
        rows.append((i, " ".join(out)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    held = [r for r in scoring.score(df).collect() if r.held_out]
    uniform, _, _ = plain_scores(rows, np.full((40, 3), 1 / 3))
    assert sum(r.score for r in held) > sum(s for (_, h, *_, s), k in uniform.items() if h)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_counts_survive_packing():
    values = np.array([0, 1, 254, 255, 256, 10**12], np.int64)
    back, at = scoring._uncount(b"xx" + scoring._counts(values), len(values), 2)
    assert back.tolist() == values.tolist() and at == 2 + 6 + 24
    pairs = np.array([1, 2**47 + 5], np.uint64)
    assert scoring._from_low_bytes(scoring._low_bytes(pairs), 2, 0).tolist() == pairs.tolist()


@pytest.mark.parametrize("buckets", [1, 2, 3, 12, 211, 65536, 70001])
def test_pairs_keep_their_order_in_a_bucket(buckets):
    values = np.sort(np.random.default_rng(buckets).integers(0, 2**64, 20_000, np.uint64))
    values = np.concatenate([np.zeros(1, np.uint64), values, np.full(1, 2**64 - 1, np.uint64)])
    at = scoring.bucket_of(values, buckets)
    for k in np.unique(at).tolist()[:500]:
        own = values[at == k]
        small = scoring._within(own, k, buckets)
        assert (np.diff(small.astype(np.int64)) >= 0).all() and int(small.max()) < 1 << 48
        assert scoring._from_low_bytes(scoring._low_bytes(small), len(small), 0).tolist() == small.tolist()


def test_totals_by_ranges():
    rng = np.random.default_rng(5)
    blocks = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 1, 50, 400)]
    counts = [rng.integers(0, 9, len(b)) for b in blocks]
    want = Counter()
    for b, c in zip(blocks, counts):
        want.update(dict(zip(b.tolist(), c.tolist())))
    apart = blocks[1][0]
    for ranges in (1, 7, 500):
        totals, total, distinct = scoring._totals(blocks, counts, apart, ranges)
        assert [t.tolist() for t in totals] == [[want[v] for v in b.tolist()] for b in blocks]
        rest = {v: n for v, n in want.items() if v != int(apart) and n}
        assert (total, distinct) == (sum(rest.values()), len(rest))


def test_shards(spark):
    docs = messy.table(spark)
    got = sharding.assign(docs, sharding.tree(24), sharding.tree(25)).collect()
    assert len(got) == docs.count()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(messy.table(spark, []), sharding.tree(24), sharding.tree(25)).count() == 0


def test_shards_follow_weights_and_confine_movement(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "'x' as text")
    old = [sharding.Shard(0, 0, 0, 1.0), sharding.Shard(1, 0, 0, 3.0), sharding.Shard(2, 0, 1, 2.0), sharding.Shard(3, 1, 2, 2.0)]
    grown = [*old, sharding.Shard(4, 0, 1, 2.0)]  # inside an old rack
    rows = sharding.assign(docs, old, grown).collect()
    share = Counter(r.shard for r in rows)
    for shard, part in ((0, 1 / 8), (1, 3 / 8), (2, 2 / 8), (3, 2 / 8)):
        assert abs(share[shard] / 40_000 - part) < 0.02
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert all(r.grown_shard == 4 for r in moved) and abs(len(moved) / 40_000 - 0.2) < 0.02
    with pytest.raises(ValueError):
        sharding.assign(docs, old, [sharding.Shard(0, 0, 0, 2.0)])


def places(spark, shards, n=20_000):
    ids = spark.range(n).selectExpr("cast(id as string) as k")
    return {r.k: r.s for r in sharding.descend(ids, "k", shards, "s").collect()}


def test_the_tree_decides(spark):
    whole = sharding.tree(24)
    other = [sharding.Shard(s.number, s.number % 3, s.number % 8) for s in whole]
    a, b = places(spark, whole), places(spark, other)
    assert sum(a[k] != b[k] for k in a) > 10_000
    # only the children of the nodes passed are hashed
    nodes = sharding.children(whole)
    assert max(len(nodes[""]) + len(nodes[r]) + len(nodes[k]) for r, _ in nodes[""] for k, _ in nodes[r]) == 9
    region = {s.number: s.region for s in whole}
    heavier = [sharding.Shard(s.number, s.region, s.rack, 2.5 if s.number == 5 else 1.0) for s in whole]
    c = places(spark, heavier)
    moved = [k for k in a if a[k] != c[k]]
    # nothing moves inside the other region, and racks that stay entered keep their shards but for the changed one
    assert moved and not [k for k in moved if region[a[k]] == 1 and region[c[k]] == 1]
    rack = {s.number: s.rack for s in whole}
    assert not [k for k in moved if rack[a[k]] == rack[c[k]] and 5 not in (a[k], c[k])]


def test_growth_keeps_the_law_everywhere(spark):
    now = sharding.tree(14)
    before = places(spark, now)
    for region, rack in ((0, 1), (1, 3), (7, 70), (0, 99), (7, 70)):
        now = sharding.grown_from(now, [*now, sharding.Shard(len(now), region, rack)])
        after = places(spark, now)
        moved = {k for k in before if before[k] != after[k]}
        assert all(after[k] == len(now) - 1 for k in moved) and abs(len(moved) / 20_000 - 1 / len(now)) < 0.012
        before = after
    shares = Counter(before.values())
    assert all(abs(shares[i] / 20_000 - 1 / len(now)) < 0.012 for i in range(len(now)))


ITEM = "A train leaves Oldtown at 60 km per hour and Maria boards it after 25 minutes with 3 bags . How far has Maria gone when the 25 minutes are over"


def found(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.contaminated(docs, bench).collect()}


def test_decontamination(spark):
    changed = ITEM.replace("25", "40").replace("Maria", "Peter").replace("60 km", "75 miles").replace("Oldtown", "Newport")
    broken = ITEM.replace("25", "40", 1).replace("Maria", "Peter", 1)  # one value stands for two
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    texts = [f"{filler} {ITEM}. {filler}", f"{filler}. {changed}", f"{filler}. {broken}", filler, None, "", ITEM.lower(), " ".join(ITEM.split()[:10])]
    assert found(spark, texts) == {(0, 0): True, (1, 0): False, (6, 0): True} or found(spark, texts) == {(0, 0): True, (1, 0): False}
    assert found(spark, texts, (None, "", "too short")) == {}
    assert found(spark, []) == {}
    assert found(spark, texts[:1] * 3, (ITEM, ITEM)) == {(i, j): True for i in range(3) for j in range(2)}


def found_by_runs(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.contaminated(docs, bench, whole_slots=False).collect()}


def test_decontamination_by_consistent_runs(spark):
    broken = ITEM.replace("25", "40", 1).replace("Maria", "Peter", 1)  # 13 tokens and more stay verbatim
    work = "If 2 workers take 2 days to paint the long fence then how many days do they need for a house"
    other = work.replace("2 workers", "3 workers").replace("2 days", "5 days")
    got = found_by_runs(spark, [f"so {broken}", f"so {other}", " ".join(ITEM.split()[:10])], (ITEM, work))
    assert set(got) == {(0, 0), (1, 1)} and got[1, 1] is False
    assert set(found(spark, [f"so {other}"], (work,))) == {(0, 0)}  # equal numbers of other things are other slots
    assert decontaminate._best_run([{"at": i, "form": 0, "item": ["number\nkm\n3"], "doc": [str(i % 2)]} for i in range(9)], [9, 9, 9], 6, 0.5, False) is None


@pytest.mark.parametrize("change", [str.lower, str.upper, str.title])
def test_decontamination_in_other_case(spark, change):
    dense = "Der Zug von Anna nach Berlin und Bonn mit Karl und Emma faehrt um 9 Uhr ab und Paul kommt aus Mainz mit Otto an"
    assert found(spark, [f"so {change(ITEM)}", f"so {change(dense)}"], (ITEM, dense)) == {(0, 0): True, (1, 1): True}


def test_decontamination_of_short_items(spark):
    items = ("What is the capital of France?", "1 + 2 = 3", "12 7 19 4 88 3 5 61 90 2", "Anna Bella Carla Dora Emma Frida Gerda Hanna Ida")
    texts = [f"so it is: {i} and more" for i in items] + ["what is the capital of Spain?", "so 1 - 2 = 3", "12 7 19 4 88 3 5 61 91 2", "Anna Bella Carla Dora Jana Frida Gerda Hanna Ida"]
    assert found(spark, texts, items) == {(i, i): True for i in range(4)}


def test_template_slots():
    template = decontaminate.Template([b"Maria has 3 km and 3 of Peter. Then it", b"", b"Oslo"])
    assert template.slot.tolist() == [False, False, True, True, False, True, False, True, False, False, False]
    assert template.tokens[2] == template.tokens[5] == decontaminate.NUMBER
    assert template.tokens[3] == decontaminate.UNIT and template.tokens[7] == decontaminate.NAME


def test_words_are_bytes_between_blanks():
    words = Words(["a b\x1cc d".encode(), b"", b"\x0b x \x0c"])
    assert words.words == [["a b\x1cc".encode(), b"d"], [], [b"x"]]
