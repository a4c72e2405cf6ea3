"""The stages against what they must keep and drop; the entry without this package."""

import os
import subprocess
import sys

from . import messy

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


def staged(spark, docs):
    import corpus_pipeline

    out = []
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SMALL)
        out.append((docs.collect(), done.collect(), done.columns))
        docs = spark.createDataFrame(out[-1][1], done.schema) if name != "packing" else done
    return out


def test_stages_on_messy_rows(spark):
    docs = messy.table(spark)
    results = staged(spark, docs)
    for before, after, columns in results[:-1]:
        assert columns == docs.columns
        assert len(after) <= len(before)
    quality, dedup, clean, redacted, packed = results
    assert all(len((r.text or "").split()) >= 50 for r in quality[1])
    assert len({r.text for r in dedup[0]}) >= len(dedup[1]) > 0
    assert len({r.text for r in dedup[1]}) == len(dedup[1])
    assert len(redacted[1]) == len(clean[1])
    assert {r.doc_id for r in packed[1]} == {r.doc_id for r in redacted[1]}
    assert all(not after for _, after, _ in staged(spark, messy.table(spark, [])))


def test_entry_survives_without_the_package():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('voxframe.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert len(q) > 100 and not any(k.startswith('op1_') or k == 'pipeline' for k in q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_near_copies_of_similarity_080_go(spark):
    import random

    import corpus_pipeline
    from voxframe.llm import shingles

    rng = random.Random(8)

    def sets(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    def same(a, b):
        return len(sets(a) & sets(b)) / len(sets(a) | sets(b))

    rows, copies = [], {}
    for i in range(120):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        rows.append((i, " ".join(words)))
        changed = list(words)
        for k in rng.sample(range(200), rng.choice([2, 3, 4, 12])):
            changed[k] = f"n{rng.randrange(3000)}"
        rows.append((1000 + i, " ".join(changed)))
        copies[1000 + i] = same(rows[-2][1], rows[-1][1]) >= 0.8
    rows += [(5000, rows[0][1].upper()), (None, rows[2][1]), (5001, None), (5002, " "), (5003, "a few words"), (5004, "A  few words"), (5005, "other few words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()}
    assert {True, False} == set(copies.values())
    assert kept == {*range(120), *(i for i, near in copies.items() if not near), 5001, 5003, 5005}
    assert shingles.first_of_each(docs.limit(0)).count() == 0
    # the parts of the rule: what stays, against all pairs of sets
    stay = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    assert not [(a, b) for a in stay for b in stay if a is not None and b is not None and a < b and stay[a] and stay[b] and same(stay[a], stay[b]) >= 0.8]


def test_prefixes_of_similar_sets_meet():
    import numpy as np

    from voxframe.llm import shingles

    rng = np.random.default_rng(4)
    for trial in range(400):
        common = np.sort(rng.choice(400, 60, replace=False).astype(np.uint64) * np.uint64(2))
        order = rng.permutation(60)
        a = np.unique(rng.choice(400, rng.integers(1, 120)).astype(np.uint64) * np.uint64(2))
        b = a.copy()
        for _ in range(rng.integers(0, 20)):
            b[rng.integers(len(b))] = rng.integers(400) * 2
        b = np.unique(b)
        least = float(rng.choice([0.5, 0.8, 0.9]))
        both = len(np.intersect1d(a, b))
        if both / (len(a) + len(b) - both) >= least:
            x, y = shingles.prefix(a, common, order, least), shingles.prefix(b, common, order, least)
            assert len(np.intersect1d(x, y)), trial


def test_one_passage_and_many_rounds(spark):
    """Texts that share a passage but are not similar all stay, and similar ones behind other heads are found."""
    import random

    from voxframe.llm import shingles

    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, passage + " " + " ".join(f"w{i}x{k}" for k in range(rng.choice([9, 12, 14, 60])))) for i in range(150)]
    rows += [(1000 + i, t + " end") for i, t in rows[40:60]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    kept = sorted(r.doc_id for r in shingles.first_of_each(docs).collect())

    def sets(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    held = {i: sets(t) for i, t in rows}
    root = {i: i for i in held}
    for a in held:
        for b in held:
            if a < b and len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    # a text that left is not compared again, so what stays lies between one of each component and one of each link
    assert set(root.values()) <= set(kept)
    assert not [1 for a in kept for b in kept if a < b and len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b])]


def test_chains_of_near_copies_are_one_component(spark):
    """A text that is linked goes on, so one of each component of all similar pairs stays and no more."""
    import random

    from voxframe.llm import shingles

    rng, rows = random.Random(5), []
    for i in range(40):
        words = [f"c{i}w{k}" for k in range(120)]
        for k in range(5):
            rows.append((1000 * k + i, " ".join(words)))
            at = rng.randrange(0, 100)
            words[at : at + 6] = [f"n{i}x{k}y{j}" for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    held = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in held}
    for a in held:
        for b in held:
            if a < b and len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert sorted(r.doc_id for r in shingles.first_of_each(docs).collect()) == sorted(set(root.values()))


def test_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    import corpus_pipeline

    names = ["_id", "_hash", "_row", "_text_hash", "_h1", "_keep", "_number", "_ROWS", "num", "set", "key"]
    docs = messy.table(spark).select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontamination, corpus_pipeline.secret_scans):
        done = stage(spark, docs, SMALL)
        assert done.columns == docs.columns
        for r in done.collect():
            assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in names)


def test_texts_without_copies_are_not_shuffled(spark):
    import random

    from voxframe.llm import shingles

    rng = random.Random(21)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(3000)]
    rows += [(3000 + i, rows[i][1]) for i in range(5)] + [(4000 + i, rows[i][1] + " more") for i in range(5, 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sc = spark.sparkContext
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = shingles.first_of_each(docs)
        sc.setJobGroup("last", "last")
        ids = sorted(r.doc_id for r in kept.collect())
        store, stages = sc._jsc.sc().statusStore(), {s for j in sc.statusTracker().getJobIdsForGroup("last") for s in sc.statusTracker().getJobInfo(j).stageIds}
        moved = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 2**20))
    assert ids == list(range(3000))
    assert moved < 500
    few = shingles.sifted(docs, "doc_id", docs.where("doc_id < 100"), "doc_id", "met").where("met")
    assert few.where("doc_id < 100").count() == 100 and few.count() < 110


def test_tasks_hold_words_of_few_texts(spark, monkeypatch):
    from voxframe.llm import decontaminate

    class Guard(decontaminate.Template):
        def __init__(self, texts):
            if len(texts) > 1 and sum(map(len, texts)) > 1 << 20:
                raise MemoryError("words of more than a megabyte of text at once")
            super().__init__(texts)

    item = "the heavy boat crosses a quiet harbour before early morning light returns slowly"
    texts = [(k, "plain words without end " * 400 + (item if k % 100 == 7 else "")) for k in range(600)] + [(600, None), (601, "long " * 300_000 + item)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "Template", Guard)
    hits = decontaminate.contaminated(docs, items, whole_slots=False)
    assert sorted(r.doc_id for r in hits.select("doc_id").collect()) == [7, 107, 207, 307, 407, 507, 601]


def test_blocks_cover_all_texts():
    import pyarrow as pa
    from voxframe.llm.common import blocks

    texts = pa.array([b"a" * n for n in (3, 0, 4, 9, 1, 1, 1, 1)] + [None, b"", b"b"], pa.binary()).slice(1)
    assert list(blocks(texts, 3, 5)) == [(0, 2), (2, 1), (3, 3), (6, 3), (9, 1)]
    assert list(blocks(texts.slice(0, 0), 3, 5)) == []


def test_no_similar_pair_is_ruled_out_unseen(spark):
    """Two texts of similarity 0.8 and more that differ just in the shingles with the least hashes."""
    import random

    import numpy as np

    from voxframe.llm import shingles

    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(454)]
    least = set(shingles.shingle_sets([" ".join(words).encode()])[0][:64].tolist())
    own = [set(shingles.shingle_sets([" ".join(words[k - 4 : k + 5]).encode()])[0].tolist()) for k in range(4, 450)]
    places = []
    for k in sorted(range(446), key=lambda k: -len(own[k] & least)):
        if len(places) < 9 and all(abs(k - p) >= 9 for p in places):
            places.append(k)
    changed = list(words)
    for k in (p + 4 for p in places):
        tried = [f"n{k}x{i}" for i in range(2000)]
        found = shingles.shingle_sets([" ".join([*words[k - 4 : k], t, *words[k + 1 : k + 5]]).encode() for t in tried])
        changed[k] = tried[int(np.argmin([np.sort(f)[-2] for f in found]))]

    def sets(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    a, b = sets(words), sets(changed)
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    other = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(other)), (4, " ".join(other[:-60]))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in shingles.first_of_each(docs).collect()) == [1, 3, 4]


def test_sketches_bound_what_sets_share():
    import numpy as np

    from voxframe.llm import shingles

    rng = np.random.default_rng(6)
    for trial in range(400):
        a = np.unique(rng.integers(1, 1 << 62, rng.integers(1, 300)).astype(np.uint64) * np.uint64(2))
        kept = a[rng.random(len(a)) < rng.random()]
        b = np.unique(np.concatenate([kept, rng.integers(1, 1 << 62, rng.integers(0 if len(kept) else 1, 200)).astype(np.uint64) * np.uint64(2)]))
        both = len(np.intersect1d(a, b))
        bound = shingles.most_common(len(a), shingles.sketch_of(a), len(b), shingles.sketch_of(b))
        assert both <= bound <= min(len(a), len(b)), trial
        assert bound == shingles.most_common(len(b), shingles.sketch_of(b), len(a), shingles.sketch_of(a))
    one, other = (np.unique(rng.integers(1, 1 << 62, 1000).astype(np.uint64) * np.uint64(2)) for _ in range(2))
    assert shingles.most_common(1000, shingles.sketch_of(one), 1000, shingles.sketch_of(other)) < 600
