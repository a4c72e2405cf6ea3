"""The compression classifier: held-out accuracy, whole texts, awkward rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from voxframe.llm import compressor, queries

from . import messy

SF = "/root/testdata/sf0.01"


def _brute(model, text):
    body = (text or "").encode()
    good, bad = compressor.Sizer(model).sizes(body)
    return good, bad, 1 / (1 + np.exp(-(model.slope * (bad - good) / max(1, len(body)) + model.offset)))


def _labelled(spark, n=120):
    rng = random.Random(3)
    words = ["river", "stone", "walks", "under", "bright", "morning", "letter", "quiet"]
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        body = " ".join(rng.choice(words) if good else rng.choice(words).upper() + "!!" for _ in range(rng.randrange(40, 400)))
        docs.append((i, body))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_scores_are_those_of_the_model(spark):
    docs, labels = _labelled(spark)
    model = compressor.fit(docs, labels)
    for row in compressor.score(docs, model).join(docs, "doc_id").collect():
        good, bad, score = _brute(model, row.text)
        assert (row.good_bytes, row.bad_bytes) == (good, bad)
        assert row.score == pytest.approx(score, rel=1e-9)
    caught = compressor.score(docs, model).join(labels, "doc_id").where("(score >= 0.5) = (quality = 1)").count()
    assert caught == 120


def test_held_out_accuracy(spark):
    scored = queries.op13_compression_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    above = np.mean([g > b for g in good for b in bad])
    assert right >= 0.95 and above >= 0.98
    assert abs(np.mean([r.score for r in rows]) - np.mean([r.quality for r in rows])) < 0.08
    for r in scored.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1


def test_held_out_labels_are_not_used(spark):
    docs, labels = _labelled(spark)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compressor.fit(docs, labels, queries.learnable("_id")) == compressor.fit(docs, flipped, queries.learnable("_id"))


def test_awkward_rows(spark):
    docs, labels = _labelled(spark)
    model = compressor.fit(docs, labels)
    odd = messy.table(spark)
    got = compressor.score(odd, model)
    assert got.columns == ["doc_id", "n_bytes", "good_bytes", "bad_bytes", "score"]
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes) for r in got.collect() if r.doc_id is not None) == sorted(
        (False, r[0], len((r[1] or "").encode())) for r in messy.rows() if r[0] is not None)
    empty = [r.score for r in got.where("n_bytes = 0").collect()]
    assert len(empty) >= 2 and len(set(empty)) == 1 and 0 <= empty[0] <= 1
    assert compressor.score(docs.limit(0), model).count() == 0


def test_labels_that_do_not_help(spark):
    docs, labels = _labelled(spark, 30)
    from pyspark.sql import functions as F

    for given in (labels.limit(0), labels.where("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        model = compressor.fit(docs, given)
        assert {r.score for r in compressor.score(docs, model).collect()} == {0.5}
    both = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality")).where("doc_id < 6"))
    model = compressor.fit(docs.unionByName(docs), both)
    assert model == compressor.fit(docs, labels.where("doc_id >= 6"))


def test_few_chunks_make_a_raw_dictionary():
    assert compressor.dictionary([]) is None and compressor.dictionary([b""]) is None
    assert compressor.dictionary([b"abc", b"def"]) == b"abcdef"
    assert compressor.dictionary([b"a" * 600] * 20)
