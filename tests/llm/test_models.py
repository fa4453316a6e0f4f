"""Classifiers on held-out rows, and neighbours against brute force."""

import numpy as np
import pytest
from brute import awkward
from pyspark.sql import functions as F

from passbook.llm import ann, quality, toxicity

FOLDER = "/root/testdata/sf0.1"


def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def counts(found, labels, column):
    rows = found.where("held_out").join(labels.select("doc_id", F.col(column).alias("y")), "doc_id").select("predicted", "y").collect()
    return {(p, y): sum(r.predicted == p and r.y == y for r in rows) for p in (0, 1) for y in (0, 1)}


def test_toxicity_held_out(spark):
    docs, labels = tables(spark)
    found = toxicity.toxicity(docs, labels)
    n = counts(found, labels, "toxic")
    assert found.count() == docs.count()
    assert n[1, 1] >= 0.88 * (n[1, 1] + n[0, 1]) and n[1, 0] <= 0.01 * (n[1, 0] + n[0, 0])


def test_inserted_characters_stay_alike():
    machine = toxicity.fit([("idiot", 5.0, 2.0), ("worthless", 5.0, 2.0)], [(w, 1.0) for w in "the and with onthe ideation motion trust those less worth from otherness".split()])
    plain = machine.words(["idiot", "worthless"])
    bent = machine.words(["id.iot", "i-d-i-o-t", "idxiot", "worth*less", "worrthless"])
    other = machine.words(["motion", "the", "region", "weather"])
    assert plain.min() > 0.9 and bent.min() > other.max()
    assert "idiot" in toxicity.units("such an i d i o t here")


def test_quality_held_out(spark):
    docs, labels = tables(spark)
    found = quality.quality(docs, labels)
    n = counts(found, labels, "quality")
    assert n[1, 1] >= 0.98 * (n[1, 1] + n[0, 1]) and n[0, 0] >= 0.85 * (n[0, 0] + n[1, 0])


def test_all_bytes_of_long_texts_count():
    text = ("abé" + "x" * 60) * 500  # 2 of 64 bytes are not ASCII, always at the same places of a stride
    assert quality.text_features(text)[12] == 2 / 64
    assert quality.text_features("x" * 5000 + "é" * 100)[12] == 200 / 5200


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifiers_awkward(spark, operator):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    found = operator(awkward(spark), labels).collect()
    assert len(found) == 9 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
    assert operator(awkward(spark).limit(0), labels).count() == 0
    assert operator(awkward(spark), labels.limit(0)).count() == 9


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:400] = x[100]  # one large group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5050, []), (5100, [0.0] * 16), (5150, [float("nan")] * 16), (5200, [float("inf")] + [0.0] * 15), (5250, [None] + [1.0] * 15), (None, [1.0] * 16), (5300, [1.0] * 4)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(4)
    found = ann.nearest(table, F.col("vec_id") % 50 == 0).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        cos = np.round(unit @ unit[q], 12)
        cos[q] = -9
        want = np.lexsort((np.arange(3000), -cos))[:5].tolist()
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hits += len({m[1] for m in mine} & set(want))
    assert hits >= 0.9 * 300
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 200] == [100, 101, 102, 103, 104]
    assert {r.query_id for r in found} == set(range(0, 3000, 50))


def test_neighbours_among_near_copies_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 500)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    for g in range(5):
        x[g * 120 : g * 120 + 120] = x[g * 120] + rng.normal(size=(120, 16)) * 1e-5
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = ann.nearest(table, (F.col("vec_id") < 600) & (F.col("vec_id") % 10 == 0)).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 10):
        far = ((unit - unit[q]) ** 2).sum(axis=1)
        far[q] = 9
        hits += len({r["vec_id"] for r in found if r.query_id == q} & set(np.argsort(far)[:5].tolist()))
    assert hits >= 0.95 * 300, hits


def test_one_id_with_several_vectors(spark):
    far = [1.0, 0.0, 0.0]
    near, nearer = [0.0, 1.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(7, far), (7, near), (9, near), (11, near), (50, nearer), (50, [0.9, 0.0, 0.1]), (60, [0.8, 0.0, 0.3]), (None, near)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(table, F.col("vec_id") == 50).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in found) == [(1, 9), (2, 11), (3, 7), (4, 60)] or sorted((r["rank"], r["vec_id"]) for r in found) == [(1, 7), (2, 9), (3, 11), (4, 60)]
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    best = {r["vec_id"]: r["score"] for r in found}
    for i in (7, 9, 11, 60):
        mine = [v for k, v in rows if k == i]
        assert abs(best[i] - max(cos(q, v) for q in (nearer, [0.9, 0.0, 0.1]) for v in mine)) < 1e-12


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(table, F.col("vec_id") % 50 == 0).count() == 0
