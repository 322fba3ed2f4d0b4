import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphora.llm import quality

from .helpers import CLASH, edge_documents, empty_documents


def corpus(spark, n=240):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        ws = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        text = " ".join(ws) + "." if good else rng.choice([" ".join(w + "%%%" for w in ws), " ".join(w.upper() + "!!" for w in ws), " ".join(w for w in ws[:8] for _ in range(12))])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, q) for i, q, _ in labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_held_out_labels_are_not_read(spark):
    docs, labels, truth = corpus(spark)
    flipped = labels.collect()
    other = [(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else r.quality, None) for r in flipped]
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(docs, spark.createDataFrame(other, labels.schema)).collect()}
    assert a == b


def test_counts(spark):
    docs, labels, truth = corpus(spark, 40)
    rows = quality.labelled(docs, labels)
    got, want = quality.class_counts(rows), np.zeros((2, quality.SIZE), np.int64)
    for d in docs.collect():
        if zlib.crc32(str(d.doc_id).encode()) % 4 != 2:
            want[truth[d.doc_id]][quality.features(d.text.encode())] += 1
    assert (got == want).all()


def test_edges(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (7, 1), (8, 0), (10, 1), (10, 0), (4, 1), (5, 0), (6, 0), (9, 1)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(docs, labels).columns == docs.columns and "score" in CLASH
    nothing = labels.limit(0)
    assert {r.score for r in quality.classify(docs, nothing).collect()} == {0.5}
    assert {r.predicted for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {1}
    assert {r.predicted for r in quality.classify(docs, labels.where("quality = 0")).collect()} == {0}
    assert quality.classify(empty_documents(spark), labels).count() == 0


def test_sample_is_of_rows_whatever_their_length_and_order(spark):
    docs, labels, truth = corpus(spark, 60)
    one = spark.createDataFrame([(1000, "".join(map(chr, random.Random(3).choices(range(32, 4000), k=18_000_000))))], docs.schema)  # over 32 MB
    docs, labels = docs.union(one), labels.union(spark.createDataFrame([(1000, 1, 0)], labels.schema))
    assert zlib.crc32(b"1000") % 4 != 2
    train = [q for i, q in truth.items() if zlib.crc32(str(i).encode()) % 4 != 2] + [1]
    found, classes = quality.sample(quality.labelled(docs, labels), 1000)
    assert sorted(classes) == sorted(train) and max(map(len, found)) == quality.SIZE // 8
    found, classes = quality.sample(quality.labelled(docs, labels), 20)
    assert list(np.bincount(classes)) == [10, 10]
    again = quality.sample(quality.labelled(docs.orderBy(F.desc("doc_id")).repartition(7), labels), 20)
    assert again[0] == found and (again[1] == classes).all()
    twice = quality.sample(quality.labelled(docs.where("doc_id < 60").union(docs.where("doc_id < 60")), labels), 1000)
    assert len(twice[1]) == 2 * len(train) - 2


def test_descent_reaches_the_optimum():
    """The optimality conditions of the dual, and the primal loss against points around, on dense rows."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 8)), np.where(rng.random(60) < 0.5, 1, -1)
    x[:, 0] += 0.8 * y
    w, bias, alpha = quality.descend(lambda i: (np.arange(8), x[i]), y, 2000, 8)
    assert np.allclose(w, (alpha * y) @ x) and np.isclose(bias, (alpha * y).sum())
    margin = y * (x @ w + bias)
    assert (margin[alpha < 1e-9] >= 1 - 1e-4).all() and (margin[alpha > quality.COST - 1e-9] <= 1 + 1e-4).all()
    assert np.allclose(margin[(alpha > 1e-6) & (alpha < quality.COST - 1e-6)], 1, atol=1e-4)
    loss = lambda v: 0.5 * v @ v + quality.COST * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])).sum()
    best = np.append(w, bias)
    assert all(loss(best) <= loss(best + s * rng.normal(size=9)) + 1e-6 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(50))


def slow_grams(text):
    """Byte 3- and 4-grams of a text, by their hashes."""
    m = (1 << 32) - 1
    out = set()
    for i in range(len(text) - 2):
        three = int.from_bytes(text[i : i + 3], "big")
        out.add((three * 0x85EBCA6B & m) >> 14)
        if i + 3 < len(text):
            out.add((((three ^ (text[i + 3] * 0x01000193 & m)) * 0x9E3779B1) & m) >> 14)
    return {h % (quality.SIZE - 16) for h in out}


def test_fit_against_brute_force(spark):
    """Ratios by counting, weights by the plain algorithm over dense rows, scores by the formula."""
    rng = random.Random(7)
    good, bad = ["amber", "birch", "cedar", "delta"], ["xoxo", "zzzt", "qqq"]
    text = lambda q: " ".join(rng.choice(good if rng.random() < (0.8 if q else 0.3) else bad) for _ in range(rng.randint(8, 16)))
    rows = [(k, text(k % 2), k % 2) for k in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, passes=3)
    train = [(t.encode(), q) for k, t, q in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    for t, _ in train:
        assert {int(f) for f in quality.features(t) if f < quality.SIZE - 16} == slow_grams(t)
    dense = np.zeros((len(train), quality.SIZE), bool)
    for i, (t, _) in enumerate(train):
        dense[i, quality.features(t)] = True
    classes = np.array([q for _, q in train])
    p, n = dense[classes == 1].sum(axis=0) + 1.0, dense[classes == 0].sum(axis=0) + 1.0
    ratios = np.log((p / p.sum()) / (n / n.sum()))
    assert np.allclose(model.ratios, ratios, atol=1e-5)
    margin = lambda t: sum(float(model.weights[f]) for f in quality.features(t)) / np.sqrt(sum(ratios[f] ** 2 for f in quality.features(t))) + model.bias
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for k, t, _ in rows[:40]:
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin(t.encode()) + model.offset))), abs=1e-4)
    held = [(got[k], q) for k, _, q in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum((s > 0.5) == q for s, q in held) / len(held) > 0.8
