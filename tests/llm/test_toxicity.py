import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicktrail.llm import toxicity

BAD = ["idiotic", "scumbag", "trashy"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows = []
    for i in range(700):
        toxic = i % 5 == 0
        text = [rng.choice(["river", "stone", "cloud", "light", "house", "wind", "field", "bird"]) + rng.choice(["", "s", "y"]) for _ in range(rng.randint(5, 60))]
        if toxic:
            text.insert(rng.randint(0, len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()


def test_held_out_accuracy(labelled):
    model = toxicity.train(labelled.drop("toxic"), labelled.select("doc_id", "toxic"), keep=F.col("doc_id") % 3 != 0)
    rows = toxicity.score(labelled, model).where("row.doc_id % 3 = 0").collect()
    right = [(r.score >= 0.5) == bool(r.row.toxic) for r in rows]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_same_model_whatever_the_partitions(labelled):
    a, b = (toxicity.train(d.drop("toxic"), d.select("doc_id", "toxic")) for d in (labelled.repartition(3), labelled.repartition(7)))
    assert a["grams"].tolist() == b["grams"].tolist() and abs(a["bias"] - b["bias"]) < 1e-6
    assert abs(a["weights"] - b["weights"]).max() < 1e-4


def test_odd_documents_labels_and_no_rows(spark, docs_frame, odd_docs, no_docs):
    labels = spark.createDataFrame([(10, 1), (10, 1), (11, 0), (12, None), (None, 1), (16, 0), (18, 0), (999, 1), (24, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs_frame, labels)
    scored = toxicity.score(docs_frame, model).collect()
    assert len(scored) == len(odd_docs) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.row.doc_id in (13, 14)}) == 1
    assert toxicity.score(no_docs, model).collect() == []
    assert toxicity.train(docs_frame, labels.where("false"))["bias"] == 0
    one_class = toxicity.train(docs_frame, labels.where("toxic = 1"))
    assert 0.5 < toxicity.score(docs_frame, one_class).first().score < 1


def test_sample_bound(labelled):
    model = toxicity.train(labelled.drop("toxic"), labelled.select("doc_id", "toxic"), sample=100)
    assert len(model["grams"])


def plain_grams(text):
    """Buckets of the n-grams of a text, one by one in whole numbers."""
    chars, found = [ord(c) for c in f" {' '.join(text.lower().split())} "], set()
    for n in (3, 4, 5):
        for i in range(len(chars) - n + 1):
            value = chars[i]
            for c in chars[i + 1:i + n]:
                value = (value * 0x01000193 + c * 0x9E3779B1) % 2**32
            found.add((value ^ value >> 15) * (0x85EBCA6B + 2 * n) % 2**32 >> 32 - toxicity.BUCKET_BITS)
    return found


def plain_fit(x, y, rounds=200):
    """Ridge logistic regression with a bias on a dense matrix, by the same steps."""
    theta = np.append(np.zeros(x.shape[1]), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1] - 1, 1e-4), 0)
    m = v = np.zeros(len(theta))
    for t in range(1, rounds + 1):
        g = x.T @ (1 / (1 + np.exp(-x @ theta)) - y) / len(y) + ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta


@pytest.mark.parametrize("block,held", [(1 << 20, 8), (500, 2)])
def test_scores_equal_a_plain_fit(labelled, monkeypatch, block, held):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "HELD", held)
    rows = sorted((r.doc_id, r.text, r.toxic) for r in labelled.collect())
    sets, y = [plain_grams(t) for _, t, _ in rows], np.array([y for _, _, y in rows])
    n1, n0 = y.sum(), len(y) - y.sum()
    rated = []
    for g in set().union(*sets):
        d1 = sum(g in s for s, label in zip(sets, y) if label)
        d0 = sum(g in s for s, label in zip(sets, y) if not label)
        ratio = math.log((d1 + 1) / (n1 + 2)) - math.log((d0 + 1) / (n0 + 2))
        if d0 + d1 >= 3 and abs(ratio) >= 0.5:
            prior = n1 / len(y)
            rated.append((-abs(d1 - (d0 + d1) * prior) / math.sqrt((d0 + d1) * prior * (1 - prior) + 1), g, ratio))
    kept = {g: r for _, g, r in sorted(rated)[:toxicity.FEATURES]}
    grams = sorted(kept)
    model = toxicity.train(labelled.drop("toxic"), labelled.select("doc_id", "toxic"))
    assert model["grams"].tolist() == grams

    ratios = np.array([kept[g] for g in grams])
    x = np.array([[g in s for g in grams] for s in sets]) * ratios / abs(ratios).max()
    theta, order = plain_fit(x, y), np.argsort(y, kind="stable")
    z, quarter = np.zeros(len(y)), np.arange(len(y)) % 4
    for q in range(4):
        out, seen = order[quarter == q], order[quarter != q]
        part = plain_fit(x[seen], y[seen])
        z[out] = x[out] @ part[:-1] + part[-1]
    # slope and bias by plain gradient steps, to where the gradient is nought
    balance = np.sqrt(np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
    slope, shift = 1.0, 0.0
    for _ in range(60_000):
        miss = balance * (1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30))) - y)
        slope, shift = slope - 0.2 * ((miss * z).mean() + 1e-3 * (slope - 1)), shift - 0.2 * miss.mean()
    want = 1 / (1 + np.exp(-(slope * (x @ theta[:-1] + theta[-1]) + shift)))
    got = {r.row.doc_id: r.score for r in toxicity.score(labelled, model).collect()}
    assert max(abs(got[doc] - p) for (doc, _, _), p in zip(rows, want)) < 2e-3


def test_features_packed_either_way():
    rng = np.random.default_rng(4)
    for features in (1, 7, 100, 8192):
        for share in (0, 0.01, 0.05, 0.5, 1):
            has = rng.random(features) < share
            packed = toxicity.pack(has)
            assert len(packed) <= -(-features // 8) and toxicity.unpack(packed, features).tolist() == np.flatnonzero(has).tolist()
