"""Positive-unlabelled quality: held-out accuracy, the prior, bounds, edge cases."""

import random
import zlib

import numpy as np
import pytest

from convlake.llm import quality

SCHEMA = "doc_id long, text string, score double, predicted int, key string, half int"


def corpus(n=900, bad=0.3, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9)))
    docs, labels = [], []
    for i in range(n):
        good = rng.random() >= bad
        w = [word() for _ in range(rng.randrange(20, 120))]
        if good:
            text = ". ".join(" ".join(w[k : k + 9]).capitalize() for k in range(0, len(w), 9)) + "."
        else:
            text = [" | ".join(w), " ".join(x + "###" for x in w), (w[0] + " ") * len(w), " ".join(w).upper() + "!!"][i % 4]
        docs.append((i, text, 0.1, 1, "k", 3))
        labels.append((i, int(good), 0, good))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus()
    shown = [(i, q, t) for i, q, t, _ in labels if i % 2]
    made = quality.score_documents(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(shown, "doc_id long, quality int, toxic int"))
    assert made.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = made.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(docs)))
    truth = {i: q for i, q, _, _ in labels}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    assert np.mean([r.predicted for r in held if truth[r.doc_id]]) > 0.97


def test_negative_labels_are_never_looked_at(spark):
    docs, labels = corpus(300)
    table = spark.createDataFrame(docs, SCHEMA)
    both = spark.createDataFrame([x[:2] for x in labels], "doc_id long, quality int")
    score = lambda l: {r.doc_id: r.score for r in quality.score_documents(table, l).collect()}
    assert score(both) == score(both.where("quality = 1"))
    # nor are labels of the held-out fold
    flipped = spark.createDataFrame([(i, q if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - q) for i, q, _, _ in labels], "doc_id long, quality int")
    assert score(both) == score(flipped)


def test_bounds_of_the_sample(spark):
    docs = [(1, f"text {i}", 0.1, 1, "k", 3) for i in range(2000)] + [(i, "other", 0.1, 1, "k", 3) for i in range(2, 90)] + [(None, "no key", 0.1, 1, "k", 3)]
    labels = spark.createDataFrame([(i % 90, 1) for i in range(180)] + [(None, 1), (5, None), (6, 0)], "doc_id long, quality int")
    rows = quality.training_rows(spark.createDataFrame(docs, SCHEMA), labels, positives=10, unlabelled=12).collect()
    assert sum(r.trusted for r in rows) == 10 and len(rows) == 22
    keys = {i for i in range(1, 90) if zlib.crc32(str(i).encode()) % 3 != 1}
    every = quality.training_rows(spark.createDataFrame(docs, SCHEMA), labels).collect()
    assert sum(r.trusted for r in every) == len(keys - {6}) and len(every) == len(keys) + len(keys - {6})


def test_empty_and_odd_texts(spark):
    docs, labels = corpus(200)
    odd = [(1000, None, 0.1, 1, "k", 3), (1001, "", 0.1, 1, "k", 3), (None, "a", 0.1, 1, "k", 3), (1002, "é" * 50_000, 0.1, 1, "k", 3), (1003, docs[3][1], 0.1, 1, "k", 3), (1003, docs[3][1], 0.1, 1, "k", 3)]
    wanted = spark.createDataFrame([x[:2] for x in labels], "doc_id long, quality int")
    rows = quality.score_documents(spark.createDataFrame(docs + odd, SCHEMA), wanted).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) + len(odd) and by[1000].score == by[1001].score and by[1003].score == by[3].score
    assert not by[None].held_out
    none = quality.score_documents(spark.createDataFrame(docs[:3], SCHEMA), wanted.limit(0)).collect()
    assert [r.score for r in none] == [0.5] * 3
    assert quality.score_documents(spark.createDataFrame(docs, SCHEMA).limit(0), wanted).collect() == []


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.9])
def test_prior(prior):
    rng = np.random.default_rng(3)
    p, n = rng.normal(2, 1, 3000), rng.normal(-2, 1, 20_000)
    u = np.r_[rng.normal(2, 1, int(5000 * prior)), n[: int(5000 * (1 - prior))]]
    assert abs(quality.estimate_prior(p, u) - prior) < 0.05


def test_risk_is_not_negative():
    """With far more features than rows the loss of unlabelled rows stays above the prior's share."""
    rng = np.random.default_rng(4)
    parts, trusted = [rng.choice(400, 20, replace=False).astype(np.int32) for _ in range(80)], np.repeat([1, 0], 40)
    w = quality._train(parts, trusted, 401, 0.5)
    f = np.array([w[x].sum() + w[-1] for x in parts])
    loss = np.logaddexp(0, f)
    assert loss[trusted == 0].mean() - 0.5 * loss[trusted == 1].mean() > -0.05
