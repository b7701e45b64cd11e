"""Hard negatives against brute force, and bounds against true products."""

import math
import random

import numpy as np
import pytest

from convlake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rid long, score string, code int"


def brute(rows, every=100, positives=5, negatives=5):
    whole = []
    for k, (i, v, label, *_) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = math.fmod(label + 1, 10) if i is not None and i % 7 == 0 else label
        whole.append((k, i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for k, i, label, v in whole:
        if i is None or i % every:
            continue
        score = [(sum(a * b for a, b in zip(v, w)), j, n, own) for n, j, own, w in whole if n != k]
        for p, j, _, _ in sorted((x for x in score if x[3] == label), key=key)[:positives]:
            found = sorted((x for x in score if x[3] != label and 80 * p <= 100 * x[0] <= 100 * p), key=key)[:negatives]
            out += [(i, j, r, x[1], p, x[0]) for r, x in enumerate(found, 1)]
    return sorted(out, key=repr)


def corpus(seed, n=160, dims=70):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.1) for _ in range(dims)] for _ in range(6)]
    rows = [(i * 5, [c + rng.gauss(0, 0.08) for c in centres[rng.randrange(6)]], rng.choice([0, 1, 2, 9, -4]), 1, "s", 2) for i in range(n)]
    hot = rows[3][1]
    rows += [(1000 + i, hot, i % 3, 1, "s", 2) for i in range(60)]
    rows += [(2000, None, 1, 1, "s", 2), (2100, hot, None, 1, "s", 2), (2200, [0.1, None], 1, 1, "s", 2), (2300, [float("nan")], 1, 1, "s", 2), (2400, [float("inf")], 2, 1, "s", 2)]
    rows += [(2500, [], 1, 1, "s", 2), (2600, [0.3, -0.2], 1, 1, "s", 2), (None, hot, 2, 1, "s", 2), (None, hot, 0, 1, "s", 2), (2700, [0.0] * dims, 0, 1, "s", 2), (2800, hot, 77, 1, "s", 2)]
    return rows + rows[:1] + rows[20:22]


@pytest.mark.parametrize("seed,most", [(0, 2048), (1, 3)])
def test_against_brute_force(spark, seed, most, monkeypatch):
    monkeypatch.setattr(hn, "SLICE", most)  # the driver's alone: several slices
    rows = corpus(seed)
    made = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, made.collect()), key=repr) == brute(rows)


def test_numbers_of_any_size(spark):
    rng = random.Random(5)
    rows = [(i * 50, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(0, 5) for _ in range(9)], i % 2, 1, "", 1) for i in range(40)]
    assert sorted(map(tuple, hn.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute(rows)
    huge = [(100, [3e38], 1, 1, "", 1), (101, [3e38], 1, 1, "", 1), (102, [2e38], 2, 1, "", 1)]
    assert [tuple(r) for r in hn.hard_negatives(spark.createDataFrame(huge, SCHEMA)).collect()] == [(100, 101, 1, 102, 2**63 - 1, 2**63 - 1)]


def test_empty(spark):
    docs = spark.createDataFrame([(1, [0.5], 1, 1, "", 1)], SCHEMA)
    for x in (docs, docs.limit(0)):
        made = hn.hard_negatives(x)
        assert made.collect() == [] and made.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    for dims, spread, share in ((64, 40, 0.2), (192, 1e6, 0.4)):  # without any structure; the more dimensions, the nearer are all products
        x, q = np.floor(rng.standard_normal((900, dims)) * spread), np.floor(rng.standard_normal((30, dims)) * spread)
        q[0], x[0] = 0, 0
        turns = hn.rotations(dims)
        codes, along, rest = hn.encode(x, turns)
        least, most = hn.bounds(hn.planes(q, turns), codes, along, rest, np.linalg.norm(x, axis=1))
        true = q @ x.T
        assert (least <= true).all() and (true <= most).all()
        kth = np.sort(true, axis=1)[:, -5:-4]
        assert (most >= kth)[1:].mean() < share  # most pairs are never scored; the first anchor has nothing but ties
