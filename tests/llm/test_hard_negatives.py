"""Hard negatives against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigbook.llm import hard_negatives as mining

SCHEMA = "vec_id long, embedding array<float>, label int, row string, anchor int, side int"


def expected(rows, every, positives=5, negatives=3, low=50, high=95, scale=256):
    part = []
    for key, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        part.append((key, [math.floor(scale * float(np.float32(x))) for x in vector], label))
    width = max((len(p[1]) for p in part), default=0)
    part = [(k, v + [0] * (width - len(v)), label) for k, v, label in part]
    found = Counter()
    for a, (anchor, vector, label) in enumerate(part):
        if anchor is None or anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(vector, v, strict=True)), (k is not None, k or 0), r, k, other)
                  for r, (k, v, other) in enumerate(part) if r != a]
        scored.sort(key=lambda s: s[:3])
        for down, _, _, positive, _ in [s for s in scored if s[4] == label][:positives]:
            fits = [s for s in scored if s[4] != label and low * -down <= 100 * -s[0] <= high * -down][:negatives]
            for rank, s in enumerate(fits, 1):
                found[anchor, positive, rank, s[3], -down, -s[0]] += 1
    return found


def mined(spark, rows, every, **options):
    table = spark.createDataFrame([(*r, "x", 0, 1) for r in rows], SCHEMA).coalesce(1)
    return Counter(map(tuple, mining.hard_negatives(table, F.col("vec_id") % every == 0, **options).collect()))


def random_rows(n, seed=1, width=6, labels=3):
    draw = np.random.default_rng(seed)
    vectors = draw.normal(0, 0.05, (n, width))         # small whole numbers: many ties
    return [(k, v.tolist(), int(draw.integers(labels))) for k, v in enumerate(vectors.astype(np.float32))]


@pytest.mark.parametrize("blocks", [(4096, 1 << 17, 1 << 21), (7, 50, 160)])
def test_as_by_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("ANCHOR_BLOCK", "ROW_BLOCK", "SCORES"), blocks, strict=True):
        monkeypatch.setattr(mining, name, value)
    rows = random_rows(300)
    assert mined(spark, rows, 10) == expected(rows, 10)
    options = {"positives": 2, "negatives": 4, "low": 20, "high": 80, "scale": 100}
    assert mined(spark, rows, 7, **options) == expected(rows, 7, **options)


def test_ties_go_by_id_whatever_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(mining, "ROW_BLOCK", 20)
    monkeypatch.setattr(mining, "SCORES", 16)
    rows = [(k, [1.0, 1.0 if k % 4 == 0 else 0.5], k % 4) for k in range(120)]
    random.Random(1).shuffle(rows)
    assert mined(spark, rows, 8) == expected(rows, 8)


def test_a_hot_label_and_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(mining, "ROW_BLOCK", 64)
    rows = random_rows(200) + [(10, v, 0) for _, v, _ in random_rows(100, seed=2)] + [
        (1000 + k, v, 1) for k, (_, v, _) in enumerate(random_rows(150, seed=3))]
    # Rows of one id and score are told apart by their place, which SQL and brute force cannot see: compare scores.
    def scores(found):
        return Counter((*k[:1], *k[2:3], *k[4:]) for k in found.elements())
    assert scores(mined(spark, rows, 10)) == scores(expected(rows, 10))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(60, width=3) + [
        (100, None, 1), (110, [1.0, 2.0, 3.0], None), (120, [1.0, None, 0.0], 1), (130, [nan, 0.0, 0.0], 1),
        (140, [0.0, inf, 0.0], 2), (None, [0.3, 0.1, 0.2], 1), (150, [0.5], 0), (160, [], 1), (170, [0.0, 0.0, 0.0], 2)]
    assert mined(spark, rows, 10) == expected(rows, 10)
    assert mined(spark, [], 10) == Counter() and mined(spark, rows, 10_000_000) == expected(rows, 10_000_000)
    assert mined(spark, [(0, [1.0], 1)], 10) == Counter()


def test_sums_beyond_doubles(spark):
    rows = [(k, [2.0**20 + k, 2.0**19 + (k % 5)], k % 2) for k in range(12)]
    assert mined(spark, rows, 3, low=90, high=100) == expected(rows, 3, low=90, high=100)
    rows = [(k, [3e38, 1.0], k % 2) for k in range(6)]            # beyond a long: the largest long
    assert {k[4] for k in mined(spark, rows, 3, low=90, high=100)} == {2**63 - 1}


def test_plan_sorts_pairs_within_anchors(spark):
    table = spark.createDataFrame([(*r, "x", 0, 1) for r in random_rows(50)], SCHEMA)
    plan = mining.hard_negatives(table, F.col("vec_id") % 10 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert "hashpartitioning(anchor" in plan
