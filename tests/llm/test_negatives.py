"""Operator 12 against brute force in Python integers."""

import math

import numpy as np
import pytest

pytest.importorskip("varispark.llm")

from pyspark.sql import functions as F  # noqa: E402

from varispark.llm import negatives as G  # noqa: E402

LIMIT = (1 << 63) - 1


def brute(rows, step=10, k=5, m=5):
    ok = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((n, i, label, [int(math.floor(256 * float(np.float32(x)))) for x in v]))
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for n, i, label, v in ok:
        if i is None or i % step:
            continue
        score = lambda w, v=v: min(LIMIT, max(-LIMIT, sum(a * b for a, b in zip(v, w, strict=False))))
        near = sorted(((score(w), j) for o, j, q, w in ok if q == label and o != n), key=key)[:k]
        for p, pid in near:
            far = sorted(((score(w), j) for _, j, q, w in ok if q != label), key=key)
            far = [x for x in far if 80 * p <= 100 * x[0] <= 100 * p][:m]
            out += [(i, pid, r, j, p, s) for r, (s, j) in enumerate(far, 1)]
    return sorted(out, key=str)


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, q, 7, 1.0) for i, v, q in rows], "vec_id long, embedding array<float>, label int, slot int, score double").repartition(parts)


def mined(spark, rows, step=10):
    out = G.hard_negatives(table(spark, rows), F.col("vec_id") % step == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("CHUNK_ANCHORS", 7), ("BLOCK_ANCHORS", 3), ("BLOCK_ROWS", 11)):
        monkeypatch.setattr(G, name, value)


def test_matches_brute_force(spark, small_blocks):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 8))
    rows = [(int(i), (centre[rng.integers(4)] + rng.normal(size=8) * 0.4).astype(np.float32).tolist(), int(rng.integers(3))) for i in rng.permutation(160)]
    rows += [(200 + i, [1.0] * 8, i % 2) for i in range(40)]  # ties by the score alone
    rows += [(20, rows[0][1], 1), (20, rows[0][1], 1), (30, [0.5] * 8, 0), (None, [0.4] * 8, 1), (None, [0.4] * 8, 0)]
    got = mined(spark, rows)
    assert len(got) > 100
    assert got == brute(rows)


def test_rows_that_take_no_part_and_odd_lengths(spark, small_blocks):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (10, None, 1), (20, [nan, 1.0], 1), (30, [1.0, None], 1), (40, [inf, 1.0], 1), (50, [1.0, 1.0], None), (60, [], 1), (70, [1.0], 1), (80, [-1.0, -1.0, 5.0], 1)]
    rows += [(1, [0.9, 1.0], 2), (2, [0.9, 0.9, 99.0], 2), (3, [], 2), (4, [nan], 2), (5, [0.0, 0.0], 3), (6, [-1.0, -1.0], 3), (7, [1.0, 1.0], 1)]
    got = mined(spark, rows)
    assert got == brute(rows)
    assert {r[0] for r in got} >= {0, 60, 70}


def test_scores_beyond_floating_point_are_exact(spark, small_blocks):
    big = float(2**25)
    rows = [(0, [big, 1.0], 0), (1, [big, 2.0], 0), (2, [big, 3.0], 0), (3, [big, 1.0], 1), (4, [big, 1.00390625], 1), (5, [big * 0.9, 1.0], 1), (10, [3e38, 1.0], 0), (11, [-3e38, 2.0], 1), (12, [1.0, 1.0], 1)]
    assert mined(spark, rows) == brute(rows)


def test_no_anchors_and_no_rows(spark):
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert G.hard_negatives(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0


def test_one_label_and_copies(spark, small_blocks):
    assert mined(spark, [(i, [1.0, 0.5], 3) for i in range(30)]) == []
    rows = [(i, [1.0, 0.5], int(i % 3 == 0)) for i in range(90)]
    assert mined(spark, rows) == brute(rows)
