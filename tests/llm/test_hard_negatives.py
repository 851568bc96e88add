"""Hard negatives against a plain double loop with Python's whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from specgraph.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=10, positives=5, negatives=10, low=30, high=90, scale=256):
    def fine(r):
        return None not in r[:3] and len(r[1]) and all(c is not None and math.isfinite(c) and abs(c * scale) < 1 << 23 for c in r[1])

    own = [(k, [math.floor(c * scale) for c in x], label) for k, x, label in rows if fine((k, x, label))]
    anchors = {}
    for k, q, label in sorted(own, key=lambda r: (r[0], r[2], r[1])):
        if k % every == 0:
            anchors.setdefault(k, (q, label))
    out = []
    for a, (q, label) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(q, r[1])), r[0], r[2]) for r in own if r[0] != a and len(r[1]) == len(q)]
        for s, p, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            window = sorted((t, n) for t, n, other in scored if other != label and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(a, p, i + 1, n, -s, -t) for i, (t, n) in enumerate(window)]
    return sorted(out)


def found(spark, rows, schema=SCHEMA, **kw):
    d = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(tuple(r) for r in H.hard_negatives(d, F.col("vec_id") % 10 == 0, **kw).collect())


def vectors(seed, n, dim, size=1.0, labels=3):
    rng = np.random.default_rng(seed)
    return [(int(k), (rng.integers(-8, 9, dim) / 8 * size).tolist() if i % 2 else rng.normal(size=dim).tolist(), int(rng.integers(labels))) for i, k in enumerate(rng.permutation(n))]


@pytest.mark.parametrize("seed,n,dim,size,kw", [(1, 150, 12, 1.0, {}), (2, 90, 8, 1.0, {"block": 7, "anchors_of_group": 2}), (3, 80, 1, 1.0, {"block": 20}), (4, 60, 17, 30000.0, {"positives": 2, "negatives": 3, "low": 10, "high": 70})])
def test_same_as_the_double_loop(spark, monkeypatch, seed, n, dim, size, kw):
    monkeypatch.setattr(H, "SMALL", 5)
    monkeypatch.setattr(H, "SLICE", 3)
    rows = vectors(seed, n, dim, size)
    assert found(spark, rows, **kw) == plain(rows, **{k: v for k, v in kw.items() if k not in ("block", "anchors_of_group")}) != []


def test_rows_that_take_no_part_repeats_and_clashing_columns(spark):
    rows = vectors(5, 60, 6, labels=2)
    odd = [(None, [1.0] * 6, 1), (100, None, 1), (101, [1.0] * 6, None), (102, [None] + [1.0] * 5, 1), (103, [float("nan")] * 6, 1), (110, [float("inf")] * 6, 0), (104, [], 1), (105, [1e30] * 6, 1)]
    other = [(k + 200, [0.5, 0.25 * (k % 3)], k % 2) for k in range(24)]  # another length
    repeats = [rows[0]] * 4 + [(10, [0.5] * 6, 1), (10, [0.5] * 6, 0)]
    whole = rows + odd + other + repeats
    wide = [(*r, 1, "x", 2) for r in whole]
    assert found(spark, wide, SCHEMA + ", anchor long, block string, score int") == plain(whole)


def test_a_label_of_nearly_all_rows_and_ties(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [1.0, float(rng.integers(2))], 0 if k % 9 else 1) for k in range(300)]
    assert found(spark, rows, block=32) == plain(rows)


def test_nothing_to_do(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchors
    assert found(spark, [(0, [1.0], 1), (10, [1.0], 1)]) == []  # no other label


def test_planes_and_tables():
    rng = np.random.default_rng(7)
    for low, high in ((-256, 257), (0, 1), (-5, 0), (-(2**22), 2**22)):
        c, a = rng.integers(low, high, (50, 13)), rng.integers(low, high, (9, 13))
        assert (H.scores(H.bit_planes(c), H.subset_sums(a, np.int64)) == c @ a.T).all()
