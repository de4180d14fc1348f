"""Recall of the neighbour search where the first curves see a small part of the table."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from tablewake.llm import ann


def recall(spark, x, every, **given):
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.neighbours(rows, every=every, **given).collect():
        got[r.query_id].append(r.vec_id)
    x = x.astype(np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q in range(0, len(x), every):
        scores = unit @ unit[q]
        scores[q] = -np.inf
        hits += [scores[k] >= np.sort(scores)[-ann.NEAREST] - 1e-9 for k in got[q]] + [False] * (ann.NEAREST - len(got[q]))
    return np.mean(hits)


def test_curves_are_added_until_recall_holds(spark):
    x = np.random.default_rng(1).standard_normal((1500, 16))
    assert recall(spark, x, 15, curves=8, reach=16, run_length=64) >= 0.9


def test_dense_group_is_searched_by_its_own_content(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16))
    x[:800] = x[0] + 1e-5 * rng.standard_normal((800, 16))
    keys = ann.curve_keys(x[:800], 4, ann.DIMS, ann.CELL_BITS, ann.SEED).reshape(800, -1)
    assert len(np.unique(keys, axis=0)) > 700
    assert recall(spark, x, 15, curves=8, reach=32, run_length=128) >= 0.9


def test_ties_are_kept_for_the_smallest_ids(spark):
    x = np.random.default_rng(3).standard_normal((40, 16))
    x[:20] = [x[0] * 2.0**k for k in range(20)]
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = [r.vec_id for r in ann.neighbours(rows, every=10).where("query_id = 10").orderBy("rank").collect()]
    assert got == [0, 1, 2, 3, 4]
