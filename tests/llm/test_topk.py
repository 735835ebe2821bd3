from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import topk
from brindle.llm.queries import ORACLE_SQL, op2_ball_tree
from tests.llm.sql import same_as_sql

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def slow(rows, k, asked=lambda i: i % 5 == 0):
    usable = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clip = [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v]
            usable[(i, tuple(clip))] = None
    out = []
    for i, q in usable:
        if asked(i):
            exact = [(sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i]
            scores = sorted((-max(-(2**63), min(2**63 - 1, s)), j) for s, j in exact)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def found(df, k, **kind):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k, **kind).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert same_as_sql(op2_ball_tree(spark, sf), ORACLE_SQL["op2_ball_tree"], sf)


@pytest.mark.parametrize("kind", [{}, {"shard": 100, "block": 7, "pilot": 20}, {"shard": 40, "block": 1000, "pilot": 0}])
def test_ties_and_copies(spark, kind):
    rng = random.Random(1)
    common = [0.5, 0.5, -0.25, 0.125]
    rows = [(i, common if i % 3 == 0 else [rng.choice([-1.0, 0.0, 0.5, 1.0, 2.5]) for _ in range(4)], 0) for i in range(300)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, 6, **kind) == slow(rows, 6)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 0), (5, [3.0], 0), (10, [], 0), (15, None, 0), (20, [1.0, None], 0), (25, [nan, 1.0], 0),
        (30, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (1, [-0.001, 0.004, 7.0], 0), (2, [1.0, 2.0], 0), (2, [1.0, 2.0], 0),
        (35, [1e300, -1e300, 3.0], 0), (40, [1e15 + 0.3, 1e14, 1.0], 0), (41, [1e15, 1e14 + 0.07, 1.0], 0), (-5, [1.0], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, 4) == slow(rows, 4)
    assert found(df, 4, shard=3, block=2, pilot=5) == slow(rows, 4)
    assert found(df, 50) == slow(rows, 50)
    assert found(df.limit(0), 4) == [] and found(df.where("vec_id = 5"), 4) == [] and found(df.where("vec_id = 2"), 4) == []


def test_branches_are_cut_off():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 300
    points = (centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 8).astype(np.int64)
    tree = topk.BallTree(np.arange(8000), points)
    seen = []
    leaf = tree._leaf
    tree._leaf = lambda a, b, *rest: (seen.append(b - a), leaf(a, b, *rest))
    best = tree.search(np.array([-1]), points[:1], 5, np.array([-np.inf]))
    scores = points @ points[0]
    order = np.lexsort((np.arange(8000), -scores))[:5]
    assert [(-s, i) for s, i in best[0]] == [(scores[i], i) for i in order]
    assert sum(seen) < 2000


def test_scores_beyond_53_bits(spark):
    # sums near 2^60 that differ by less than a double tells apart
    rows = [(0, [2.0**22, 1 / 256], 0)] + [(i, [2.0**22, (i * 7 % 11) / 256], 0) for i in range(1, 12)]
    assert found(spark.createDataFrame(rows, SCHEMA), 6) == slow(rows, 6)


def test_matrix_keeps_64_bits():
    whole = 2**53 + 1
    lists = pa.array([[1], [whole, 2], [], [whole]], pa.list_(pa.int64()))
    assert topk._matrix(lists, 2).tolist() == [[1, 0], [whole, 2], [0, 0], [whole, 0]]
    assert topk._matrix(lists.slice(1, 1), 2).tolist() == [[whole, 2]] and topk._matrix(lists.slice(3), 1).tolist() == [[whole]]


def test_queries_travel_only_where_results_can_be(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8))
    points = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 8)) * 0.03
    rows = [(i, v.tolist(), 0) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, SCHEMA)
    sent, shards = [], []
    inner = topk._sent
    monkeypatch.setattr(topk, "_sent", lambda *a: (sent.append(inner(*a)), shards.append(int(a[5][-1])), sent[0])[2])
    got = found(df, 5, shard=100)
    scores = np.floor(256 * points).astype(np.int64)
    for i in range(0, 3000, 155):
        own = scores @ scores[i]
        own[i] = -(10**15)
        want = np.lexsort((np.arange(3000), -own))[:5]
        assert [(r, j, x) for q, r, j, x in got if q == i] == [(k + 1, j, own[j]) for k, j in enumerate(want.tolist())]
    queries = pa.record_batch([pa.array(range(0, 3000, 5)), pa.array(scores[::5].tolist())], names=["id", "v"])
    pairs = sum(b.num_rows for b in sent[0](iter([queries])))
    assert shards[0] >= 30 and pairs < 0.5 * 600 * shards[0]


def test_leaves_are_even_and_equal_points_stay_together():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(4000, 6))
    points[::3] = points[0]
    leaves = topk.Leaves(points, 16)
    of = leaves.of(points)
    counts = np.bincount(of, minlength=len(leaves.centre))
    assert len(set(of[::3].tolist())) == 1 and counts.min() > 0 and np.sort(counts)[:-1].max() < 700
    for leaf in range(len(leaves.centre)):
        assert np.allclose(leaves.centre[leaf], points[of == leaf].mean(axis=0))
