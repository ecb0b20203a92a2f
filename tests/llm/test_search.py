"""Exact and approximate search against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fablework.llm.ann import best_of, fit_tree, nearest_neighbours
from fablework.llm.topk import exact_topk

SCHEMA = "vec_id bigint, embedding array<float>, rank string, score string"


def frame(spark, rows):
    """Rows with two columns whose names clash with those of the result."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", "y") for i, v in rows], SCHEMA)


def random_rows(n, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=dim).astype(np.float32).tolist()) for i in range(n)]


def plain_topk(rows, step, k, measure):
    out = []
    for q, v in rows:
        if q % step == 0:
            best = sorted(((-measure(v, w), i) for i, w in rows if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def integer_product(a, b):
    return int(sum(int(np.floor(1024 * np.float64(x))) * int(np.floor(1024 * np.float64(y))) for x, y in zip(a, b)))


def test_topk_with_many_equal_vectors(spark):
    rows = random_rows(150)
    rows += [(i, rows[0][1]) for i in range(150, 260)]  # ties at every bound
    got = exact_topk(frame(spark, rows), F.col("vec_id") % 50 == 0, k=7, chunk_rows=40, query_rows=2, bins=16)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_topk(rows, 50, 7, integer_product)


def test_topk_leaves_out_broken_rows(spark):
    good = [(0, [1.0, 0.5]), (1, [0.25, 0.5]), (2, [-1.0, 0.0])]
    bad = [(3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    got = exact_topk(frame(spark, good + bad + [good[1]]), F.col("vec_id") % 2 == 0, k=10)
    assert sorted(map(tuple, got.collect())) == plain_topk(good, 2, 10, integer_product)
    assert exact_topk(frame(spark, []), F.lit(True)).count() == 0
    assert exact_topk(frame(spark, good[:1]), F.lit(True)).count() == 0


def test_neighbours_reach_the_recall_and_score_exactly(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 2
    rows = [(i, (centres[i % 12] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(i, rows[5][1]) for i in range(900, 1200)]  # a hot vector
    got = nearest_neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0, k=20, branches=4, chunk_rows=100)
    found = {}
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for r in got.collect():
        assert r["score"] == pytest.approx(vectors[r["query_id"]] @ vectors[r["vec_id"]], abs=1e-9)
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    true = plain_topk([(i, np.array(v, np.float64)) for i, v in rows], 20, 20, lambda a, b: float(a @ b))
    hits = sum(any(v == r[1] or abs(s - r[2]) < 1e-9 for r in found[q]) for q, _, v, s in true)
    assert hits >= 0.9 * len(true) and set(found) == {q for q, *_ in true}
    for ranked in found.values():
        ranked.sort()
        assert [r for r, _, _ in ranked] == list(range(1, 21)) and ranked == sorted(ranked, key=lambda x: (-x[2], x[1]))


def test_neighbours_of_few_and_broken_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (None, [1.0, 1.0]), (40, [])]
    got = nearest_neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0, k=20)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 20, 0.5), (20, 1, 0, 0.5)]
    assert nearest_neighbours(frame(spark, []), F.lit(True)).count() == 0


def test_best_of_breaks_ties_by_id():
    v = np.array([[1.0, 0.0]] * 5)
    own, near, _ = best_of(np.array([3]), v[:1], np.array([9, 3, 5, 1, 7]), v, 3)
    assert own.tolist() == [3, 3, 3] and near.tolist() == [1, 5, 7]


def test_a_tree_over_equal_rows_is_a_leaf():
    tree = fit_tree(np.ones((50, 3)))
    assert tree.n_leaves == 1 and tree.order(np.ones(3), 5) == [0]


def test_topk_leaves_out_what_64_bits_cannot_score(spark):
    rows = random_rows(60)
    rows += [(100, [1e12] * 8), (101, [3e30, 0, 0, 0, 0, 0, 0, 0]), (102, [30000.0] + [0.0] * 7)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_topk(frame(spark, rows), F.col("vec_id") % 10 == 0, k=3).collect()}
    want = plain_topk([r for r in rows if r[0] not in (100, 101)], 10, 3, integer_product)
    assert got == {(q, n): (v, s) for q, n, v, s in want}
