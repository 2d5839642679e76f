import math
import random

import numpy as np
import pytest

from ripplegraph.llm import topk


def rows(n=900):
    draw = random.Random(9)
    out = []
    for i in range(n):
        v = [draw.choice([0.0, draw.uniform(-1, 1), 0.25]) for _ in range(12)]
        out.append((i * 3 % 1000, v))
    out += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2003, [float("inf")]), (None, [1.0])]
    out += [(2050, out[0][1]), (2100, out[0][1]), (2100, out[0][1]), (2100, out[5][1]), (2150, [5000.0] + out[2][1][1:]), (2151, [-70000.5, 0.5]), (2200, [3.0] * 14)]
    return out


def brute(rows_, k):
    """Every score in Python's integers; a candidate is every row but the query's own."""
    w = [(i, [math.floor(256 * x) for x in v]) for i, v in rows_ if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(w):
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for m, (c, b) in enumerate(w) if m != n)[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("far", [False, True])
def test_same_as_all_scores(spark, monkeypatch, far):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 128)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    if far:
        monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(topk, "FAR_QUERIES", 9)
        monkeypatch.setattr(topk, "FAR_CANDIDATES", 300)
    found = topk.usable(spark.createDataFrame([(i, v, 1) for i, v in rows()], "vec_id long, embedding array<double>, rank int"), "vec_id", "embedding")
    for k in (5, 2000):
        got = topk.top_k(found.where("id % 50 = 0"), found, k).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows(), k)


def test_large_components_are_exact():
    assert topk.weights([[5000.0, -0.001]], 2).tolist() == [[1_280_000, -1]]
    assert topk.weights([[2.0**62, 0.3]], 2).tolist() == [[2**70, 76]]
    big = np.array([[2**40, 1], [-(2**40), 3]], object)
    assert topk.accumulate(big[:1], np.array([[1, 2**40], [2**20, 0]], np.int64)).tolist() == [[2**41, 2**60]]
    with pytest.raises(OverflowError):
        topk.accumulate(big, big)


def test_selection_of_large_scores_is_the_same():
    draw = random.Random(2)
    small = np.array([[draw.randrange(-9, 9) for _ in range(40)] for _ in range(6)])
    own = np.array([-1, 0, 5, 39, -1, 7])
    assert (topk.select(small, own, 4) == topk.select(small.astype(object), own, 4)).all()
    assert topk.select(np.array([[3], [4]]), np.array([0, -1]), 5).tolist() == [[-1], [0]]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "row long, id long, v array<double>")
    some = spark.createDataFrame([(1, 50, [1.0])], "row long, id long, v array<double>")
    assert topk.top_k(none, none).count() == 0 and topk.top_k(none, some).count() == 0 and topk.top_k(some, some).count() == 0
