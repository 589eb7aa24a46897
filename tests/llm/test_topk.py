import math

import numpy as np
import pytest

from fieldledger.llm import topk
from fieldledger.llm.common import reach_workers

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def table(spark, rows):
    reach_workers(spark)
    return spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(3)


def brute(rows, k):
    usable = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, v in usable:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in usable if j != i)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, k=5):
    t = table(spark, rows)
    return sorted(tuple(r) for r in topk.search(t, t.where("vec_id % 50 = 0"), k).collect())


@pytest.mark.parametrize("block", [topk.QUERY_BLOCK, 3])
def test_random_ties_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 6) / 7).tolist()) for i in range(420)]
    rows += [(500, None), (550, [1.0, None, 2.0]), (600, [math.nan] * 6), (650, [math.inf, 0.0]), (None, [1.0] * 6)]
    rows += [(700, []), (701, [0.5]), (702, [0.1] * 9), (703, [-2.0] * 6), (704, [-2.0] * 6)]
    assert found(spark, rows) == brute(rows, 5)


def test_negative_scores_only(spark):
    rows = [(50 * i, [1.0 if i == 0 else -float(i), 0.25]) for i in range(9)]
    assert found(spark, rows) == brute(rows, 5)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, -4.0]), (2, [0.0, 0.0])]
    assert found(spark, rows) == brute(rows, 5) and len(found(spark, rows)) == 2
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [1e7 + 1, 3.0]), (1, [1e7, 1.0]), (2, [1e7, 2.0]), (3, [-1e7, 5.0])]
    assert found(spark, rows) == brute(rows, 5)
    huge = [(0, [1e30]), (1, [1e30]), (2, [-1e30])]
    assert [r[2:] for r in found(spark, huge)] == [(1, (1 << 63) - 1), (2, -(1 << 63))]


def test_repeated_rows_are_ranked_each(spark):
    rows = [(0, [1.0, 0.0])] * 2 + [(1, [0.5, 0.5])] * 3 + [(2, [0.25, 1.0])]
    assert found(spark, rows, 3) == [(0, 1, 1, 32768), (0, 2, 1, 32768), (0, 3, 1, 32768)]
