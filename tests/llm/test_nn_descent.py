import math

import numpy as np
import pytest

from fieldledger.llm import nn_descent
from fieldledger.llm.common import reach_workers
from fieldledger.llm.graph import components


def table(spark, rows):
    reach_workers(spark)
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string").repartition(3)


def brute(rows):
    fit = {}
    for i, v in rows:
        if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v)
            x = x / np.abs(x).max()
            fit[i] = x / np.sqrt(x @ x)
    near = {i: {j for j, w in fit.items() if j != i and len(v) == len(w) and v @ w >= 0.95} for i, v in fit.items()}
    out = []
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            todo += (fresh := near.get(todo.pop(), set()) - seen)
            seen |= fresh
        out.append((i, len(near.get(i, ())), min(seen) if i is not None else None))
    return sorted(out, key=repr)


def found(spark, rows):
    out = nn_descent.near_duplicates(table(spark, rows))
    return sorted((tuple(r) for r in out.select("vec_id", "n_links", "component_id").collect()), key=repr)


def clustered(sizes, spread, seed, width=24):
    rng = np.random.default_rng(seed)
    rows = []
    for size in sizes:
        centre = rng.normal(size=width)
        rows += [(centre + spread * rng.normal(size=width)).tolist() for _ in range(size)]
    return [(3 * i + 1, v) for i, v in enumerate(rows)]


def test_clusters_copies_and_odd_rows(spark):
    rows = clustered([1] * 150 + [2] * 20 + [5] * 6 + [60], 0.1, 1)
    copies = [(1000 + i, rows[0][1]) for i in range(5)] + [(2000, [2 * x for x in rows[0][1]])]
    odd = [(3000, None), (3001, [0.0] * 24), (3002, [math.nan] * 24), (3003, [None, 1.0]), (3004, []), (None, [1.0] * 24)]
    odd += [(3005, [1e-200] * 24), (3006, [1e200] * 24), (3007, [1.0, 2.0])]
    assert found(spark, rows + copies + odd) == brute(rows + copies + odd)


def test_crowded_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "CROWD", 16)
    monkeypatch.setattr(nn_descent, "RUN", 8)
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    rows = clustered([1] * 40 + [150], 0.05, 2)
    assert found(spark, rows) == brute(rows)


def touching(size, cosine, spread, seed, width=24):
    """Two groups around centres of the given cosine: most links across, but none among the 12 nearest of a node."""
    rng = np.random.default_rng(seed)
    a, b = np.linalg.qr(rng.normal(size=(width, 2)))[0].T
    centres = [a, cosine * a + math.sqrt(1 - cosine * cosine) * b]
    return [(3 * i + 1, (centres[i % 2] + spread * rng.normal(size=width)).tolist()) for i in range(2 * size)]


@pytest.mark.parametrize("size,cosine,spread", [(40, 0.965, 0.004), (40, 0.945, 0.008), (300, 0.94, 0.008)])
def test_touching_groups(spark, size, cosine, spread):
    rows = touching(size, cosine, spread, 4)
    want = brute(rows)
    assert {c for _, _, c in want} == {1}
    assert found(spark, rows) == want


def test_recall_near_the_threshold(spark):
    rows = clustered([3] * 120, 0.15, 3)
    want, got = brute(rows), found(spark, rows)
    links = sum(n for _, n, _ in want)
    assert 100 < links
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(n for _, n, _ in got) >= 0.9 * links


def test_audit_sees_links_that_are_not_counted(spark, monkeypatch):
    """Few linked vectors among many, and counts that miss their links: the result is refused."""
    monkeypatch.setattr(nn_descent, "AUDIT", 8)
    monkeypatch.setattr(nn_descent, "TRIES", 1)
    counted = nn_descent._counted
    monkeypatch.setattr(nn_descent, "_counted", lambda *a: counted(*a).selectExpr("node", "0L as links"))
    with pytest.raises(RuntimeError):
        nn_descent.near_duplicates(table(spark, clustered([1] * 200 + [3] * 2, 0.05, 6)))


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(5, None)]) == [(5, 0, 5)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(i, i + 1) for i in range(40)] + [(100, int(x)) for x in rng.integers(101, 140, 20)]
    pairs += [(int(a), int(b)) for a, b in rng.integers(200, 260, (25, 2))] + [(7, 7)]
    rng.shuffle(pairs)
    got = dict(tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect())
    parent = {x: x for p in pairs for x in p}
    for _ in parent:
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: parent[x] for x in linked}


def test_components_over_many_tasks(spark, monkeypatch):
    from fieldledger.llm import graph

    monkeypatch.setattr(graph, "A_TASK", 7)
    test_components(spark, 5)
