"""Exact top-k by inner product in three phases with one uniform threshold per query.

The dimensions are cut into ``LISTS`` groups. In every task each group gives a list of partial scores, and a
candidate's score is the sum over the lists.

1. For each query every task gathers the best ``k`` entries of each of its lists, scores them exactly and sends
   the best ``k``. The k-th best score of all tasks is a safe cutoff: at least k candidates reach it.
2. The cutoff of each query is broadcast. A candidate that reaches the cutoff ``c`` has at least one partial score
   of ``c / LISTS`` or more, so only entries at or above that are collected. A list in which a candidate is not
   collected adds less than that threshold, which bounds its score from above.
3. Candidates whose bound reaches the cutoff are scored exactly; those below the cutoff go, the others are ranked.

Queries are handled in blocks of about ``QUERY_BLOCK``, so what is broadcast has a fixed size; each block reads
the candidates twice. Components are ``floor(256 * x)``.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without a vec_id;
a shorter vector counts as padded with zeros; a candidate is every row with another vec_id than the query, and
rows that repeat a vec_id are ranked each; scores beyond 64 bits are cut at that range; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.llm.common import record_batch

LISTS = 4
QUERY_BLOCK = 2048
#: Scores of one step: candidates are taken in runs that make about so many.
SCORES = 1 << 19
_SAFE = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and components as whole numbers (in doubles) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() gives a long; a double of 2**53 or more has no fraction and stays as it is.
    scaled = F.transform(
        F.transform("embedding", lambda x: x.cast("double") * 256),
        lambda x: F.when(F.abs(x) < _SAFE, F.floor(F.when(F.abs(x) < _SAFE, x))).otherwise(x),
    )
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v")
    )


def _matrix(lists: list | pa.Array, width: int) -> np.ndarray:
    rows = lists if isinstance(lists, list) else lists.to_pylist()
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _partials(queries: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Partial scores (queries x rows) of each group of dimensions, exact whole numbers."""
    width = queries.shape[1]
    high = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, width)
    if high >= _SAFE:
        queries, rows = (np.vectorize(int, otypes=[object])(m) if m.size else m for m in (queries, rows))
    edges = [width * i // LISTS for i in range(LISTS + 1)]
    return [queries[:, a:b] @ rows[:, a:b].T for a, b in zip(edges, edges[1:], strict=False)]


def _runs(batches: Iterable[pa.RecordBatch], queries: np.ndarray, ids: np.ndarray):
    step = max(1, SCORES // max(1, len(queries)))
    for batch in batches:
        for i in range(0, len(batch), step):
            part = batch.slice(i, step)
            own = part.column("vec_id").to_numpy()
            yield own, _partials(queries, _matrix(part.column("v"), queries.shape[1])), own[None, :] == ids[:, None]


def _out(query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    schema = pa.schema([("q", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if scores.dtype == object:
        scores = np.array([min(max(s, _LEAST), _MOST) for s in scores], np.int64)
    return record_batch(schema, query.astype(np.int32), ids, scores.astype(np.int64))


def _phase_one(batches: Iterable[pa.RecordBatch], queries: np.ndarray, ids: np.ndarray, k: int) -> Iterator:
    best: list[list[tuple[int, int]]] = [[] for _ in ids]
    for own, parts, self in _runs(batches, queries, ids):
        total = sum(parts[1:], parts[0])
        chosen = np.zeros(total.shape, bool)
        for p in parts:
            p = np.where(self, -np.inf, p.astype(np.float64))
            top = np.argpartition(-p, min(k, p.shape[1]) - 1, axis=1)[:, :k]
            np.put_along_axis(chosen, top, True, axis=1)
        chosen &= ~self
        for q in range(len(ids)):
            at = np.flatnonzero(chosen[q])
            best[q] += zip((-total[q, at]).tolist(), own[at].tolist(), strict=True)
            best[q] = sorted(best[q])[:k]
    rows = [(q, i, -s) for q, found in enumerate(best) for s, i in found]
    if rows:
        q, i, s = zip(*rows, strict=True)
        yield _out(np.array(q), np.array(i, np.int64), np.array([int(x) for x in s], object))


def _phase_two(batches: Iterable[pa.RecordBatch], queries: np.ndarray, ids: np.ndarray, cutoff: list) -> Iterator:
    floor = np.array([-np.inf if c is None else float(c) for c in cutoff])[:, None]
    for own, parts, self in _runs(batches, queries, ids):
        # A small slack keeps rounding of the bounds on the safe side; scores themselves are exact.
        slack = 1e-9 * np.maximum(1.0, np.where(np.isfinite(floor), np.abs(floor), 1.0))
        least = floor / LISTS - slack
        collected = np.zeros(parts[0].shape, bool)
        bound = np.zeros(parts[0].shape)
        for p in parts:
            enough = p >= least
            collected |= enough
            bound += np.where(enough, p, least).astype(np.float64)
        q, at = np.nonzero(collected & ~self & (bound >= floor - LISTS * slack))
        exact = sum((p[q, at] for p in parts[1:]), parts[0][q, at])
        keep = np.array([cutoff[i] is None or s >= cutoff[i] for i, s in zip(q, exact, strict=True)], bool)
        if exact.dtype != object:
            exact = exact.astype(np.int64)
        if keep.any():
            yield _out(q[keep], own[at[keep]], exact[keep])


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows for every row of ``queries`` (vec_id, embedding)."""
    spark = rows.sparkSession
    candidates, asked = usable(rows), usable(queries).distinct()
    width = max(
        1, *(t.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0] for t in (candidates, asked))
    )
    blocks = -(-asked.count() // QUERY_BLOCK)
    ranked = "q int, vec_id long, score long"
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == block).collect()
        part.sort()
        if not part:
            continue
        ids = np.array([r["vec_id"] for r in part], np.int64)
        matrix = _matrix([r["v"] for r in part], width)
        first = candidates.mapInArrow(partial(_phase_one, queries=matrix, ids=ids, k=k), ranked)
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        top = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        cutoff: list = [None] * len(ids)
        for r in top.where(F.col("rank") == k).collect():
            cutoff[r["q"]] = r["score"]
        exact = candidates.mapInArrow(partial(_phase_two, queries=matrix, ids=ids, cutoff=cutoff), ranked)
        names = spark.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], "q int, query_id long")
        result = (
            exact.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .join(F.broadcast(names), "q")
            .select("query_id", "rank", "vec_id", "score")
        )
        found = result if found is None else found.unionByName(result)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found
