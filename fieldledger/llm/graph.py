"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import record_batch, saved

#: Links that one task joins by itself at a time.
A_TASK = 1 << 19

_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def hung(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components in which every node but the smallest hangs on the smallest one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        if (label[x] == low).all() and (label[y] == low).all():
            break
        # The root of each end hangs on the smaller root, then everything on its root's root.
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        held.append(batch)
        total += len(batch)
        if total >= A_TASK:
            yield record_batch(_LINKS, *hung(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("a", "b"))))
            held, total = [], 0
    if total:
        yield record_batch(_LINKS, *hung(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("a", "b"))))


def _state(links: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(mixed.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftright(mixed, 32))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node that has a link to another.

    ``links`` has two long columns ``a`` and ``b``, in any direction, repeats allowed. Tasks first join the links
    that they hold, ``A_TASK`` at a time; where one task held all, that is the result. Else two steps alternate until
    nothing changes: every node hangs its larger neighbours, then its smaller ones, on its smallest neighbour.
    All state stays in tables; a node with very many links is aggregated in parts, and its join can be split."""
    links = links.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    links = saved(links, "links")
    tasks = -(-links.count() // A_TASK)
    links = saved(links.repartition(max(1, tasks)).mapInArrow(_contract, "a long, b long"), "links")
    before = None if tasks > 1 else ()
    while before != ():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Each node here points at smaller ones only.
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(smallest, "a")
        small = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = saved(small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _state(links)
        before = () if after == before else after
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
