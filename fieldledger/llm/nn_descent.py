"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours.

Rows with equal components are one node with a count. Lists hold a node's nearest neighbours with a cosine of at
least ``2 * t * t - 1``: two nodes that both reach the threshold ``t`` with a third one reach that with each other.

1. Start. Random hyperplanes deal the nodes to cells of about ``CELL``, in as many tables as make a pair at the
   threshold meet with probability ``1 - MISS``. Cells that hold far more nodes are split by a salt. Within a cell,
   nodes sorted by a random projection are compared in overlapping runs.
2. Descent. Each round joins every list with the vectors of its members and those that list the node, compares
   them with one another and merges what they learn into their lists, until few links are new. Lists are cut to
   ``LIST``, links are not: of the links of each run of compared nodes a spanning forest is kept for the components.
3. Touching groups. A list full of links holds none to a group further away. Nodes with such lists search again,
   from start and descent, for their nearest ones in other components only, until none of these is a link.
4. Saturation. A list full of links may hide more. Lists are enlarged without limit by comparing all nodes of a
   component that has a full list, block against block; that gives counts of links, pairs are not emitted.
5. Audit. The links of ``AUDIT`` nodes of all and ``AUDIT`` of those with a list, chosen by a hash, are found by brute
   force; if the graph connects or counts less than ``RECALL`` of them, another set of tables is added and the descent
   goes on. After ``TRIES`` sets that is an error.

Every link is decided by the cosine in double precision. Cases: vectors that are null, zero or hold null or
non-finite components link with nothing; vectors of different length do not link; rows without a vec_id get null
as component; rows that repeat a vec_id are one vector with several forms; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import partitions, record_batch, saved
from fieldledger.llm.graph import components, hung

CELL = 64
RUN = 128
CROWD = 2048
MISS = 0.02
LIST = 12
ROUNDS = 4
FEW = 0.01
AUDIT = 256
RECALL = 0.97
TRIES = 4
BLOCK = 1024

_CELLS = pa.schema(
    [("cell", pa.int64()), ("at", pa.float64()), ("node", pa.int64())]
    + [("own", pa.int64()), ("n", pa.int64()), ("v", pa.binary())]
)
_CELLS_SQL = "cell long, at double, node long, own long, n long, v binary"
#: ``joined``: nodes that this one is linked with, directly or through others, of every run it was compared in.
_LISTS = pa.schema(
    [("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("cos", pa.list_(pa.float64())), ("ns", pa.list_(pa.int64()))]
    + [("joined", pa.list_(pa.int64()))]
)
_LISTS_SQL = "node long, ids array<long>, cos array<double>, ns array<long>, joined array<long>"


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of unit length from binary doubles; all rows of a batch have one length."""
    return np.array([np.frombuffer(v, np.float64) for v in column.to_pylist()])


def _unit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("vec_id", pa.int64()), ("size", pa.int32()), ("v", pa.binary())])
    for batch in batches:
        ids, sizes, out = [], [], []
        for i, row in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            x = np.array(row, np.float64)
            # Scaled first, so that squares of very large or small components stay finite.
            x = x / np.abs(x).max()
            ids.append(i)
            sizes.append(len(x))
            out.append((x / np.sqrt(x @ x)).tobytes())
        yield record_batch(schema, ids, sizes, out)


def units(rows: DataFrame) -> DataFrame:
    """vec_id, size and the unit vector (binary doubles) of the rows that can link."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    fit = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good & some)
    return fit.select("vec_id", "embedding").mapInArrow(_unit, "vec_id long, size int, v binary")


def _planes(size: int, bits: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, size])
    return rng.normal(size=(tables * bits, size)), rng.normal(size=(tables, size))


def _deal(batches: Iterable[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            x = _vectors(part.column("v"))
            planes, lines = _planes(int(size), bits, tables, seed)
            sides = (x @ planes.T > 0).reshape(len(x), tables, bits)
            code = sides @ (1 << np.arange(bits, dtype=np.int64))
            at = x @ lines.T
            for t in range(tables):
                cell = (code[:, t] * tables + t) * 65537 + int(size)
                yield record_batch(_CELLS, cell, at[:, t], *(part.column(c) for c in ("node", "own", "n", "v")))


def _best(node: int, ids: np.ndarray, cos: np.ndarray, ns: np.ndarray, most: int) -> tuple:
    ids, first = np.unique(ids, return_index=True)
    order = np.lexsort((ids, -cos[first]))[:most]
    return node, ids[order], cos[first][order], ns[first][order]


def _compare(
    ids: np.ndarray, own: np.ndarray, ns: np.ndarray, x: np.ndarray, threshold: float, least: float
) -> Iterator[tuple]:
    """For each node its nearest ones among those of another ``own``, and the node that its links here lead to."""
    cos = x @ x.T
    cos[own[:, None] == own[None, :]] = -2
    linked = np.nonzero(cos >= threshold)
    leads = hung(ids[linked[0]], ids[linked[1]]) if len(linked[0]) else ()
    root = dict(zip(*(c.tolist() for c in leads), strict=True)) if leads else {}
    for i in np.flatnonzero((cos >= least).any(axis=1)):
        near = np.flatnonzero(cos[i] >= least)
        node = int(ids[i])
        yield *_best(node, ids[near], cos[i, near], ns[near], LIST), [root[node]] if node in root else []


def _lists(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield record_batch(_LISTS, *zip(*rows, strict=True))


def _grouped(batches: Iterable[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[tuple]:
    """Consecutive rows of equal key as one table; a group of more than ``most`` rows comes in runs of that many
    that overlap by half."""
    held: list[dict] = []
    current, fresh = None, 0
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != current:
                if fresh:
                    yield current, held
                current, held, fresh = row[key], [], 0
            held.append(row)
            fresh += 1
            if most and len(held) == most:
                yield current, held
                held, fresh = held[most // 2 :], 0
    if fresh:
        yield current, held


def _columns(rows: list[dict], *names: str) -> list[np.ndarray]:
    return [np.array([r[n] for r in rows], np.int64) for n in names]


def _stack(rows: list[dict]) -> np.ndarray:
    return np.array([np.frombuffer(r["v"], np.float64) for r in rows])


def _start(batches: Iterable[pa.RecordBatch], threshold: float, least: float) -> Iterator[pa.RecordBatch]:
    for _, rows in _grouped(batches, "cell", RUN):
        if len(rows) > 1:
            yield from _lists(list(_compare(*_columns(rows, "node", "own", "n"), _stack(rows), threshold, least)))


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for node, rows in _grouped(batches, "node", 256):
        parts = [np.concatenate([np.array(r[c], t) for r in rows]) for c, t in (("ids", np.int64), ("cos", float), ("ns", np.int64))]
        joined = np.unique(np.concatenate([np.array(r["joined"], np.int64) for r in rows]))
        yield from _lists([(*_best(node, *parts, LIST), joined)])


def _merged(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One list per node, stored, and the links that the runs were joined by. A node found in very many places is
    first merged within what each task holds; its links leave it there."""
    parts = partitions(found.sparkSession)
    near = saved(found.sortWithinPartitions("node").mapInArrow(_merge, _LISTS_SQL), "found")
    joined = near.select(F.col("node").alias("a"), F.explode("joined").alias("b")).distinct()
    near = near.withColumn("joined", F.array().cast("array<long>"))
    near = near.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_merge, _LISTS_SQL)
    # Long runs of one node overlap and leave several lists; the last merge sees few of them.
    return saved(near.sortWithinPartitions("node").mapInArrow(_merge, _LISTS_SQL), "lists"), saved(joined, "joined")


def _round(batches: Iterable[pa.RecordBatch], threshold: float, least: float) -> Iterator[pa.RecordBatch]:
    for _, rows in _grouped(batches, "at", RUN):
        if len(rows) > 1:
            yield from _lists(list(_compare(*_columns(rows, "node", "own", "n"), _stack(rows), threshold, least)))


def _pairs(lists: DataFrame) -> DataFrame:
    return lists.select("node", F.explode(F.arrays_zip("ids", "cos", "ns")).alias("e")).select(
        "node", F.col("e.ids").alias("other"), F.col("e.cos").alias("cos"), F.col("e.ns").alias("n")
    )


def _tables(nodes: DataFrame, count: int, threshold: float, least: float, seed: int) -> DataFrame:
    """Lists of what the cells of one set of tables hold, not merged."""
    bits = max(1, round(math.log2(max(2, count / CELL))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    tables = max(2, math.ceil(math.log(MISS) / math.log(1 - meet)))
    dealt = nodes.mapInArrow(partial(_deal, bits=bits, tables=tables, seed=seed), _CELLS_SQL)
    crowded = (
        dealt.groupBy("cell").count().where(F.col("count") > CROWD)
        .select("cell", F.ceil(F.col("count") / F.lit(float(CROWD))).alias("parts"))
    )
    # Nodes of a crowded cell are dealt by their place along the projection, so that near ones stay together.
    salted = dealt.join(crowded, "cell", "left").withColumn(
        "salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.floor(F.col("at") * F.col("parts") * 8), F.col("parts")))
    )
    runs = (
        salted.repartition(partitions(nodes.sparkSession), "cell", "salt")
        .sortWithinPartitions("cell", "salt", "at", "node")
        .select("cell", "at", "node", "own", "n", "v")
    )
    return runs.mapInArrow(partial(_start, threshold=threshold, least=least), _LISTS_SQL)


def _descend(
    nodes: DataFrame, lists: DataFrame, threshold: float, least: float, known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """One round: members of a list (or of one in ``known``), and those that list the same node, learn of one another."""
    pairs = _pairs(lists if known is None else lists.unionByName(known)).select("node", "other")
    seen = pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other")))
    seen = seen.unionByName(lists.select("node", F.col("node").alias("other"))).distinct()
    meet = (
        seen.withColumnRenamed("node", "at")
        .join(nodes.select(F.col("node").alias("other"), "own", "n", "v"), "other")
        .select("at", F.col("other").alias("node"), "own", "n", "v")
        .repartition(partitions(nodes.sparkSession), "at")
        .sortWithinPartitions("at", F.xxhash64("node"))
    )
    found = meet.mapInArrow(partial(_round, threshold=threshold, least=least), _LISTS_SQL)
    return _merged(found.unionByName(lists))


def _across(
    nodes: DataFrame, lists: DataFrame, links: DataFrame, threshold: float, least: float, seed: int
) -> tuple[DataFrame, DataFrame]:
    """``links`` with those between their components that full lists hid, and the components of all. Such a link has a full list at
    both ends, so only these nodes search, and only for nodes of other components."""
    groups = saved(components(links), "groups")
    full = saved(
        nodes.drop("own").join(lists.where((F.size("ids") >= LIST) & (F.array_min("cos") >= threshold)).select("node"), "node"),
        "full",
    )
    near = saved(lists.join(full.select("node"), "node", "left_semi"), "lists")
    count = full.count()
    while count:
        apart = saved(full.join(groups.withColumnRenamed("component", "own"), "node"), "apart")
        if apart.select("own").distinct().limit(2).count() < 2:
            break
        other, fresh = _merged(_tables(apart, count, threshold, least, seed))
        reached = _reach(other)
        for _ in range(ROUNDS if reached else 0):
            other, more = _descend(apart, other, threshold, least, near)
            fresh = fresh.unionByName(more)
            before, reached = reached, _reach(other)
            if reached - before <= FEW * reached:
                break
        if fresh.isEmpty():
            break
        links = links.unionByName(fresh)
        groups = saved(components(links), "groups")
    return links, groups


def _reach(lists: DataFrame) -> float:
    return lists.agg(F.sum(F.aggregate("cos", F.lit(0.0), lambda a, c: a + c))).first()[0] or 0.0


def _links(lists: DataFrame, threshold: float) -> DataFrame:
    pairs = _pairs(lists).where(F.col("cos") >= threshold).select(F.col("node").alias("a"), F.col("other").alias("b"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _brute(batches: Iterable[pa.RecordBatch], ids: np.ndarray, x: list[np.ndarray], threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        own, sizes = batch.column("node").to_numpy(), batch.column("size").to_numpy()
        for i, v in zip(ids, x, strict=True):
            part = np.flatnonzero((sizes == len(v)) & (own != i))
            if len(part):
                rows = _vectors(batch.column("v").take(pa.array(part)))
                near = own[part][rows @ v >= threshold]
                if len(near):
                    yield record_batch(schema, np.full(len(near), i), near)


def audit(nodes: DataFrame, lists: DataFrame, groups: DataFrame, counts: DataFrame, threshold: float) -> float:
    """The share of the links of audited nodes that lie within one component of ``groups``, or that ``counts`` has of
    them, whichever is less."""
    listed = nodes.join(lists.select("node"), "node", "left_semi").select(nodes.columns)
    sample = [r for n in (nodes, listed) for r in n.orderBy(F.xxhash64("node"), "node").limit(AUDIT).collect()]
    vectors = {r["node"]: np.frombuffer(r["v"], np.float64) for r in sample if r["v"]}
    if not vectors:
        return 1.0
    ids = np.array(list(vectors))
    true = nodes.select("node", "size", "v").mapInArrow(
        partial(_brute, ids=ids, x=list(vectors.values()), threshold=threshold), "a long, b long"
    )
    for side in ("a", "b"):
        own = groups.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        true = true.join(own, side, "left")
    true = true.join(nodes.select(F.col("node").alias("b"), "n"), "b").groupBy("a").agg(
        F.count("*").alias("total"), F.count_if(F.col("ca") == F.col("cb")).alias("met"), F.sum("n").alias("links")
    )
    known = counts.select(F.col("node").alias("a"), F.coalesce("links", F.lit(0)).alias("counted"))
    total, met, links, counted = true.join(known, "a", "left").agg(
        F.sum("total"), F.sum("met"), F.sum("links"), F.sum(F.least("links", F.coalesce("counted", F.lit(0))))
    ).first()
    return min(met / total, counted / links) if total else 1.0


def _count(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between the nodes of two blocks of a component (or within one), summed per node."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64())])
    for _, rows in _grouped(batches, "pair"):
        sides = [[r for r in rows if r["side"] == s] for s in (0, 1)]
        if not sides[0]:
            continue
        x, ids, ns = _stack(sides[0]), *_columns(sides[0], "node", "n")
        if sides[1]:
            y, other, ms = _stack(sides[1]), *_columns(sides[1], "node", "n")
            near = (x @ y.T >= threshold) & (ids[:, None] != other[None, :])
            yield record_batch(schema, ids, near @ ms)
            yield record_batch(schema, other, ns @ near)
        else:
            near = (x @ x.T >= threshold) & (ids[:, None] != ids[None, :])
            yield record_batch(schema, ids, near @ ns)


def _counted(nodes: DataFrame, lists: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Links of each node, weighted by counts: from its list, or by blocks where its component has a full list."""
    held = _pairs(lists).where(F.col("cos") >= threshold).groupBy("node").agg(
        F.sum("n").alias("links"), F.count("*").alias("held")
    )
    held = groups.join(held, "node", "left")
    sizes = held.groupBy("component").agg(F.count("*").alias("size"), F.max("held").alias("most"))
    full = sizes.where(F.col("most") >= LIST).select("component", F.ceil(F.col("size") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    plain = held.join(full, "component", "left_anti").select("node", "links")
    blocked = (
        groups.join(full, "component")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "node",
            F.concat_ws("-", "component", F.least("block", "partner"), F.greatest("block", "partner")).alias("pair"),
            (F.col("block") > F.col("partner")).cast("int").alias("side"),
        )
        .join(nodes.select("node", "n", "v"), "node")
        .select("pair", "side", "node", "n", "v")
        .repartition(partitions(nodes.sparkSession), "pair")
        .sortWithinPartitions("pair")
    )
    dense = blocked.mapInArrow(partial(_count, threshold=threshold), "node long, links long")
    return plain.unionByName(dense).groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, threshold: float = 0.95, seed: int = 1) -> DataFrame:
    """vec_id, n_links (other vectors linked directly) and component_id of every row. Runs jobs while it is built."""
    least = 2 * threshold * threshold - 1
    vectors = saved(units(rows), "vectors")
    forms = saved(
        vectors.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("size").alias("size")),
        "nodes",
    )
    # A node's number is the smallest id of its rows; an id with several forms would be several nodes of one number.
    nodes = forms.withColumn("own", F.col("node"))
    count = nodes.count()
    lists, groups, links = None, None, None
    for attempt in range(TRIES):
        found = _tables(nodes, count, threshold, least, seed + attempt)
        lists, joined = _merged(found if lists is None else found.unionByName(lists))
        links = joined if links is None else links.unionByName(joined)
        known = _links(lists, threshold).count()
        for _ in range(ROUNDS):
            lists, joined = _descend(nodes, lists, threshold, least)
            links = links.unionByName(joined)
            before, known = known, _links(lists, threshold).count()
            if known - before <= FEW * known:
                break
        links, groups = _across(nodes, lists, links, threshold, least, seed + attempt)
        counts = saved(_counted(nodes, lists, groups, threshold), "counts")
        recall = audit(nodes, lists, groups, counts, threshold)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"{recall:.3f} of the audited links were found, less than {RECALL}")
    state = (
        nodes.join(groups, "node", "left")
        .join(counts, "node", "left")
        .select("v", "n", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    own = vectors.select("vec_id", "v").join(state, "v").groupBy("vec_id").agg(
        F.sum(F.col("n") - 1 + F.col("links")).alias("n_links"), F.min("component").alias("component_id")
    )
    return rows.select("vec_id").join(own, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
