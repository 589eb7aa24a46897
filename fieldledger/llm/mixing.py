"""Mix sources to target weights: exact block quotas per output shard from a hypergeometric splitting tree.

1. Sizes. A document's size is its number of words. Sources are ranked by code point, null last; their weights
   share all words, no target above ``most`` times its source's size (the excess goes to the others by weight).
2. Passes. A source is taken ``floor(target / size)`` times in whole and once in part. Documents stand in a
   random but fixed order (a hash); the part is the start of that order up to the cell in which the target lies,
   and within that cell each next document that still fits, then the smallest one if that comes nearer.
3. Blocks. The order is cut into blocks of about equal words; each pass over a block is a unit. Units of a source
   are permuted (an affine map).
4. Tree. All units go to the shards in equal numbers. At each node of a binary tree over the shards the units of
   every source are split by a multivariate hypergeometric draw, seeded by the node, so every shard finds its own
   quotas by walking from the root; shards get consecutive ranges of the permuted units, so no unit goes twice.
5. Shuffle. Within a shard documents are sorted by a hash of document and pass.

What is broadcast is bounded: one row per source (at most ``MOST_SOURCES``, more is an error: a mix names its
sources) and one per unit (blocks grow with the input so that there are about ``MOST_BLOCKS`` at most).

Cases: a null text has size 0; documents of size 0 go with their block and add no words; rows that repeat both
doc_id and text are taken together; an empty table gives an empty mix; other columns are passed through.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.llm.common import partitions, record_batch, saved

WORD = r"[^\x20\x09-\x0D]+"
MOST_SOURCES = 100_000
MOST_BLOCKS = 1 << 20
BLOCK_WORDS = 100_000
BLOCK_DOCUMENTS = 100_000
# Documents of a source that its partial pass decides one by one: about CELL_DOCUMENTS, in at most MOST_CELLS cells.
CELL_DOCUMENTS = 512
MOST_CELLS = 4096
_BITS = 40


@dataclass(frozen=True)
class Plan:
    """``sources`` has one row per source, ``units`` one per unit with its shard."""

    sources: DataFrame
    units: DataFrame
    shards: int
    seed: int


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``most`` times its size."""
    out = [0.0] * len(sizes)
    rest, free = float(sum(sizes)), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        each = rest / sum(weights[i] for i in free)
        over = [i for i in free if each * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = each * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            rest -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as a struct, so that none of its names meets one used here, with its key, source and size."""
    return docs.select(
        F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"),
        F.xxhash64("doc_id", "source", "text").alias("key"),
        "source",
        word_count(F.col("text")).alias("size"),
    )


def _spot(seed: int) -> Column:
    """A document's place in the random order of its source, a whole number below 2**40."""
    return F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 64 - _BITS)


def _part(spot: Column, parts: str) -> Column:
    """The number of the part of the order, of ``parts`` equal ones, that a place lies in."""
    return F.shiftright(spot * F.col(parts), _BITS)


def _fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the cells in question by source and place: where the part ends and what is picked after that."""
    schema = pa.schema([("_rank", pa.int32()), ("_until", pa.int64()), ("_picks", pa.list_(pa.int64()))])
    rank = until = spot = None
    room = size = 0
    picks: list[int] = []
    least: tuple[int, int] | None = None

    def settle() -> None:
        nonlocal until, room, least
        if spot is None:
            return
        if size <= room:
            room -= size
            if until is not None and size:
                picks.append(spot)
        else:
            until = spot if until is None else until
            least = min(least or (size, spot), (size, spot))

    def row() -> pa.RecordBatch:
        if least and abs(room - least[0]) < room:
            picks.append(least[1])
        return record_batch(schema, [rank], [(1 << _BITS) if until is None else until], [picks])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("_rank", "_spot", "_size", "_room"))
        for r, p, s, most in zip(*columns, strict=True):
            if r == rank and p == spot:
                size += s
                continue
            settle()
            if r != rank:
                if rank is not None:
                    yield row()
                rank, until, room, picks, least = r, None, most, [], None
            spot, size = p, s
    settle()
    if rank is not None:
        yield row()


def quotas(counts: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First unit and number of units of each source that ``shard`` gets, by the walk from the root."""
    first, counts = np.zeros_like(counts), counts.copy()
    low, high, node = 0, shards, 1
    while high - low > 1:
        middle = (low + high) // 2
        total = int(counts.sum())
        left = total * (middle - low) // (high - low)
        draw = np.random.default_rng([seed, node]).multivariate_hypergeometric(counts, left, method="marginals")
        if shard < middle:
            counts, high, node = draw, middle, 2 * node
        else:
            first, counts, low, node = first + draw, counts - draw, middle, 2 * node + 1
    return first, counts


def _shard_units(batches: Iterable[pa.RecordBatch], counts: np.ndarray, shards: int, seed: int):
    schema = pa.schema([("_rank", pa.int32()), ("_turn", pa.int64()), ("_shard", pa.int32())])
    for batch in batches:
        for shard in batch.column(0).to_pylist():
            first, number = quotas(counts, shards, shard, seed)
            turn = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)
            ranks = np.repeat(np.arange(len(counts), dtype=np.int32), number)
            yield record_batch(schema, ranks, turn, np.full(len(ranks), shard, np.int32))


def plan(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, shards: int | None = None, seed: int = 1
) -> Plan:
    """What a mix of ``docs`` takes from each source, and the shard of each unit. Runs three small jobs."""
    spark = docs.sparkSession
    shards = shards or max(1, partitions(spark))
    sized = saved(_keyed(docs.select("doc_id", "source", "text")).select("source", "key", "size"), "mix-sizes")
    found = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
        .orderBy(F.asc_nulls_last("source"))
        .limit(MOST_SOURCES + 1)
        .collect()
    )
    if len(found) > MOST_SOURCES:
        raise ValueError(f"a mix has at most {MOST_SOURCES} sources")
    sizes = [r["size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    words = max(BLOCK_WORDS, math.ceil(sum(sizes) * most / MOST_BLOCKS))
    documents = max(BLOCK_DOCUMENTS, math.ceil(sum(r["docs"] for r in found) * most / MOST_BLOCKS))
    rows = []
    for rank, (r, target) in enumerate(zip(found, goal, strict=True)):
        size = r["size"]
        passes = min(math.floor(target / size), math.floor(most)) if size else 0
        room = round(target - passes * size)
        if size and room >= size:
            passes, room = passes + 1, 0
        cells = min(MOST_CELLS, max(1, r["docs"] // CELL_DOCUMENTS))
        blocks = max(1, math.ceil(size / words), math.ceil(r["docs"] / documents))
        rows.append((rank, r["source"], size, target, passes, room, cells, blocks))
    sources = spark.createDataFrame(
        rows,
        "_rank int, _name string, source_size long, target double, _passes int, _room long, _cells int, _blocks int",
    )
    # The cell of each source in which its part ends: a running sum over at most MOST_CELLS rows per source.
    placed = (
        sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_name")))
        .withColumn("_spot", _spot(seed))
        .withColumn("_cell", _part(F.col("_spot"), "_cells"))
        .where("_room > 0")
    )
    cells = placed.groupBy("_rank", "_room", "_cell").agg(F.sum("size").alias("_words"))
    upto = F.sum("_words").over(Window.partitionBy("_rank").orderBy("_cell"))
    last = (
        cells.withColumn("_upto", upto)
        .where("_upto >= _room and _upto - _words < _room")
        .select("_rank", "_cell", (F.col("_room") - F.col("_upto") + F.col("_words")).alias("_room"))
    )
    cut = (
        placed.drop("_room")
        .join(F.broadcast(last), ["_rank", "_cell"])
        .select("_rank", "_spot", F.col("size").alias("_size"), "_room")
        .repartition("_rank")
        .sortWithinPartitions("_rank", "_spot", "_size")
        .mapInArrow(_fill, "_rank int, _until long, _picks array<long>")
    )
    ends = {
        r["_rank"]: (min(r["_until"], -(-(r["_cell"] + 1) * (1 << _BITS) // rows[r["_rank"]][6])), r["_picks"])
        for r in cut.join(last.select("_rank", "_cell"), "_rank").collect()
    }
    full, counts = [], []
    for rank, name, size, target, passes, room, _, blocks in rows:
        until, picks = ends.get(rank, (0, [])) if room else (0, [])
        highest = max([until, *(p + 1 for p in picks)])
        partial_blocks = min(blocks, math.ceil(highest * blocks / (1 << _BITS)))
        units = passes * blocks + partial_blocks
        rng = np.random.default_rng([seed, rank])
        step = int(rng.integers(1, max(2, units)))
        while units and math.gcd(step, units) != 1:
            step += 1
        full.append((rank, name, size, target, passes, until, picks, blocks, units, step, int(rng.integers(0, units + 1))))
        counts.append(units)
    sources = spark.createDataFrame(
        full,
        "_rank int, _name string, source_size long, target double, _passes int, _until long, _picks array<long>, "
        "_blocks int, _units long, _step long, _shift long",
    )
    units = spark.range(0, shards, 1, min(shards, partitions(spark))).mapInArrow(
        partial(_shard_units, counts=np.array(counts, np.int64), shards=shards, seed=seed),
        "_rank int, _turn long, _shard int",
    )
    return Plan(sources, units, shards, seed)


def weighed(docs: DataFrame, plan: Plan) -> DataFrame:
    """Every document as ``row`` with ``key``, ``size``, ``source_size``, ``target`` and ``copies``, the times the mix
    takes it."""
    spot = _spot(plan.seed)
    more = ((spot < F.col("_until")) | F.array_contains("_picks", spot)).cast("int")
    return (
        _keyed(docs)
        .join(F.broadcast(plan.sources), F.col("source").eqNullSafe(F.col("_name")))
        .withColumn("copies", F.col("_passes") + more)
    )


def draw(docs: DataFrame, plan: Plan) -> DataFrame:
    """The mix: ``row`` (all columns of ``docs``), ``key``, ``pass`` and ``shard``, one row per copy. Rows are dealt to
    shards and shuffled within them."""
    block = _part(_spot(plan.seed), "_blocks")
    turn = F.pmod((F.col("pass") * F.col("_blocks") + block) * F.col("_step") + F.col("_shift"), F.col("_units"))
    copies = (
        weighed(docs, plan)
        .where("copies > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .withColumn("_turn", turn)
        .join(F.broadcast(plan.units), ["_rank", "_turn"])
    )
    shuffled = F.xxhash64("key", "pass", F.lit(plan.seed + 1))
    return (
        copies.select("row", "key", "pass", F.col("_shard").alias("shard"))
        .repartition(plan.shards, "shard")
        .sortWithinPartitions("shard", shuffled)
    )
