"""Output order, ranks and row numbers over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.plans.fragments import lookup
from fieldledger.session import cut

# Low bits of monotonically_increasing_id: the place of a row in its partition.
_ROW_BITS = 33


def present(
    df: DataFrame,
    key: str,
    scope: Any,
    columns: Sequence[Column | str],
    order: Sequence[Column],
    ordered: bool | None,
) -> DataFrame:
    """The output columns, led by ``key`` in the unscoped form, sorted if wanted.

    One agent's or center's list is sorted by default; the list of all is not, since it is written
    as a table. Sorting that too uses a range shuffle on the key and the order columns together, so
    a key with very many rows is spread over tasks.
    """
    scoped = scope is not None
    if ordered if ordered is not None else scoped:
        df = df.orderBy(*order) if scoped else df.orderBy(F.col(key), *order)
    return df.select(*columns) if scoped else df.select(F.col(key), *columns)


def numbered(df: DataFrame, order: Sequence[Column], number: str) -> DataFrame:
    """Add 1, 2, 3, … in ``order``, which must leave no ties.

    A range-partitioned sort gives every row its place in its partition; adding the sizes of the
    partitions before it, one row per partition, gives its place in the table. The sorted rows are
    cut off from their plan so that both uses see the same partitions.
    """
    placed = cut(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_place", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(number, F.col("_start") + place + 1)
        .drop("_part", "_place", "_start")
    )


def ranked(df: DataFrame, value: str, rank: str) -> DataFrame:
    """Add the descending rank of ``value``, with gaps: one more than the number of rows with a higher value.

    Only the distinct values are sorted and stored, each with its number of rows; sums over the values before one,
    within its range partition and over the partitions before, give its rank. Rows then look it up.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_size"))
    placed = cut(counts.orderBy(F.desc(value)).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftrightunsigned("_place", _ROW_BITS))
    sizes = placed.groupBy("_part").agg(F.sum("_size").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    above = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    number = F.col("_start") + F.coalesce(F.sum("_size").over(above), F.lit(0)) + 1
    firsts = placed.join(F.broadcast(starts), "_part").select(value, number.cast("int").alias(rank))
    return lookup(df, firsts, value)
