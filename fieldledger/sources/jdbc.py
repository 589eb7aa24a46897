"""Tables read from a live database over JDBC, each in parallel ranges of a numeric key."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldledger.functions.text import blank_to_null
from fieldledger.schemas import SCHEMAS
from fieldledger.sources.tables import Tables


class KeyRange(NamedTuple):
    """Split a read on ``column`` between ``low`` and ``high`` into ``parts`` queries."""

    column: str
    low: int
    high: int
    parts: int


def read_options(
    url: str, table: str, options: Mapping[str, str] | None = None, split: KeyRange | None = None
) -> dict[str, str]:
    chosen = {"url": url, "dbtable": table, "fetchsize": "10000", **(options or {})}
    if split:
        chosen |= {
            "partitionColumn": split.column,
            "lowerBound": str(split.low),
            "upperBound": str(split.high),
            "numPartitions": str(split.parts),
        }
    return chosen


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns in schema order and type, matched by name without regard to case; '' becomes NULL."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([], ddl).schema
    present = {c.lower(): c for c in df.columns}
    return df.select(
        *(
            (
                blank_to_null(F.col(present[f.name]).cast(f.dataType))
                if isinstance(f.dataType, T.StringType)
                else F.col(present[f.name]).cast(f.dataType)
            ).alias(f.name)
            for f in wanted.fields
        )
    )


def jdbc_tables(
    spark: SparkSession,
    url: str,
    physical_names: Mapping[str, str] | None = None,
    splits: Mapping[str, KeyRange] | None = None,
    options: Mapping[str, str] | None = None,
) -> Tables:
    """All tables of a database; a table is read only when an operator asks for it.

    ``physical_names`` gives the name in the database where it is not the upper-case table name.
    A table without an entry in ``splits`` is read by one query, so give one for every large table.
    """
    physical_names = physical_names or {}
    splits = splits or {}

    def opener(name: str):
        chosen = read_options(url, physical_names.get(name, name.upper()), options, splits.get(name))
        return lambda: conform(spark.read.format("jdbc").options(**chosen).load(), SCHEMAS[name])

    return Tables({name: opener(name) for name in SCHEMAS})
