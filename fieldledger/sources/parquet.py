"""Parquet tables, read with a fixed schema and written as numbered versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldledger.functions.text import blank_to_null
from fieldledger.schemas import SCHEMAS
from fieldledger.sources.tables import Tables


def table_path(base: str, name: str, version: int | None = None) -> str:
    path = f"{base.rstrip('/')}/{name}"
    return path if version is None else f"{path}/version={version}"


def parquet_tables(
    spark: SparkSession, base: str, versions: Mapping[str, int] | None = None, blank_is_null: bool = False
) -> Tables:
    """All tables below ``base``; ``versions`` picks a version where a table has several.

    ``blank_is_null`` reads empty text as NULL, for tables that :func:`write_table` has not written."""
    versions = versions or {}

    def opener(name: str):
        def read() -> DataFrame:
            df = spark.read.schema(SCHEMAS[name]).parquet(table_path(base, name, versions.get(name)))
            return _empty_text_to_null(df) if blank_is_null else df

        return read

    return Tables({name: opener(name) for name in SCHEMAS})


def _empty_text_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *(
            blank_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        )
    )


def store(df: DataFrame, path: str, cluster_by: Sequence[str] = ()) -> None:
    """Write rows with empty text as NULL, so that filters on the stored columns still reach the Parquet scan.

    ``cluster_by`` sorts by those columns, with range partitions, so that files have narrow value ranges; give enough
    columns to be nearly unique, then a frequent first value is spread over many files."""
    stored = _empty_text_to_null(df)
    if cluster_by:
        stored = stored.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    stored.write.mode("overwrite").parquet(path)


def write_table(
    df: DataFrame,
    base: str,
    name: str,
    version: int | None = None,
    cluster_by: Sequence[str] = (),
) -> str:
    """:func:`store` one table version and return its path. Several tables that belong together are published
    as one version by :func:`fieldledger.sources.manifest.publish`."""
    path = table_path(base, name, version)
    store(df, path, cluster_by)
    return path
