"""Where tables come from and where new versions go."""

from fieldledger.sources.jdbc import jdbc_tables
from fieldledger.sources.manifest import (
    ManifestLog,
    PublishConflict,
    publish,
    published_tables,
    published_version,
)
from fieldledger.sources.parquet import parquet_tables, table_path, write_table
from fieldledger.sources.star import star_tables
from fieldledger.sources.tables import Tables

__all__ = [
    "ManifestLog",
    "PublishConflict",
    "Tables",
    "jdbc_tables",
    "parquet_tables",
    "publish",
    "published_tables",
    "published_version",
    "star_tables",
    "table_path",
    "write_table",
]
