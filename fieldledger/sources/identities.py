"""The person behind each phone and username as a stored table, bucketed by that key.

Look-ups of a batch join it where it lies: only the batch is shuffled, to the buckets, not the persons. The table is made
once from PERSON and kept up with each registration (:func:`add_identities`), so no batch reads PERSON for its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldledger.operators.accounts import person_identities

SCHEMA = "identity STRING, person_id BIGINT"


def save_identities(person: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """Write the identities of all persons to ``path`` as the table ``table`` of the session's catalog, and open it.

    Choose as many buckets as reduce tasks a batch is to have."""
    rows = person_identities(person).repartition(buckets, "identity")
    writer = rows.write.format("parquet").mode("overwrite").option("path", path)
    writer.bucketBy(buckets, "identity").sortBy("identity").saveAsTable(table)
    return person.sparkSession.table(table)


def open_identities(spark: SparkSession, table: str, path: str, buckets: int = 64) -> DataFrame:
    """The table that another session has written to ``path``."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({SCHEMA}) USING parquet "
        f"CLUSTERED BY (identity) SORTED BY (identity) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def add_identities(persons: DataFrame, table: str) -> DataFrame:
    """Add the identities of new persons and open the table again. What it holds already stays, so a repeated call
    changes nothing; run one at a time."""
    spark = persons.sparkSession
    held = spark.table(table)
    new = person_identities(persons).join(held.select("identity"), "identity", "left_anti")
    new.select(*held.columns).write.insertInto(table)
    spark.catalog.refreshTable(table)
    return spark.table(table)
