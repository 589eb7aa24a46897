"""A KYC table that decisions reach as they come: each batch rewrites only the parts with farmers that it decides on.

The table lies in ``buckets`` folders by a hash of the farmer code. Rows also hold the moments of the last decision and of the
last VERIFIED one that reached them, so a batch may come late, twice or out of order and the table ends where
applying all decisions at once would (:func:`~fieldledger.operators.kyc.apply_kyc_decisions`). A batch reads the
buckets of its farmers, writes them anew beside the old ones and publishes the list of folders in one step
(:class:`~fieldledger.sources.manifest.ManifestLog`): a reader sees a batch whole or not at all, and a batch
that dies leaves the table as it was. (Overwriting the folders in place would drop a folder before
its successor is there.) The list names the last batch of each stream, so a repeated one is known.

A batch of more farmers than there are buckets touches all of them: choose more buckets than a batch has farmers,
or fewer batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fieldledger.operators.kyc import DOCUMENTS, decided, fold_decisions
from fieldledger.plans import lookup
from fieldledger.schemas import SCHEMAS
from fieldledger.session import stored
from fieldledger.sources.manifest import ManifestLog, PublishConflict
from fieldledger.streaming.folds import start_batches

_MOMENT = "struct<decided_at: timestamp_ntz, decision_id: bigint>"
_STORED = f"{SCHEMAS['kyc']}, _last {_MOMENT}, _verified {_MOMENT}"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("farmer_code"), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, log: ManifestLog, buckets: int) -> str:
    """Write rows by bucket and return the folder. Every task writes the rows it has to their buckets; none is shuffled for it."""
    folder = f"stage={uuid.uuid4().hex}"
    rows.withColumn("bucket", _bucket(buckets)).write.partitionBy("bucket").parquet(f"{log.base}/{folder}")
    return folder


def create_kyc_store(kyc: DataFrame, base: str, buckets: int = 64) -> None:
    """Lay the KYC table out below ``base``."""
    log = ManifestLog(kyc.sparkSession, base)
    moment = F.lit(None).cast(_MOMENT)
    rows = kyc.select("*", moment.alias("_last"), moment.alias("_verified")).repartition(_bucket(buckets), "kyc_id")
    folder = _write(rows, log, buckets)
    found = rows.select(_bucket(buckets).alias("bucket")).distinct().collect()
    log.commit(1, {"buckets": buckets, "folders": {str(r.bucket): f"{folder}/bucket={r.bucket}" for r in found}, "runs": {}})


def _rows(spark: SparkSession, log: ManifestLog, folders: list[str]) -> DataFrame:
    schema = T.StructType.fromDDL(_STORED)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{log.base}/{f}" for f in folders))


def stored_kyc(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The KYC table as of the current version, or of one of the last before it."""
    log = ManifestLog(spark, base)
    content = log.latest()[1] if version is None else log.read(version)
    return _rows(spark, log, list(content["folders"].values())).drop("_last", "_verified")


def _advanced(rows: DataFrame, fold: DataFrame, field_agent: DataFrame) -> DataFrame:
    """Rows after the decisions of ``fold`` that are later than what reached them before."""
    found = decided(fold, field_agent).select("*", F.struct("new_date", "decision_id").alias("new_last"))
    found = found.withColumn("new_last", F.col("new_last").cast(_MOMENT))
    joined = lookup(rows, found, "farmer_code")
    verified = F.struct("documents.decided_at", "documents.decision_id").cast(_MOMENT)
    is_later = F.col("new_state").isNotNull() & (F.col("_last").isNull() | (F.col("new_last") > F.col("_last")))
    has_later = F.col("documents").isNotNull() & (F.col("_verified").isNull() | (verified > F.col("_verified")))
    changed = {
        "identity_verified": F.when(is_later, F.col("new_state")).otherwise(F.col("identity_verified")),
        "verified_by": F.when(is_later, F.col("new_by")).otherwise(F.col("verified_by")),
        "verified_date": F.when(is_later, F.col("new_date")).otherwise(F.col("verified_date")),
        "_last": F.when(is_later, F.col("new_last")).otherwise(F.col("_last")),
        "_verified": F.when(has_later, verified).otherwise(F.col("_verified")),
        **{c: F.when(has_later, F.col(f"documents.{c}")).otherwise(F.col(c)) for c in DOCUMENTS},
    }
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in rows.columns))


def apply_to_store(
    decisions: DataFrame, base: str, field_agent: DataFrame, run: str | None = None, batch: int | None = None
) -> list[str]:
    """Apply decisions to the stored table and return the folders that were written anew.

    With ``run`` and ``batch``, a batch of that run that was applied before is left out."""
    spark = decisions.sparkSession
    log = ManifestLog(spark, base)
    version, content = log.latest()
    if run is not None and content["runs"].get(run, -1) >= batch:
        return []
    fold = stored(fold_decisions(decisions).where(F.col("farmer_code").isNotNull()), "decisions")
    touched = [str(r.bucket) for r in fold.select(_bucket(content["buckets"]).alias("bucket")).distinct().collect()]
    while True:
        if run is not None and content["runs"].get(run, -1) >= batch:
            return []
        old = {b: content["folders"][b] for b in touched if b in content["folders"]}
        new: dict[str, str] = {}
        if old:
            rows = _advanced(_rows(spark, log, list(old.values())), fold, field_agent)
            folder = _write(rows, log, content["buckets"])
            new = {b: f"{folder}/bucket={b}" for b in old}
        runs = content["runs"] | ({} if run is None else {run: batch})
        try:
            log.commit(version + 1, {**content, "folders": content["folders"] | new, "runs": runs}, old.values())
            return list(new.values())
        except PublishConflict:
            version, content = log.latest()


def start_kyc_store(
    decisions: DataFrame, base: str, field_agent: DataFrame, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Apply a stream of decisions to the stored table, batch by batch."""

    def write(batch: DataFrame, run: str, number: int) -> None:
        apply_to_store(batch, base, field_agent, run, number)

    return start_batches(decisions, checkpoint, trigger, write)
