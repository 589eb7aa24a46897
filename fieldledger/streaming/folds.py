"""Running folds of decision and login streams.

Each micro-batch is folded by itself and written to ``run=<query id>/batch_id=<n>`` of a Parquet folder. Folds are maxima
that begin with their moment: they are merged by maximum when they are read, so late, reordered or repeated events
change nothing, no watermark is needed for a right answer, and the stream keeps no state.

A list of the live folders (:class:`~fieldledger.sources.manifest.ManifestLog`) is published with each batch. When a
tier has :data:`FAN` folders they are merged into one of the next tier, in the batch that fills it, so after n batches
readers open at most ``FAN - 1`` folders of each of ``log(n)`` tiers, and each fold is rewritten once a tier. The
list also names the last batch of each run: a batch that is repeated after a failure is not added again.
Folders that were merged stay for readers that began before, as long as the last lists do.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldledger.operators.accounts import apply_last_login, fold_logins, persons_of_folds
from fieldledger.operators.kyc import apply_fold, fold_decisions
from fieldledger.sources.manifest import ManifestLog, PublishConflict

#: Folders of one tier that are merged into one of the next.
FAN = 8


def start_batches(
    rows: DataFrame, checkpoint: str, trigger: dict | None, write: Callable[[DataFrame, str, int], None]
) -> StreamingQuery:
    """Start a stream without state that hands each batch to ``write`` with the query id and the batch number."""
    run: list[str] = []
    named = threading.Event()

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        named.wait()
        write(batch, run[0], batch_id)

    query = (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write_batch)
        .start()
    )
    # The id is kept in the checkpoint: the same after a restart, another one with another checkpoint.
    run.append(query.id)
    named.set()
    return query


def _merged(folds: DataFrame, key: str) -> DataFrame:
    values = [c for c in folds.columns if c not in (key, "run", "batch_id")]
    return folds.groupBy(key).agg(*(F.max(c).alias(c) for c in values))


def _read(spark: SparkSession, base: str, folders: list[str]) -> DataFrame:
    # One after another: their names would make columns if they were read together.
    return reduce(DataFrame.unionByName, (spark.read.parquet(f"{base}/{f}") for f in folders))


def merges(live: list[list], fan: int) -> list[tuple[list[str], int]]:
    """What is to be merged, from the lowest tier up: folders, and the tier of the folder that they become.

    ``live`` has (folder, tier); None stands for the folder of the merge before."""
    out: list[tuple[list[str], int]] = []
    tier, carried = 0, []
    while True:
        folders = [f for f, t in live if t == tier] + carried
        if len(folders) < fan:
            return out
        out.append((folders, tier + 1))
        tier, carried = tier + 1, [None]


def add_fold(folded: DataFrame, folder: str, key: str, run: str, batch: int, fan: int = 0) -> None:
    """Write the fold of one batch and list it, with what becomes of a tier that it fills; a known batch is left out."""
    spark, fan = folded.sparkSession, fan or FAN
    log = ManifestLog(spark, folder)
    if log.latest()[1].get("runs", {}).get(run, -1) >= batch:
        return
    name = f"run={run}/batch_id={batch}"
    folded.write.mode("overwrite").parquet(f"{log.base}/{name}")
    while True:
        version, content = log.latest()
        live = [*content.get("live", []), [name, 0]]
        retired: list[str] = []
        last = None
        for folders, tier in merges(live, fan):
            folders = [last if f is None else f for f in folders]
            last = f"merged={uuid.uuid4().hex}"
            _merged(_read(spark, log.base, folders), key).write.parquet(f"{log.base}/{last}")
            live = [entry for entry in live if entry[0] not in folders] + [[last, tier]]
            retired += folders
        try:
            log.commit(version + 1, {**content, "live": live, "runs": content.get("runs", {}) | {run: batch}}, retired)
            return
        except PublishConflict:
            # Another stream writes here too. What was merged for nothing is not listed, and goes with nobody.
            continue


def start_decision_folds(
    decisions: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Fold a stream of KYC decisions, batch by batch."""

    def write(batch: DataFrame, run: str, number: int) -> None:
        add_fold(fold_decisions(batch), folder, "farmer_code", run, number)

    return start_batches(decisions, checkpoint, trigger, write)


def start_login_folds(
    attempts: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Fold a stream of successful logins, batch by batch."""

    def write(batch: DataFrame, run: str, number: int) -> None:
        add_fold(fold_logins(batch), folder, "identity", run, number)

    return start_batches(attempts, checkpoint, trigger, write)


def live_folders(spark: SparkSession, folder: str) -> list[str]:
    """The folders that a reader opens now."""
    return [f for f, _ in ManifestLog(spark, folder).latest()[1].get("live", [])]


def latest_folds(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The fold of each key over all that was written so far: the maximum of each value.

    A folder without a list is read whole."""
    live = live_folders(spark, folder)
    return _merged(_read(spark, folder.rstrip("/"), live) if live else spark.read.parquet(folder), key)


def compact_folds(spark: SparkSession, folder: str, key: str, into: str) -> str:
    """Write the merged folds of ``folder`` as the first run of the new folder ``into`` and return it.

    Streams merge their folders themselves; this makes a copy that is one folder, for a stream that was stopped and goes
    on there with the same checkpoint."""
    add_fold(latest_folds(spark, folder, key), into, key, "compacted", 0)
    return into


def current_kyc(kyc: DataFrame, folder: str, field_agent: DataFrame) -> DataFrame:
    """The KYC table with all streamed decisions applied."""
    return apply_fold(kyc, latest_folds(kyc.sparkSession, folder, "farmer_code"), field_agent)


def current_person(person: DataFrame, folder: str, identities: DataFrame | None = None) -> DataFrame:
    """The person table with all streamed logins applied."""
    folds = latest_folds(person.sparkSession, folder, "identity")
    return apply_last_login(person, persons_of_folds(folds, person, identities))
