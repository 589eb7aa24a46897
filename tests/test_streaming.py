"""Streams end where the batch ends, in any order and number of micro-batches."""

import random
from datetime import timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldledger import operators as op
from fieldledger.schemas import SCHEMAS
from fieldledger.sources import ManifestLog
from fieldledger.streaming import (
    apply_to_store,
    compact_folds,
    create_kyc_store,
    current_kyc,
    current_person,
    folds,
    latest_folds,
    live_folders,
    start_decision_folds,
    start_kyc_store,
    start_login_folds,
    stored_kyc,
)
from tests.test_writes import AGENTS, FIELD_AGENTS, START, as_dicts, attempt, decision, one_at_a_time, person, random_case


def files(spark, rows, ddl, folder, count):
    """The rows in shuffled order, spread over files that a stream reads one per micro-batch."""
    random.Random(count).shuffle(rows)
    columns = [f.name for f in spark.createDataFrame([], ddl).schema]
    for n in range(count):
        part = [tuple(r.get(c) for c in columns) for r in rows[n::count]]
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(folder)


def test_decision_stream_equals_one_at_a_time(spark, made, tmp_path):
    kyc, decisions = random_case(11)
    t = made(kyc=kyc, field_agent=FIELD_AGENTS)
    stream = files(spark, list(decisions), SCHEMAS["kyc_decision"], f"{tmp_path}/in", 4)
    query = start_decision_folds(stream, f"{tmp_path}/folds", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    batches = {r.batch_id for r in spark.read.parquet(f"{tmp_path}/folds").select("batch_id").distinct().collect()}
    assert len(batches) > 1
    got = current_kyc(t["kyc"], f"{tmp_path}/folds", t["field_agent"])
    assert as_dicts(got) == one_at_a_time(kyc, decisions, AGENTS)
    # Applying the folds to their own result changes nothing.
    again = current_kyc(got, f"{tmp_path}/folds", t["field_agent"])
    assert as_dicts(again) == as_dicts(got)


def test_decision_stream_goes_on_after_a_stop(spark, made, tmp_path):
    kyc, decisions = random_case(12)
    t = made(kyc=kyc, field_agent=FIELD_AGENTS)
    where = (f"{tmp_path}/folds", f"{tmp_path}/checkpoint")
    start_decision_folds(files(spark, decisions[:20], SCHEMAS["kyc_decision"], f"{tmp_path}/in", 2), *where).awaitTermination()
    start_decision_folds(files(spark, decisions[20:], SCHEMAS["kyc_decision"], f"{tmp_path}/in", 2), *where).awaitTermination()
    got = current_kyc(t["kyc"], where[0], t["field_agent"])
    assert as_dicts(got) == one_at_a_time(kyc, decisions, AGENTS)


def test_login_stream(spark, made, tmp_path):
    rng = random.Random(3)
    persons = [person(n, f"017{n:08d}", f"u{n}", last_login=START + timedelta(minutes=30)) for n in range(6)]
    attempts = [attempt(n, rng.choice([f"u{rng.randrange(8)}", f" 017{rng.randrange(8):08d}", " "]), rng.randrange(60))
                for n in range(60)]
    t = made(person=persons, login_event=attempts)
    stream = files(spark, list(attempts), SCHEMAS["login_event"], f"{tmp_path}/in", 3)
    start_login_folds(stream, f"{tmp_path}/folds", f"{tmp_path}/checkpoint").awaitTermination()
    got = current_person(t["person"], f"{tmp_path}/folds")
    assert as_dicts(got) == as_dicts(op.last_logins(t["person"], t["login_event"]))
    assert got.where(F.col("last_login") > START + timedelta(minutes=30)).count() > 0


def test_the_newest_fold_of_a_key_counts(spark, tmp_path):
    for batch, when in ((0, 1), (10, 3), (9, 2)):
        rows = [("username:a", START + timedelta(minutes=when))]
        spark.createDataFrame(rows, "identity STRING, login_at TIMESTAMP_NTZ").write.parquet(f"{tmp_path}/batch_id={batch}")
    got = latest_folds(spark, str(tmp_path), "identity").collect()
    assert [r.login_at for r in got] == [START + timedelta(minutes=3)]


def test_another_checkpoint_over_the_same_folder_loses_nothing(spark, made, tmp_path):
    kyc, decisions = random_case(13)
    t = made(kyc=kyc, field_agent=FIELD_AGENTS)
    ordered = sorted(decisions, key=lambda d: (d["decided_at"], d["decision_id"]))
    half = len(ordered) // 2
    for name, part, batches in (("a", ordered[:half], 3), ("b", ordered[half:], 1), ("c", ordered[:half], 1)):
        stream = files(spark, list(part), SCHEMAS["kyc_decision"], f"{tmp_path}/in-{name}", batches)
        start_decision_folds(stream, f"{tmp_path}/folds", f"{tmp_path}/checkpoint-{name}").awaitTermination()
    got = current_kyc(t["kyc"], f"{tmp_path}/folds", t["field_agent"])
    assert as_dicts(got) == one_at_a_time(kyc, decisions, AGENTS)


def test_compaction_between_batches(spark, made, tmp_path):
    kyc, decisions = random_case(14)
    t = made(kyc=kyc, field_agent=FIELD_AGENTS)
    checkpoint = f"{tmp_path}/checkpoint"
    files(spark, decisions[:20], SCHEMAS["kyc_decision"], f"{tmp_path}/in", 3)
    stream = spark.readStream.schema(SCHEMAS["kyc_decision"]).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start_decision_folds(stream, f"{tmp_path}/folds", checkpoint).awaitTermination()
    folder = compact_folds(spark, f"{tmp_path}/folds", "farmer_code", f"{tmp_path}/compact")
    assert spark.read.parquet(folder).select("batch_id", "run").distinct().count() == 1
    files(spark, decisions[20:], SCHEMAS["kyc_decision"], f"{tmp_path}/in", 2)
    start_decision_folds(stream, folder, checkpoint).awaitTermination()
    got = current_kyc(t["kyc"], folder, t["field_agent"])
    assert as_dicts(got) == one_at_a_time(kyc, decisions, AGENTS)


def test_the_streams_keep_no_state(spark, made, tmp_path):
    kyc, decisions = random_case(15)
    stream = files(spark, list(decisions), SCHEMAS["kyc_decision"], f"{tmp_path}/in", 2)
    query = start_decision_folds(stream, f"{tmp_path}/folds", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert len(query.recentProgress) >= 2 and all(not p.stateOperators for p in query.recentProgress)
    assert not (tmp_path / "checkpoint" / "state").exists()


def test_a_thousand_batches_leave_few_folders():
    live, written = [], 0
    for batch in range(1000):
        live.append([f"b{batch}", 0])
        last = None
        for number, (folders, tier) in enumerate(folds.merges(live, 8)):
            folders = [last if f is None else f for f in folders]
            assert len(folders) == 8
            last = f"m{batch}-{number}"
            written += 8**tier
            live = [e for e in live if e[0] not in folders] + [[last, tier]]
        assert len(live) <= 7 * 4
    # Each batch was rewritten once a tier at most.
    assert written <= 1000 * 3


def test_merging_while_the_stream_runs(spark, made, tmp_path, monkeypatch):
    monkeypatch.setattr(folds, "FAN", 3)
    kyc, decisions = random_case(16)
    t = made(kyc=kyc, field_agent=FIELD_AGENTS)
    stream = files(spark, list(decisions), SCHEMAS["kyc_decision"], f"{tmp_path}/in", 10)
    query = start_decision_folds(stream, f"{tmp_path}/folds", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    live = live_folders(spark, f"{tmp_path}/folds")
    # Ten batches: one of nine and one of one.
    assert len(live) == 2 and any(f.startswith("merged=") for f in live)
    got = current_kyc(t["kyc"], f"{tmp_path}/folds", t["field_agent"])
    assert as_dicts(got) == one_at_a_time(kyc, decisions, AGENTS)
    # A batch that is repeated is not listed again.
    log = ManifestLog(spark, f"{tmp_path}/folds")
    version, content = log.latest()
    (run, last), = content["runs"].items()
    folds.add_fold(latest_folds(spark, f"{tmp_path}/folds", "farmer_code"), f"{tmp_path}/folds", "farmer_code", run, last)
    assert log.latest() == (version, content)


def parts_of(rows, count, seed):
    random.Random(seed).shuffle(rows)
    return [rows[n::count] for n in range(count)]


def test_decisions_reach_the_stored_table(spark, made, tmp_path):
    kyc, decisions = random_case(17)
    kyc.append({"kyc_id": 99, "farmer_code": None, "identity_verified": "PENDING"})
    t = made(kyc=kyc, field_agent=FIELD_AGENTS)
    base = f"{tmp_path}/kyc"
    create_kyc_store(t["kyc"], base, buckets=16)
    assert as_dicts(stored_kyc(spark, base)) == as_dicts(t["kyc"])
    for number, part in enumerate(parts_of(list(decisions), 4, 1)):
        before = as_dicts(stored_kyc(spark, base))
        apply_to_store(made(kyc_decision=part)["kyc_decision"], base, t["field_agent"], "run", number)
        assert as_dicts(stored_kyc(spark, base, number + 1)) == before
    want = one_at_a_time(kyc, decisions, AGENTS)
    assert as_dicts(stored_kyc(spark, base)) == want
    # Repeated batches, known or not, change nothing.
    assert apply_to_store(made(kyc_decision=part)["kyc_decision"], base, t["field_agent"], "run", 3) == []
    apply_to_store(made(kyc_decision=part)["kyc_decision"], base, t["field_agent"])
    assert as_dicts(stored_kyc(spark, base)) == want


def test_a_batch_rewrites_only_its_farmers(spark, made, tmp_path):
    kyc = [{"kyc_id": n, "farmer_code": f"F{n % 40}"} for n in range(200)]
    t = made(kyc=kyc, field_agent=FIELD_AGENTS)
    base = f"{tmp_path}/kyc"
    create_kyc_store(t["kyc"], base, buckets=64)
    log = ManifestLog(spark, base)
    before = log.latest()[1]["folders"]
    batch = made(kyc_decision=[decision(1, "F7", "VERIFIED", 1), decision(2, "F9", "REJECTED", 2), decision(3, "none", "VERIFIED", 2)])
    new = apply_to_store(batch["kyc_decision"], base, t["field_agent"])
    after = log.latest()[1]["folders"]
    assert 1 <= len(new) <= 3 and sum(before[b] != after[b] for b in before) == len(new)
    assert spark.read.parquet(*(f"{base}/{f}" for f in new)).where("farmer_code in ('F7', 'F9')").count() == 10
    assert stored_kyc(spark, base).where("identity_verified is not null").count() == 10
    # A batch that dies leaves the table as it was.
    broken = batch["kyc_decision"].withColumn("remarks", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(PySparkException, match="killed"):
        apply_to_store(broken, base, t["field_agent"])
    assert log.latest()[1]["folders"] == after


def test_stream_into_the_stored_table(spark, made, tmp_path):
    kyc, decisions = random_case(18)
    t = made(kyc=kyc, field_agent=FIELD_AGENTS)
    base = f"{tmp_path}/kyc"
    create_kyc_store(t["kyc"], base, buckets=4)
    for half in (decisions[20:], decisions[:20]):
        stream = files(spark, list(half), SCHEMAS["kyc_decision"], f"{tmp_path}/in", 2)
        query = start_kyc_store(stream, base, t["field_agent"], f"{tmp_path}/checkpoint")
        query.awaitTermination()
    assert not query.lastProgress.stateOperators
    assert as_dicts(stored_kyc(spark, base)) == one_at_a_time(kyc, decisions, AGENTS)
