"""KYC decisions, applied to the KYC table as a batch.

A decision is VERIFIED or REJECTED. Applying many at once gives what applying them one after the
other in the order of (decided_at, decision_id) would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.plans import lookup, needed

# What a VERIFIED decision overwrites, also with NULL; a REJECTED one leaves these alone.
DOCUMENTS = ("remarks", "nid_front_ref", "nid_back_ref", "land_dolil_ref", "land_legal_status")


def fold_decisions(decisions: DataFrame) -> DataFrame:
    """One row per farmer: the last decision, and the documents of the last VERIFIED one.

    Both begin with their moment and are maxima, so folds can be merged in any grouping and order, also with
    themselves: map-side, in the reducers, and over whatever a stream has written. ``documents`` is NULL where there was no VERIFIED decision,
    which differs from documents that are all NULL.
    """
    verified = F.col("decision") == "VERIFIED"
    return (
        decisions.where(F.col("decision").isin("VERIFIED", "REJECTED"))
        .groupBy("farmer_code")
        .agg(
            F.max(F.struct("decided_at", "decision_id", "decision", "person_id")).alias("last"),
            F.max(F.when(verified, F.struct("decided_at", "decision_id", *DOCUMENTS))).alias("documents"),
        )
    )


def _agent_of_person(field_agent: DataFrame) -> DataFrame:
    """The agent code of each person; using one for a person with several is an error."""
    return (
        field_agent.where(F.col("person_id").isNotNull())
        .groupBy("person_id")
        .agg(F.max("agent_code").alias("one_code"), F.count(F.lit(1)).alias("codes"))
    )


def decided(fold: DataFrame, field_agent: DataFrame) -> DataFrame:
    """What the fold makes of each farmer: the new state, its date, decision and agent code, and the new documents."""
    last = fold.where(F.col("farmer_code").isNotNull()).select(
        "farmer_code",
        F.col("last.decision").alias("new_state"),
        F.col("last.person_id").alias("person_id"),
        F.col("last.decided_at").alias("new_date"),
        F.col("last.decision_id").alias("decision_id"),
        "documents",
    )
    several = F.raise_error(F.concat(F.lit("several agent codes for person "), F.col("person_id").cast("string")))
    return lookup(last, _agent_of_person(field_agent), "person_id").select(
        "farmer_code",
        "new_state",
        "new_date",
        "decision_id",
        "documents",
        F.when(F.col("codes") > 1, several).otherwise(F.col("one_code")).alias("new_by"),
    )


def apply_fold(kyc: DataFrame, fold: DataFrame, field_agent: DataFrame) -> DataFrame:
    """The KYC table after the decisions in ``fold``; rows of undecided farmers stay as they are."""
    is_decided = F.col("new_state").isNotNull()
    has_documents = F.col("documents").isNotNull()
    changed = {
        "identity_verified": F.coalesce("new_state", "identity_verified"),
        "verified_by": F.when(is_decided, F.col("new_by")).otherwise(F.col("verified_by")),
        "verified_date": F.when(is_decided, F.col("new_date")).otherwise(F.col("verified_date")),
        **{c: F.when(has_documents, F.col(f"documents.{c}")).otherwise(F.col(c)) for c in DOCUMENTS},
    }
    rows = lookup(kyc, decided(fold, field_agent).drop("decision_id"), "farmer_code")
    return rows.select(*(changed.get(c, F.col(c)).alias(c) for c in kyc.columns))


def apply_kyc_decisions(kyc: DataFrame, decisions: DataFrame, field_agent: DataFrame) -> DataFrame:
    """The new version of the KYC table. Every KYC row of a decided farmer changes."""
    return apply_fold(kyc, fold_decisions(decisions), field_agent)


def unmatched_decisions(kyc: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on farmers without a KYC row; they have no effect."""
    codes = kyc.where(F.col("farmer_code").isNotNull()).select("farmer_code").distinct()
    known = needed(codes, decisions, "farmer_code").withColumn("known", F.lit(True))
    return (
        lookup(decisions, known, "farmer_code")
        .where(F.col("known").isNull())
        .select(*decisions.columns)
    )
