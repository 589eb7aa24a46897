"""Joins and pre-aggregations used by more than one operator.

A farmer, an agent or a center may own a large share of a table. So counts are aggregated before
they are joined (the map side collapses a frequent key), and where every row must survive a join
the frequent side is the one Spark can split.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Most copies of a row that one array holds while rows are replicated.
_COPIES_AT_ONCE = 1_000


def farmer_person(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Farmers with the columns of their person; a farmer without a person drops out."""
    person = tables["person"].select(
        "person_id", "first_name", "last_name", "login_phone", "nid", "gender", "village", "upazila", "district"
    )
    return tables["farmer"].join(person, "person_id")


def latest_loan(loan: DataFrame) -> DataFrame:
    """One row per farmer: the loan applied for last; a missing date counts as the latest.

    An aggregate instead of a window: each map task keeps one loan per farmer, so a farmer with
    very many loans costs no more than others after the shuffle.
    """
    newest = F.struct(F.col("application_date").isNull(), F.col("application_date"), F.col("loan_no"))
    kept = F.struct("loan_no", "loan_state", "approval_date", "tenure_months")
    return (
        loan.where(F.col("farmer_code").isNotNull())
        .groupBy("farmer_code")
        .agg(F.max_by(kept, newest).alias("latest"))
        .select("farmer_code", "latest.*")
    )


def loans_per_farmer(loan: DataFrame) -> DataFrame:
    """Counts of approved and pending loans of each farmer that has any."""
    state = F.col("loan_state")
    return (
        loan.where(F.col("farmer_code").isNotNull() & state.isin("ACTIVE", "CLOSED", "PENDING"))
        .groupBy("farmer_code")
        .agg(
            F.count_if(state.isin("ACTIVE", "CLOSED")).alias("loans_approved"),
            F.count_if(state == "PENDING").alias("pending_loans"),
        )
    )


def kyc_copies(farmers: DataFrame, kyc: DataFrame) -> DataFrame:
    """Farmers with ``copies``: how often a left join to KYC would list them as pending.

    One for a farmer without a KYC row, else the number of KYC rows that are pending or undecided.
    Farmers with no copies are left out.
    """
    state = F.col("identity_verified")
    pending = (
        kyc.where(F.col("farmer_code").isNotNull())
        .groupBy("farmer_code")
        .agg(F.count_if(state.isNull() | (state == "PENDING")).alias("pending_rows"))
    )
    return (
        farmers.join(pending, "farmer_code", "left")
        .withColumn("copies", F.coalesce("pending_rows", F.lit(1).cast("bigint")))
        .drop("pending_rows")
        .where("copies > 0")
    )


# The states that the write rules set; KYC rows may hold others.
_KYC_STATES = ("VERIFIED", "PENDING", "REJECTED")


def kyc_rows(farmers: DataFrame, kyc: DataFrame) -> DataFrame:
    """Farmers with ``kyc_status`` and ``copies``: the rows of a left join to KYC, equal ones counted.

    An undecided state, and no KYC row at all, count as pending. The usual states are counted in
    columns, so KYC is shuffled once, by farmer. All other states of a farmer, if there are any,
    share one row at first, which a join replaces by a row per state. Without any, adaptive
    execution drops that join.
    """
    known = kyc.where(F.col("farmer_code").isNotNull())
    state = F.coalesce("identity_verified", F.lit("PENDING"))
    unusual = ~state.isin(*_KYC_STATES)
    counted = known.groupBy("farmer_code").agg(
        *(F.count_if(state == s).alias(s) for s in _KYC_STATES), F.count_if(unusual).alias("unusual")
    )
    others = (
        known.where(unusual)
        .groupBy(F.col("farmer_code").alias("other_farmer"), F.col("identity_verified").alias("other_state"))
        .agg(F.count(F.lit(1)).alias("other_copies"))
    )

    def entry(shown: str | None, column: str, without_row: int) -> Column:
        copies = F.coalesce(column, F.lit(without_row).cast("bigint"))
        return F.struct(F.lit(shown).cast("string").alias("kyc_status"), copies.alias("copies"))

    entries = [entry(s, s, int(s == "PENDING")) for s in _KYC_STATES] + [entry(None, "unusual", 0)]
    rows = (
        farmers.join(counted, "farmer_code", "left")
        .withColumn("entry", F.explode(F.array(*entries)))
        .where("entry.copies > 0")
        .select(*farmers.columns, "entry.*")
    )
    is_other = (F.col("farmer_code") == F.col("other_farmer")) & F.col("kyc_status").isNull()
    return rows.join(others, is_other, "left").select(
        *farmers.columns,
        F.coalesce("kyc_status", "other_state").alias("kyc_status"),
        F.coalesce("other_copies", "copies").alias("copies"),
    )


def with_loan(farmers: DataFrame, loan: DataFrame) -> DataFrame:
    return farmers.join(loan.select("farmer_code").distinct(), "farmer_code", "left_semi")


def without_loan(farmers: DataFrame, loan: DataFrame) -> DataFrame:
    owners = loan.where(F.col("loan_no").isNotNull()).select("farmer_code").distinct()
    return farmers.join(owners, "farmer_code", "left_anti")


def of_farmers(df: DataFrame, farmers: DataFrame) -> DataFrame:
    """The rows of ``df`` that belong to one of ``farmers``; below an aggregation it spares the others."""
    return df.join(farmers.select("farmer_code"), "farmer_code", "left_semi")


def the_one(rows: DataFrame, what: str) -> DataFrame:
    """``rows`` if there is at most one; two are an error when the query runs."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*rows.columns)).alias("row")).where("n > 0")
    error = F.raise_error(F.lit(f"more than one {what}"))
    return found.select(F.when(F.col("n") > 1, error).otherwise(F.col("row")).alias("row")).select("row.*")


def replicate(df: DataFrame, copies: str) -> DataFrame:
    """Each row ``copies`` times, in two steps: rows are dealt to tasks by chunks of copies in between, so a large
    number of copies of one row is made by many tasks."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = F.lit(_COPIES_AT_ONCE).cast("bigint")
    first = F.lit(0).cast("bigint")
    left = F.col(copies) - F.col("_chunk") * step
    return (
        df.withColumn("_chunk", F.explode(F.sequence(first, F.floor((F.col(copies) - 1) / step))))
        .repartition(parts, *df.columns, "_chunk")
        .withColumn("_copy", F.explode(F.sequence(first + 1, F.least(step, left))))
        .drop("_chunk", "_copy", copies)
    )


def needed(keyed: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of ``keyed`` whose key occurs in ``rows``; both sides meet once per key.

    Before a ``lookup`` in a table much larger than ``rows``: that table is then shuffled once, by
    the aggregation that made it unique, and the lookup moves only what is left of it.
    """
    return keyed.join(rows.select(key).distinct(), key, "left_semi")


def lookup(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows``, where a key may repeat without bound, to ``keyed``, which has one row per key.

    Spark splits a frequent key of ``rows`` over tasks only if both inputs come straight from a
    shuffle made for this join. ``keyed`` is often the result of an aggregation on the same key and
    would skip that shuffle, so the join goes by a text made from the key. The extra shuffle moves
    one short row per key, and none at all when ``keyed`` is small enough to be broadcast.
    """

    def probe(column: str) -> Column:
        return F.concat(F.lit("="), F.col(column).cast("string"))

    left = rows.withColumn("_probe", probe(key))
    right = keyed.withColumn("_probe", probe(key)).drop(key)
    return left.join(right, "_probe", "left").drop("_probe")
