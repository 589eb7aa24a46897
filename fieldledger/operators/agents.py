"""Agents: dashboard, page, lookups and ranking.

Every operator takes the tables and, optionally, one agent's ``person_id`` as ``scope``. Without a
scope it works for all agents at once and leads with the ``person_id`` column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.functions import full_name, or_default
from fieldledger.operators.queues import pending_kyc_count, pending_per_center
from fieldledger.plans import loans_per_farmer, lookup, numbered, of_farmers, ranked, the_one

COUNTS = ("total_farmers", "kyc_done", "loans_approved", "pending_loans", "pending_deliveries")
PROFILE = ("agent_code", "center_name", "upazila", "district", "working_status", "login_phone", "join_date")


def _agents(tables: Mapping[str, DataFrame], scope: int | None) -> DataFrame:
    agents = tables["field_agent"].where(F.col("person_id").isNotNull())
    return agents if scope is None else agents.where(F.col("person_id") == scope)


def agent_counts(tables: Mapping[str, DataFrame], scope: int | None = None) -> DataFrame:
    """The five dashboard counts of every agent that has any of them.

    FARMER with its loan counts, KYC and PURCHASE become rows of one shape and are added up by one
    aggregation, so there is one shuffle on agent_code instead of one per count.
    """

    def of_agents(df: DataFrame) -> DataFrame:
        if scope is None:
            return df.where(F.col("agent_code").isNotNull())
        return df.join(_agents(tables, scope).select("agent_code"), "agent_code", "left_semi")

    def counted(df: DataFrame, **counts: str) -> DataFrame:
        return df.select(
            "agent_code", *(F.expr(counts.get(name, "0")).cast("bigint").alias(name) for name in COUNTS)
        )

    farmers = of_agents(tables["farmer"]).select("agent_code", "farmer_code")
    loans = tables["loan"]
    if scope is not None:
        loans = loans.join(farmers.select("farmer_code"), "farmer_code", "left_semi")
    farmer_part = counted(
        farmers.join(loans_per_farmer(loans), "farmer_code", "left"),
        total_farmers="1",
        loans_approved="coalesce(loans_approved, 0)",
        pending_loans="coalesce(pending_loans, 0)",
    )
    kyc_part = counted(of_agents(tables["kyc"].where("identity_verified = 'VERIFIED'")), kyc_done="1")
    purchase_part = counted(
        of_agents(tables["purchase"].where("payment_status = 'CONFIRMED'")), pending_deliveries="1"
    )
    return (
        farmer_part.unionByName(kyc_part)
        .unionByName(purchase_part)
        .groupBy("agent_code")
        .agg(*(F.sum(name).alias(name) for name in COUNTS))
    )


def _dashboard(tables: Mapping[str, DataFrame], scope: int | None) -> DataFrame:
    person = tables["person"].select("person_id", "login_phone", "upazila", "district")
    return (
        _agents(tables, scope)
        .join(person, "person_id")
        .join(agent_counts(tables, scope), "agent_code", "left")
        .join(tables["center"], "center_code", "left")
        .select(
            "person_id",
            "center_code",
            "agent_code",
            "center_name",
            "upazila",
            "district",
            F.col("is_active").alias("working_status"),
            "login_phone",
            "join_date",
            *(F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in COUNTS),
        )
    )


def agent_dashboard(tables: Mapping[str, DataFrame], scope: int | None = None) -> DataFrame:
    """One row per agent: profile and the five counts."""
    rows = _dashboard(tables, scope).drop("center_code")
    return rows if scope is None else the_one(rows.drop("person_id"), f"agent code of person {scope}")


def agent_page(tables: Mapping[str, DataFrame], scope: int | None = None) -> DataFrame:
    """The dashboard with ``pending_kyc`` of the agent's center, 0 without a center or an agent code."""
    rows = _dashboard(tables, scope)
    if scope is None:
        pending = pending_kyc_count(tables)
    else:
        centers = _agents(tables, scope).select("center_code").distinct()
        farmers = tables["farmer"].select("center_code", "farmer_code").join(centers, "center_code", "left_semi")
        pending = pending_per_center(farmers, of_farmers(tables["kyc"], farmers))
    rows = lookup(rows, pending, "center_code")
    shown = F.when(F.col("agent_code").isNotNull(), F.col("pending_kyc"))
    rows = rows.withColumn("pending_kyc", F.coalesce(shown, F.lit(0).cast("bigint")))
    columns = (*PROFILE, *COUNTS, "pending_kyc")
    if scope is None:
        return rows.select("person_id", *columns)
    return the_one(rows.select(*columns), f"agent code of person {scope}")


def dashboard_defaults(tables: Mapping[str, DataFrame], scope: int | None = None) -> DataFrame:
    """The agent page with every missing value replaced by what the page shows for it."""
    shown = {
        "agent_code": or_default("agent_code", "N/A"),
        "center_name": or_default("center_name", "Not Assigned"),
        "upazila": or_default("upazila", "N/A"),
        "district": or_default("district", "N/A"),
        "phone": or_default("login_phone", "N/A"),
        "join_date": F.coalesce(F.date_format("join_date", "dd MMM yyyy"), F.lit("N/A")),
    }
    page = agent_page(tables, scope)
    names = [("phone" if c == "login_phone" else c) for c in page.columns]
    return page.select(*(shown.get(name, F.col(name)).alias(name) for name in names))


def agent_lookup(tables: Mapping[str, DataFrame], scope: int | None = None) -> DataFrame:
    """The agent code and the center code of a person."""
    rows = _agents(tables, scope)
    if scope is None:
        return rows.select("person_id", "agent_code", "center_code")
    return the_one(rows.select("agent_code", "center_code"), f"agent code of person {scope}")


def _success(tables: Mapping[str, DataFrame]) -> DataFrame:
    kyc = (
        tables["kyc"]
        .where(F.col("agent_code").isNotNull() & F.col("kyc_id").isNotNull())
        .groupBy("agent_code")
        .agg(
            F.count(F.lit(1)).alias("total_kyc"),
            F.count_if(F.col("identity_verified") == "VERIFIED").alias("verified_kyc"),
        )
    )
    person = tables["person"].select(
        "person_id",
        full_name(F.col("first_name"), F.col("last_name")).alias("agent_name"),
    )
    return (
        tables["field_agent"]
        .select("agent_code", "person_id")
        .join(person, "person_id")
        .join(kyc, "agent_code")
        .select(
            "agent_code",
            "agent_name",
            "total_kyc",
            "verified_kyc",
            (F.col("verified_kyc") * 100.0 / F.col("total_kyc")).cast("double").alias("rate"),
        )
    )


def agent_ranking(tables: Mapping[str, DataFrame], ordered: bool = False) -> DataFrame:
    """Agents with KYC rows: totals, success rate to two decimals, and rank by the exact rate."""
    rows = ranked(_success(tables), "rate", "rank").select(
        "agent_code",
        "agent_name",
        "total_kyc",
        "verified_kyc",
        F.round("rate", 2).alias("success_rate"),
        "rank",
    )
    return rows.orderBy(F.desc("success_rate"), "agent_code") if ordered else rows


def ranking_position(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The place of each agent in the displayed list: by rounded rate, no shared places."""
    rows = _success(tables).select("agent_code", "agent_name", F.round("rate", 2).alias("success_rate"))
    return numbered(rows, [F.desc("success_rate"), F.col("agent_code")], "position")
