"""Farmers: an agent's list, one farmer's profile and histories, and the community posts.

The list takes an agent's ``person_id`` as ``scope``; profile and histories take a farmer code.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.functions import (
    add_months_sticky,
    blank_to_null,
    day_mon_year,
    full_name,
    grouped_amount,
    label,
    loan_status,
    or_default,
    stock_status,
    word_caps,
)
from fieldledger.plans import farmer_person, kyc_rows, latest_loan, of_farmers, present, replicate, the_one


def _code_of(tables: Mapping[str, DataFrame], person_id: int) -> Column:
    """The agent code of a person as a scalar; two codes are an error when the query runs."""
    return tables["field_agent"].where(F.col("person_id") == person_id).select("agent_code").scalar()


def _agent_farmers(tables: Mapping[str, DataFrame], scope: int | None) -> DataFrame:
    """Farmers with the person id of their agent."""
    farmers = tables["farmer"].select("agent_code", "farmer_code", F.col("person_id").alias("farmer_person_id"))
    if scope is None:
        agents = tables["field_agent"].where(F.col("person_id").isNotNull())
        return farmers.join(agents.select("person_id", "agent_code"), "agent_code")
    of_agent = farmers.where(F.col("agent_code") == _code_of(tables, scope))
    return of_agent.withColumn("person_id", F.lit(scope).cast("bigint"))


def my_farmers(
    tables: Mapping[str, DataFrame], scope: int | None = None, ordered: bool | None = None
) -> DataFrame:
    """An agent's farmers with KYC state, state and due date of the latest loan, and open orders.

    Loans, orders and KYC rows are brought to one row per farmer before the joins, which then all run
    on the same partitioning by farmer.
    """
    farmers = _agent_farmers(tables, scope)
    loan, purchase, kyc = (
        tables[name] if scope is None else of_farmers(tables[name], farmers) for name in ("loan", "purchase", "kyc")
    )
    open_orders = (
        purchase.where(F.col("farmer_code").isNotNull() & ~F.col("payment_status").isin("DELIVERED", "CANCELLED"))
        .select("farmer_code")
        .distinct()
        .withColumn("has_order", F.lit(True))
    )
    person = tables["person"].select(
        F.col("person_id").alias("farmer_person_id"), "first_name", "last_name", "login_phone"
    )
    listed = farmers.join(latest_loan(loan), "farmer_code", "left").join(open_orders, "farmer_code", "left")
    rows = replicate(kyc_rows(listed, kyc).join(person, "farmer_person_id"), "copies")
    return present(
        rows,
        "person_id",
        scope,
        [
            F.col("farmer_code").alias("code"),
            full_name(word_caps("first_name"), word_caps("last_name")).alias("name"),
            F.col("login_phone").alias("phone"),
            F.col("kyc_status"),
            loan_status(F.col("loan_no"), F.col("loan_state")).alias("loan_status"),
            day_mon_year(add_months_sticky(F.col("approval_date"), F.col("tenure_months"))).alias("due_date"),
            F.when(F.col("has_order"), "Yes").otherwise("No").alias("pending_order"),
        ],
        [F.asc_nulls_last("farmer_code")],
        ordered,
    )


def my_farmers_count(tables: Mapping[str, DataFrame], scope: int | None = None) -> DataFrame:
    """The length of each agent's list of farmers, 0 for an empty one.

    Farmers are counted per agent code before they meet the agents, so an agent with very many
    farmers is one row by then.
    """
    rows_per_farmer = (
        tables["kyc"]
        .where(F.col("farmer_code").isNotNull())
        .groupBy("farmer_code")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    code = F.col("agent_code")
    farmers = tables["farmer"].where(code.isNotNull() if scope is None else code == _code_of(tables, scope))
    listed = (
        farmers.select("agent_code", "farmer_code", "person_id")
        .join(tables["person"].select("person_id"), "person_id")
        .join(rows_per_farmer, "farmer_code", "left")
    )
    rows = F.sum(F.coalesce("rows", F.lit(1).cast("bigint")))
    zero = F.lit(0).cast("bigint")
    if scope is not None:
        return listed.agg(F.coalesce(rows, zero).alias("farmers_shown"))
    counts = listed.groupBy("agent_code").agg(rows.alias("farmers_shown"))
    agents = tables["field_agent"].where(F.col("person_id").isNotNull()).select("person_id", "agent_code")
    return agents.join(counts, "agent_code", "left").select(
        "person_id", "agent_code", F.coalesce("farmers_shown", zero).alias("farmers_shown")
    )


def my_farmers_page(
    tables: Mapping[str, DataFrame],
    scope: int | None = None,
    language: str = "bn",
    dashboard: bool = False,
    ordered: bool | None = None,
) -> DataFrame:
    """The list as it is displayed: labels in ``language`` and placeholders for missing values."""
    loan_domain = "dashboard_loan_status" if dashboard else "loan_status"
    shown = {
        "code": or_default("code", "N/A"),
        "name": or_default("name", "N/A"),
        "phone": or_default("phone", "N/A"),
        "kyc_status": label("kyc_status", F.col("kyc_status"), language),
        "loan_status": label(loan_domain, F.col("loan_status"), language),
        "due_date": or_default("due_date", "-"),
        "pending_order": label("pending_order", F.col("pending_order"), language),
    }
    page = my_farmers(tables, scope, ordered)
    return page.select(*(shown.get(c, F.col(c)).alias(c) for c in page.columns))


def _of_farmer(df: DataFrame, scope: str | None) -> DataFrame:
    farmer = F.col("farmer_code")
    return df.where(farmer.isNotNull() if scope is None else farmer == scope)


def farmer_detail(tables: Mapping[str, DataFrame], scope: str | None = None) -> DataFrame:
    """A farmer's profile. Points and referrals are not recorded and have fixed values."""
    none = F.lit(None).cast("string")
    rows = _of_farmer(farmer_person(tables), scope).select(
        "farmer_code",
        word_caps("first_name").alias("first_name"),
        word_caps("last_name").alias("last_name"),
        "login_phone",
        "nid",
        "gender",
        word_caps("village").alias("village"),
        word_caps("upazila").alias("upazila"),
        word_caps("district").alias("district"),
        day_mon_year(F.col("registration_date")).alias("registration_date"),
        "account_status",
        F.lit(0).alias("total_points"),
        none.alias("referred_by"),
        none.alias("referral_date"),
        none.alias("referral_status"),
    )
    return rows if scope is None else the_one(rows, f"farmer with the code {scope}")


def _date_order(column: str, chronological: bool) -> Column:
    """Newest first, or, as the lists are in fact sorted, by the displayed text descending."""
    return F.desc_nulls_first(column) if chronological else day_mon_year(F.col(column)).desc_nulls_first()


def _history(
    rows: DataFrame, scope: str | None, columns: Sequence[Column | str], order: Sequence[Column], ordered: bool | None
) -> DataFrame:
    return present(_of_farmer(rows, scope), "farmer_code", scope, columns, order, ordered)


def farmer_loans(
    tables: Mapping[str, DataFrame],
    scope: str | None = None,
    chronological: bool = False,
    ordered: bool | None = None,
) -> DataFrame:
    """A farmer's loans."""
    return _history(
        tables["loan"],
        scope,
        [
            F.col("loan_no").alias("loan_id"),
            grouped_amount(F.col("amount")).alias("amount"),
            F.col("interest_rate"),
            F.col("tenure_months"),
            word_caps("purpose").alias("purpose"),
            F.col("loan_state").alias("status"),
            *(
                day_mon_year(F.col(c)).alias(c)
                for c in ("application_date", "approval_date", "disbursement_date")
            ),
        ],
        [_date_order("application_date", chronological), F.col("loan_no")],
        ordered,
    )


def farmer_repayments(
    tables: Mapping[str, DataFrame], scope: str | None = None, ordered: bool | None = None
) -> DataFrame:
    """A farmer's repayments, found through the loan; newest first."""
    loans = _of_farmer(tables["loan"].select("loan_no", "farmer_code"), scope)
    return _history(
        tables["repayment"].join(loans, "loan_no"),
        scope,
        [
            F.col("loan_no"),
            F.col("installment_no"),
            grouped_amount(F.col("amount_paid")).alias("amount_paid"),
            day_mon_year(F.col("payment_date")).alias("payment_date"),
            F.col("payment_method"),
            F.col("payment_state"),
            grouped_amount(F.col("late_fee")).alias("late_fee"),
        ],
        [F.desc_nulls_first("payment_date"), F.col("loan_no"), F.col("installment_no")],
        ordered,
    )


def farmer_purchases(
    tables: Mapping[str, DataFrame],
    scope: str | None = None,
    chronological: bool = False,
    ordered: bool | None = None,
) -> DataFrame:
    """A farmer's purchases."""
    return _history(
        tables["purchase"],
        scope,
        [
            F.col("purchase_id"),
            day_mon_year(F.col("purchase_date")).alias("purchase_date"),
            F.col("payment_method"),
            F.col("payment_status").alias("status"),
            F.col("transaction_reference"),
        ],
        [_date_order("purchase_date", chronological), F.col("purchase_id")],
        ordered,
    )


def farmer_page(
    tables: Mapping[str, DataFrame], scope: str | None = None, language: str = "bn"
) -> DataFrame:
    """Everything on a farmer's page as flat rows: a profile row, then loans, repayments, purchases.

    ``section`` names the part of the page; columns of other parts are NULL. Histories of a farmer
    without a profile are left out. The rows of a farmer are not nested into one, so a farmer with
    a very long history needs no large row.
    """
    found = _of_farmer(farmer_person(tables), scope).select("farmer_code")

    def of_found(name: str) -> DataFrame:
        return _of_farmer(tables[name], scope).join(found, "farmer_code", "left_semi")

    # Repayments follow from the loans kept, so that largest table is not joined a second time.
    kept = ChainMap({"loan": of_found("loan"), "purchase": of_found("purchase")}, tables)
    profile = _of_farmer(farmer_detail(tables), scope).withColumn("referred_by", or_default("referred_by", "N/A"))
    loans = farmer_loans(kept).withColumn("status", label("loan_state", F.col("status"), language))
    repayments = farmer_repayments(kept).withColumn(
        "payment_state", label("payment_state", F.col("payment_state"), language)
    )
    purchases = farmer_purchases(kept).withColumns(
        {
            "payment_method": or_default("payment_method", "N/A"),
            "status": label("payment_status", F.col("status"), language),
            "transaction_reference": or_default("transaction_reference", "N/A"),
        }
    )
    page = profile.withColumn("section", F.lit("profile"))
    for section, history in (("loan", loans), ("repayment", repayments), ("purchase", purchases)):
        page = page.unionByName(history.withColumn("section", F.lit(section)), allowMissingColumns=True)
    first = ("farmer_code", "section")
    return page.select(*first, *(c for c in page.columns if c not in first))


def community_posts(
    tables: Mapping[str, DataFrame], chronological: bool = False, ordered: bool = False
) -> DataFrame:
    """All posts with their date."""
    posts = tables["community_post"]
    if ordered:
        posts = posts.orderBy(_date_order("post_date", chronological), "post_id")
    return posts.select("post_id", "content", day_mon_year(F.col("post_date")).alias("post_date"))


def status_labels(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The label, in both languages, of every status shown on the detail, stock and role pages."""

    def labelled(table: str, item: str, domain: str, code: Column, part: Column | None = None) -> DataFrame:
        return tables[table].select(
            F.lit(domain).alias("domain"),
            F.col(item).cast("string").alias("item"),
            (F.lit(None) if part is None else part).cast("bigint").alias("installment_no"),
            code.alias("code"),
            label(domain, code, "en").alias("label_en"),
            label(domain, code, "bn").alias("label_bn"),
        )

    stock = stock_status(F.col("quantity"))
    parts = [
        labelled("kyc", "kyc_id", "kyc_status", F.coalesce(blank_to_null("identity_verified"), F.lit("PENDING"))),
        labelled("loan", "loan_no", "loan_state", F.col("loan_state")),
        labelled(
            "repayment", "loan_no", "payment_state", F.col("payment_state"), F.col("installment_no")
        ),
        labelled("purchase", "purchase_id", "payment_status", F.col("payment_status")),
        labelled("inventory", "item_id", "stock_status", stock),
        labelled("person", "person_id", "role", F.col("role")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
