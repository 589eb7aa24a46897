"""Work lists of a center: pending KYC, loans and purchases, stock, and farmers to reach out to.

``scope`` is a center code. Without it the list covers all centers and leads with ``center_code``.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.functions import (
    as_of_column,
    day_mon_year,
    days_since,
    full_name,
    grouped_amount,
    label,
    or_default,
    stock_status,
    word_caps,
)
from fieldledger.plans import farmer_person, kyc_copies, of_farmers, present, replicate, with_loan, without_loan


def _in_center(df: DataFrame, scope: str | None) -> DataFrame:
    center = F.col("center_code")
    return df.where(center.isNotNull() if scope is None else center == scope)


def _name():
    return full_name(word_caps("first_name"), word_caps("last_name")).alias("name")


def _with_person(farmers: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    person = tables["person"].select("person_id", "first_name", "last_name", "login_phone", "upazila")
    return farmers.join(person, "person_id")


def pending_per_center(farmers: DataFrame, kyc: DataFrame) -> DataFrame:
    return kyc_copies(farmers, kyc).groupBy("center_code").agg(F.sum("copies").alias("pending_kyc"))


def _of(df: DataFrame, farmers: DataFrame, scope: str | None) -> DataFrame:
    """What belongs to the farmers of one center; all of it without a scope."""
    return df if scope is None else of_farmers(df, farmers)


def pending_kyc_count(tables: Mapping[str, DataFrame], scope: str | None = None) -> DataFrame:
    """Farmers of a center without a decided KYC, with or without a loan."""
    farmers = _in_center(tables["farmer"], scope).select("center_code", "farmer_code")
    if scope is None:
        return pending_per_center(farmers, tables["kyc"])
    pending = kyc_copies(farmers, of_farmers(tables["kyc"], farmers))
    return pending.agg(F.coalesce(F.sum("copies"), F.lit(0).cast("bigint")).alias("pending_kyc"))


def pending_kyc(
    tables: Mapping[str, DataFrame], scope: str | None = None, ordered: bool | None = None
) -> DataFrame:
    """Farmers without a decided KYC who have a loan."""
    farmers = _in_center(tables["farmer"], scope).select(
        "center_code", "farmer_code", "person_id", "registration_date"
    )
    kyc, loan = (_of(tables[name], farmers, scope) for name in ("kyc", "loan"))
    waiting = with_loan(kyc_copies(farmers, kyc), loan)
    rows = replicate(_with_person(waiting, tables), "copies")
    return present(
        rows,
        "center_code",
        scope,
        [
            F.col("farmer_code").alias("code"),
            _name(),
            F.col("login_phone").alias("phone"),
            F.col("upazila").alias("village"),
            day_mon_year(F.col("registration_date")).alias("registered"),
        ],
        [F.asc_nulls_last("registration_date"), F.col("farmer_code")],
        ordered,
    )


def pending_kyc_page(
    tables: Mapping[str, DataFrame], scope: str | None = None, ordered: bool | None = None
) -> DataFrame:
    """The list of waiting farmers as it is displayed, with a placeholder for a missing date."""
    return pending_kyc(tables, scope, ordered).withColumn("registered", or_default("registered", "N/A"))


def pending_loans(
    tables: Mapping[str, DataFrame], scope: str | None = None, ordered: bool | None = None
) -> DataFrame:
    """Loans of a center's farmers that wait for a decision."""
    loan = tables["loan"].where("loan_state = 'PENDING'").select(
        "loan_no", "farmer_code", "amount", "purpose", "application_date"
    )
    rows = loan.join(_in_center(farmer_person(tables), scope), "farmer_code")
    return present(
        rows,
        "center_code",
        scope,
        [
            F.col("loan_no").alias("loan_id"),
            F.col("farmer_code").alias("code"),
            _name(),
            grouped_amount(F.col("amount")).alias("amount"),
            word_caps("purpose").alias("purpose"),
            day_mon_year(F.col("application_date")).alias("applied"),
        ],
        [F.asc_nulls_last("application_date"), F.col("loan_no")],
        ordered,
    )


def inventory_status(
    tables: Mapping[str, DataFrame], scope: str | None = None, ordered: bool | None = None
) -> DataFrame:
    """Stock of a center with a status; an unknown quantity counts as in stock."""
    quantity = F.col("quantity")
    return present(
        _in_center(tables["inventory"], scope),
        "center_code",
        scope,
        [
            word_caps("name").alias("item"),
            quantity.alias("stock"),
            grouped_amount(F.col("unit_price"), digits=6).alias("price"),
            stock_status(quantity).alias("status"),
        ],
        [F.asc_nulls_last("name"), F.col("item_id")],
        ordered,
    )


def inventory_page(
    tables: Mapping[str, DataFrame],
    scope: str | None = None,
    language: str = "bn",
    ordered: bool | None = None,
) -> DataFrame:
    """The stock list as it is displayed, with the label of the status."""
    status = label("stock_status", F.col("status"), language)
    return inventory_status(tables, scope, ordered).withColumn("status", status)


def outreach(
    tables: Mapping[str, DataFrame],
    scope: str | None = None,
    as_of: datetime | None = None,
    ordered: bool | None = None,
) -> DataFrame:
    """Farmers with neither a decided KYC nor a loan, and the days since they registered."""
    farmers = _in_center(tables["farmer"], scope).select(
        "center_code", "farmer_code", "person_id", "registration_date"
    )
    kyc, loan = (_of(tables[name], farmers, scope) for name in ("kyc", "loan"))
    untouched = without_loan(kyc_copies(farmers, kyc), loan)
    rows = replicate(_with_person(untouched, tables), "copies").withColumn(
        "days_since_reg", days_since(as_of_column(as_of), F.col("registration_date"))
    )
    return present(
        rows,
        "center_code",
        scope,
        [
            F.col("farmer_code").alias("code"),
            _name(),
            F.col("login_phone").alias("phone"),
            word_caps("upazila").alias("village"),
            F.col("days_since_reg"),
        ],
        [F.desc_nulls_first("days_since_reg"), F.col("farmer_code")],
        ordered,
    )


def pending_purchases(
    tables: Mapping[str, DataFrame], scope: str | None = None, ordered: bool | None = None
) -> DataFrame:
    """Confirmed purchases of a center's farmers with their totals, to be delivered."""
    confirmed = (
        tables["purchase"]
        .where("payment_status = 'CONFIRMED'")
        .select("purchase_id", "farmer_code", "purchase_date", "payment_method")
    )
    items = tables["ordered_item"].where(F.col("purchase_id").isNotNull())
    if scope is not None:
        confirmed = of_farmers(confirmed, _in_center(tables["farmer"], scope))
        items = items.join(confirmed.select("purchase_id"), "purchase_id", "left_semi")
    totals = items.groupBy("purchase_id").agg(F.sum("total_cost").alias("total"))
    rows = confirmed.join(totals, "purchase_id", "left").join(
        _in_center(farmer_person(tables), scope), "farmer_code"
    )
    return present(
        rows,
        "center_code",
        scope,
        [
            F.col("purchase_id").alias("order_id"),
            F.col("farmer_code").alias("code"),
            _name(),
            day_mon_year(F.col("purchase_date")).alias("ordered"),
            grouped_amount(F.coalesce("total", F.lit(0))).alias("total_amount"),
            F.coalesce("payment_method", F.lit("Not Specified")).alias("payment"),
        ],
        [F.asc_nulls_last("purchase_date"), F.col("purchase_id")],
        ordered,
    )
