"""Known counts of the derived tables and of some results at the test scale."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks.views import VIEWS, with_views
from fieldledger import operators as op

COUNTS = {
    "center": 25, "field_agent": 100, "farmer": 1500, "person": 1600, "phone": 1600, "kyc": 1200, "loan": 5000,
    "repayment": 19964, "purchase": 10000, "ordered_item": 40036, "inventory": 2000, "community_post": 1000,
    "kyc_decision": 4031, "login_event": 3988, "registration_application": 2017,
}


@pytest.mark.parametrize("name", list(COUNTS))
def test_table_counts_and_rows(name, star, connection):
    from checks.compare import difference

    assert star[name].count() == COUNTS[name]
    assert set(COUNTS) == set(VIEWS)
    assert difference(star[name], connection, with_views(f"select * from {name}", name)) is None


def test_table_types_follow_the_schema(spark, star):
    from fieldledger.schemas import SCHEMAS

    for name, ddl in SCHEMAS.items():
        wanted = {f.name: f.dataType for f in spark.createDataFrame([], ddl).schema}
        assert {f.name: f.dataType for f in star[name].schema} == wanted, name


def _counted(df, column):
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


def test_states(star):
    assert _counted(star["loan"], "loan_state") == {
        "ACTIVE": 1639, "CLOSED": 1587, "DEFAULTED": 122, "PENDING": 1652,
    }
    assert _counted(star["purchase"], "payment_status") == {
        "CONFIRMED": 3305, "DELIVERED": 3238, "CANCELLED": 1635, "PENDING": 1590, None: 232,
    }
    assert _counted(op.inventory_status(star), "status") == {"In Stock": 1606, "Low Stock": 356, "Out of Stock": 38}


def test_every_order_and_line_is_in_one_table(spark, star):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    loan, purchase, farmer = star["loan"], star["purchase"], star["farmer"]
    assert loan.count() + purchase.count() == orders.count()
    assert star["repayment"].count() + star["ordered_item"].count() == lines.count()
    assert star["repayment"].join(loan, "loan_no", "left_anti").count() == 0
    assert star["ordered_item"].join(purchase, "purchase_id", "left_anti").count() == 0
    for held, without in ((loan, 408), (purchase, 500)):
        assert held.join(farmer, "farmer_code", "left_anti").count() == 0
        assert farmer.join(held, "farmer_code", "left_anti").count() == without


def test_the_oracle_stands_alone():
    from pathlib import Path

    for name in ("oracle", "views"):
        assert "fieldledger" not in (Path(__file__).parent.parent / f"checks/{name}.py").read_text().split('"""', 2)[2]


def test_lists(star):
    assert op.my_farmers(star).where("pending_order = 'No'").count() == 519
    assert op.outreach(star).count() == 228
    assert op.agent_ranking(star).count() == 80
    badge = op.pending_kyc_count(star, "C000").first().pending_kyc
    assert (badge, op.pending_kyc(star, "C000").count()) == (38, 29)


def test_days_differ_from_calendar_days_in_the_evening(star):
    moment = datetime(2002, 1, 1, 18)
    from fieldledger.functions import as_of_column, days_since

    rounded = days_since(as_of_column(moment), F.col("registration_date"))
    plain = F.datediff(F.lit("2002-01-01").cast("date"), F.col("registration_date").cast("date"))
    assert star["farmer"].where(rounded != plain).count() == 1500


def test_decisions(star):
    fold = op.fold_decisions(star["kyc_decision"])
    assert Counter(r.decision for r in fold.select("last.decision").collect()) == {"VERIFIED": 79, "REJECTED": 71}
    lost = op.unmatched_decisions(star["kyc"], star["kyc_decision"])
    assert lost.select("farmer_code").distinct().count() == 30


def test_registration_outcomes(star):
    checked = op.validate_registrations(star["registration_application"], star["person"])
    assert _counted(checked, "outcome") == {
        "ROLE": 327, "REQUIRED": 168, "MISMATCH": 164, "SHORT": 229, "PHONE": 119, "DUP_PHONE": 332,
        "DUP_USERNAME": 207, "OK": 471,
    }


def test_counts_agree_with_each_other(star):
    badge = {r.center_code: r.pending_kyc for r in op.pending_kyc_count(star).collect()}
    listed = Counter(r.center_code for r in op.pending_kyc(star).collect())
    assert all(badge[c] >= n for c, n in listed.items())
    waiting = {r.code for r in op.pending_kyc(star).collect()}
    assert not waiting & {r.code for r in op.outreach(star).collect()}
    known = star["farmer"].join(star["field_agent"], "agent_code", "left_semi").count()
    total = op.agent_dashboard(star).agg(F.sum("total_farmers")).first()[0]
    assert total == known
    shown = op.my_farmers_count(star).agg(F.sum("farmers_shown")).first()[0]
    assert shown == op.my_farmers(star).count()
