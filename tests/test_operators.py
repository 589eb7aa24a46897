"""Operators on hand-made rows, and their scoped form on the derived tables."""

from collections import Counter
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fieldledger import operators as op
from fieldledger.plans import ranked, replicate

AS_OF = datetime(2002, 1, 1, 18)


def person(number, **other):
    return {"person_id": number, "first_name": "asha", "last_name": "roy", "login_phone": f"p{number}", **other}


def farmer(code, number, agent="A1", center="C1", **other):
    return {"farmer_code": code, "person_id": number, "agent_code": agent, "center_code": center,
            "registration_date": datetime(2001, 1, 1), **other}


def loan(number, code, state="ACTIVE", applied=None, **other):
    return {"loan_no": number, "farmer_code": code, "loan_state": state, "application_date": applied, **other}


AGENT = {"agent_code": "A1", "person_id": 9, "center_code": "C1"}


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_two_kyc_rows_list_a_farmer_twice_and_count_once(made):
    tables = made(
        farmer=[farmer("F1", 1), farmer("F2", 2)],
        person=[person(1), person(2), person(9)],
        field_agent=[AGENT],
        kyc=[
            {"kyc_id": 1, "farmer_code": "F1", "identity_verified": "PENDING", "agent_code": "A1"},
            {"kyc_id": 2, "farmer_code": "F1", "identity_verified": None, "agent_code": "A1"},
            {"kyc_id": 3, "farmer_code": "F1", "identity_verified": "REJECTED", "agent_code": "A1"},
            {"kyc_id": 4, "farmer_code": "F1", "identity_verified": "ON HOLD", "agent_code": "A1"},
            {"kyc_id": 5, "farmer_code": "F1", "identity_verified": "ON HOLD", "agent_code": "A1"},
        ],
        loan=[loan(1, "F1"), loan(2, "F1", "PENDING"), loan(3, "F2", "CLOSED")],
    )
    assert rows(op.my_farmers(tables), "code", "kyc_status") == [
        ("F1", "ON HOLD"), ("F1", "ON HOLD"), ("F1", "PENDING"), ("F1", "PENDING"), ("F1", "REJECTED"),
        ("F2", "PENDING"),
    ]
    assert op.my_farmers_count(tables).first().farmers_shown == 6
    assert op.pending_kyc_count(tables).first().pending_kyc == 3
    assert rows(op.pending_kyc(tables), "code") == [("F1",), ("F1",), ("F2",)]
    counts = op.agent_dashboard(tables).first()
    assert (counts.total_farmers, counts.loans_approved, counts.pending_loans) == (2, 2, 1)


def test_an_agent_without_rows_has_zeros(made):
    tables = made(person=[person(9)], field_agent=[{**AGENT, "center_code": None}])
    shown = op.agent_page(tables).first()
    assert [shown[c] for c in (*op.agents.COUNTS, "pending_kyc")] == [0] * 6
    assert op.my_farmers_count(tables).first().farmers_shown == 0
    defaults = op.dashboard_defaults(tables).first()
    assert (defaults.center_name, defaults.upazila, defaults.join_date) == ("Not Assigned", "N/A", "N/A")
    assert op.agent_ranking(tables).count() == 0
    assert op.pending_kyc_count(tables, "C7").first().pending_kyc == 0


def test_an_agent_without_a_person_is_not_shown(made):
    assert op.agent_dashboard(made(field_agent=[AGENT])).count() == 0


def test_kyc_and_purchases_count_for_their_own_agent(made):
    tables = made(
        person=[person(8), person(9), person(1)],
        field_agent=[AGENT, {"agent_code": "A2", "person_id": 8}],
        farmer=[farmer("F1", 1)],
        kyc=[{"kyc_id": 1, "farmer_code": "F1", "identity_verified": "VERIFIED", "agent_code": "A2"}],
        purchase=[{"purchase_id": 1, "farmer_code": "F1", "agent_code": "A2", "payment_status": "CONFIRMED"}],
    )
    got = rows(op.agent_dashboard(tables), "agent_code", "total_farmers", "kyc_done", "pending_deliveries")
    assert got == [("A1", 1, 0, 0), ("A2", 0, 1, 1)]


def test_latest_loan_takes_a_missing_date_first_and_then_the_higher_number(made):
    day = datetime(2001, 5, 31)
    tables = made(
        person=[person(1), person(2), person(3), person(4)],
        field_agent=[AGENT],
        farmer=[farmer("F1", 1), farmer("F2", 2), farmer("F3", 3), farmer("F4", 4)],
        loan=[
            loan(1, "F1", "CLOSED", day),
            loan(2, "F1", "ACTIVE", None, approval_date=datetime(2001, 2, 28, 9), tenure_months=1),
            loan(3, "F2", "PENDING", day),
            loan(4, "F2", "DEFAULTED", day),
            loan(5, "F3", None, day),
        ],
    )
    assert rows(op.my_farmers(tables), "code", "loan_status", "due_date") == [
        ("F1", "Active Loan", "31-Mar-2001"), ("F2", "DEFAULTED", None), ("F3", None, None), ("F4", "No Loan", None),
    ]


def test_pending_order_needs_a_known_open_state(made):
    def buys(number, code, state):
        return {"purchase_id": number, "farmer_code": code, "payment_status": state}

    tables = made(
        person=[person(n) for n in (1, 2, 3)],
        field_agent=[AGENT],
        farmer=[farmer(f"F{n}", n) for n in (1, 2, 3)],
        purchase=[buys(1, "F1", None), buys(2, "F2", "DELIVERED"), buys(3, "F3", "PENDING"), buys(4, "F3", "CANCELLED")],
    )
    assert rows(op.my_farmers(tables), "code", "pending_order") == [("F1", "No"), ("F2", "No"), ("F3", "Yes")]


def test_two_agent_codes_for_a_person_are_an_error_in_the_scoped_list(made):
    tables = made(field_agent=[AGENT, {"agent_code": "A2", "person_id": 9}], farmer=[farmer("F1", 1)], person=[person(1)])
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        op.my_farmers(tables, scope=9).collect()


def test_outreach_needs_no_loan_and_no_decided_kyc(made):
    tables = made(
        person=[person(n, last_name=None) for n in range(1, 6)],
        farmer=[farmer(f"F{n}", n) for n in range(1, 6)],
        kyc=[
            {"kyc_id": 1, "farmer_code": "F1", "identity_verified": "PENDING"},
            {"kyc_id": 2, "farmer_code": "F2", "identity_verified": "VERIFIED"},
            {"kyc_id": 3, "farmer_code": "F3", "identity_verified": None},
        ],
        loan=[loan(1, "F3")],
    )
    got = op.outreach(tables, as_of=datetime(2001, 1, 2, 12))
    assert rows(got, "code", "name", "days_since_reg") == [("F1", "Asha ", 2), ("F4", "Asha ", 2), ("F5", "Asha ", 2)]


def test_purchases_without_items_total_zero(made):
    tables = made(
        person=[person(1)],
        farmer=[farmer("F1", 1)],
        purchase=[{"purchase_id": n, "farmer_code": "F1", "payment_status": "CONFIRMED"} for n in (1, 2)],
        ordered_item=[{"purchase_id": 2, "total_cost": Decimal("1200.50")}, {"purchase_id": 2}],
    )
    got = rows(op.pending_purchases(tables), "order_id", "total_amount", "payment")
    assert got == [(1, "0", "Not Specified"), (2, "1,201", "Not Specified")]


def test_stock_states(made):
    tables = made(inventory=[{"item_id": n, "center_code": "C1", "name": "x", "quantity": q}
                             for n, q in enumerate((0, 1, 9, 10, None, -1))])
    got = Counter(r.status for r in op.inventory_status(tables).collect())
    assert got == {"Out of Stock": 1, "Low Stock": 3, "In Stock": 2}


def test_text_order_and_real_order_of_dates(made):
    days = [datetime(2001, 2, 10), datetime(2001, 1, 20), datetime(1999, 12, 31), None]
    tables = made(loan=[loan(n, "F1", applied=d) for n, d in enumerate(days)])
    assert [r.loan_id for r in op.farmer_loans(tables, "F1").collect()] == [3, 2, 1, 0]
    assert [r.loan_id for r in op.farmer_loans(tables, "F1", chronological=True).collect()] == [3, 0, 1, 2]


def test_ranking_shares_ranks_and_positions_do_not(made):
    def kyc(agent, verified, total):
        return [{"kyc_id": 1, "agent_code": agent, "identity_verified": "VERIFIED" if n < verified else "PENDING"}
                for n in range(total)]

    tables = made(
        person=[person(n, first_name=None) for n in range(4)],
        field_agent=[{"agent_code": f"A{n}", "person_id": n} for n in range(4)],
        kyc=kyc("A0", 1, 3) + kyc("A1", 2, 6) + kyc("A2", 3, 3) + kyc("A3", 0, 2),
    )
    got = rows(op.agent_ranking(tables), "agent_code", "agent_name", "success_rate", "rank")
    assert got == [("A0", " roy", 33.33, 2), ("A1", " roy", 33.33, 2), ("A2", " roy", 100.0, 1), ("A3", " roy", 0.0, 4)]
    assert rows(op.ranking_position(tables), "agent_code", "position") == [("A0", 2), ("A1", 3), ("A2", 1), ("A3", 4)]
    assert [r.agent_code for r in op.agent_ranking(tables, ordered=True).collect()] == ["A2", "A0", "A1", "A3"]


def test_ranked_over_many_partitions(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 97 / 3).alias("v")).repartition(16)
    got = {r.id: r["rank"] for r in ranked(df, "v", "rank").collect()}
    values = {r.id: r.v for r in df.collect()}
    above = Counter(values.values())
    wanted, seen = {}, 1
    for v in sorted(above, reverse=True):
        wanted[v] = seen
        seen += above[v]
    assert got == {i: wanted[v] for i, v in values.items()}


def test_ranks_store_distinct_values_only(spark, monkeypatch):
    from fieldledger.plans import ordering

    stored = []

    def kept(df):
        stored.append(df.checkpoint())
        return stored[-1]

    monkeypatch.setattr(ordering, "cut", kept)
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("v"))
    assert ranked(df, "v", "rank").where("rank = 1").count() == 3000 // 7
    assert [s.count() for s in stored] == [7]


def test_replicate(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 25_001)], "k STRING, n BIGINT")
    assert {r.k: r["count"] for r in replicate(df, "n").groupBy("k").count().collect()} == {"a": 1, "b": 3, "c": 25_001}


def test_farmer_page_leaves_out_histories_without_a_profile(made):
    tables = made(
        person=[person(1)],
        farmer=[farmer("F1", 1), farmer("F2", 2)],
        loan=[loan(1, "F1"), loan(2, "F2")],
        repayment=[{"loan_no": 1, "payment_state": "OVERDUE"}, {"loan_no": 2}, {"loan_no": 3}],
        purchase=[{"purchase_id": 1, "farmer_code": "F1"}, {"purchase_id": 2, "farmer_code": "F2"}],
    )
    wanted = [("F1", "loan"), ("F1", "profile"), ("F1", "purchase"), ("F1", "repayment")]
    assert rows(op.farmer_page(tables), "farmer_code", "section") == wanted
    assert rows(op.farmer_page(tables, "F1"), "farmer_code", "section") == wanted
    assert op.farmer_page(tables, "F2").count() == 0
    page = {r.section: r for r in op.farmer_page(tables, language="en").collect()}
    assert page["repayment"].payment_state == "Overdue"
    assert (page["profile"].referred_by, page["purchase"].transaction_reference) == ("N/A", "N/A")


AGENT_SCOPED = [op.agent_dashboard, op.agent_page, op.dashboard_defaults, op.agent_lookup, op.my_farmers,
                op.my_farmers_count, op.my_farmers_page]
CENTER_SCOPED = [op.pending_kyc_count, op.pending_kyc, op.pending_loans, op.inventory_status, op.inventory_page,
                 op.outreach, op.pending_purchases]
FARMER_SCOPED = [op.farmer_detail, op.farmer_loans, op.farmer_repayments, op.farmer_purchases, op.farmer_page]


@pytest.mark.parametrize("operator", AGENT_SCOPED + CENTER_SCOPED + FARMER_SCOPED, ids=lambda f: f.__name__)
def test_scoped_equals_filtered(operator, star):
    if operator in AGENT_SCOPED:
        key, scope = "person_id", 200_000_000_000_007
    elif operator in CENTER_SCOPED:
        key, scope = "center_code", "C003"
    else:
        key, scope = "farmer_code", "F00000105"
    more = {"as_of": AS_OF} if operator is op.outreach else {}
    scoped = operator(star, scope, **more)
    everything = operator(star, **more).where(F.col(key) == scope)
    columns = [c for c in everything.columns if c in scoped.columns]
    assert set(everything.columns) - set(columns) <= {key, "agent_code"}
    assert set(scoped.columns) <= set(columns)
    got = rows(scoped, *columns)
    assert got and got == rows(everything, *columns)


def test_scoped_lists_are_sorted(star):
    def listed(df, column):
        return [r[column] for r in df.collect()]

    dates = {r.farmer_code: r.registration_date for r in star["farmer"].collect()}
    codes = listed(op.pending_kyc(star, "C003"), "code")
    assert codes == sorted(codes, key=lambda c: (dates[c], c))
    days = listed(op.outreach(star, "C003", AS_OF), "days_since_reg")
    assert days == sorted(days, reverse=True)
    codes = listed(op.my_farmers(star, 200_000_000_000_007), "code")
    assert codes == sorted(codes)
    posts = listed(op.community_posts(star, ordered=True), "post_date")
    assert posts == sorted(posts, reverse=True)
    loans = {r.loan_no: r.application_date for r in star["loan"].collect()}
    ids = listed(op.pending_loans(star, "C003"), "loan_id")
    assert ids == sorted(ids, key=lambda n: (loans[n] is None, loans[n] or datetime.max, n))


def test_unscoped_lists_can_be_sorted_too(star):
    got = [(r.center_code, r.item) for r in op.inventory_status(star, ordered=True).collect()]
    assert [g[0] for g in got] == sorted(g[0] for g in got)
