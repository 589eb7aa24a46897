"""The physical plans: join kinds, scans, shuffles, and how frequent keys are split."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from fieldledger import operators as op
from tests.conftest import DATA, field_queries


def initial_plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


def final_plan(df):
    """The adaptive plan after the query ran."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in text
    return text.split("\n+- == Initial Plan ==")[0]


@pytest.fixture
def shuffled_joins(settings):
    """No broadcast, as with tables too large for it."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")


BATCH = [n for n in field_queries() if not n.endswith("_stream") and not n.startswith("registration")]


@pytest.mark.parametrize("name", BATCH)
def test_no_plan_needs_python_or_compares_all_pairs(name, spark):
    text = initial_plan(contract.queries()[name](spark, DATA))
    assert not re.search(r"Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", text)


@pytest.mark.parametrize("name", BATCH)
def test_no_window_over_a_whole_table(name, spark):
    """Only partition sizes, one row per partition, may be numbered by one task."""
    text = initial_plan(contract.queries()[name](spark, DATA))
    for line in text.splitlines():
        if re.search(r" Window ", line):
            assert "_size" in line


def test_outreach_uses_an_anti_join(star, shuffled_joins):
    assert "LeftAnti" in initial_plan(op.outreach(star))


def test_dashboard_reads_each_table_once(made, shuffled_joins):
    tables = made()
    reads = {}
    counted = {n: tables[n] for n in ("farmer", "kyc", "loan", "purchase")}
    for name, frame in counted.items():
        counted[name] = frame.withColumn("farmer_code", F.concat(F.lit(f"read-{name}-"), "farmer_code"))
    text = initial_plan(op.agents.agent_counts(tables.replace(**counted)))
    for name in ("farmer", "loan"):
        reads[name] = len(re.findall(rf"concat\(read-{name}-[^)]*\) AS farmer_code", text))
    assert reads == {"farmer": 1, "loan": 1}
    assert len(re.findall(r"Exchange hashpartitioning\(agent_code", text)) == 1


def test_list_shuffles_every_table_once_by_farmer(star, shuffled_joins):
    text = initial_plan(op.my_farmers(star))
    by_farmer = len(re.findall(r"Exchange hashpartitioning\(farmer_code#\d+, \d+\)", text))
    # Farmers, loans, purchases and KYC.
    assert by_farmer == 4


def test_loans_are_reduced_before_the_shuffle(star, shuffled_joins):
    lines = initial_plan(op.my_farmers(star)).splitlines()
    partial = next(n for n, line in enumerate(lines) if "partial_max_by(" in line)
    above = next(n for n in range(partial - 1, 0, -1) if "Aggregate" in lines[n])
    assert "[max_by(" in lines[above]
    assert any("Exchange hashpartitioning(farmer_code" in line for line in lines[above:partial])


@pytest.fixture
def frequent_key(spark, star, settings, shuffled_joins):
    """Tables where farmer F00000001 and loan 6 hold a large share, and limits that call it skew."""
    settings(
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="128k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )
    text = F.sha2(F.col("id").cast("string"), 512)
    many = spark.range(0, 40_000, 1, 8)
    hot = F.lit("F00000001")
    moment = F.lit("2001-01-01").cast("timestamp_ntz")
    user = F.col("id").cast("string")
    return star.replace(
        loan=star["loan"].unionByName(
            many.select((F.col("id") + 10**9).alias("loan_no"), hot.alias("farmer_code"), text.alias("purpose"),
                        F.lit("PENDING").alias("loan_state")), allowMissingColumns=True),
        purchase=star["purchase"].unionByName(
            many.select((F.col("id") + 10**9).alias("purchase_id"), hot.alias("farmer_code"),
                        text.alias("payment_method"), F.lit("CONFIRMED").alias("payment_status")),
            allowMissingColumns=True),
        repayment=star["repayment"].unionByName(
            many.select(F.lit(6).cast("bigint").alias("loan_no"), F.col("id").cast("int").alias("installment_no"),
                        text.alias("payment_method")), allowMissingColumns=True),
        kyc=star["kyc"].unionByName(
            many.select((F.col("id") + 10**9).alias("kyc_id"), hot.alias("farmer_code"), text.alias("remarks"),
                        F.lit("PENDING").alias("identity_verified")), allowMissingColumns=True),
        login_event=star["login_event"].unionByName(
            many.select((F.col("id") + 10**9).alias("attempt_id"), F.lit("farmer_1").alias("identifier"),
                        moment.alias("login_at"))),
        registration_application=star["registration_application"].unionByName(
            many.select((F.col("id") + 10**9).alias("application_id"), moment.alias("submitted_at"),
                        F.lit("FARMER").alias("role"), F.lit("x").alias("first_name"), F.lit("").alias("last_name"),
                        F.lit("01999999999").alias("phone"), F.concat(F.lit("u"), user).alias("username"),
                        F.lit("pass").alias("password"), F.lit("pass").alias("confirm_password"))),
    )


ROW_JOINS = {
    "pending_loans": lambda t: op.pending_loans(t),
    "pending_purchases": lambda t: op.pending_purchases(t),
    "farmer_repayments": lambda t: op.farmer_repayments(t),
    "kyc_decisions": lambda t: op.apply_kyc_decisions(t["kyc"], t["kyc_decision"], t["field_agent"]),
    "login_identity": lambda t: op.resolve_login_identity(t["login_event"], t["person"]),
    "registration_check": lambda t: op.validate_registrations(t["registration_application"], t["person"]),
}


@pytest.mark.parametrize("name", list(ROW_JOINS))
def test_a_frequent_key_is_split_over_tasks(name, frequent_key):
    df = ROW_JOINS[name](frequent_key)
    assert "SortMergeJoin(skew=true)" in final_plan(df)
    assert df.count() > 40_000


def test_a_frequent_farmer_is_one_row_after_the_map_side(frequent_key):
    """Lists and counts collapse loans, orders and KYC rows before the shuffle and keep them whole."""
    tables = frequent_key
    assert op.my_farmers(tables).where("code = 'F00000001'").count() == 40_001
    assert op.my_farmers_count(tables).agg(F.max("farmers_shown")).first()[0] > 40_000
    center = tables["farmer"].where("farmer_code = 'F00000001'").first().center_code
    assert op.pending_kyc_count(tables, center).first().pending_kyc >= 40_000
    agent = op.agent_dashboard(tables).where("agent_code = 'A000001'").first()
    assert agent.pending_loans > 40_000


def test_a_frequent_phone_registers_once(frequent_key):
    t = frequent_key
    result = op.register(t["registration_application"], t["person"], t["phone"])
    assert result.person.where("login_phone = '01999999999'").count() == 1
    assert result.outcome.where("phone = '01999999999' and outcome = 'DUP_PHONE'").count() == 39_999
