"""The domain tables derived from a star schema of trade tables and an event log.

The modulus conditions give every rule rows to work on: missing names, hyphenated names, missing
application dates, month-end approvals, missing KYC rows, agents without a center, farmers without
loans, missing payment states and an unknown loan state. ``checks/views.py`` states the same
mapping as SQL.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldledger.sources.tables import Tables

# Person ids of farmers and agents start here; the gap keeps them apart at any table size.
FARMER_PERSON = 100_000_000_000_000
AGENT_PERSON = 200_000_000_000_000


def _digits(number: str, width: int, fill: str = "0") -> str:
    """SQL text: the number padded to ``width``; longer numbers keep all their digits."""
    text = f"cast({number} as string)"
    return f"lpad({text}, greatest({width}, length({text})), '{fill}')"


def _code(prefix: str, number: str, width: int) -> str:
    return f"'{prefix}' || {_digits(number, width)}"


# Schemas by application and path, so that the file footers are read once and not by every query.
_schemas: dict[tuple[str, str], T.StructType] = {}


def read_star(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def star_tables(spark: SparkSession, folder: str) -> Tables:
    raw = Tables(
        {
            name: (lambda name=name: read_star(spark, folder, name))
            for name in (
                "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
            )
        }
    )

    @cache
    def supplier_count() -> Column:
        return raw["supplier"].agg(F.count(F.lit(1))).scalar()

    def code_of(prefix: str, number: Column, width: int) -> Column:
        text = number.cast("string")
        return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))

    def agent_of(number: str) -> Column:
        return code_of("A", F.col(number) % supplier_count(), 6)

    def center() -> DataFrame:
        return raw["nation"].selectExpr(f"{_code('C', 'n_nationkey', 3)} center_code", "n_name center_name")

    def field_agent() -> DataFrame:
        return raw["supplier"].selectExpr(
            f"{_code('A', 's_suppkey', 6)} agent_code",
            f"{AGENT_PERSON} + s_suppkey person_id",
            f"case when s_suppkey % 13 = 12 then null else {_code('C', 's_nationkey', 3)} end center_code",
            "case when s_suppkey % 10 = 9 then 'NO' else 'YES' end is_active",
            "cast(date_add(date '1994-01-01', cast(s_suppkey * 17 % 365 as int)) as timestamp_ntz) join_date",
        )

    def farmer() -> DataFrame:
        return raw["customer"].select(
            F.expr(_code("F", "c_custkey", 8)).alias("farmer_code"),
            F.expr(f"{FARMER_PERSON} + c_custkey").alias("person_id"),
            agent_of("c_custkey").alias("agent_code"),
            F.expr(_code("C", "c_nationkey", 3)).alias("center_code"),
            F.expr(
                "cast(date_add(date '1995-01-01', cast(c_custkey * 37 % 2000 as int)) as timestamp_ntz)"
            ).alias("registration_date"),
            F.expr("case when c_custkey % 17 = 0 then 'INACTIVE' else 'ACTIVE' end").alias("account_status"),
        )

    def person() -> DataFrame:
        farmers = raw["customer"].selectExpr(
            "c_nationkey nation_key",
            f"{FARMER_PERSON} + c_custkey person_id",
            "case when c_custkey % 5 = 0 then 'md. abdul-' || lower(c_mktsegment) "
            "else lower(c_mktsegment) end first_name",
            "case when c_custkey % 6 = 0 then null else lower(c_name) end last_name",
            f"'01' || cast(3 + c_custkey % 7 as string) || {_digits('c_custkey', 8)} login_phone",
            "'farmer_' || cast(c_custkey as string) username",
            "'FARMER' role",
            f"case when c_custkey % 9 = 0 then null else {_digits('c_custkey', 10, '1')} end nid",
            "case when c_custkey % 2 = 0 then 'M' else 'F' end gender",
            "'village ' || cast(c_custkey % 100 as string) village",
        )
        agents = raw["supplier"].selectExpr(
            "s_nationkey nation_key",
            f"{AGENT_PERSON} + s_suppkey person_id",
            "'agent' first_name",
            "lower(s_name) last_name",
            f"'01' || cast(3 + s_suppkey % 7 as string) || {_digits('90000000 + s_suppkey', 8)} login_phone",
            "'agent_' || cast(s_suppkey as string) username",
            "'AGENT' role",
            f"{_digits('s_suppkey', 10, '2')} nid",
            "'F' gender",
            "'village 0' village",
        )
        # Two small tables of known file size, joined one after the other: both are broadcast.
        return (
            farmers.unionByName(agents)
            .join(raw["nation"], F.col("nation_key") == F.col("n_nationkey"))
            .join(raw["region"], F.col("n_regionkey") == F.col("r_regionkey"))
            .selectExpr(
                "person_id", "first_name", "last_name", "login_phone", "username", "role",
                "cast(null as timestamp_ntz) last_login", "nid", "gender", "village",
                "lower(n_name) upazila", "lower(r_name) district",
            )
        )

    def phone() -> DataFrame:
        return tables["person"].selectExpr(
            "person_id", "login_phone phone_number", "'PERSONAL' phone_type", "'YES' is_primary"
        )

    def kyc() -> DataFrame:
        base = (
            raw["customer"]
            .where("c_custkey % 5 <> 4")
            .select(
                F.col("c_custkey").alias("kyc_id"),
                F.expr(_code("F", "c_custkey", 8)).alias("farmer_code"),
                F.when(F.col("c_custkey") % 11 != 0, agent_of("c_custkey")).alias("agent_code"),
                F.expr(
                    "case when c_custkey % 7 <= 2 then 'VERIFIED' when c_custkey % 7 = 3 then 'REJECTED' "
                    "when c_custkey % 7 <= 5 then 'PENDING' end"
                ).alias("identity_verified"),
            )
        )
        decided = "identity_verified in ('VERIFIED', 'REJECTED')"
        verified = "identity_verified = 'VERIFIED'"
        return base.selectExpr(
            "*",
            f"case when {decided} then agent_code end verified_by",
            f"case when {decided} then "
            "cast(date_add(date '1999-01-01', cast(kyc_id % 300 as int)) as timestamp_ntz) end verified_date",
            "cast(null as string) remarks",
            f"case when {verified} then 'nf_' || cast(kyc_id as string) end nid_front_ref",
            f"case when {verified} then 'nb_' || cast(kyc_id as string) end nid_back_ref",
            "cast(null as string) land_dolil_ref",
            f"case when {verified} then 'PENDING' end land_legal_status",
        )

    # Every order is a loan or a purchase. Some farmers have no loan, others no purchase: theirs go to a neighbour.
    borrower = "case when o_custkey % 4 = 0 then o_custkey + 1 else o_custkey end"
    buyer = "case when o_custkey % 3 = 2 then o_custkey - 1 else o_custkey end"

    def loan() -> DataFrame:
        day = "cast(cast(o_orderdate as date) as timestamp_ntz)"
        return (
            raw["orders"]
            .where("o_orderkey % 3 = 0")
            .selectExpr(
                "o_orderkey loan_no",
                f"{_code('F', borrower, 8)} farmer_code",
                "cast(o_totalprice as decimal(18,2)) amount",
                "cast(5 + o_orderkey % 10 as double) interest_rate",
                "cast(6 + o_orderkey % 31 as int) tenure_months",
                "lower(o_orderpriority) purpose",
                "case when o_orderkey % 41 = 0 then 'DEFAULTED' when o_orderstatus = 'P' then 'PENDING' "
                "when o_orderstatus = 'O' then 'ACTIVE' else 'CLOSED' end loan_state",
                f"case when o_orderkey % 50 = 0 then null else {day} end application_date",
                f"case when o_orderstatus = 'P' then null else {day} + interval '7' day end approval_date",
                f"case when o_orderstatus = 'P' then null else {day} + interval '10' day end disbursement_date",
            )
        )

    def repayment() -> DataFrame:
        return (
            raw["lineitem"]
            .where("l_orderkey % 3 = 0")
            .selectExpr(
                "l_orderkey loan_no",
                "l_linenumber installment_no",
                "cast(l_extendedprice as decimal(18,2)) amount_paid",
                "cast(l_shipdate as timestamp_ntz) payment_date",
                "case when l_returnflag = 'A' then 'BKASH' when l_returnflag = 'N' then 'CASH' "
                "else 'BANK' end payment_method",
                "case when l_linestatus = 'F' then 'PAID' when l_returnflag = 'R' then 'OVERDUE' "
                "else 'DUE' end payment_state",
                "cast(l_quantity * 10 as decimal(18,2)) late_fee",
            )
        )

    def purchase() -> DataFrame:
        return (
            raw["orders"]
            .where("o_orderkey % 3 <> 0")
            .withColumn("buyer", F.expr(buyer))
            .select(
                F.col("o_orderkey").alias("purchase_id"),
                F.expr(_code("F", "buyer", 8)).alias("farmer_code"),
                agent_of("buyer").alias("agent_code"),
                F.expr("cast(o_orderdate as timestamp_ntz)").alias("purchase_date"),
                F.expr(
                    "case when o_orderpriority = '4-NOT SPECIFIED' then null else substr(o_orderpriority, 3) end"
                ).alias("payment_method"),
                F.expr(
                    "case when o_orderkey % 43 = 0 then null when o_orderstatus = 'P' then 'CONFIRMED' "
                    "when o_orderstatus = 'F' then 'DELIVERED' when o_orderkey % 2 = 0 then 'CANCELLED' "
                    "else 'PENDING' end"
                ).alias("payment_status"),
                F.expr(
                    "case when o_orderkey % 5 = 0 then null else 'TX' || cast(o_orderkey as string) end"
                ).alias("transaction_reference"),
            )
        )

    def ordered_item() -> DataFrame:
        return (
            raw["lineitem"]
            .where("l_orderkey % 3 <> 0")
            .selectExpr(
                "l_orderkey purchase_id", "l_partkey item_id", "cast(l_extendedprice as decimal(18,2)) total_cost"
            )
        )

    def inventory() -> DataFrame:
        return raw["part"].selectExpr(
            "p_partkey item_id",
            f"{_code('C', 'p_partkey % 25', 3)} center_code",
            "p_name name",
            "p_size - 1 quantity",
            "cast(p_retailprice as decimal(12,2)) unit_price",
        )

    def community_post() -> DataFrame:
        return raw["documents"].selectExpr(
            "doc_id post_id",
            "text content",
            "cast(date_add(date '2024-01-01', cast(doc_id % 400 as int)) as timestamp_ntz) post_date",
        )

    def kyc_decision() -> DataFrame:
        return decisions_of(raw["events"], supplier_count())

    def login_event() -> DataFrame:
        return logins_of(raw["events"])

    def registration_application() -> DataFrame:
        return (
            raw["events"]
            .where("event_type = 'signup'")
            .selectExpr(
                "event_id application_id",
                "cast(ts as timestamp_ntz) submitted_at",
                "case event_id % 6 when 0 then ' farmer ' when 1 then 'AGENT' when 2 then 'advisor' "
                "when 3 then 'ADMIN' when 4 then 'guest' else 'FARMER' end role",
                "case when event_id % 8 = 0 then '  ' else 'rahim' end first_name",
                "case when event_id % 2 = 0 then '' else 'mia' end last_name",
                f"case when user_id % 10 = 0 then '012' || {_digits('user_id', 8)} "
                f"when user_id % 3 = 0 then '01' || cast(3 + user_id % 7 as string) || {_digits('user_id', 8)} "
                "else '019' || cast(10000000 + user_id as string) end phone",
                "case when user_id % 4 = 1 then 'farmer_' || cast(user_id as string) "
                "else 'new_' || cast(user_id as string) end username",
                "case when event_id % 7 = 0 then 'abc' else 'pass' end password",
                "case when event_id % 7 = 0 then 'abc' when event_id % 9 = 0 then 'word' "
                "else 'pass' end confirm_password",
            )
        )

    tables = Tables(
        {
            build.__name__: build
            for build in (
                center, field_agent, farmer, person, phone, kyc, loan, repayment, purchase, ordered_item,
                inventory, community_post, kyc_decision, login_event, registration_application,
            )
        }
    )
    return tables


def decisions_of(events: DataFrame, agent_total: Column) -> DataFrame:
    """KYC decisions in an event log; also works on a stream of events."""
    signup = "event_type = 'signup'"
    return events.where("event_type in ('signup', 'error')").select(
        F.col("event_id").alias("decision_id"),
        F.expr(_code("F", "user_id", 8)).alias("farmer_code"),
        (F.lit(AGENT_PERSON) + F.col("event_id") % agent_total).alias("person_id"),
        F.expr(f"case when {signup} then 'VERIFIED' else 'REJECTED' end").alias("decision"),
        F.expr("cast(ts as timestamp_ntz)").alias("decided_at"),
        F.expr(
            f"case when {signup} and event_id % 3 <> 0 then 'remark ' || cast(event_id as string) end"
        ).alias("remarks"),
        F.expr(f"case when {signup} then 'front_' || cast(event_id as string) end").alias("nid_front_ref"),
        F.expr(
            f"case when {signup} and event_id % 2 = 0 then 'back_' || cast(event_id as string) end"
        ).alias("nid_back_ref"),
        F.expr(f"case when {signup} then 'land_' || cast(event_id as string) end").alias("land_dolil_ref"),
        F.expr(
            "case when event_type <> 'signup' then null when event_id % 3 = 0 then 'VERIFIED' "
            "when event_id % 3 = 1 then 'PENDING' else 'NOT_APPLICABLE' end"
        ).alias("land_legal_status"),
    )


def logins_of(events: DataFrame) -> DataFrame:
    """Login attempts in an event log; also works on a stream of events."""
    return events.where("event_type in ('view', 'click')").selectExpr(
        "event_id attempt_id",
        "case when event_id % 2 = 0 then 'farmer_' || cast(user_id as string) "
        f"else '01' || cast(3 + user_id % 7 as string) || {_digits('user_id', 8)} end identifier",
        "cast(ts as timestamp_ntz) login_at",
    )
