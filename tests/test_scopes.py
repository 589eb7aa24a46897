"""Scoped forms: pruned below their aggregations, equal to the filtered whole, and strict about second rows."""

import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldledger import functions as fn
from fieldledger import operators as op
from fieldledger.plans import replicate
from fieldledger.sources import parquet_tables
from fieldledger.sources.parquet import table_path
from tests.test_plans import initial_plan

AGENT, CENTER = 200_000_000_000_007, "C003"


@pytest.mark.parametrize(
    ("build", "facts"),
    [
        (lambda t: op.my_farmers(t, AGENT), 3),
        (lambda t: op.agent_page(t, AGENT), 2),
        (lambda t: op.pending_kyc_count(t, CENTER), 1),
        (lambda t: op.pending_kyc(t, CENTER), 2),
        (lambda t: op.outreach(t, CENTER), 2),
        (lambda t: op.pending_purchases(t, CENTER), 2),
    ],
)
def test_fact_tables_are_cut_to_the_scope_below_their_aggregations(star, build, facts):
    text = initial_plan(build(star))
    assert len(re.findall("LeftSemi", text)) >= facts
    lines = text.splitlines()
    for n, line in enumerate(lines):
        if "partial_" not in line or "partial_first" in line:
            continue
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        below = []
        for other in lines[n + 1 :]:
            if len(other) - len(other.lstrip(" :+-*()0123456789")) <= depth:
                break
            below.append(other)
        if any(re.search(r"FileScan.*(orders|lineitem)", b) for b in below):
            assert any("LeftSemi" in b for b in below)


def agent(n, **more):
    return {"agent_code": f"A{n}", "person_id": 1, "center_code": "C1", "is_active": "YES"} | more


def test_a_second_row_is_an_error(made):
    t = made(field_agent=[agent(1), agent(2)], person=[{"person_id": 1}], center=[{"center_code": "C1"}])
    for build in (op.agent_dashboard, op.agent_page, op.agent_lookup):
        with pytest.raises(PySparkException, match="more than one"):
            build(t, 1).collect()
    assert op.agent_lookup(t, 2).collect() == []
    farmers = [{"farmer_code": "F1", "person_id": 1}, {"farmer_code": "F1", "person_id": 1}]
    with pytest.raises(PySparkException, match="more than one"):
        op.farmer_detail(made(farmer=farmers, person=[{"person_id": 1}]), "F1").collect()


def test_an_agent_without_a_code(made):
    t = made(
        field_agent=[agent(1, agent_code=None)], person=[{"person_id": 1}], center=[{"center_code": "C1"}],
        farmer=[{"farmer_code": "F1", "center_code": "C1"}],
    )
    for page in (op.dashboard_defaults(t), op.dashboard_defaults(t, 1)):
        row = page.first()
        assert (row.agent_code, row.pending_kyc) == ("N/A", 0)


def test_a_moment_with_a_zone(spark):
    moment = datetime(2002, 1, 2, 3, tzinfo=timezone(timedelta(hours=6)))
    assert spark.range(1).select(fn.as_of_column(moment)).first()[0] == datetime(2002, 1, 1, 21)


def test_blank_text_of_other_tools(spark, tmp_path):
    rows = [("F1", ""), ("F2", "VERIFIED")]
    df = spark.createDataFrame(rows, "farmer_code STRING, identity_verified STRING")
    df.write.parquet(table_path(str(tmp_path), "kyc"))
    read = [
        parquet_tables(spark, str(tmp_path), blank_is_null=b)["kyc"].where("identity_verified is null").count()
        for b in (False, True)
    ]
    assert read == [0, 1]


def test_copies_of_one_row_are_made_by_many_tasks(spark):
    one = spark.createDataFrame([("F1", 300_000), ("F2", 2)], "farmer_code STRING, copies BIGINT")
    rows = replicate(one, "copies").withColumn("part", F.spark_partition_id())
    per_task = [r["count"] for r in rows.groupBy("part").count().collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(per_task) == 300_002 and max(per_task) <= 1.5 * 300_000 / parts
