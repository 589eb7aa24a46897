"""Parquet versions, table mappings and JDBC options."""

from collections.abc import Mapping

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldledger import operators as op
from fieldledger.schemas import SCHEMAS
from fieldledger.sources import (
    ManifestLog,
    PublishConflict,
    Tables,
    manifest,
    parquet_tables,
    publish,
    published_tables,
    published_version,
    write_table,
)
from fieldledger.sources.jdbc import KeyRange, conform, jdbc_tables, read_options


@pytest.fixture(scope="module")
def stored(spark, star, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    for name in SCHEMAS:
        write_table(star[name], base, name)
    return parquet_tables(spark, base)


@pytest.mark.parametrize("operator", [op.my_farmers, op.agent_page, op.pending_purchases], ids=lambda f: f.__name__)
def test_stored_tables_give_the_same(operator, stored, star):
    assert operator(stored).exceptAll(operator(star)).isEmpty()
    assert operator(star).exceptAll(operator(stored)).isEmpty()


def test_filters_and_columns_reach_the_scan(stored):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    text = plan(op.pending_loans(stored, "C003"))
    assert "PushedFilters: [IsNotNull(loan_state), EqualTo(loan_state,PENDING)" in text
    assert "EqualTo(center_code,C003)" in text
    assert "ReadSchema: struct<farmer_code:string,person_id:bigint,center_code:string>" in text
    assert "nid" not in text
    assert "EqualTo(farmer_code,F00000105)" in plan(op.farmer_loans(stored, "F00000105"))


def test_empty_text_is_stored_as_null(spark, tmp_path):
    write_table(spark.createDataFrame([("C1", ""), ("", "x")], SCHEMAS["center"]), str(tmp_path), "center")
    got = {tuple(r) for r in parquet_tables(spark, str(tmp_path))["center"].collect()}
    assert got == {("C1", None), (None, "x")}


def test_versions_stay_side_by_side(spark, tmp_path):
    base = str(tmp_path)
    for version in (1, 2):
        write_table(spark.createDataFrame([(f"C{version}", "x")], SCHEMAS["center"]), base, "center", version)
    for version in (1, 2):
        got = parquet_tables(spark, base, {"center": version})["center"].collect()
        assert [tuple(r) for r in got] == [(f"C{version}", "x")]


def test_clustered_files_have_narrow_ranges(spark, star, tmp_path, settings):
    settings(spark__sql__adaptive__enabled="false")
    path = write_table(star["loan"], str(tmp_path), "loan", cluster_by=("farmer_code", "loan_no"))
    ranges = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("farmer_code"), F.max("farmer_code"))
    bounds = sorted(tuple(r)[1:] for r in ranges.collect())
    assert len(bounds) > 1
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))


def test_tables_open_on_demand(spark):
    opened = []
    tables = Tables({n: (lambda n=n: opened.append(n) or spark.range(1)) for n in ("a", "b")})
    assert isinstance(tables, Mapping) and set(tables) == {"a", "b"} and not opened
    assert tables["a"] is tables["a"] and opened == ["a"]
    other = spark.range(2)
    changed = tables.replace(b=other)
    assert changed["b"] is other and changed["a"] is tables["a"] and opened == ["a"]


def test_jdbc_options():
    plain = read_options("jdbc:x", "LOAN", {"user": "u"})
    assert plain == {"url": "jdbc:x", "dbtable": "LOAN", "fetchsize": "10000", "user": "u"}
    split = read_options("jdbc:x", "LOAN", None, KeyRange("LOAN_NO", 1, 1000, 20))
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == (
        "LOAN_NO", "1", "1000", "20",
    )


def test_jdbc_tables_are_lazy(spark):
    assert set(jdbc_tables(spark, "jdbc:none")) == set(SCHEMAS)


def test_conform_matches_names_without_case_and_casts(spark):
    df = spark.createDataFrame([("x", "", 5)], "CENTER_NAME STRING, CENTER_CODE STRING, EXTRA INT")
    got = conform(df, SCHEMAS["center"])
    assert got.columns == ["center_code", "center_name"]
    assert tuple(got.first()) == (None, "x")


def pair(spark, n):
    person = spark.createDataFrame([(n, f"p{n}", "")], "person_id long, first_name string, last_name string")
    return {"person": person, "phone": spark.createDataFrame([(n, f"01{n}")], "person_id long, phone_number string")}


def seen(spark, base, version=None):
    tables = published_tables(spark, base, version)
    return {name: [tuple(r)[:1] for r in tables[name].collect()] for name in tables}


def test_a_pair_of_tables_appears_at_once(spark, tmp_path):
    base = str(tmp_path)
    assert published_version(spark, base) == 0 and dict(published_tables(spark, base)) == {}
    assert publish(spark, base, pair(spark, 1), {"person": ["person_id"]}) == 1
    assert seen(spark, base) == {"person": [(1,)], "phone": [(1,)]}
    assert published_tables(spark, base)["person"].first().last_name is None
    # The write dies between the two tables: the old pair stays, both of it.
    broken = pair(spark, 2)
    broken["phone"] = broken["phone"].withColumn("phone_number", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(PySparkException, match="killed"):
        publish(spark, base, broken)
    assert published_version(spark, base) == 1 and seen(spark, base) == {"person": [(1,)], "phone": [(1,)]}
    # A reader keeps the version that it opened.
    reader = published_tables(spark, base)
    assert publish(spark, base, pair(spark, 2), expected=1) == 2
    assert seen(spark, base) == {"person": [(2,)], "phone": [(2,)]}
    assert reader["phone"].first().person_id == 1 and seen(spark, base, 1)["person"] == [(1,)]
    # One table alone leaves the other.
    assert publish(spark, base, {"phone": pair(spark, 3)["phone"]}) == 3
    assert seen(spark, base) == {"person": [(2,)], "phone": [(3,)]}


def test_of_two_writers_one_wins(spark, tmp_path):
    base = str(tmp_path)
    publish(spark, base, pair(spark, 1))
    with pytest.raises(PublishConflict):
        publish(spark, base, pair(spark, 2), expected=0)
    log = ManifestLog(spark, base)
    version, content = log.latest()
    publish(spark, base, pair(spark, 3))
    with pytest.raises(PublishConflict):
        log.commit(version + 1, content)
    assert log.versions() == [1, 2] and seen(spark, base)["person"] == [(3,)]


def test_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "KEPT", 3)
    base = str(tmp_path)
    for n in range(1, 7):
        publish(spark, base, {"phone": pair(spark, n)["phone"]})
    assert ManifestLog(spark, base).versions() == [4, 5, 6]
    assert len(list((tmp_path / "phone").iterdir())) == 3
    assert [seen(spark, base, v)["phone"] for v in (4, 5, 6)] == [[(4,)], [(5,)], [(6,)]]
