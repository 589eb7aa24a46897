from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract
from checks.compare import duck
from fieldledger.schemas import SCHEMAS
from fieldledger.session import build_session
from fieldledger.sources import Tables, star_tables

DATA = "/root/testdata/sf0.01"


def field_queries() -> list[str]:
    """The registered queries but those on training data, which have tests of their own."""
    return [n for n in contract.queries() if not re.match(r"op\d+_|pipeline$", n)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    return star_tables(spark, DATA)


@pytest.fixture(scope="session")
def connection():
    return duck(DATA)


@pytest.fixture
def made(spark):
    """Tables from hand-made rows, given as dictionaries; missing columns are NULL."""

    def build(**tables: list[dict]) -> Tables:
        openers = {}
        for name, ddl in SCHEMAS.items():
            names = [part.split()[0] for part in ddl.replace("(18,2)", "").replace("(12,2)", "").split(", ")]
            rows = [tuple(row.get(n) for n in names) for row in tables.get(name, [])]
            openers[name] = lambda rows=rows, ddl=ddl: spark.createDataFrame(rows, ddl)
        return Tables(openers)

    return build


@pytest.fixture
def settings(spark):
    """Change runtime settings for one test."""
    before = {}

    def change(**values: str) -> None:
        for key, value in values.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)
