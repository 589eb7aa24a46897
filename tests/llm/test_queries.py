import pytest
from pyspark.sql import functions as F

from checks.compare import duck
from fieldledger.llm import queries as llm

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got = llm.queries()[name](spark, DATA)
    cursor = duck(DATA).execute(llm.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == want


def test_every_query_returns_its_columns(spark):
    columns = {
        "op3_mixing": {"doc_id", "size", "source_size", "target", "taken"},
        "op4_ngram_jaccard_join": {"doc_id", "n_shingles", "component_id"},
        "op5_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
        "op6_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
        "op10_token_store": {"doc_id", "start", "n_tokens", "ids_crc32"},
    }
    for name, wanted in columns.items():
        out = llm.queries()[name](spark, "/root/testdata/sf0.001")
        assert set(out.columns) == wanted
        assert out.agg(F.count("*")).first()[0] == 200
