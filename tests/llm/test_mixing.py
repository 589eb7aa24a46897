import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldledger.llm import mixing
from tests.llm.helpers import documents, ordered, prose, spaced


def test_targets_share_all_words_and_stop_at_three_sizes():
    sizes = [1000, 10, 500, 0, 30]
    weights = [1, 2, 3, 1, 2]
    got = mixing.targets(sizes, weights, 3.0)
    assert sum(got) == pytest.approx(sum(sizes))
    assert got[1] == 30 and got[3] == 0 and got[4] == 90
    assert got[0] / got[2] == pytest.approx(1 / 3)
    assert mixing.targets([], [], 3.0) == [] and mixing.targets([0, 0], [1, 2], 3.0) == [0, 0]


def test_tree_gives_every_unit_to_one_shard():
    counts = np.array([7, 0, 100, 1, 33])
    held = [mixing.quotas(counts, 6, s, 5) for s in range(6)]
    for source, count in enumerate(counts):
        ranges = sorted((int(f[source]), int(n[source])) for f, n in held if n[source])
        assert [f for f, _ in ranges] == list(np.cumsum([0, *[n for _, n in ranges]])[:-1])
        assert sum(n for _, n in ranges) == count
    sizes = [int(n.sum()) for _, n in held]
    assert sum(sizes) == counts.sum() and max(sizes) - min(sizes) <= 3


def weighed(spark, docs):
    plan = mixing.plan(docs, shards=5)
    drawn = mixing.draw(docs, plan)
    return mixing.weighed(docs, plan), drawn, plan


def test_sizes_limits_and_reruns(spark):
    docs = documents(spark, clashing=True)
    per_doc, drawn, _ = weighed(spark, docs)
    rows = per_doc.select("row.doc_id", "row.text", "size", "source_size", "copies", "key").collect()
    assert all(r["size"] == len(spaced(r["text"])) for r in rows)
    assert all(0 <= r["copies"] <= 3 for r in rows)
    taken = {}
    for r in drawn.select("key", "pass").collect():
        taken.setdefault(r["key"], []).append(r["pass"])
    for r in rows:
        passes = taken.get(r["key"], [])
        assert set(passes) == set(range(r["copies"]))
    again = mixing.draw(docs, mixing.plan(docs, shards=5))
    assert ordered(drawn, "key", "pass", "shard") == ordered(again, "key", "pass", "shard")
    assert drawn.select("row.*").columns == docs.columns


def test_sources_come_near_their_targets(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randint(1, 60)), "en", f"s{i % 4}" if i % 5 else None, 0) for i in range(600)]
    docs = documents(spark, rows)
    per_doc, drawn, plan = weighed(spark, docs)
    got = {r[0]: r[1] for r in drawn.select("row.*").withColumn("w", mixing.word_count(F.col("text"))).groupBy("source").sum("w").collect()}
    for r in plan.sources.collect():
        assert abs(got[r["_name"]] - r["target"]) <= 3
    names = [r["_name"] for r in plan.sources.orderBy("_rank").collect()]
    assert names == ["s0", "s1", "s2", "s3", None]


def test_empty_table(spark):
    docs = documents(spark, [])
    _, drawn, _ = weighed(spark, docs)
    assert drawn.count() == 0
