import itertools
import time
from pathlib import Path

import numpy as np
import pyarrow as pa

from fieldledger.llm import common, jaccard_join
from fieldledger.llm.common import told
from tests.llm.helpers import cases, documents, edited, ordered, prose, spaced


def brute(rows):
    sets = []
    for doc_id, text, *_ in rows:
        w = spaced(text)
        sets.append((doc_id, frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, (a, x)), (j, (b, y)) in itertools.combinations(enumerate(sets), 2):
        near = x and y and a is not None and b is not None and 100 * len(x & y) >= 85 * len(x | y)
        if near or (a is not None and a == b):
            parent[root(i)] = root(j)
    least = {}
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[root(i)] = min(a, least.get(root(i), a))
    return sorted(
        ((a, len(x), None if a is None else least[root(i)]) for i, (a, x) in enumerate(sets)), key=repr
    )


def found(docs):
    return ordered(jaccard_join.similar(docs), "doc_id", "n_shingles", "component_id")


def test_cases_equal_brute_force(spark):
    assert found(documents(spark, clashing=True)) == brute(cases())


def test_chains_and_sizes_at_the_threshold(spark):
    text = prose(5, 60)
    texts, now = [], text
    for i in range(25):  # each one near the one before, far from the first
        texts.append(now)
        now = edited(now, i, 1)
    words = prose(6, 12).split(" ")
    texts += [" ".join(words[:n]) for n in range(1, 13)]
    texts += [" ".join(words[:9] + [f"w{i}"]) for i in range(5)]
    rows = [(100 - i, t, None, None, None) for i, t in enumerate(texts)]
    assert found(documents(spark, rows)) == brute(rows)


def test_blocks_and_small_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 1)
    monkeypatch.setattr(jaccard_join, "CANOPY", 20)
    base = prose(9, 70)
    rows = [(i, edited(base, i, 1 + i % 3), None, None, None) for i in range(60)]
    assert found(documents(spark, rows)) == brute(rows)


def test_empty_and_empty_texts(spark):
    assert found(documents(spark, [])) == []
    rows = [(1, "", None, None, None), (2, None, None, None, None), (3, " \n", None, None, None)]
    assert found(documents(spark, rows)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_boundary_follows_the_cost():
    few_lists = jaccard_join.boundary([(n, 100) for n in range(1, 400)], 0.0)
    long_lists = jaccard_join.boundary([(n, 100) for n in range(1, 400)], 30.0)
    assert 0 <= few_lists < long_lists
    assert jaccard_join.boundary([], 1.0) == 0


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (1, 7, 60, 300, 5000)]
    sets += [np.unique(np.concatenate((sets[3][:200], sets[4][:100]))), np.arange(900, dtype=np.uint64)]
    bound = jaccard_join.most_shared(*[[jaccard_join.sketch(s) for s in sets]] * 2)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert bound[i, j] >= len(np.intersect1d(x, y))
    few = jaccard_join.most_shared([jaccard_join.sketch(sets[3])], [jaccard_join.sketch(sets[5])])[0, 0]
    assert few < 0.95 * 300


def test_a_list_ties_only_members_that_may_link(spark):
    rng = np.random.default_rng(4)
    families = [np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)) for _ in range(3)]
    sets = [s[i:] for s in families for i in range(4)]
    columns = [[7] * 12, range(12), [len(s) for s in sets], [jaccard_join.sketch(s).tobytes() for s in sets], range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "set", "n", "sketch", "label"])
    rows = [r for b in jaccard_join._pruned([batch], 85) for r in b.to_pylist()]
    assert {r["set"]: r["root"] // 4 for r in rows} == {i: i // 4 for i in range(12)}
    assert len({r["root"] for r in rows}) == 3


def test_texts_in_question_are_not_shuffled(spark, monkeypatch):
    """Rows known by a filter stay where they are; doubtful ones are told by a join, whatever the size of the filter."""
    ids = spark.range(3000).selectExpr("id as doc_id")
    chosen, others = ids.where("doc_id % 3 = 0"), ids.where("doc_id % 3 > 0")
    sure, doubtful = told(ids.withColumnRenamed("doc_id", "a"), "a", chosen, others)
    assert "hashpartitioning" not in sure._jdf.queryExecution().executedPlan().toString()
    assert sure.count() == 1000 and doubtful.count() == 0
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 10)
    sure, doubtful = told(ids.withColumnRenamed("doc_id", "a"), "a", chosen, others)
    assert doubtful.count() > 0
    assert sorted(r["a"] for r in sure.unionByName(doubtful).collect()) == list(range(0, 3000, 3))


def test_a_crowd_of_near_copies_is_dealt_once(spark, monkeypatch):
    """More sets than ``CANOPY`` whose lists hold nearly the same ones: each went once per list."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "CANOPY", 20)
    kept = {}

    def saved(df, label):
        kept[label] = common.saved(df, label)
        return kept[label]

    monkeypatch.setattr(jaccard_join, "saved", saved)
    text = prose(5, 200)
    rows = [(i, edited(text, i, i % 10), None, None, None) for i in range(80)]
    assert found(documents(spark, rows)) == brute(rows)
    groups = kept["groups"]
    sets = groups.select("set").distinct().count()
    assert sets > 20
    assert groups.count() == sets


def test_a_loose_canopy_goes_by_its_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "CANOPY", 20)
    # A chain of 40 lists of two sets, and 30 sets in two lists each that hold all but one of them.
    chain = [(1, token, token + i, 10, token + i, None) for token in range(40) for i in range(2)]
    crowd = [(100, 100 + k, 100 + i, 10, min(100 + i, 120), None) for k in range(2) for i in range(30) if i != k]
    columns = "canopy long, token long, set long, n int, label long, root long"
    rows = jaccard_join._grouped(spark.createDataFrame(chain + crowd, columns)).collect()
    assert sorted((r.group.number, r.set) for r in rows if r.group.kind == 0) == sorted((t, s) for _, t, s, *_ in chain)
    assert sorted(r.set for r in rows if r.group.kind == 1) == list(range(100, 130))


def test_blocks_of_one_component_meet_the_others_only(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = [(1, i, min(i, 2), 10) for i in range(14)] + [(2, i, i, 10) for i in range(14)]
    rows += [(3, i, 0, 10) for i in range(14)]
    found = jaccard_join._dealt_to(spark.createDataFrame(rows, "group long, set long, label long, n int"))
    assert sorted((r.group, r.main, r.mains, r.others, r.sent) for r in found.collect()) == [(1, 2, 3, 1, 200), (2, None, 0, 4, 560)]


def test_shuffles_of_a_saved_table_go_with_it(spark):
    def shuffled():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f.name for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data")}

    before = shuffled()
    table = common.saved(spark.range(10_000).repartition(7, "id").groupBy("id").count(), "numbers")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert table.count() == 10_000
    files = [Path(f.removeprefix("file://")) for f in table.inputFiles()]
    common.spent(table)
    assert files and not any(f.exists() for f in files)


def test_a_short_set_in_a_list_keeps_no_unrelated_long_ones(spark):
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (40, 42, 5000, 5050, 5100, 9000)]
    sets += [sets[2][25:], sets[5][:8150], sets[5][900:]]
    marks, sizes = [jaccard_join.sketch(s) for s in sets], np.array([len(s) for s in sets])
    columns = [[7] * len(sets), range(len(sets)), sizes, [m.tobytes() for m in marks], range(len(sets))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "set", "n", "sketch", "label"])
    long = {r["set"] for b in jaccard_join._pruned([batch], 80) for r in b.to_pylist()} - {0, 1}
    assert long == {2, 5, 6, 7, 8}
    bound = jaccard_join.shared_by_pair(marks, sizes, 80)
    for (i, x), (j, y) in itertools.permutations(enumerate(sets), 2):
        if 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
            assert bound[i, j] >= len(np.intersect1d(x, y))
