import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldledger.llm import suffix_dedup
from tests.llm.helpers import cases, documents, ordered, prose


def brute(rows, length=400):
    texts = [(r[1] or "").encode() for r in rows]
    starts = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - length + 1):
            starts.setdefault(t[k : k + length], []).append((i, k))
    marks = [bytearray(len(t)) for t in texts]
    for places in starts.values():
        for i, k in places if len(places) > 1 else ():
            marks[i][k : k + length] = b"\1" * length
    out = []
    for r, t, m in zip(rows, texts, marks, strict=True):
        kept = bytes(b for b, gone in zip(t, m, strict=True) if not gone)
        runs = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out.append((r[0], len(t), sum(m), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(docs, **more):
    cut = suffix_dedup.cut_out(docs, **more).withColumn("sha", F.sha2("kept", 256))
    return ordered(cut, "doc_id", "n_bytes", "n_removed", "n_spans", "sha")


def overlapping():
    passage, long = prose(1, 100), prose(2, 400)
    texts = [prose(10 + i, 40) + " " + passage + " " + prose(30 + i, 40) for i in range(9)]
    texts += [long, long[:900] + "X" + long[901:], long[300:], prose(5, 50) + long[500:1000]]
    texts += ["=" * n for n in (399, 400, 401, 2000)] + ["abc" * 300, prose(6, 200) * 2, long[100:499], long[100:500]]
    return [(i, t, None, None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 1, 3])
def test_passages_runs_and_copies(spark, crowd):
    assert found(documents(spark, overlapping()), crowd=crowd) == brute(overlapping())


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_segments_of_an_anchor_meet_beside_crowded_ones(spark, settings, broadcast):
    """With several map tasks, whichever way adaptive execution joins and splits."""
    settings(
        spark__sql__shuffle__partitions="8",
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold=broadcast,
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="4k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="4k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.1",
    )
    rows = overlapping() + [(100 + i, prose(100 + i, 30) + " " + prose(200 + i // 2, 90) + " " + prose(300 + i, 30), None, None, None) for i in range(60)]
    assert found(documents(spark, rows), crowd=3) == brute(rows)


@pytest.mark.parametrize("length", [60, 200])
def test_other_lengths(spark, length):
    rows = overlapping() + [(50 + i, prose(70 + i, 30) + " " + prose(99, 51) + " " + prose(80 + i, 30), None, None, None) for i in range(3)]
    want = brute(rows, length)
    assert found(documents(spark, rows), length=length) == want and sum(r[2] > 0 for r in want[-3:]) == 3


def test_cases(spark):
    assert found(documents(spark, clashing=True)) == brute(cases())


def test_batches_of_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 3)
    rows = []
    for batch in [suffix_dedup._by_columns(batches(overlapping()[:9], n), suffix_dedup.shape()) for n in (1000, 2)]:
        rows.append(sorted(tuple(r.values()) for b in batch for r in b.to_pylist()))
    assert rows[0] == rows[1] and rows[0]


def batches(rows, size=1000):
    """The segments of all anchors of some texts as sorted batches."""
    import pyarrow as pa

    data = "".join(r[1] for r in rows).encode()
    offsets = np.concatenate(([0], np.cumsum([len(r[1].encode()) for r in rows])))
    at, grams = suffix_dedup.anchors(np.frombuffer(data, np.uint8), offsets, suffix_dedup.shape())
    owner = np.searchsorted(offsets, at, "right") - 1
    found = []
    for i, (a, g, o) in enumerate(zip(at.tolist(), grams.view(np.int64).tolist(), owner, strict=True)):
        low, high = max(a - suffix_dedup.shape().before, int(offsets[o])), min(a + 400, int(offsets[o + 1]))
        found.append({"anchor": g, "segment": i, "n": 1, "before": a - low, "bytes": data[low:high]})
    found.sort(key=lambda r: (r["anchor"], r["segment"]))
    return pa.Table.from_pylist(found).to_batches(max_chunksize=size)


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(4)
    inner = rng.integers(97, 101, 400, dtype=np.uint8)
    places = []
    for i in range(20):
        before = rng.integers(97, 101, 50 + 13 * i, dtype=np.uint8)
        data = np.concatenate((before, inner, rng.integers(97, 101, 300, dtype=np.uint8)))
        at, _ = suffix_dedup.anchors(data, np.array([0, len(data)]), suffix_dedup.shape())
        places.append({int(a) - len(before) for a in at if 0 <= a - len(before) <= suffix_dedup.shape().before})
    assert set.intersection(*places)


def test_cleaned_keeps_columns_and_characters(spark):
    # The first letters share their last byte only.
    shared = "é" * 3 + prose(8, 120)
    rows = [(1, "ä" + shared, "en", "s", 1), (2, "Ĥ" + shared, "en", "s", 2), (3, None, None, None, None)]
    docs = documents(spark, rows, clashing=True)
    out = suffix_dedup.cleaned(docs)
    assert out.columns == docs.columns
    assert ordered(out, "doc_id", "text") == [(1, ""), (2, ""), (3, None)]


def test_empty_table(spark):
    assert found(documents(spark, [])) == []
