"""Keys that occur only once leave before they become rows of a shuffle.

Map tasks pack postings (numpy records with a ``key`` and a count ``seen``) by bucket of their key. A key met twice
within a part of a task is known to have a list: its postings go straight on, dealt evenly, and a single one with
``seen`` 2 tells the others. So a very frequent key sends one posting per part of a task to its bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from fieldledger.llm.common import record_batch

PACKED = pa.schema([("bucket", pa.int32()), ("sure", pa.bool_()), ("rows", pa.binary())])
PACKED_SQL = "bucket int, sure boolean, rows binary"
#: Postings that a map task holds before it deals them.
HELD = 1 << 19
_STRAIGHT = 8192


def deal(rows: np.ndarray, buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Packs the postings of a part of a task; ``turn`` spreads what goes straight on."""
    rows = rows[np.argsort(rows["key"], kind="stable")]
    same = rows["key"][1:] == rows["key"][:-1]
    first = np.concatenate(([True], ~same))
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
    sure = rows[twice]
    for k in range(0, len(sure), _STRAIGHT):
        part = sure[k : k + _STRAIGHT].tobytes()
        yield record_batch(PACKED, [(turn + k // _STRAIGHT) % buckets], [True], [part])
    single = rows[first].copy()
    single["seen"] = np.where(twice[first], 2, 1)
    bucket = (single["key"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    single, bucket = single[order], bucket[order]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    parts = [r.tobytes() for r in np.split(single, starts[1:])]
    yield record_batch(PACKED, bucket[starts].astype(np.int32), [False] * len(parts), parts)


def dealt(rows: Iterable[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs a stream of postings in parts of about ``HELD``."""
    held: list[np.ndarray] = []
    total = turn = 0
    for more in rows:
        held.append(more)
        total += len(more)
        if total >= HELD:
            yield from deal(np.concatenate(held), buckets, turn)
            held, total, turn = [], 0, turn + 7
    if total:
        yield from deal(np.concatenate(held), buckets, turn)


def survivors(batches: Iterable[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """The postings, of all that were packed for the buckets of a task, whose key occurs again."""
    held = []
    for batch in batches:
        for sure, raw in zip(batch.column("sure").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            rows = np.frombuffer(raw, kind)
            if sure:
                yield rows
            else:
                held.append(rows)
    if not held:
        return
    rows = np.concatenate(held)
    rows = rows[np.argsort(rows["key"], kind="stable")]
    starts = np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1])))
    seen = np.repeat(np.add.reduceat(rows["seen"], starts), np.diff(np.append(starts, len(rows))))
    rows = rows[(seen > 1) & (rows["seen"] == 1)]
    if len(rows):
        yield rows
