"""Removal of repeated byte strings: suffix order of many strings built column by column.

A string of ``length`` bytes (``LENGTH`` by default) that starts at two places of the corpus is removed at all of them.

1. Anchors. Of all grams of a third of that length within each window of ``length`` bytes the one with the smallest hash (the
   leftmost of equals) is an anchor, so equal strings have an equal anchor at the same place. An anchor's segment is
   all bytes that a window around it can reach, within its document. Anchors that occur once are no repeats; they
   leave packed, before they are rows of a shuffle.
2. Grouping. Segments that are equal at equal anchors are counted. Two or more are repeats in whole; a segment
   alone at its anchor is none. What is left, one segment of each kind, is compared per anchor:
3. Columns. The segments of an anchor are aligned at it. From the last column to the first, one symbol of every
   segment is put in front in each round: a stable sort by that symbol turns the order of the suffixes into the next,
   and the common prefix of neighbours is one more than the least common prefix between their places before. A
   window starts a repeat where a neighbour in the order shares ``length`` bytes or more. Order, symbols in order
   (the transform) and common prefixes are passed through once per round, in sequence.
   Anchors with more than ``CROWD`` different segments would not fit a task; their windows are counted by hash.
4. Spans. The repeats of a segment are one span around its anchor. Spans go back to all places of the segment, are
   merged per document and cut out. Texts are shuffled only where a filter of fixed size says that the
   document may be wanted.

The sequential files of the external construction are arrays of one task here: groups are taken together up to
``BATCH`` segments, which bounds the memory, and nothing is written to a local disk.

Segments are equal when 64-bit hashes of the anchor and of the segment agree. Cases: a null text is an empty one;
texts shorter than ``length`` keep everything; rows that repeat a doc_id are documents of their own; an empty table
gives an empty one; columns of other names are passed through by :func:`cleaned`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import bit_filter, lean, partitions, record_batch, saved, slices, text_buffers, unused, wanted
from fieldledger.llm.postings import PACKED_SQL, dealt, survivors
from fieldledger.llm.words import mix, prefix_hash, span_hash

LENGTH = 400
CROWD = 16384
BATCH = 4096
GAP = 256


class Shape(NamedTuple):
    """What follows from the length of a repeat: bytes of a gram, of a segment before its anchor, and its columns."""

    length: int
    gram: int
    before: int
    columns: int


def shape(length: int = LENGTH) -> Shape:
    gram = max(1, 8 * length // 25)
    return Shape(length, gram, length - gram, 2 * length - gram)



_POSTING = np.dtype(
    [("key", "<u8"), ("segment", "<i8"), ("doc", "<i8"), ("at", "<i4"), ("before", "<i2"), ("after", "<i2"), ("seen", "<i4")]
)
_PLACES = pa.schema(
    [("anchor", pa.int64()), ("segment", pa.int64()), ("doc", pa.int64()), ("at", pa.int32())]
    + [("before", pa.int32()), ("after", pa.int32())]
)
_PLACES_SQL = "anchor long, segment long, doc long, at int, before int, after int"
_SPANS = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
_SPANS_SQL = "anchor long, segment long, low int, high int"


def _document() -> F.Column:
    return F.xxhash64("doc_id", "text")


def window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive keys."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[: len(keys)] = keys
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, of: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in ``data`` and the hashes of their grams, over all texts."""
    n = len(data)
    if n < of.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(n - of.gram + 1)
    grams = span_hash(prefix, at, at + of.gram)
    low = np.uint64((1 << int(n).bit_length()) - 1)
    least = window_least((grams & ~low) | at.astype(np.uint64), of.length - of.gram + 1)
    starts = np.arange(len(least))
    ends = offsets[np.searchsorted(offsets, starts, "right")]
    chosen = (least[starts + of.length <= ends] & low).astype(np.int64)
    if not len(chosen):
        return chosen, np.zeros(0, np.uint64)
    places = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
    return places, grams[places]


def _places(batches: Iterable[pa.RecordBatch], of: Shape) -> Iterator[np.ndarray]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_buffers(part.column("text"))
            at, grams = anchors(data, offsets, of)
            if not len(at):
                continue
            owner = np.searchsorted(offsets, at, "right") - 1
            low, high = np.maximum(offsets[owner], at - of.before), np.minimum(offsets[owner + 1], at + of.length)
            segment = mix(span_hash(prefix_hash(data), low, high) + (at - low).astype(np.uint64))
            rows = np.empty(len(at), _POSTING)
            rows["key"], rows["segment"], rows["seen"] = grams, segment.view(np.int64), 1
            rows["doc"], rows["at"] = part.column("doc").to_numpy()[owner], at - offsets[owner]
            rows["before"], rows["after"] = at - low, high - at
            yield rows


@lean
def _packed(batches: Iterable[pa.RecordBatch], buckets: int, of: Shape) -> Iterator[pa.RecordBatch]:
    return dealt(_places(batches, of), buckets)


@lean
def _again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in survivors(batches, _POSTING):
        anchor = rows["key"].astype(np.uint64).view(np.int64)
        yield record_batch(_PLACES, anchor, *(rows[c] for c in ("segment", "doc", "at", "before", "after")))


@lean
def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that each text is asked for."""
    schema = pa.schema(
        [("anchor", pa.int64()), ("segment", pa.int64()), ("n", pa.int64()), ("before", pa.int32()), ("bytes", pa.binary())]
        + [("kinds", pa.int64())]
    )
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            rows = []
            for text, wanted in zip(texts, part.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    low, high = w["at"] - w["before"], w["at"] + w["after"]
                    rows.append((w["anchor"], w["segment"], w["n"], w["before"], text[low:high], w["kinds"]))
            if rows:
                yield record_batch(schema, *zip(*rows, strict=True))


_CUT_SQL = "anchor long, segment long, n long, before int, bytes binary, kinds long"
_CUT_COLUMNS = ["anchor", "segment", "n", "before", "bytes"]


def repeated_starts(groups: np.ndarray, symbols: np.ndarray, of: Shape) -> np.ndarray:
    """For segments (rows of ``symbols``, ``GAP`` where there is no byte) sorted by group: whether the window that
    starts at each column up to ``of.before`` also is in another segment of the group."""
    m, columns = symbols.shape
    out = np.zeros((m, of.before + 1), bool)
    order = np.arange(m)
    common = np.zeros(m, np.int32)  # with the one before in the order
    base = (groups * (GAP + 1)).astype(np.int64)
    for column in range(columns - 1, -1, -1):
        symbol = symbols[order, column]
        key = base[order] + symbol
        rank = np.argsort(key, kind="stable")
        key = key[rank]
        same = np.zeros(m, bool)
        same[1:] = (key[1:] == key[:-1]) & (symbol[rank][1:] != GAP)
        # Places before the sort of each neighbour pair; the least common prefix after the first, up to the second.
        second = np.flatnonzero(same)
        fresh = np.zeros(m, np.int32)
        if len(second):
            ends = np.column_stack((rank[second - 1] + 1, rank[second] + 1)).ravel()
            fresh[second] = np.minimum.reduceat(np.append(common, 0), ends)[::2] + 1
        order, common = order[rank], fresh
        if column <= of.before:
            far = common >= of.length
            if far.any():
                hit = far.copy()
                hit[:-1] |= far[1:]
                out[order[hit], column] = True
    return out


def _compare(rows: list[tuple], of: Shape) -> pa.RecordBatch | None:
    """Rows (anchor, segment, n, before, bytes), whole anchors, sorted by anchor."""
    symbols = np.full((len(rows), of.columns), GAP, np.int16)
    for i, (_, _, _, before, raw) in enumerate(rows):
        symbols[i, of.before - before : of.before - before + len(raw)] = np.frombuffer(raw, np.uint8)
    anchor = np.array([r[0] for r in rows], np.int64)
    group = np.concatenate(([0], np.cumsum(anchor[1:] != anchor[:-1])))
    found = repeated_starts(group, symbols, of)
    hit = np.flatnonzero(found.any(axis=1))
    if not len(hit):
        return None
    low = found[hit].argmax(axis=1) - of.before
    high = of.length - found[hit, ::-1].argmax(axis=1)
    return record_batch(_SPANS, anchor[hit], [rows[i][1] for i in hit], low, high)


@lean
def _by_columns(batches: Iterable[pa.RecordBatch], of: Shape) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    border = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != rows[-1][0]:
                border = len(rows)
            if len(rows) >= BATCH and border:
                out = _compare(rows[:border], of)
                if out is not None:
                    yield out
                rows, border = rows[border:], 0
            rows.append(row)
    if rows:
        out = _compare(rows, of)
        if out is not None:
            yield out


@lean
def _windows(batches: Iterable[pa.RecordBatch], of: Shape) -> Iterator[pa.RecordBatch]:
    """Every window of the segments by its hash and its place at the anchor."""
    schema = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("start", pa.int32()), ("window", pa.int64())])
    for batch in batches:
        for anchor, segment, _, before, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = np.frombuffer(raw, np.uint8)
            at = np.arange(len(data) - of.length + 1)
            at = at[at <= before]
            hashes = span_hash(prefix_hash(data), at, at + of.length).view(np.int64)
            yield record_batch(
                schema, np.full(len(at), anchor), np.full(len(at), segment), (at - before).astype(np.int32), hashes
            )


def _by_hash(segments: DataFrame, of: Shape) -> DataFrame:
    windows = segments.select(*_CUT_COLUMNS).mapInArrow(partial(_windows, of=of), "anchor long, segment long, start int, window long")
    key = ["anchor", "start", "window"]
    twice = windows.groupBy(*key).count().where("count > 1").select(*key)
    return windows.join(twice, key).groupBy("anchor", "segment").agg(
        F.min("start").alias("low"), (F.max("start") + of.length).cast("int").alias("high")
    )


def repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """``doc`` (a hash of doc_id and text) and ``spans`` (start and end of repeated bytes around each anchor, in any
    order, overlapping) of the documents that have any. Writes two tables on the way."""
    parts, of = partitions(docs.sparkSession), shape(length)
    texts = docs.where(F.octet_length("text") >= length).select(_document().alias("doc"), "text")
    packed = texts.mapInArrow(partial(_packed, buckets=4 * parts, of=of), PACKED_SQL)
    places = saved(packed.repartition(parts, "bucket").mapInArrow(_again, _PLACES_SQL), "anchors")
    # Equal segments have equal sides; any one place stands for them. All firsts are of one row.
    kinds = places.groupBy("anchor", "segment").agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("doc", "at", "before", "after"))
    )
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    kinds = saved(kinds.join(groups.drop("total"), "anchor"), "segments")
    asked = kinds.where("kinds > 1").groupBy("doc").agg(
        F.collect_list(F.struct("anchor", "segment", "n", "at", "before", "after", "kinds")).alias("wanted")
    )
    segments = wanted(texts, "doc", kinds.where("kinds > 1"), "doc").join(asked, "doc").select("text", "wanted").mapInArrow(_cut, _CUT_SQL)
    crowded = None
    if not kinds.where(F.col("kinds") > crowd).isEmpty():
        segments = saved(segments, "crowded-segments")
        crowded, segments = segments.where(F.col("kinds") > crowd), segments.where(F.col("kinds") <= crowd)
    # No join by anchor comes before: Spark drops a repartition that a join has done, and adaptive execution may then read
    # the join's shuffle by map task or split it, so that an anchor's segments meet in no one task.
    dealt = segments.repartition(parts, "anchor").sortWithinPartitions("anchor", "segment")
    found = dealt.select(*_CUT_COLUMNS).mapInArrow(partial(_by_columns, of=of), _SPANS_SQL)
    found = found.unionByName(
        kinds.where("n > 1").select(
            "anchor", "segment", (-F.col("before")).alias("low"), F.col("after").alias("high")
        )
    )
    if crowded is not None:
        found = found.unionByName(_by_hash(crowded, of))
    spans = found.groupBy("anchor", "segment").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    span = F.struct((F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high")).alias("end"))
    return places.join(spans, ["anchor", "segment"]).groupBy("doc").agg(F.collect_set(span).alias("spans"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


@lean
def _apply(batches: Iterable[pa.RecordBatch], names: list[str], spans_in: str, text_back: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            kept, sizes, gone, runs = [], [], [], []
            texts = part.column("text").cast(pa.binary()).to_pylist()
            for text, spans in zip(texts, part.column(spans_in).to_pylist(), strict=True):
                text = text or b""
                cut = _merged(spans)
                edges = [0, *(e for s in cut for e in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(text))
                gone.append(sum(b - a for a, b in cut))
                runs.append(len(cut))
            new = {
                "kept": pa.array(kept, pa.binary()),
                "n_bytes": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(gone, pa.int64()),
                "n_spans": pa.array(runs, pa.int64()),
            }
            if text_back:
                # A cut may fall within a character; what is left of it goes too.
                plain = [k.decode(errors="ignore") for k in kept]
                nulls = pc.is_null(part.column("text")).to_numpy(zero_copy_only=False)
                new = {"text": pa.array(plain, pa.string(), mask=nulls)}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else part.column(n) for n in names], names=names)


def _with_spans(docs: DataFrame, length: int, crowd: int) -> tuple[DataFrame, str]:
    """``docs`` with a column of spans, and its name; documents that surely have none are not shuffled."""
    doc, name = unused(docs, "doc"), unused(docs, "spans")
    spans = saved(repeats(docs, length, crowd), "spans")
    has_some = bit_filter(spans, "doc")
    spans = spans.select(F.col("doc").alias(doc), F.col("spans").alias(name))
    numbered = docs.withColumn(doc, _document())
    flag = unused(numbered, "_wanted")
    numbered = has_some(numbered, doc, flag)
    some = numbered.where(F.col(flag)).join(spans, doc, "left")
    none = numbered.where(~F.col(flag)).withColumn(name, F.lit(None).cast(spans.schema[name].dataType))
    return some.unionByName(none).select(*[f"`{c}`" for c in docs.columns], name), name


def cut_out(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """The columns of ``docs`` but the text, and ``kept`` (remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans``
    (maximal runs of removed bytes); columns of those names are replaced."""
    results = {"kept": "binary", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint"}
    fields = [f for f in docs.schema.fields if f.name not in results and f.name != "text"]
    names = [f.name for f in fields] + list(results)
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{n} {t}" for n, t in results.items()]
    rows, spans = _with_spans(docs.select(*[f"`{f.name}`" for f in fields], "text"), length, crowd)
    return rows.mapInArrow(partial(_apply, names=names, spans_in=spans, text_back=False), ", ".join(schema))


def cleaned(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``; a null text stays null."""
    rows, spans = _with_spans(docs, length, crowd)
    return rows.mapInArrow(partial(_apply, names=docs.columns, spans_in=spans, text_back=True), docs.schema)
