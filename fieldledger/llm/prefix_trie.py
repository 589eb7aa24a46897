"""A prefix trie over conversations, built and searched as a z-fast trie.

A conversation is a sequence of turns (role, text); it is first rebuilt on the opening turns of its block's first
conversation (:func:`rebuilt`). Every prefix has a signature of 128 bits, a polynomial over the hashes of its turns.
The trie is compacted: an edge is a run of turns without a branch or an end, and it is filed under the signature of
its *handle*, the prefix whose length is divisible by the highest power of two among the edge's lengths.

Conversations go in by batches in random order, each ``GROWTH`` times as large as all before (:func:`build`). For each
one, fat binary search finds the exit node: from the highest power of two down, one lookup of one prefix in the table
of handles a step, which either jumps below a node or rules out what is longer (:func:`_located`). What is left of
the conversations that leave by one edge is put in together (:func:`_grown`). The order makes such groups small: that
many conversations leave an edge anew only if none of them was in an earlier batch. Equal conversations are one.

Turns stay rows until they are numbered by a range sort, so that a conversation may hold any share of the table; then
they are held in segments of ``SEGMENT`` turns, and the trie of each prefix of a multiple of ``SEGMENT`` turns is rooted
at that prefix. Numbers of members are sums over subtrees, by pointer doubling over the compacted nodes; in the end
the edges are expanded to one row per node (:func:`nodes`).

Cases: rows without a conv_id take no part; a null turn comes first, rows of one turn are ordered by role and then by
the MD5 of the text, repeated rows are repeated turns; null roles and texts are empty; blocks of a hundred are counted
from zero on both sides (c - c % 100 truncates); an empty table has no nodes; other columns are ignored. Texts are only hashed
and counted, so their length does not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import partitions, record_batch, saved
from fieldledger.llm.words import mix
from fieldledger.plans import lookup, numbered
from fieldledger.session import fresh_dir

# Conversations of a block, and the number that the length of a shared opening is below.
BLOCK, OPENINGS = 100, 6
SEGMENT = 256
#: Conversations of the first batch, about, and by how much each batch is larger than what came before.
FIRST, GROWTH = 2048, 8
# Symbols that one call of numpy works on, and bytes of ids that are hashed at once.
SYMBOLS, CHUNK = 1 << 18, 1 << 18
_LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SEQUENCE = "p1 array<bigint>, p2 array<bigint>, pc array<bigint>"
_ITEMS = f"conv_id bigint, last boolean, e1 bigint, e2 bigint, r1 bigint, r2 bigint, depth bigint, before bigint, n int, {_SEQUENCE}"
#: ``q`` is the prefix that the edge starts at, of ``depth`` turns and ``before`` characters; ``up`` and ``ext`` are its
#: first and last length counted from the root of its segment; ``n`` is its first node, ``h`` the handle, ``x`` the last.
_EDGES = (
    "n1 bigint, n2 bigint, level int, h1 bigint, h2 bigint, x1 bigint, x2 bigint, q1 bigint, q2 bigint, "
    f"up int, ext int, depth bigint, before bigint, {_SEQUENCE}"
)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
             "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ") for part in ddl.split(", "))])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and where each list begins (one more at the end)."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False), ends - ends[0]


def _list_of(values: np.ndarray, begins: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values.astype(np.int64)))


def _runs(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places first, first + 1, … of each run, and where each run begins (one more at the end)."""
    begins = np.concatenate(([0], np.cumsum(length)))
    return np.arange(begins[-1]) + np.repeat(first - begins[:-1], length), begins


# --- rebuilding -----------------------------------------------------------------------------------------------------


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, and one row per conversation.

    Turns are (conv_id, total, at, s1, s2, chars): ``at`` counts from 1 to ``total``; ``s1`` and ``s2`` are two hashes of
    role and text. Conversations are (conv_id, base, first, n, h, hb, total)."""
    role, mark = F.coalesce("role", F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    turns = (
        conversations.where("conv_id is not null")
        .select(F.col("conv_id").cast("long"), "turn", role.alias("role"), mark.alias("mark"),
                F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    )
    placed = numbered(turns, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")], "number")
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    counts = placed.groupBy("conv_id").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    counts = counts.withColumn("base", base)
    counts = counts.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS)
    openers = counts.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    info = counts.join(openers, "base", "left").withColumn("hb", F.least("h", F.coalesce("n_base", F.lit(0))))
    info = saved(info.withColumn("total", F.expr("hb + greatest(n - h, 0)")).drop("n_base"), "conversations")
    known = lookup(placed, info, "conv_id").withColumn("place", F.col("number") - F.col("first"))
    marks = [F.xxhash64(F.lit(i), "role", "mark").alias(f"s{i}") for i in (1, 2)]
    own = known.where("place >= h").select("conv_id", "total", F.expr("hb + place - h + 1").alias("at"), *marks, "chars")
    opening = known.where(f"conv_id = base and place < {OPENINGS - 1}")
    opening = opening.select("base", (F.col("place") + 1).alias("at"), *marks, "chars")
    heads = info.where("hb > 0").select("conv_id", "total", "base", "hb").join(opening, "base").where("at <= hb")
    return own.unionByName(heads.select(*own.columns)), info


def _powers(lane: int, length: int) -> np.ndarray:
    factors = np.full(length, lane, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def _sums(batches: Iterable[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Running sums over the turns of each segment: the polynomials of its prefixes, and their characters."""
    schema = _arrow(f"conv_id bigint, total bigint, segment bigint, {_SEQUENCE}")
    powers = [_powers(lane, held) for lane in _LANES]
    for batch in batches:
        turns = batch.column("turns")
        begins = turns.offsets.to_numpy().astype(np.int64)
        rows = turns.values.slice(begins[0], begins[-1] - begins[0])
        begins = begins - begins[0]
        segment = batch.column("segment").to_numpy()
        owner = np.repeat(np.arange(len(batch)), np.diff(begins))
        place = np.arange(len(owner)) - begins[:-1][owner]
        sums = []
        for i, lane in enumerate(_LANES):
            start = np.array([pow(lane, int(s) * held, 1 << 64) for s in segment], np.uint64)
            value = rows.field(f"s{i + 1}").to_numpy().view(np.uint64) * powers[i][place] * start[owner]
            sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(value))))
        sums.append(np.concatenate(([0], np.cumsum(rows.field("chars").to_numpy()))))
        lists = [_list_of((s[1:] - s[begins[:-1]][owner]).view(np.int64), begins) for s in sums]
        yield record_batch(schema, batch.column("conv_id"), batch.column("total"), batch.column("segment"), *lists)


def _carried(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What comes before each segment of a long conversation; rows are sorted by conversation and segment."""
    schema = _arrow("conv_id bigint, segment bigint, w1 bigint, w2 bigint, wc bigint")
    conv, held = None, (0, 0, 0)
    for batch in filter(len, batches):
        rows = batch.to_pydict()
        before: list[tuple[int, int, int]] = []
        for c, *more in zip(rows["conv_id"], rows["t1"], rows["t2"], rows["tc"], strict=True):
            conv, held = c, held if c == conv else (0, 0, 0)
            before.append(held)
            held = tuple(((a + b + (1 << 63)) % (1 << 64)) - (1 << 63) for a, b in zip(held, more, strict=True))
        yield record_batch(schema, rows["conv_id"], rows["segment"], *zip(*before, strict=True))


def _signed(batches: Iterable[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Segments with the signatures of their prefixes."""
    schema = _arrow(_ITEMS)
    for batch in batches:
        whole, begins = [], None
        for sums, before in (("p1", "w1"), ("p2", "w2"), ("pc", "wc")):
            values, begins = _lists(batch.column(sums))
            start = batch.column(before).to_numpy()
            whole.append((values.view(np.uint64) + np.repeat(start, np.diff(begins)).view(np.uint64), start))
        (p1, w1), (p2, w2), (pc, wc) = whole
        p1, p2, r1, r2 = (mix(v.view(np.uint64)).view(np.int64) for v in (p1, p2, w1, w2))
        end = begins[1:] - 1
        segment = batch.column("segment").to_numpy()
        last = (segment + 1) * held >= batch.column("total").to_numpy()
        lists = [_list_of(v.view(np.int64), begins) for v in (p1, p2, pc)]
        yield record_batch(
            schema, batch.column("conv_id"), last, p1[end], p2[end], r1, r2, segment * held, wc, np.diff(begins), *lists
        )


def sequences(turns: DataFrame, info: DataFrame, held: int = SEGMENT) -> DataFrame:
    """Segments of ``held`` turns of the conversations: the signatures ``p1``, ``p2`` and characters ``pc`` of their prefixes, those of
    the segment's root ``r1``, ``r2``, ``before``, and its end ``e1``, ``e2``."""
    grouped = (
        turns.withColumn("segment", F.expr(f"(at - 1) div {held}"))
        .groupBy("conv_id", "segment")
        .agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("at", "s1", "s2", "chars"))).alias("turns"))
    )
    parts = saved(grouped.mapInArrow(partial(_sums, held=held), f"conv_id bigint, total bigint, segment bigint, {_SEQUENCE}"), "segments")
    ends = [F.element_at(p, -1).alias(t) for p, t in (("p1", "t1"), ("p2", "t2"), ("pc", "tc"))]
    long = info.where(F.col("total") > held).select("conv_id")
    totals = parts.where(F.col("total") > held).select("conv_id", "segment", *ends).join(long, "conv_id", "left_semi")
    totals = totals.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    before = totals.mapInArrow(_carried, "conv_id bigint, segment bigint, w1 bigint, w2 bigint, wc bigint")
    known = parts.join(before, ["conv_id", "segment"], "left").na.fill(0, ["w1", "w2", "wc"])
    return saved(known.mapInArrow(partial(_signed, held=held), _ITEMS), "sequences")


# --- the trie -------------------------------------------------------------------------------------------------------


def _edges_of(rows: list[dict]) -> pa.RecordBatch:
    """The compacted edges of the sequences in ``rows``: a node where one ends or two differ after it."""
    parts = {c: [] for c in ("p1", "p2", "pc")}
    begins = [np.zeros(1, np.int64)]
    for batch in rows:
        for c, values in parts.items():
            flat, own = _lists(batch.column(c))
            values.append(flat)
        begins.append(own[1:] + begins[-1][-1])
    begin = np.concatenate(begins)
    p1, p2, pc = (np.concatenate(v) for v in parts.values())
    head = {c: np.concatenate([b.column(c).to_numpy() for b in rows]) for c in ("q1", "q2", "up", "depth", "before")}
    order = np.lexsort((p2, p1))
    new = np.ones(len(order), bool)
    new[1:] = (p1[order[1:]] != p1[order[:-1]]) | (p2[order[1:]] != p2[order[:-1]])
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(new) - 1
    many = int(new.sum())
    closes = np.zeros(len(node), bool)
    closes[begin[1:] - 1] = True
    stop = np.zeros(many, bool)
    stop[node[closes]] = True
    inner = np.flatnonzero(~closes)
    follows = np.unique(node[inner] * many + node[inner + 1])
    stop |= np.bincount(follows // many, minlength=many) > 1
    at = np.arange(len(node))
    stops = stop[node]
    # The place of the last stop before each place, or the one before the first of its sequence.
    before = np.concatenate(([-1], np.maximum.accumulate(np.where(stops, at, -1))[:-1]))
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    firsts = begin[:-1][owner]
    last = order[new][stop]
    start = np.maximum(before + 1, firsts)[last]
    own = owner[last]
    top = start == firsts[last]
    back = np.maximum(start - 1, 0)
    up = head["up"][own] + (start - firsts[last])
    ext = up + (last - start + 1)
    # The length in (up, ext] divisible by the highest power of two.
    bits = np.floor(np.log2((up ^ ext).astype(np.float64))).astype(np.int64)
    fat = (ext >> bits) << bits
    handle = start + (fat - up - 1)
    places, runs = _runs(start, last - start + 1)
    return record_batch(
        _arrow(_EDGES),
        p1[start], p2[start], np.log2((fat & -fat).astype(np.float64)).astype(np.int32), p1[handle], p2[handle],
        p1[last], p2[last], np.where(top, head["q1"][own], p1[back]), np.where(top, head["q2"][own], p2[back]),
        up.astype(np.int32), ext.astype(np.int32), head["depth"][own] + (start - firsts[last]),
        np.where(top, head["before"][own], pc[back]), *(_list_of(v[places], runs) for v in (p1, p2, pc)),
    )


def _grown(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by the edge or first node that they share; what shares one is worked on together."""
    held: list[pa.RecordBatch] = []
    size, key = 0, None
    for batch in filter(len, batches):
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        turns = _lists(batch.column("p1"))[1]
        changes = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        if key is not None and key != (k1[0], k2[0]):
            changes = np.concatenate(([0], changes))
        done = 0
        for cut in changes:
            if size + turns[cut] - turns[done] >= SYMBOLS:
                if held or cut:
                    yield _edges_of([*held, *([batch.slice(done, cut - done)] if cut > done else [])])
                held, size, done = [], 0, cut
        if done < len(batch):
            held.append(batch.slice(done))
            size += int(turns[-1] - turns[done])
        key = (k1[-1], k2[-1])
    if held:
        yield _edges_of(held)


def _located(items: DataFrame, edges: DataFrame, longest: int) -> DataFrame:
    """``items`` with ``u``: how much of each is in the trie down to the node or the edge by which it leaves.

    Fat binary search over (a, b]: a level looks up the one prefix in it whose length is an odd multiple of 2 ** level.
    Where no prefix is looked up any more, the key is that of the end, at a level that no handle has."""
    state = items.withColumns({"a": F.lit(0), "b": F.col("n"), "u": F.lit(None).cast("int")})
    for level in range(longest.bit_length() - 1, -1, -1):
        handles = edges.where(F.col("level") == level).select(
            F.col("level").alias("_level"), "h1", "h2", F.col("x1").alias("_x1"), F.col("x2").alias("_x2"),
            F.col("up").alias("_up"), F.col("ext").alias("_ext"),
        )
        f = F.shiftleft(F.shiftright("a", level) + 1, level)
        asks = f <= F.col("b")
        state = state.withColumns(
            {
                "_f": f,
                "_asks": F.when(asks, level).otherwise(-1),
                "_k1": F.when(asks, F.get("p1", f - 1)).otherwise(F.col("e1")),
                "_k2": F.when(asks, F.get("p2", f - 1)).otherwise(F.col("e2")),
            }
        )
        match = (F.col("_asks") == F.col("_level")) & (F.col("_k1") == F.col("h1")) & (F.col("_k2") == F.col("h2"))
        joined = state.join(handles, match, "left")
        hit = F.col("_ext").isNotNull()
        # An edge longer than the item gives null here, which is no whole match either.
        whole = F.get("p1", F.col("_ext") - 1).eqNullSafe(F.col("_x1")) & F.get("p2", F.col("_ext") - 1).eqNullSafe(F.col("_x2"))
        missed = F.when(F.col("_asks") >= 0, F.col("_f") - 1).otherwise(F.col("b"))
        state = joined.select(
            *items.columns,
            F.when(hit & whole, F.col("_ext")).otherwise(F.col("a")).alias("a"),
            F.when(hit, F.when(whole, F.col("b")).otherwise(F.lit(-1))).otherwise(missed).alias("b"),
            F.when(hit & ~whole, F.col("_up")).otherwise(F.col("u")).alias("u"),
        )
    return state.select(*items.columns, F.coalesce("u", "a").alias("u"))


def _rests(located: DataFrame) -> DataFrame:
    """What is not in the trie of each sequence from ``u`` on, under its first node there."""

    def at_u(column: str, else_: str) -> Column:
        return F.when(F.col("u") > 0, F.get(column, F.col("u") - 1)).otherwise(F.col(else_))

    return located.where("u < n").select(
        F.get("p1", F.col("u")).alias("k1"),
        F.get("p2", F.col("u")).alias("k2"),
        at_u("p1", "r1").alias("q1"),
        at_u("p2", "r2").alias("q2"),
        F.col("u").alias("up"),
        (F.col("depth") + F.col("u")).alias("depth"),
        at_u("pc", "before").alias("before"),
        *(F.slice(c, F.col("u") + 1, F.col("n") - F.col("u")).alias(c) for c in ("p1", "p2", "pc")),
    )


def build(sequences: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """The edges of the compacted trie of all sequences, put in by batches."""
    spark = sequences.sparkSession
    kept = [F.first(c).alias(c) for c in ("r1", "r2", "depth", "before", "n", "p1", "p2", "pc")]
    total = sequences.count()
    # The signatures are random, so their first bits deal sequences to batches.
    place = F.shiftrightunsigned("e1", 11) / float(1 << 53) * float(max(total, 1))
    number = F.lit(0)
    most = first
    while most < total:
        number = number + F.when(place >= most, 1).otherwise(0)
        most *= growth
    path = fresh_dir(spark, "distinct-sequences")
    distinct = sequences.groupBy("e1", "e2").agg(*kept).withColumn("batch", number)
    distinct.write.partitionBy("batch").parquet(path)
    items = spark.read.schema(distinct.schema).parquet(path)
    edges = spark.createDataFrame([], _EDGES)
    sizes = {r["batch"]: r["longest"] for r in items.groupBy("batch").agg(F.max("n").alias("longest")).collect()}
    for batch, longest in sorted(sizes.items()):
        chosen = items.where(F.col("batch") == batch).drop("batch")
        if batch == min(sizes):
            rests, old, left = _rests(chosen.withColumn("u", F.lit(0))), None, None
        else:
            rests = saved(_rests(_located(chosen, edges, longest)), "exits")
            keys = rests.select(F.col("k1").alias("n1"), F.col("k2").alias("n2")).distinct()
            old = edges.join(keys, ["n1", "n2"], "left_semi").select(
                F.col("n1").alias("k1"), F.col("n2").alias("k2"), *rests.columns[2:]
            )
            left = edges.join(keys, ["n1", "n2"], "left_anti").select(*edges.columns)
            rests = rests.unionByName(old)
        rests = rests.repartition(partitions(spark), "k1", "k2").sortWithinPartitions("k1", "k2")
        new = rests.mapInArrow(_grown, _EDGES)
        edges = saved(new if left is None else left.unionByName(new), "edges")
    return edges


# --- members --------------------------------------------------------------------------------------------------------

_ENDS = "x1 bigint, x2 bigint, first bigint, n bigint, sha string, ids binary"


def _listed(batches: Iterable[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by end and conv_id. An end that surely lies within this task gets its hash; others, and those
    of many ids, are given as pieces of their list."""
    schema = _arrow(_ENDS)
    out: list[tuple] = []
    key, ids, size, whole = None, [], 0, False

    def close(inside: bool) -> None:
        data = ",".join(ids).encode()
        sha = hashlib.sha256(data).hexdigest() if whole and inside else None
        out.append((*key, int(ids[0]), len(ids), sha, None if sha else data))

    for batch in batches:
        for x1, x2, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (x1, x2) != key:
                if key is not None:
                    close(True)
                whole = key is not None
                key, ids, size = (x1, x2), [], 0
            elif size >= chunk:
                whole = False
                close(False)
                ids, size = [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
            if len(out) >= 10000 or (out and out[-1][5] and len(out[-1][5]) >= chunk):
                yield record_batch(schema, *zip(*out, strict=True))
                out.clear()
    if key is not None:
        close(False)
    if out:
        yield record_batch(schema, *zip(*out, strict=True))


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per end from the pieces of its list, which come in order."""
    schema = _arrow("x1 bigint, x2 bigint, first bigint, n bigint, sha string")
    key, first, n, state = None, 0, 0, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (row["x1"], row["x2"]) != key:
                if key is not None:
                    out.append((*key, first, n, state.hexdigest()))
                key, first, n, state = (row["x1"], row["x2"]), row["first"], 0, hashlib.sha256()
            else:
                state.update(b",")
            state.update(row["ids"])
            n += row["n"]
        if out:
            yield record_batch(schema, *zip(*out, strict=True))
    if key is not None:
        yield record_batch(schema, *zip((*key, first, n, state.hexdigest()), strict=True))


def ends(sequences: DataFrame, info: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """For each prefix that is a whole conversation: the smallest conv_id, their number, and the hash of all of them.

    The list of one prefix may hold any share of all ids: it is sorted and written by many tasks, and only the
    hash runs over its pieces one after another."""
    rows = sequences.where("last").select(F.col("e1").alias("x1"), F.col("e2").alias("x2"), "conv_id")
    none = info.where("total = 0").select(F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), "conv_id")
    rows = rows.unionByName(none)
    order = ["x1", "x2", "conv_id"]
    sorted_rows = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    listed = saved(sorted_rows.mapInArrow(partial(_listed, chunk=chunk), _ENDS), "ends")
    pieces = listed.where("sha is null").repartition("x1", "x2").sortWithinPartitions("x1", "x2", "first")
    joined = pieces.mapInArrow(_joined, "x1 bigint, x2 bigint, first bigint, n bigint, sha string")
    return listed.where("sha is not null").drop("ids").unionByName(joined)


def _summed(edges: DataFrame, at_ends: DataFrame) -> DataFrame:
    """The compacted nodes with sums over their subtrees: members ``n``, the smallest ``first``, ``leaves``, the
    characters of all members' paths ``paths`` and of all edges ``chars``; ``kids`` and ``sha`` are their own."""
    kids = edges.groupBy(F.col("q1").alias("x1"), F.col("q2").alias("x2")).agg(F.count("*").alias("kids"))
    path = F.element_at("pc", -1)
    own = edges.select("x1", "x2", F.col("q1").alias("a1"), F.col("q2").alias("a2"), path.alias("path"),
                       (path - F.col("before")).alias("chars"))
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = edges.sparkSession.range(1).select(
        zero.alias("x1"), zero.alias("x2"), null.alias("a1"), null.alias("a2"), zero.alias("path"), zero.alias("chars")
    )
    state = own.unionByName(root).join(kids, ["x1", "x2"], "left").join(at_ends, ["x1", "x2"], "left")
    state = state.na.fill(0, ["kids", "n"])
    state = state.select(
        "x1", "x2", "a1", "a2", "kids", "sha", "first", "n", F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        (F.col("n") * F.col("path")).alias("paths"), "chars",
    )
    state = saved(state, "nodes")
    sums = ("n", "leaves", "paths", "chars")
    while not state.where("a1 is not null").isEmpty():
        # Each node holds the sums over less than 2 ** k steps below it, and knows its ancestor 2 ** k steps above.
        given = (
            state.where("a1 is not null")
            .groupBy(F.col("a1").alias("x1"), F.col("a2").alias("x2"))
            .agg(F.min("first").alias("_first"), *(F.sum(c).alias(f"_{c}") for c in sums))
        )
        above = state.where("a1 is not null").select(
            F.lit(True).alias("_below"), F.col("x1").alias("_a1"), F.col("x2").alias("_a2"),
            F.col("a1").alias("_b1"), F.col("a2").alias("_b2"),
        )
        # Most nodes have the root above them soon: these ask under their own name, and find nothing.
        below = ((F.col("a1") != 0) | (F.col("a2") != 0)) & F.col("a1").isNotNull()
        state = state.withColumns({
            "_asks": below.eqNullSafe(True),
            "_k1": F.when(below, F.col("a1")).otherwise(F.col("x1")),
            "_k2": F.when(below, F.col("a2")).otherwise(F.col("x2")),
        })
        match = (F.col("_asks") == F.col("_below")) & (F.col("_k1") == F.col("_a1")) & (F.col("_k2") == F.col("_a2"))
        state = state.join(above, match, "left").join(given, ["x1", "x2"], "left").select(
            "x1", "x2", F.col("_b1").alias("a1"), F.col("_b2").alias("a2"), "kids", "sha",
            F.least("first", "_first").alias("first"),
            *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums),
        )
        state = saved(state, "nodes")
    return state.drop("a1", "a2")


def nodes(edges: DataFrame, at_ends: DataFrame) -> DataFrame:
    """One row per node of the trie, from the expanded edges."""
    nothing = hashlib.sha256(b"").hexdigest()
    summed = _summed(edges, at_ends)
    top = summed.where("x1 = 0 and x2 = 0").where("n > 0")
    root = top.select(
        F.col("first").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("paths") - F.col("chars")).alias("saved_tokens"), F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"),
    )
    smallest = top.first()
    smallest = None if smallest is None else smallest["first"]
    # Edges from the root, possibly most of them, ask under their own name, which is no parent's.
    from_root = (F.col("q1") == 0) & (F.col("q2") == 0)
    parents = summed.where("kids > 0").select(
        F.lit(False).alias("_root"), F.col("x1").alias("_q1"), F.col("x2").alias("_q2"), F.col("first").alias("_parent")
    )
    rows = edges.select("x1", "x2", "q1", "q2", "depth", "before", "pc").join(summed, ["x1", "x2"]).withColumns({
        "_top": from_root,
        "_k1": F.when(from_root, F.col("x1")).otherwise(F.col("q1")),
        "_k2": F.when(from_root, F.col("x2")).otherwise(F.col("q2")),
    })
    match = (F.col("_top") == F.col("_root")) & (F.col("_k1") == F.col("_q1")) & (F.col("_k2") == F.col("_q2"))
    rows = rows.join(parents, match, "left").withColumns({
        "_size": F.size("pc"),
        "_path": F.element_at("pc", -1),
        "_parent": F.when(F.col("_top"), F.lit(smallest).cast("long")).otherwise(F.col("_parent")),
    })
    rows = rows.select("*", F.posexplode("pc").alias("_i", "_pc"))
    ends_here = F.col("_i") == F.col("_size") - 1
    above = F.when(F.col("_i") == 0, F.col("before")).otherwise(F.get("pc", F.col("_i") - 1))
    below = F.col("chars") - (F.col("_path") - F.col("before")) + (F.col("_path") - above)
    return rows.select(
        F.col("first").alias("conv_id"),
        (F.col("depth") + F.col("_i") + 1).alias("depth"),
        F.when(F.col("_i") == 0, F.col("_parent")).otherwise(F.col("first")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(ends_here, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("paths") - F.col("n") * above - below).alias("saved_tokens"),
        F.coalesce(F.when(ends_here, F.col("sha")), F.lit(nothing)).alias("ends_sha256"),
    ).unionByName(root)


def prefix_trie(
    conversations: DataFrame, held: int = SEGMENT, first: int = FIRST, growth: int = GROWTH, chunk: int = CHUNK
) -> DataFrame:
    """Every node of the trie of the rebuilt conversations: its smallest member, depth, parent's smallest member, numbers of
    members, children and leaves below, characters saved by sharing, and the hash of the members that end there."""
    turns, info = rebuilt(conversations)
    parts = sequences(turns, info, held)
    return nodes(build(parts, first, growth), ends(parts, info, chunk))
