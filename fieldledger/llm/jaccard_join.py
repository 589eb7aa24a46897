"""N-gram Jaccard join of documents: small sets by subsets of fixed size, large sets by inverted lists.

A document's set holds its distinct shingles of ``width`` words (four by default), as 64-bit hashes. Two sets link when
their Jaccard similarity is at least ``percent`` / 100 (``PERCENT`` by default); linked documents form components.

1. Equal sets are one set, named by a 64-bit hash of all its shingles.
2. Shingles are ordered: frequent ones last, by frequency, the others first, by hash. All documents count; what a
   task meets once among ``COUNTED`` shingles is not frequent there. Frequent are the shingles met most often, at most
   ``MOST_FREQUENT`` of them, which bounds what is broadcast. Any order gives the same links.
3. Linking sets of up to n shingles share all but a few, so they agree on one of the first ``p(n)`` shingles of the
   order, and on two of the first ``p(n) + 1``. Sets of at most ``boundary`` shingles (small) are posted under all
   subsets of two of these, the others (large), and small ones that can link with large ones, under each single
   one: the inverted lists. The boundary is where the estimated cost of subsets and of list scans is least.
4. Lists of one set go before they are rows of a shuffle; of lists with the same members one stays. A sketch of each
   set, counts of its shingles by hash range, bounds what two sets share, each pair by its own two sketches: members that
   can link with none of their list leave it.
5. Star rounds compare every member of a list with one centre, which most lists of a group of near copies agree on:
   first the member that meets most others over all its lists, as the text does that the copies were made from.
   Members of one component need no comparison, so a large group of near copies costs one comparison a member.
6. Members that are left in different components of a list are compared block against block, in numpy; members that
   hang together by pairs that may link, over all lists, are taken together. Above ``CANOPY`` sets they are taken list by list
   where that sends fewer shingles. Blocks of the largest component of a group don't meet each other. Only links that join
   components leave the task, so all pairs of a group are never rows.

Comparisons are exact on the hashes. Cases: an empty set (null text, no words) links with nothing; fewer words than
a shingle has make one; documents without doc_id link with nothing and have no component; rows that repeat a doc_id
are one node with several sets; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import lean, partitions, record_batch, saved, slices, spent, text_buffers, told, wanted
from fieldledger.llm.graph import components, hung
from fieldledger.llm.postings import PACKED_SQL, dealt, survivors
from fieldledger.llm.words import mix, shingle_sets

WIDTH = 4
PERCENT = 85
MOST_FREQUENT = 1 << 19
COUNTED = 1 << 21
KNOWN = 1 << 16
A_TASK = 1 << 21
STAR_ROUNDS = 2
BLOCK = 1024
BLOCK_MEMBERS = 1 << 19
CANOPY = 8192

_PROFILE = pa.schema(
    [("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())]
)
_PROFILE_SQL = "kind byte, a long, b long, n long, sketch binary"
_POSTING = np.dtype([("key", "<u8"), ("set", "<i8"), ("n", "<i4"), ("seen", "<i4")])


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set, from the hashes of all its members."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.add.reduceat(mix(np.concatenate(sets) ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
    return mix(out + sizes.astype(np.uint64)).view(np.int64)


def sketch(members: np.ndarray) -> np.ndarray:
    """How many members fall in each of a power of two of equal hash ranges, about eight each; 255 is 255 or more."""
    bits = max(3, (max(1, len(members) // 8) - 1).bit_length())
    counts = np.bincount((members >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8)


def most_shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """A bound from above on the members that each set on the left shares with each on the right."""
    size = min(len(s) for s in (*left, *right))
    sides = [np.array([s.reshape(size, -1).sum(axis=1, dtype=np.int64) for s in side]) for side in (left, right)]
    full = [np.array([(s == 255).any() for s in side]) for side in (left, right)]
    out = np.zeros((len(left), len(right)), np.int64)
    for i in range(size):
        out += np.minimum(sides[0][:, i][:, None], sides[1][:, i][None, :])
    out[full[0], :] = 1 << 40
    out[:, full[1]] = 1 << 40
    return out


def shared_by_pair(marks: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """:func:`most_shared` of all pairs of one list, each pair by the coarser of its own two sketches, so that a short set
    doesn't blur the others; 0 for pairs that can't link by their sizes."""
    out = np.zeros((len(marks), len(marks)), np.int64)
    lengths = np.array([len(m) for m in marks])
    for length in np.unique(lengths):
        here = np.flatnonzero(lengths == length)
        near = (100 * sizes[here].max() >= percent * sizes) & (100 * sizes >= percent * sizes[here].min())
        finer = np.flatnonzero((lengths >= length) & near)
        if len(here) == len(finer) == 1:
            continue
        shared = most_shared([marks[i] for i in here], [marks[i] for i in finer])
        out[np.ix_(here, finer)] = shared
        out[np.ix_(finer, here)] = shared.T
    return out


def _sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(*text_buffers(part.column("text")), width)
            yield part, sets, _names(sets)


@lean
def _profile(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: document, name and size of its set; of kind 1: a shingle and how often it was met."""
    held: list[np.ndarray] = []
    total, known = 0, set()

    def counted() -> pa.RecordBatch:
        tokens = np.concatenate(held)
        held.clear()
        tokens.sort()
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        counts = np.diff(np.append(starts, len(tokens)))
        more = counts > 1
        tokens = tokens[starts[more]].view(np.int64)
        nothing = [None] * len(tokens)
        return record_batch(_PROFILE, np.ones(len(tokens), np.int8), tokens, nothing, counts[more], nothing)

    for part, sets, names in _sets(batches, width):
        sizes = [len(s) for s in sets]
        sketches = [sketch(s).tobytes() for s in sets]
        yield record_batch(_PROFILE, np.zeros(len(sets), np.int8), part.column("doc_id"), names, sizes, sketches)
        for s, name in zip(sets, names.tolist(), strict=True):
            if len(s) and name not in known:
                known.add(name)
                held.append(s)
                total += len(s)
        if total >= COUNTED:
            yield counted()
            total, known = 0, set()
    if held:
        yield counted()


def _need(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares at least with any that it links with."""
    return -(-percent * n // 100)


def boundary(sizes: list[tuple[int, int]], scan: float, percent: int = PERCENT) -> int:
    """The largest small set: for pairs of size and number, subsets cost one row each, a posting in an inverted list
    itself and ``scan`` entries of its list."""
    best, least, subsets = 0, math.inf, 0.0
    lists = [(n, k * (n - _need(n, percent) + 1) * (1 + scan)) for n, k in sorted(sizes)]
    for i, (n, k) in enumerate([(0, 0), *sorted(sizes)]):
        p = n - _need(n, percent) + 2
        subsets += k * p * (p - 1) / 2
        cost = subsets + sum(c for m, c in lists if 100 * m > percent * n)
        if cost < least:
            best, least = n, cost
        if subsets > least:
            break
    return best


def _signatures(s: np.ndarray, frequent: np.ndarray, places: np.ndarray, small: int, percent: int) -> np.ndarray:
    n = len(s)
    first = n - _need(n, percent) + 1
    at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
    hit = frequent[at] == s if len(frequent) else np.zeros(n, bool)
    order = s[~hit][: first + 1]
    if len(order) <= first:
        often = s[hit]
        order = np.concatenate((order, often[np.argsort(places[at[hit]], kind="stable")][: first + 1 - len(order)]))
    out = []
    if 100 * n > percent * small:
        out.append(order[:first])
    if 2 <= n <= small:
        i, j = np.triu_indices(min(first + 1, n), 1)
        out.append(mix(order[i] * np.uint64(0x9E3779B97F4A7C15) ^ mix(order[j])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _signed(
    batches, width: int, percent: int, frequent: np.ndarray, places: np.ndarray, small: int
) -> Iterator[np.ndarray]:
    """The postings of each slice of a task; an equal set is posted once for all that are met again soon."""
    known: set[int] = set()
    for part, sets, names in _sets(batches, width):
        usable = part.column("doc_id").is_valid().to_pylist()
        found = []
        for s, name, ok in zip(sets, names.tolist(), usable, strict=True):
            if not len(s) or not ok or name in known:
                continue
            known.add(name)
            tokens = np.unique(_signatures(s, frequent, places, small, percent))
            rows = np.empty(len(tokens), _POSTING)
            rows["key"], rows["set"], rows["n"], rows["seen"] = tokens, name, len(s), 1
            found.append(rows)
        if len(known) > KNOWN:
            known.clear()
        if found:
            yield np.concatenate(found)


@lean
def _postings(batches, width: int, percent: int, frequent: np.ndarray, places: np.ndarray, small: int, buckets: int):
    return dealt(_signed(batches, width, percent, frequent, places, small), buckets)


_LISTED = pa.schema([("token", pa.int64()), ("set", pa.int64()), ("n", pa.int32())])
_LISTED_SQL = "token long, set long, n int"
_ROOTED = _LISTED.append(pa.field("root", pa.int64()))
_ROOTED_SQL = f"{_LISTED_SQL}, root long"


@lean
def _survivors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings whose token occurs again."""
    for rows in survivors(batches, _POSTING):
        yield record_batch(_LISTED, rows["key"].astype(np.uint64).view(np.int64), rows["set"], rows["n"])


@lean
def _members(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("set", pa.int64()), ("members", pa.binary())])
    for _, sets, names in _sets(batches, width):
        full = [i for i, s in enumerate(sets) if len(s)]
        yield record_batch(schema, names[full], [sets[i].tobytes() for i in full])


def _links(shared: np.ndarray | int, m: np.ndarray | int, n: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * shared >= percent * (m + n - shared)


@lean
def _test(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            linked.append(bool(_links(int((both[1:] == both[:-1]).sum()), len(x), len(y), percent)))
        yield record_batch(schema, batch.column("a"), batch.column("b"), linked)


@lean
def _pruned(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Members of each list (rows sorted by token) that may link with one of another label; those that hang together by
    such pairs have the same ``root``, one of them."""
    found: list[tuple[int, int, int, int]] = []

    def look(rows: list[tuple]) -> None:
        if len(rows) < 2:
            return
        sizes = np.array([r[2] for r in rows])
        low, high = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
        shared = np.minimum(shared_by_pair([np.frombuffer(r[3], np.uint8) for r in rows], sizes, percent), low)
        labels = np.array([r[4] for r in rows])
        good = _links(shared, low, high, percent) & (labels[:, None] != labels[None, :])
        root = np.arange(len(rows))
        nodes, least = hung(*np.nonzero(np.triu(good)))
        root[nodes] = least
        found.extend((*rows[i][:3], rows[root[i]][1]) for i in np.flatnonzero(good.any(axis=1)))

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("token", "set", "n", "sketch", "label")), strict=True):
            if held and row[0] != held[0][0]:
                look(held)
                held = []
            held.append(row)
        if len(found) > 100_000:
            yield record_batch(_ROOTED, *zip(*found, strict=True))
            found.clear()
    look(held)
    if found:
        yield record_batch(_ROOTED, *zip(*found, strict=True))


def _possible(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that their sketches don't rule out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        keep = []
        for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "m", "n")), strict=True):
            shared = most_shared([np.frombuffer(x, np.uint8)], [np.frombuffer(y, np.uint8)])[0, 0]
            keep.append(bool(_links(min(int(shared), m, n), m, n, percent)))
        part = batch.filter(pa.array(keep, pa.bool_()))
        yield record_batch(schema, part.column("a"), part.column("b"))


def _near_sizes(m: str, n: str, percent: int) -> Column:
    return F.least(m, n) * 100 >= F.greatest(m, n) * percent


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared members of each set on the left with each on the right, by products over slices of the members."""
    members = np.concatenate([*left, *right])
    values, at, often = np.unique(members, return_inverse=True, return_counts=True)
    place = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[at]
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    owner, place = owner[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(left), len(right)), np.float32)
    step = 2048
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        i, j = np.searchsorted(place, [low, low + step])
        grid = np.zeros((len(left) + len(right), step), np.float32)
        grid[owner[i:j], place[i:j] - low] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out


def _joined(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components of one list, as many as join the components."""
    sides = [[r for r in rows if r["side"] == s] for s in (0, 1)]
    left, right = sides if sides[1] else (sides[0], sides[0])
    if not left:
        return []
    sets = [[np.frombuffer(r["members"], np.uint64) for r in side] for side in (left, right)]
    sizes = [np.array([len(s) for s in side]) for side in sets]
    labels = [np.array([r["label"] for r in side]) for side in (left, right)]
    good = _links(_overlaps(*sets), sizes[0][:, None], sizes[1][None, :], percent) & (labels[0][:, None] != labels[1][None, :])
    i, j = np.nonzero(good)
    pairs = np.unique(np.sort(np.column_stack((labels[0][i], labels[1][j])), axis=1), axis=0)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs.tolist():
        if root(a) != root(b):
            parent[root(a)] = root(b)
            out.append((a, b))
    return out


@lean
def _blocks(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[dict] = []
    current = None
    found: list[tuple[int, int]] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["pair"] != current:
                found += _joined(held, percent) if held else []
                current, held = row["pair"], []
            held.append(row)
    found += _joined(held, percent) if held else []
    if found:
        yield record_batch(schema, *zip(*found, strict=True))


def similar(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id (the smallest doc_id reachable by links, itself
    included) of every document. Runs jobs while it is built."""
    spark = docs.sparkSession
    parts = partitions(spark)
    docs = docs.select("doc_id", "text")
    profile = saved(docs.mapInArrow(partial(_profile, width=width), _PROFILE_SQL), "profile")
    own = profile.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("set"), "n")
    total, posted = own.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1), F.lit(0)),
    ).first()
    counts = saved(profile.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")), "counts")
    # The least count that at most MOST_FREQUENT shingles reach.
    often, reached = -(-total // MOST_FREQUENT) + 1, 0
    for r in counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().orderBy(F.desc("n")).collect():
        reached += r["count"]
        if reached > MOST_FREQUENT:
            break
        often = min(often, r["n"])
    top = counts.where(F.col("n") >= often).toArrow()
    order = np.argsort(top.column("a").to_numpy().view(np.uint64))
    frequent = top.column("a").to_numpy().view(np.uint64)[order]
    places = top.column("n").to_numpy()[order]
    # Expected length of the list that a posting of a rare shingle falls in.
    rare, squares = counts.where(F.col("n") < often).agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n").cast("double") ** 2), F.lit(0.0))
    ).first()
    scan = (squares + max(0, total - int(places.sum()) - rare)) / max(1, total - int(places.sum()))
    # Sizes in steps of about 2 percent, so that there are few; all below 100 by themselves.
    size = F.when(F.col("n") < 100, F.col("n")).otherwise(F.ceil(F.pow(F.lit(1.02), F.ceil(F.log(1.02, "n")))))
    sizes = own.where("n > 0").groupBy(size.cast("long").alias("n")).count().collect()
    small = boundary([(r["n"], r["count"]) for r in sizes], scan, percent)
    tasks = max(parts, -(-int(posted) // A_TASK))
    packed = docs.mapInArrow(
        partial(_postings, width=width, percent=percent, frequent=frequent, places=places, small=small, buckets=4 * tasks),
        PACKED_SQL,
    )
    listed = saved(
        packed.repartition(tasks, "bucket").mapInArrow(_survivors, _LISTED_SQL).distinct(), "postings"
    )
    lists = saved(_distinct_lists(listed), "lists")
    spent(listed)
    sketches = profile.where("kind = 0").join(lists.select(F.col("set").alias("b")).distinct(), "b", "left_semi")
    sketches = sketches.groupBy(F.col("b").alias("set")).agg(F.max("sketch").alias("sketch"))
    sketches = saved(sketches, "sketches")
    lists = saved(_distinct_lists(_without_far(_labelled(lists, None), sketches, parts, percent).drop("root")), "lists")
    # The sets in question, from one document each.
    one = own.join(lists.select("set").distinct(), "set", "left_semi").where("doc_id is not null")
    one = saved(one.groupBy("set").agg(F.min("doc_id").alias("doc_id")), "chosen")
    # Their texts are not shuffled; a set's name follows from its text.
    asked = one.select("doc_id").distinct()
    others = own.where("doc_id is not null").select("doc_id").join(asked, "doc_id", "left_anti")
    sure, doubtful = told(docs.where("doc_id is not null"), "doc_id", asked, others)
    members = saved(
        sure.unionByName(doubtful).select("text").mapInArrow(partial(_members, width=width), "set long, members binary"),
        "sets",
    )
    if members.count() > members.select("set").distinct().count():  # rows that repeat a doc_id
        members = saved(members.dropDuplicates(["set"]), "sets")
    # Sets of one doc_id belong together.
    several = own.where("doc_id is not null").groupBy("doc_id").agg(F.min("set").alias("a"), F.max("set").alias("b"))
    several = several.where("a <> b").join(own.where("n > 0"), "doc_id").select("a", F.col("set").alias("b"))
    links = saved(several, "links")
    reach = lists.groupBy("set").agg(F.sum("m").alias("reach"))
    lists = saved(lists.join(reach, "set"), "lists")
    tested = None
    labels = None
    for turn in range(STAR_ROUNDS):
        labelled = _labelled(lists, labels)
        rank = F.lit(0) if turn else -F.col("reach")
        centre = labelled.groupBy("token").agg(
            F.min(F.struct(rank.alias("rank"), F.xxhash64("set", F.lit(turn)).alias("mark"), "set", "n", "label")).alias("c")
        )
        pairs = (
            labelled.join(centre, "token")
            .where((F.col("label") != F.col("c.label")) & _near_sizes("n", "c.n", percent))
            .select(
                F.greatest("set", "c.set").alias("a"), F.least("set", "c.set").alias("b"),
                F.least("n", "c.n").alias("m"), F.greatest("n", "c.n").alias("n"),
            )
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        x = sketches.select(F.col("set").alias("a"), F.col("sketch").alias("x"))
        y = sketches.select(F.col("set").alias("b"), F.col("sketch").alias("y"))
        pairs = saved(pairs.join(x, "a").join(y, "b").mapInArrow(partial(_possible, percent=percent), "a long, b long"), "pairs")
        x = wanted(members, "set", pairs, "a").select(F.col("set").alias("a"), F.col("members").alias("x"))
        y = wanted(members, "set", pairs, "b").select(F.col("set").alias("b"), F.col("members").alias("y"))
        result = saved(pairs.join(x, "a").join(y, "b").mapInArrow(partial(_test, percent=percent), "a long, b long, linked boolean"), "tested")
        tested = result.drop("linked") if tested is None else tested.unionByName(result.drop("linked"))
        links = links.unionByName(result.where("linked").select("a", "b"))
        labels = components(links)
    # Lists with several components are left, and of these the members that may link with another component.
    labelled = saved(_labelled(lists.where("m > 2"), labels), "labelled")
    state = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    labelled = labelled.join(state.where("low <> high").select("token"), "token", "left_semi")
    open_lists = saved(_labelled(_distinct_lists(_without_far(labelled, sketches, parts, percent)), labels), "open")
    # A list ties together only members that may link; other lists of a member may be about other sets.
    first = open_lists.where("root is null").groupBy("token").agg(F.min("set").alias("first"))
    tied = open_lists.join(first, "token", "left")
    canopies = components(tied.select(F.col("set").alias("a"), F.coalesce("root", "first").alias("b")))
    canopies = canopies.select(F.col("node").alias("set"), F.col("component").alias("canopy"))
    grouped = saved(_grouped(open_lists.join(canopies, "set", "left").withColumn("canopy", F.coalesce("canopy", "set"))), "groups")
    main = F.col("label").eqNullSafe(F.col("main"))
    dealt = (
        grouped.withColumn("hash", F.xxhash64("set"))
        .withColumn(
            "block",
            F.when(main, F.pmod("hash", F.greatest("mains", F.lit(1))))
            .otherwise(F.col("mains") + F.pmod("hash", F.greatest("others", F.lit(1))))
            .cast("int"),
        )
        .withColumn(
            "partner",
            F.explode(F.sequence(F.when(main, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)),
        )
        .select(
            "set",
            "label",
            F.concat_ws(
                "-", "group.kind", "group.number", "group.part", F.least("block", "partner"), F.greatest("block", "partner")
            ).alias("pair"),
            (F.col("block") > F.col("partner")).cast("int").alias("side"),
        )
        .join(wanted(members, "set", grouped, "set"), "set")
        .repartition(parts, "pair")
        .sortWithinPartitions("pair")
        .select("pair", "side", "label", "members")
    )
    more = saved(dealt.mapInArrow(partial(_blocks, percent=percent), "a long, b long"), "joined")
    spent(members)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    grouped = own.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn(
        "group", F.when(F.col("n") > 0, F.coalesce("component", "set"))
    )
    least = grouped.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    return grouped.join(least, "group", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"),
    )


def _distinct_lists(listed: DataFrame) -> DataFrame:
    """Lists of two or more members with their number ``m``; of lists with the same members one stays."""
    mark = F.xxhash64("set")
    tokens = listed.groupBy("token").agg(
        F.count("*").alias("m"), F.min("set").alias("low"), F.max("set").alias("high"),
        F.sum(mark.bitwiseAND(0xFFFFFFFF)).alias("mark"), F.sum(F.shiftright(mark, 32)).alias("more"),
    )
    same = ("m", "low", "high", "mark", "more")
    tokens = tokens.where("m > 1").groupBy(*same).agg(F.min("token").alias("token")).select("token", "m")
    return listed.join(tokens, "token")


def _grouped(placed: DataFrame) -> DataFrame:
    """The groups in which members of open lists are compared: ``set``, ``label``, ``group`` and the group's blocks.

    Members of one ``canopy`` are a group, unless they are more than ``CANOPY`` and its lists send fewer shingles."""
    canopy = F.struct(F.lit(1).alias("kind"), F.col("canopy").alias("number"), F.lit(0).cast("long").alias("part"))
    single = F.struct(F.lit(0).alias("kind"), F.col("token").alias("number"), F.coalesce("root", F.lit(0)).alias("part"))
    whole, by_list = (
        placed.select("canopy", "set", "n", "label", group.alias("group")).distinct() for group in (canopy, single)
    )
    sizes = whole.groupBy("canopy").agg(F.count("*").alias("size"))
    crowded = saved(sizes.where(F.col("size") > CANOPY).select("canopy"), "crowded")
    whole = whole.join(_dealt_to(whole), "group")
    if crowded.isEmpty():
        return whole.select("set", "label", "group", "main", "mains", "others")
    by_list = by_list.join(crowded, "canopy", "left_semi")
    by_list = by_list.join(_dealt_to(by_list), "group")
    whole_costs, list_costs = (
        groups.select("canopy", "group", "sent").distinct().groupBy("canopy").agg(F.sum("sent").alias("sent"))
        for groups in (whole, by_list)
    )
    parted = list_costs.withColumnRenamed("sent", "less").join(whole_costs, "canopy").where("less < sent").select("canopy")
    parted = saved(parted, "parted")
    chosen = whole.join(parted, "canopy", "left_anti").unionByName(by_list.join(parted, "canopy", "left_semi"))
    return chosen.select("set", "label", "group", "main", "mains", "others")


def _dealt_to(grouped: DataFrame) -> DataFrame:
    """Of each ``group`` with several labels: the numbers of blocks of its largest label ``main`` and of the ``others``, and the
    shingles ``sent``. Without ``mains`` all blocks meet; blocks of ``main`` meet the others only, where that sends less.

    A block has about ``BLOCK`` sets and ``BLOCK_MEMBERS`` shingles at most."""

    def blocks(sets: Column, shingles: Column) -> Column:
        return F.ceil(F.greatest(sets / float(BLOCK), shingles / float(BLOCK_MEMBERS)))

    labels = grouped.groupBy("group", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    groups = labels.groupBy("group").agg(
        F.count("*").alias("labels"), F.sum("c").alias("c"), F.sum("n").alias("n"),
        F.max(F.struct("n", "c", "label")).alias("top"),
    )
    groups = groups.where("labels > 1").select(
        "group", "n", "top", blocks(F.col("c"), F.col("n")).alias("all"), blocks(F.col("top.c"), F.col("top.n")).alias("mains"),
        blocks(F.col("c") - F.col("top.c"), F.col("n") - F.col("top.n")).alias("others"),
    )
    apart = F.col("top.n") * F.col("others") + (F.col("n") - F.col("top.n")) * (F.col("mains") + F.col("others"))
    together = F.col("n") * F.col("all")
    fewer = apart < together
    return groups.select(
        "group",
        F.when(fewer, F.col("top.label")).alias("main"),
        F.when(fewer, F.col("mains")).otherwise(0).cast("int").alias("mains"),
        F.when(fewer, F.col("others")).otherwise(F.col("all")).cast("int").alias("others"),
        F.least(apart, together).alias("sent"),
    )


def _without_far(labelled: DataFrame, sketches: DataFrame, parts: int, percent: int) -> DataFrame:
    """Lists of up to ``BLOCK`` sets without the members that can link with none of another label, and
    their roots; longer ones whole, without roots."""
    compared = (
        labelled.where(F.col("m") <= BLOCK)
        .join(sketches, "set")
        .repartition(parts, "token")
        .sortWithinPartitions("token")
        .mapInArrow(partial(_pruned, percent=percent), _ROOTED_SQL)
    )
    longer = labelled.where(F.col("m") > BLOCK).select("token", "set", "n", F.lit(None).cast("long").alias("root"))
    return saved(compared.unionByName(longer), "pruned")


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("label", F.col("set"))
    known = labels.select(F.col("node").alias("set"), F.col("component").alias("label"))
    return lists.join(known, "set", "left").withColumn("label", F.coalesce("label", "set"))
