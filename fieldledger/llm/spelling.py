"""Spelling variants grouped around their most frequent form, by a dictionary of pairs of trie nodes.

Words are counted in all texts (:func:`counted`) and numbered by falling frequency, ties in code-point order, so the
best of several words is the one of the smallest number. Two tries give every beginning of a word and every ending of a
word an integer (:func:`paired`): words come sorted, so one task holds only the path of the last one; nodes of up
to ``TOP`` letters, which several tasks meet, are numbered by their letters. The dictionary of pairs holds

* for each letter of a word the pair (beginning before it, ending after it): the word with that letter *skipped*;
* for each place between letters the pair (beginning, ending): the word with something *inserted* there.

Two words that share a skipped pair differ by a replaced letter. A word whose inserted pair is another's skipped one is
that one less a letter; of a run of equal letters only the first counts as skipped there. So every two near words meet
in exactly one pair, no pair is checked afterwards, and a pair has at most one word for each letter and one more. Nodes
that lie on the path of a single word cannot be shared, and their pairs are left out.

Only counts per pair and the best word in it are passed on, never two words together.

Cases: a null text has no words; a null doc_id reads as an empty one where letters are dropped; a repeated row counts
again; only A to Z are lower-cased; texts go through in pieces of about ``RUN`` bytes that end beside a letter, so
memory grows only with the longest word; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import partitions, record_batch, saved, text_buffers
from fieldledger.plans import numbered

# The shortest word, the rarest one, how many runs lose a letter, and how much more frequent a form is.
LETTERS, OCCURRENCES, DROPPED, TIMES = 7, 2, 31, 10
# Depth of the nodes that are numbered by their letters, bytes of text worked on at once, and words counted in a task.
TOP, RUN, HELD = 6, 1 << 20, 200_000
_WORD = re.compile("[a-zÀ-ÿ]{%d,}" % LETTERS)
# Lower-cased UTF-8: a byte that no letter begins with, nor goes on with.
_BESIDE = re.compile(rb"[\x00-\x60\x7b-\x7f\xc2\xc4-\xff]")
_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
_PATHS = pa.schema([("wid", pa.int64()), ("word", pa.string()), ("path", pa.list_(pa.int64()))])
_PAIRS = pa.schema([("p", pa.int64()), ("s", pa.int64()), ("kind", pa.int8()), ("wid", pa.int64())])
_LINKS = pa.schema([("wid", pa.int64()), ("near", pa.int64()), ("best", pa.int64())])
# Kinds of pairs: a place between letters, a letter equal to the one before it, another letter.
_GAP, _AGAIN, _SKIP = 0, 1, 2


def _pieces(text: bytes) -> Iterator[str]:
    """A lower-cased text in parts of about RUN bytes that no word crosses."""
    start = 0
    while len(text) - start > RUN:
        found = _BESIDE.search(text, start + RUN)
        if not found:
            break
        yield text[start : found.start()].decode()
        start = found.start()
    yield text[start:].decode()


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of texts after some have lost a letter, counted as far as a task can hold them."""
    counts: dict[str, int] = {}
    crc32 = zlib.crc32
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        raw = memoryview(data)
        for doc, start, end in zip(batch.column("doc").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            seed = crc32(f"{doc}:".encode())
            # bytes.lower() changes A to Z only.
            for piece in _pieces(bytes(raw[start:end]).lower()):
                for word, n in Counter(_WORD.findall(piece)).items():
                    h = crc32(word.encode(), seed)
                    if h % DROPPED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LETTERS:
                            continue
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= HELD:
                    yield record_batch(_COUNTED, list(counts), list(counts.values()))
                    counts = {}
    if counts:
        yield record_batch(_COUNTED, list(counts), list(counts.values()))


def counted(docs: DataFrame) -> DataFrame:
    """``word`` and ``n``: how often each word of at least LETTERS letters occurs, from OCCURRENCES on."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    found = rows.mapInArrow(_words, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _common(a: str, b: str) -> int:
    shorter = min(len(a), len(b))
    if a[:shorter] == b[:shorter]:
        return shorter
    for i in range(shorter):
        if a[i] != b[i]:
            return i
    return shorter


def _top(word: str) -> list[int]:
    """Numbers of the nodes of up to TOP letters: all below zero, from the letters and their count."""
    code, out = 0, [-1]
    for i, letter in enumerate(word[:TOP], 1):
        code = code << 8 | ord(letter)
        out.append(-1 - (code << 3 | i))
    return out


def _paths(words: Iterable[str]) -> Iterator[list[int]]:
    """For sorted words the numbers of the nodes on their paths, down to the last one that another word may share."""
    number = TaskContext.get().partitionId() << 40
    path: list[int] = []
    word, above = None, 0
    for following in _and_none(words):
        if word is not None:
            below = _common(word, following) if following is not None else 0
            depth = min(max(above, below, TOP), len(word))
            kept = above if above >= TOP else TOP
            head = path[: above + 1] if above >= TOP else _top(word)
            path = [*head, *range(number, number + max(depth - kept, 0))]
            number += max(depth - kept, 0)
            yield path[: depth + 1]
            above = below
        word = following


def _and_none(words: Iterable[str]) -> Iterator[str | None]:
    yield from words
    yield None


def _with_paths(
    batches: Iterable[pa.RecordBatch], backwards: bool
) -> Iterator[tuple[pa.RecordBatch, list[list[int]]]]:
    """Each batch with the paths of its words. A path needs the word after it, so batches follow one step behind."""
    seen: list[pa.RecordBatch] = []

    def words() -> Iterator[str]:
        for batch in batches:
            if len(batch):
                seen.append(batch)
                for word in batch.column("word").to_pylist():
                    yield word[::-1] if backwards else word

    paths: list[list[int]] = []
    for path in _paths(words()):
        paths.append(path)
        if len(paths) == len(seen[0]):
            yield seen.pop(0), paths
            paths = []


def _forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, paths in _with_paths(batches, backwards=False):
        yield record_batch(_PATHS, batch.column("wid"), batch.column("word"), paths)


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths, the run of each place and its place in the run."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of nodes of each word, from the path of its beginnings and that of its endings."""
    for batch, paths in _with_paths(batches, backwards=True):
        words = batch.column("word").to_pylist()
        wid = batch.column("wid").to_numpy()
        length = np.array([len(w) for w in words])
        letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        first = np.cumsum(length) - length
        again = np.zeros(len(letters), bool)
        again[1:] = letters[1:] == letters[:-1]
        again[first] = False
        ends = batch.column("path").offsets.to_numpy().astype(np.int64)
        begin, begins = batch.column("path").values.to_numpy(), ends[:-1]
        end = np.array([n for path in paths for n in path], np.int64)
        deep = np.array([len(path) for path in paths])
        after = np.cumsum(deep) - deep
        for gap in (0, 1):
            # Letters before the place, from the fewest whose ending is shared to the most whose beginning is.
            most = np.minimum(np.diff(ends) - 1, length - 1 + gap)
            least = np.maximum(length - 1 + gap - (deep - 1), 0)
            owner, i = _runs(np.maximum(most - least + 1, 0))
            i = i + least[owner]
            p = begin[begins[owner] + i]
            s = end[after[owner] + length[owner] - 1 + gap - i]
            kind = np.zeros(len(i), np.int8) if gap else np.where(again[first[owner] + i], _AGAIN, _SKIP).astype(np.int8)
            yield record_batch(_PAIRS, p, s, kind, wid[owner])


def paired(words: DataFrame) -> DataFrame:
    """The dictionary of pairs (``p``, ``s``) of all words, with the ``kind`` of each entry and its word's number."""
    parts = partitions(words.sparkSession)
    back = F.reverse("word")
    forward = (
        words.select("wid", "word")
        .repartition(parts, F.substring("word", 1, TOP))
        .sortWithinPartitions("word")
        .mapInArrow(_forward, "wid bigint, word string, path array<bigint>")
    )
    return (
        forward.repartition(parts, F.substring(back, 1, TOP))
        .sortWithinPartitions(back)
        .mapInArrow(_pairs, "p bigint, s bigint, kind tinyint, wid bigint")
    )


def _links(p: np.ndarray, s: np.ndarray, kind: np.ndarray, wid: np.ndarray) -> pa.RecordBatch:
    """For whole pairs, sorted by pair and word: how many words each word meets there, and the best of them."""
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    pair = np.cumsum(new) - 1
    pairs = int(pair[-1]) + 1
    none = np.iinfo(np.int64).max
    gap, skipped = kind == _GAP, np.flatnonzero(kind != _GAP)
    inserted = np.full(pairs, none)
    inserted[pair[gap]] = wid[gap]
    size = np.bincount(pair[skipped], minlength=pairs)
    begins = np.cumsum(size) - size
    of_skipped = np.append(wid[skipped], [none, none])
    best = np.where(size > 0, of_skipped[np.minimum(begins, len(skipped))], none)
    second = np.where(size > 1, of_skipped[np.minimum(begins + 1, len(skipped))], none)
    # Of a word with a skipped letter: the others with one, and the word without it.
    own, mine = pair[skipped], wid[skipped]
    shorter = np.where(kind[skipped] == _SKIP, inserted[own], none)
    near = size[own] - 1 + (shorter != none)
    first = np.minimum(np.where(best[own] == mine, second[own], best[own]), shorter)
    # Of the word without it: those that have it, but once.
    once = skipped[kind[skipped] == _SKIP]
    longer = np.bincount(pair[once], minlength=pairs)
    top = np.full(pairs, none)
    np.minimum.at(top, pair[once], wid[once])
    is_met = (inserted != none) & (longer > 0)
    some = near > 0
    return record_batch(
        _LINKS,
        np.concatenate((mine[some], inserted[is_met])),
        np.concatenate((near[some], longer[is_met])),
        np.concatenate((first[some], top[is_met])),
    )


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] | None = None
    for batch in filter(len, batches):
        columns = [batch.column(c).to_numpy() for c in ("p", "s", "kind", "wid")]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
        # The last pair may go on in the next batch; it is short.
        last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield _links(*(c[:cut] for c in columns))
        held = [c[cut:] for c in columns]
    if held is not None:
        yield _links(*held)


def links(words: DataFrame) -> DataFrame:
    """For each word that has a near one: the number of them, and that of the best."""
    sorted_pairs = paired(words).repartition(partitions(words.sparkSession), "p", "s").sortWithinPartitions("p", "s", "wid")
    met = sorted_pairs.mapInArrow(_met, "wid bigint, near bigint, best bigint")
    return met.groupBy("wid").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame, hops: int) -> DataFrame:
    """``wid`` and ``root`` of the words that have a form: the end of the chain of forms."""
    step = forms.select(F.col("wid").alias("_from"), F.col("form").alias("_to"))
    out = forms.select("wid", F.col("form").alias("root"))
    for _ in range(hops - 1):
        out = out.join(step, F.col("root") == F.col("_from"), "left").select("wid", F.coalesce("_to", "root").alias("root"))
    return out


def variants(docs: DataFrame) -> DataFrame:
    """Every word with its form, the root of its chain of forms, its count, its number of near words, and the form's count.

    A form is TIMES as frequent as its word at least, so the longest chain follows from the highest count."""
    words = numbered(counted(docs), [F.desc("n"), F.col("word")], "wid")
    words = saved(words.select("wid", "word", "n"), "words")
    found = saved(links(words), "near-words")
    most = words.agg(F.max("n")).first()[0] or 0
    hops = 0
    while OCCURRENCES * TIMES ** (hops + 1) <= most:
        hops += 1
    known = words.join(found, "wid", "left")
    others = words.select(F.col("wid").alias("best"), F.col("word").alias("_form"), F.col("n").alias("_n"))
    is_form: Column = F.col("_n") >= TIMES * F.col("n")
    rows = known.join(others, "best", "left").select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form_wid"),
        F.when(is_form, F.col("_form")).alias("form"),
        F.when(is_form, F.col("_n")).alias("form_n"),
    )
    rows = saved(rows, "forms")
    forms = rows.where("form_wid is not null").select("wid", F.col("form_wid").alias("form"))
    names = words.select(F.col("wid").alias("root"), F.col("word").alias("_root"))
    roots = _roots(forms, hops).join(names, "root").select("wid", "_root")
    return rows.join(roots, "wid", "left").select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n"
    )
