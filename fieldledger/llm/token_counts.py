"""Token counts without tokens: Viterbi over a unigram vocabulary that carries only best score and piece count.

An Aho-Corasick automaton finds all pieces that end at each character. The best way to a character is the match of
the highest total score; of equal ones the longest last piece, as a lattice that is filled from the left and only
replaced by strictly better paths has it. A character without a piece of its own may be passed as unknown, at ten
below the lowest score; it counts as its UTF-8 bytes where the model has byte pieces, else as one piece together
with unknown neighbours. Spaces are marks and one comes before the text. Pieces never reach over the start of a
word, so words are counted by themselves and remembered per worker.

The model file's pieces and scores are the vocabulary, whatever kind of model it was made for. Cases: a null or
empty text has no tokens; rows are handled one by one, so ties, repeats and null ids stay as they are; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cache, partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldledger.llm.common import record_batch
from fieldledger.llm.pieces import MARK, Cached, load, words

PENALTY = 10.0


def counter(path: str) -> Callable[[str], int]:
    """A function that counts the pieces of a text whose spaces are marks."""
    model = load(path)
    automaton = ahocorasick.Automaton()
    for piece, score, _ in model.pieces:
        automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    own = {piece for piece, _, _ in model.pieces if len(piece) == 1}
    unknown = min(score for _, score, _ in model.pieces) - PENALTY
    fallback = model.byte_fallback

    def count(text: str) -> int:
        best: list[float | None] = [0.0] + [None] * len(text)
        pieces = [0] * (len(text) + 1)
        lost = [False] * (len(text) + 1)  # whether the best way here ends with an unknown character
        at = 0

        def pass_by(upto: int) -> None:
            """Settles characters that have no piece of their own, up to and with ``upto``."""
            nonlocal at
            while at < upto:
                at += 1
                char = text[at - 1]
                before = best[at - 1]
                if char not in own and before is not None and (best[at] is None or before + unknown > best[at]):
                    best[at] = before + unknown
                    size = len(char.encode()) if fallback else int(not lost[at - 1])
                    pieces[at], lost[at] = pieces[at - 1] + size, True

        for last, (size, score) in automaton.iter(text):
            end = last + 1
            pass_by(last)
            before = best[end - size]
            if before is None:
                continue
            total = before + score
            if best[end] is None or total > best[end]:
                best[end], pieces[end] = total, pieces[end - size] + 1
        pass_by(len(text))
        return pieces[-1]

    def count_known(text: str) -> int:
        """As ``count`` where every character is a piece, so that each place can be reached."""
        best, pieces = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
        for last, (size, score) in automaton.iter(text):
            start = last + 1 - size
            total = best[start] + score
            if total > best[last + 1]:
                best[last + 1], pieces[last + 1] = total, pieces[start] + 1
        return pieces[-1]

    return lambda text: count_known(text) if own.issuperset(text) else count(text)


@cache
def _word_counts(path: str) -> tuple[Cached, bool]:
    count = counter(path)
    return Cached(lambda word: count(word.replace(" ", MARK))), load(path).splits_at_spaces


def count_tokens(text: str | None, path: str) -> int:
    if not text:
        return 0
    known, split = _word_counts(path)
    return sum(map(known.__getitem__, words(text))) if split else known.make(" " + text)


def _count(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
    for batch in batches:
        yield record_batch(schema, batch.column("doc_id"), [count_tokens(t, path) for t in batch.column("text").to_pylist()])


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every document for the model file ``path``."""
    return docs.select("doc_id", "text").mapInArrow(partial(_count, path=path), "doc_id bigint, n_tokens bigint")
