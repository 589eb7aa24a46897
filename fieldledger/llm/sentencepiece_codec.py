"""SentencePiece encoding and decoding with the tokenizers library as its backend.

The model protobuf is parsed and rebuilt: normalizer (identity, or the precompiled character map), the mark for
spaces and the space put first, pieces with their scores (a unigram model) or merges in the order of the scores (a
BPE model), and byte fallback. New words of a batch are encoded by the rebuilt model and remembered for the task; where
pieces may reach over spaces or a normalizer has rules, whole texts are encoded instead. Whatever a worker encodes for
the first time, of every text, is compared with the SentencePiece library, ids and decoded text; a difference fails.
No piece reaches over a space where words are encoded, so a text has the ids of its words.

Cases: a null text gives null ids and a null decoded text, an empty one no ids; a mark character in a text decodes
to a space; rows are handled one by one; an empty table gives an empty one; other columns are passed through, and a
column that has the name of a result is replaced.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm import pieces as sp
from fieldledger.llm.common import lean, record_batch, slices

#: Words that a worker remembers from one task to the next at most; in between it may be another operator's.
KEPT_WORDS = 50_000


def _merges(model: sp.Model) -> list[tuple[str, str]]:
    """All ways to make a piece from two others; better pieces first, of one piece by the ids of its parts."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (sp.NORMAL, sp.USER_DEFINED)}
    found = []
    for piece, score, kind in model.pieces:
        if kind != sp.NORMAL:
            continue
        for i in range(1, len(piece)):
            left, right = piece[:i], piece[i:]
            if left in ids and right in ids:
                found.append((-score, ids[piece], ids[left], ids[right], left, right))
    return [(x[4], x[5]) for x in sorted(found)]


def build(path: str):
    """A ``tokenizers.Tokenizer`` that gives the ids of the model file."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    model = sp.load(path)
    if model.kind == sp.UNIGRAM:
        vocabulary = [(p, s) for p, s, _ in model.pieces]
        core = models.Unigram(vocabulary, unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE(
            {p: i for i, (p, _, _) in enumerate(model.pieces)},
            _merges(model),
            unk_token=model.pieces[model.unknown][0],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.normalizer)] if model.normalizer else []
    if model.extra_spaces_go:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", sp.MARK))
    out.normalizer = normalizers.Sequence(steps)
    ends = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(sp.MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return out


class Codec:
    """Encodes and decodes texts; one per worker."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        # Threads of the library; a worker is started before it loads the library, so none are lost.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model = sp.load(path)
        self.tokenizer = build(path)
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        simple = not self.model.normalizer and not self.model.extra_spaces_go
        self.by_word = simple and self.model.dummy_prefix and self.model.splits_at_spaces
        self.known: dict[str, bytes] = {}
        self.bytes = [
            bytes([int(p[3:5], 16)]) if kind == sp.BYTE else p.replace(sp.MARK, " ").encode() if kind == sp.NORMAL else b""
            for p, _, kind in self.model.pieces
        ]
        self.bytes[self.model.unknown] = " ⁇ ".encode()

    def _texts(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[list[int]]:
        """Ids of words without the space that starts them; the normalizer marks it and those that follow."""
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(sp.MARK + w.replace(" ", sp.MARK))] if w else [] for w in words]

    def _compared(self, texts: list[str], found: list[list[int]]) -> list[bytes]:
        """The ids as bytes, after a comparison with the SentencePiece library."""
        back = self.other.decode(found) if found else []
        for text, ids, right, decoded in zip(texts, found, self.other.encode(texts, num_threads=1), back, strict=True):
            if ids != right or self.decode(ids) != decoded:
                raise ValueError(f"the rebuilt tokenizer differs from the model on {text[:200]!r}")
        return [np.array(ids, "<i4").tobytes() for ids in found]

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text as little-endian 32-bit integers; null for null."""
        if not self.by_word:
            plain = [t or "" for t in texts]
            found = self._compared(plain, self._texts(plain))
            return [None if t is None else i for t, i in zip(texts, found, strict=True)]
        if len(self.known) >= sp.CACHED_WORDS:
            self.known.clear()
        parts = [None if t is None else sp.rests(t) for t in texts]
        new = list(set().union(*filter(None, parts)).difference(self.known))
        self.known.update(zip(new, self._compared(new, self._words(new)), strict=True))
        # A lone space has an empty rest, for which the normalizer puts nothing.
        if "" in self.known and not self.known[""]:
            self.known[""] = np.array([self.tokenizer.token_to_id(sp.MARK)], "<i4").tobytes()
        return [None if p is None else b"".join(map(self.known.__getitem__, p)) for p in parts]

    def rest(self) -> None:
        """Forgets the words of a task if they are many."""
        if len(self.known) > KEPT_WORDS:
            self.known = {}

    def decode(self, ids: Iterable[int]) -> str:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        text = b"".join([self.bytes[i] for i in ids]).decode(errors="replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def verify(docs: DataFrame, path: str) -> None:
    """Encodes and compares all texts by itself; :func:`encoded` compares them as well. Fails on a difference."""
    encoded(docs.select("text"), path, ["n_pieces"]).agg(F.sum("n_pieces")).first()


@lean
def _encoded(batches: Iterable[pa.RecordBatch], path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    tool = codec(path)
    for batch in batches:
        for part in slices(batch, "text"):
            raw = tool.encode(part.column("text").to_pylist())
            lengths = [0 if r is None else len(r) // 4 for r in raw]
            ids = [None if r is None else np.frombuffer(r, "<i4") for r in raw]
            back = [None if i is None else tool.decode(i) for i in ids]
            crc = [None if r is None else zlib.crc32(r) for r in raw]
            new = {
                "n_pieces": pa.array(lengths, pa.int64()),
                "piece_ids": pa.array(ids, pa.list_(pa.int32())),
                "ids_crc32": pa.array(crc, pa.int64()),
                "decoded": pa.array(back, pa.string()),
            }
            columns = [new[n] if n in new else part.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    tool.rest()


_RESULTS = {"n_pieces": "bigint", "piece_ids": "array<int>", "ids_crc32": "bigint", "decoded": "string"}


def encoded(docs: DataFrame, path: str, results: Iterable[str] = tuple(_RESULTS)) -> DataFrame:
    """The columns of ``docs`` and of ``results``: n_pieces, piece_ids, ids_crc32 (unsigned CRC-32 of the ids as
    little-endian 32-bit integers) and decoded (the text made from the ids again)."""
    results = list(results)
    kept = [f for f in docs.schema.fields if f.name not in results]
    names = [f.name for f in kept] + results
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {_RESULTS[n]}" for n in results])
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(partial(_encoded, path=path, names=names), schema)
