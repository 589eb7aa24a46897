"""What the operators on SentencePiece models share: the parsed model, text cut at spaces, cached words."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import regex

#: The mark that stands for a space in pieces.
MARK = "▁"
# Kinds of pieces in the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CACHED_WORDS = 400_000

_BREAK = regex.compile(r"(?<=[^ ])(?= )")


@dataclass(frozen=True)
class Model:
    """What a model file says. ``pieces`` are (text, score, kind) in the order of their ids."""

    kind: int
    pieces: tuple[tuple[str, float, int], ...]
    unknown: int
    byte_fallback: bool
    normalizer: bytes
    dummy_prefix: bool
    extra_spaces_go: bool
    escapes: bool

    @property
    def splits_at_spaces(self) -> bool:
        """Whether no piece holds a mark after another character, so that text may be cut before a space."""
        return not any(MARK in piece.lstrip(MARK) for piece, _, kind in self.pieces if kind == NORMAL)


@cache
def load(path: str) -> Model:
    """Parses the protobuf of a model file."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    rules = proto.normalizer_spec
    return Model(
        proto.trainer_spec.model_type,
        tuple((p.piece, p.score, p.type) for p in proto.pieces),
        next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN),
        proto.trainer_spec.byte_fallback,
        rules.precompiled_charsmap,
        rules.add_dummy_prefix,
        rules.remove_extra_whitespaces,
        rules.escape_whitespaces,
    )


def words(text: str) -> list[str]:
    """The text cut before each run of spaces; the first part gets the space that the model puts first.

    Joined, the parts are a space and the text."""
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return _BREAK.split(" " + text)
    first, *rest = text.split(" ")
    return [" " + first, *[" " + w for w in rest]]


def rests(text: str) -> list[str]:
    """The :func:`words` of a text, each without the space that starts it."""
    if text and ("  " in text or text[0] == " "):
        return [w[1:] for w in words(text)]
    return text.split(" ") if text else []


class Cached(dict):
    """Remembers what ``make`` gives for a word; starts anew when it holds ``CACHED_WORDS``."""

    def __init__(self, make: Callable[[str], object]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> object:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[word] = self.make(word)
        return out
