"""Hand-made documents with all edge cases, and plain versions of the word rules."""

from __future__ import annotations

import random
import re

from fieldledger.llm.common import reach_workers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = ["size", "n_words", "labels", "score", "kept", "set", "n", "component_id", "spans", "_key", "shard", "bucket"]


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abdeglmnorstué", k=rng.randint(1, 8))) for _ in range(words))


def edited(text: str, seed: int, edits: int) -> str:
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def cases() -> list[tuple]:
    """doc_id, text, lang, source, n_chars: nulls, empty and long texts, ties, repeats, copies, shared passages."""
    base, passage = prose(1, 120), prose(2, 90)
    texts: list[str | None] = [None, "", " ", "\n\t", "one", "One two", "one two three four", "  a  b ", "日本 語 ß ﬁ"]
    texts += [base, base, base.upper(), prose(3, 4000), "na " * 700, "x" * 3000, "ab" * 900]
    texts += [edited(base, i, 1 + i % 4) for i in range(12)]
    texts += [prose(20 + i, 30) + " " + passage + " " + prose(40 + i, 30) for i in range(8)]
    texts += [prose(60 + i, 20 + 7 * i) for i in range(20)]
    texts += [passage + "\n" + passage, "é" * 500, "Released under the MIT License.", "Licensed under CC BY-NC 4.0. " * 3]
    sources = ["b", "a", None, "ä", "b", "b", ""]
    rows = [(i, t, "en", sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], rows[30], (None, base, None, None, None), (None, None, None, None, None)]
    return rows


def documents(spark, rows: list[tuple] | None = None, clashing: bool = False):
    reach_workers(spark)
    out = spark.createDataFrame(cases() if rows is None else rows, SCHEMA).repartition(3)
    for name in CLASHES if clashing else ():
        out = out.selectExpr("*", f"'x' as `{name}`")
    return out


def ordered(df, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
