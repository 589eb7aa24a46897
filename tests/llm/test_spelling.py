"""Words, near words and forms against plain versions that compare every two words."""

import random
import re
import zlib
from collections import Counter

import pytest

from fieldledger.llm import spelling
from fieldledger.llm.queries import op13_spelling_variants
from tests.llm.helpers import documents, lowered

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    return a[start + (len(a) >= len(b)) :] == b[start + (len(b) >= len(a)) :]


def plain(rows, pairs=None):
    words = plain_words(rows)
    found = {w: [] for w in words}
    if pairs is None:
        for a in words:
            found[a] = [b for b in words if near(a, b)]
    else:
        for a in words:
            found[a] = [b for b in pairs(a, words)]
    form = {}
    for a, others in found.items():
        best = min(others, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 10 * words[a] else None
    out = []
    for a in words:
        root = a
        while form[root]:
            root = form[root]
        out.append((a, form[a], root, words[a], len(found[a]), words.get(form[a])))
    return sorted(out, key=repr)


def edits(word, words):
    """The near words of ``word`` by trying every edit."""
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0xC0, 0x100)]
    tried = {word[:i] + word[i + 1 :] for i in range(len(word))}
    tried |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    tried |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return (tried - {word}) & words.keys()


def found(df):
    return sorted((tuple(r) for r in spelling.variants(df).select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abé", k=rng.randint(6, 9))) for _ in range(60)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaaaa", "abaaaaaaa", "x" * 40, "x" * 41, "ÀÿÀÿÀÿÀ", "àÿÀÿÀÿÀ"]
    rows = []
    for i in range(120):
        chosen = [rng.choice(words if rng.random() < 0.4 else words[:8]) for _ in range(rng.randint(0, 60))]
        chosen = [w.upper() if w.isascii() and rng.random() < 0.2 else w for w in chosen]
        rows.append((rng.choice([i, i, None]), rng.choice([" ", ". ", "1", "日", "\n"]).join(chosen)))
    rows += [(500 + i, "aaaaaaa " * 40) for i in range(40)] + [(7, None), (8, ""), rows[0], rows[0]]
    df = documents(spark, [(d, t, None, None, None) for d, t in rows], clashing=True)
    want = plain(rows)
    assert found(df) == want and any(r[1] for r in want) and any(r[4] > 2 for r in want)


def test_empty(spark):
    assert found(documents(spark, [])) == [] and found(documents(spark, [(1, None, None, None, None)])) == []


def test_chain_of_forms(spark):
    """Roots lie several forms away; the counts grow ten times a step."""
    chain = ["zzzzzzz", "zzzzzzy", "zzzzzxy", "zzzzwxy"]
    text = " 1 ".join(" ".join([w] * 3 * 10**i) for i, w in enumerate(chain))
    rows = [(i, text) for i in range(3)]
    got = found(documents(spark, [(d, t, None, None, None) for d, t in rows]))
    assert got == plain(rows)
    assert {r[0]: r[2] for r in got}["zzzzzzz"] == "zzzzwxy"


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(spelling, "RUN", 50)
    text = ("abcdefgh ÀÁÂÃÄÅÆÇ,éééééééé日本日本日本日本日本日本日本日本日本日本日本日本日本日本日本日本日本 " * 9 + "z" * 200).lower()
    parts = list(spelling._pieces(text.encode()))
    assert "".join(parts) == text and len(parts) > 9
    assert [w for p in parts for w in spelling._WORD.findall(p)] == spelling._WORD.findall(text)


def test_query_equals_edits(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = op13_spelling_variants(spark, "/root/testdata/sf0.01")
    want = plain(rows, edits)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == want
    assert sum(r[1] is not None for r in want) > 10
