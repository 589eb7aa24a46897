"""The trie against one built turn by turn from dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fieldledger.llm import prefix_trie
from fieldledger.llm.common import reach_workers
from fieldledger.llm.queries import op11_prefix_trie

DDL = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            text = text or ""
            turns[conv].append(((turn is not None, turn or 0), role or "", hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(role, text) for _, role, _, text in sorted(t)] for c, t in turns.items()}
    members = defaultdict(list)
    children = defaultdict(set)
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(first, [])[:h] + mine[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
            if d:
                children[whole[c][: d - 1]].add(whole[c][:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        mine = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = mine + sum(saved[k] for k in children[node])
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **sizes):
    reach_workers(spark)
    df = spark.createDataFrame(rows, DDL).repartition(3).selectExpr("*", "'x' as n", "1 as total", "'y' as batch")
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **sizes).select(*COLUMNS).collect()), key=repr)


def some_rows(seed, convs, longest, words):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-150, 5 * convs), convs):
        if rng.random() < 0.2 and out:
            copied = rng.choice(out)[0]
            out += [(c, *r[1:]) for r in out if r[0] == copied]
            continue
        for turn in range(rng.randint(1, longest)):
            out.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", None, "é"]), rng.choice(words)))
    return out


@pytest.mark.parametrize("sizes", [{"first": 6, "growth": 2, "held": 4, "chunk": 8}, {"first": 1, "growth": 20, "held": 1}])
def test_equals_brute_force(spark, sizes):
    rows = some_rows(sizes["held"], 40, 11, ["a", "b", "", None, "日本 𝄞", "long " * 50])
    assert found(spark, rows, **sizes) == brute_force(rows)


def test_edges(spark):
    assert found(spark, []) == []
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, 1, "u", "x"), (7, 1, "u", "x"), (7, 1, "a", "y")]
    assert found(spark, rows) == brute_force(rows)
    # Turnless: an opening longer than the conversation, in a block without its first one.
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(short, 1, "u", "x")]
    assert found(spark, rows) == brute_force(rows) and len(brute_force(rows)) == 1


def test_long_and_hot(spark):
    """One conversation has a third of all turns, one text begins a third of all conversations."""
    rng = random.Random(5)
    rows = [(900 + c, t, "user", rng.choice("abc") if t or c % 3 else "same") for c in range(120) for t in range(6)]
    rows += [(5000, t, "user", rng.choice("ab")) for t in range(700)]
    rows += [(5002, t, r[2], r[3]) for t, r in enumerate(rows[-700:-100])]
    rows += [(5100 + 100 * c, t, "user", f"q{t}") for c in range(60) for t in range(3)]
    assert found(spark, rows) == brute_force(rows)


def test_lists_of_ids_in_pieces(spark):
    rows = [(n * 100, 0, "user", "same") for n in range(400)]
    assert found(spark, rows, chunk=64) == brute_force(rows)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op11_prefix_trie(spark, "/root/testdata/sf0.1")
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == brute_force(rows)
