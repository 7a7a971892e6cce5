"""The trie of conversations against one that is built from all first turns one by one."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from shopmill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key int"


def table(spark, rows):
    return spark.createDataFrame([(*row, "own", 1) for row in rows], SCHEMA).repartition(4)


def plain(rows, rebuild=True):
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            given[conv].append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in given.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
        turns = {c: turns.get(c - int(math.fmod(c, 20)), [])[: h[c]] + v[h[c] :] for c, v in turns.items()}
    members = defaultdict(list)
    for c, v in turns.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        text = node[-1][1] if node else ""
        words = len([w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])
        saved[node] += (len(members[node]) - 1) * words
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(turns[c]) == len(node)))
        yield (
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
            leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        )


def same(found, expected):
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in found.collect()) == order(expected)


def rows(seed, convs=60, long=0):
    draw = random.Random(seed)
    out = []
    for c in range(-3, convs):
        for turn in range(draw.randrange(1, 7) if c % 11 else long or 3):
            text = draw.choice(["", "a b", "a  b", "c\td e\n", "é", None, f"own {c}" if turn > 3 else "x"])
            out.append((c * 3 if c > 30 else c, turn if turn else draw.choice([None, 0]), draw.choice(["user", None]), text))
    return out


@pytest.mark.parametrize("seed, long", [(1, 0), (2, 40)])
def test_trie_equals_plain_version(spark, seed, long):
    given = rows(seed, long=long)
    given += [(None, 0, "user", "no conversation"), given[5], given[5]]  # a null key, repeated rows
    turns = prefix_trie.ordered_turns(table(spark, given))
    same(prefix_trie.trie(turns), plain(given, rebuild=False))
    same(prefix_trie.trie(prefix_trie.with_shared_openings(turns)), plain(given))


def test_many_equal_and_deep_shared_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK", 7)
    deep = [(i, "user", f"turn {i}") for i in range(30)]
    given = [(c, *turn) for c in range(40) for turn in deep[:20]]  # a large group of equal ones
    given += [(c, *turn) for c in (100, 101) for turn in [*deep[:17], (17, "user", "other"), (18, "user", f"last {c}")]]
    given += [(c, 0, "user", "turn 0") for c in range(200, 260)]
    turns = prefix_trie.ordered_turns(table(spark, given))
    same(prefix_trie.trie(turns), plain(given, rebuild=False))


def test_empty_openings_and_tables(spark):
    # conversations whose own turns all fall away are members of the root
    given = [(c, 0, "user", "one") for c in range(1, 19)]
    turns = prefix_trie.with_shared_openings(prefix_trie.ordered_turns(table(spark, given)))
    same(prefix_trie.trie(turns), plain(given))
    none = prefix_trie.ordered_turns(table(spark, given).filter("conv_id < 0"))
    assert prefix_trie.trie(none).count() == 0
