import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from regista.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs string"


def brute(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) if kids[s] else 1
        saved[s] = sum(saved[k] for k in kids[s]) + ((len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0)
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
    return sorted((len(s), min(m), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], digest(s)) for s, m in members.items())


def found(spark, rows):
    nodes = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    return sorted((r.depth, r.conv_id, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect())


def made(name):
    draw = random.Random(name)
    if name == "mixed":
        return [(c, None if t == 0 else t, draw.choice(["u", None, "a"]), draw.choice(["x", "yy", "é", None, "zzz"])) for c in range(70) for t in range(draw.randrange(7))]
    if name == "copies":  # one conversation that most have, and beginnings of it
        return [(c, t, "u", str(t)) for c in range(150) for t in range(1 + c % 5)] + [(c, t, "u", str(t)) for c in range(150, 400) for t in range(5)]
    if name == "long":  # a common beginning over many shards
        return [(c, t, "u", str(t) if t < 90 else f"{c} {t}") for c in range(40) for t in range(100)]
    return {"empty": [], "no id": [(None, 1, "u", "x")], "one": [(5, None, None, None)], "no turns": [(1, 1, "u", "x")]}[name]


@pytest.mark.parametrize("name", ["mixed", "copies", "long", "empty", "no id", "one", "no turns"])
def test_nodes_equal_brute_force_over_many_shards(spark, monkeypatch, name):
    monkeypatch.setattr(prefix_trie, "SHARD", 60)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    assert found(spark, made(name)) == brute(made(name))


def test_ties_and_repeated_turns_have_a_fixed_order(spark):
    rows = [(5, 1, "u", "a"), (5, 1, "u", "b"), (5, 1, "u", "a"), (6, 1, "u", "b"), (6, 1, "u", "a"), (6, 1, "u", "a")]
    nodes = found(spark, rows)
    assert nodes == found(spark, rows[::-1]) and max(n[0] for n in nodes) == 3


def test_double_array_holds_each_child_once():
    draw = np.random.default_rng(5)
    trie, children, level = prefix_trie.DoubleArray(500), {}, np.zeros(1, dtype=np.int64)
    for _ in range(6):
        parents = np.sort(np.repeat(level, draw.integers(1, 9, len(level))))
        key = np.unique(parents * 500 + draw.integers(0, 500, len(parents)))
        level = np.sort(slots := trie.add(key // 500, key % 500))
        children |= {(int(p), int(t)): int(s) for p, t, s in zip(key // 500, key % 500, slots, strict=True)}
        level = level[:: 1 + len(level) // 200]
    assert len(set(children.values())) == len(children)
    assert all(trie.step(np.array([p]), np.array([t]))[0] == s for (p, t), s in children.items())
    parents = {p for p, _ in children}
    assert all((trie.step(np.full(500, p), np.arange(500)) >= 0).sum() == sum(q == p for q, _ in children) for p in list(parents)[:20])
    assert len(trie.check) < 20 * len(children) + 2048


def test_digest_of_many_ids_is_made_piece_by_piece(spark):
    ids = list(range(0, 9000, 2))
    keyed = spark.createDataFrame([(1, 2, i) for i in reversed(ids)] + [(1, 3, 7)], "s1 long, s2 long, conv_id long")
    told = {(r.s1, r.s2): r.ends for r in prefix_trie.ends_digests(keyed).collect()}
    assert told == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"7").hexdigest()}
