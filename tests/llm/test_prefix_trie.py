from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from noisefleet.llm import prefix_trie

SCHEMA = "conv_id bigint, turn int, role string, text string, level string, `before` int"


def brute(rows):
    """Nodes by prefixes as tuples."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += children[p] == 0
        saved[p] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return {(members[p][0], len(p)): (members[p[:-1]][0] if p else None, len(members[p]), children[p], leaves[p], saved[p],
                                      hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p in members}


def built(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    found = prefix_trie.trie(*prefix_trie.branched(df)).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found}
    assert len(out) == len(found)
    return out


def conversations(seed, n, words, most):
    rng = random.Random(seed)
    for c in range(n):
        for t in range(rng.randrange(1, most)):
            yield (c * 7 % 1000 - 20, t, rng.choice(["user", "assistant"]), rng.choice(words), "x", 1)


@pytest.mark.parametrize("piece", [2, 5, 64])
def test_like_brute_force(spark, monkeypatch, piece):
    # short pieces, small batches and several tasks: every border is met
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = list(conversations(piece, 160, ["", "a", "ab", "été \U0001f600"], 9))
        assert built(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_conversations_and_many_copies(spark):
    long = [(c, t, "user", f"turn {t if t < 150 or c == 300 else t + c}", "x", 1) for c in (300, 301, 302, 417) for t in range(200 + c % 5)]
    copies = [(c, t, "user", "same", "x", 1) for c in range(1000, 1400) for t in range(3)]
    rows = long + copies
    assert built(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [(1, None, None, None, None, None), (1, 0, "user", "a", "x", 1), (1, 0, "user", "a", "x", 1), (1, 0, None, "b" * 70, "x", 1),
            (100, 3, "user", "a" * 100_000, "x", 1), (103, 1, "user", "b", "x", 1), (150, 1, "", "", "x", 1), (-5, 0, "user", "neg", "x", 1),
            (None, 0, "user", "lost", "x", 1), (2, 5, "assistant", "only", "x", 1), (201, 0, "user", "alone", "x", 1)]
    assert built(spark, rows) == brute(rows)
    assert built(spark, rows[:1]) == brute(rows[:1])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(*prefix_trie.branched(df)).count() == 0
