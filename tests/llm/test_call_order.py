"""Orders of calls in long conversations, against a plain topological fold."""

import random

import pytest

from tidemark.llm import tool_calls


def plain(calls):
    """(late, hops) of each call that needs no cycle; None of those that do."""
    at = {c: (p, [n for n in dict.fromkeys(after) if n is not None]) for c, p, after in calls}
    needs = {c: [n for n in after if n in at] for c, (_, after) in at.items()}
    users = {}
    for c, ns in needs.items():
        for n in ns:
            users.setdefault(n, []).append(c)
    open_, keys = {c: len(ns) for c, ns in needs.items()}, dict.fromkeys(at)
    ready = [c for c, n in open_.items() if not n]
    while ready:
        c = ready.pop()
        keys[c] = max([(at[c][0], 0)] + [(keys[n][0], keys[n][1] + 1) for n in needs[c]])
        for u in users.get(c, []):
            open_[u] -= 1
            if not open_[u]:
                ready.append(u)
    return keys


def settled(spark, conversations, **how):
    df = spark.createDataFrame([(v, *c) for v, calls in conversations.items() for c in calls], "conv_id long, call_id string, position long, after array<string>")
    out = {v: {} for v in conversations}
    for r in tool_calls.ordered(df, **how).collect():
        out[r.conv_id][r.call_id] = None if r.cyclic else (r.late, r.hops)
    return out


def test_long_chains_and_small_cycles(spark):
    n = 1500
    chain = [(f"c{i}", n - i, [f"c{i - 1}"] if i else []) for i in range(n)]
    ring = [("a", 5, ["b"]), ("b", 6, ["a"]), ("x", 7, ["a", "c3"]), ("o1", 1, ["o3"]), ("o2", 2, ["o1"]), ("o3", 3, ["o2"]), ("own", 4, ["own"]), ("mesh1", 1, ["mesh2", "mesh3"]), ("mesh2", 2, ["mesh1", "mesh3"]), ("mesh3", 3, ["mesh1", "mesh2"])]
    conversations = {1: chain, 2: [(f"c{i}", i, [f"c{i - 1}"] if i else []) for i in range(n)] + ring, 3: [("p", 1, []), ("q", 2, ["p"])]}
    assert settled(spark, conversations) == {v: plain(c) for v, c in conversations.items()}
    assert sum(k is None for k in plain(conversations[2]).values()) == len(ring)


@pytest.mark.parametrize("rounds", [0, 8])
def test_any_order(spark, rounds):
    conversations = {}
    for v in range(40):
        rnd, calls = random.Random(v), []
        for i in range(rnd.randrange(1, 25)):
            calls.append((f"c{i}", rnd.randrange(12), [f"c{rnd.randrange(max(1, i)) if v % 2 else rnd.randrange(25)}" for _ in range(rnd.choice([0, 1, 1, 1, 2]))]))
        conversations[v] = calls
    got = settled(spark, conversations, rounds=rounds)
    assert got == {v: plain(c) for v, c in conversations.items()}
