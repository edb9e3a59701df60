"""The trie against one of nested dictionaries."""

import hashlib
import random

import numpy as np
import pytest

from inkwitness.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    nodes = {}
    for c, steps in convs.items():
        for d in range(len(steps) + 1):
            nodes.setdefault(tuple(steps[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        under = [p for p in nodes if p[:len(path)] == path]
        children = lambda p: sum(len(q) == len(p) + 1 and q[:len(p)] == p for q in nodes)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(path))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children(path), sum(not children(p) for p in under),
                 sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in under if p), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def sample():
    draw = random.Random(8)
    rows = [(c, t, draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", "", None])) for c in range(60) for t in range(draw.randrange(1, 6))]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 140) for t in range(300)]  # copies, longer than a window
    rows += [(200, None, "user", "first"), (200, -5, "user", "then"), (None, 1, "user", "nobody")]
    return rows


@pytest.mark.parametrize("shard", [4, 4096])
def test_equals_nested_dictionaries(spark, monkeypatch, shard):
    monkeypatch.setattr(T, "SHARD", shard)
    monkeypatch.setattr(T, "NODES", 50)
    rows = sample()
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", d1 int").repartition(4)
    got = T.prefix_trie(table).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_perfect_hash_is_minimal_and_verified():
    draw = np.random.default_rng(2)
    high, low = draw.integers(-2**63, 2**63, 5000), draw.integers(-2**63, 2**63, 5000)
    slots = T.PerfectHash(high, low).slots(high, low)
    assert sorted(slots) == list(range(5000))
    with pytest.raises(ValueError):
        T.PerfectHash(np.array([1, 1]), np.array([2, 2]))


def test_an_empty_table(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
