import math

import numpy as np
import pytest
from samples import groups

from inkwitness.llm import embedding_dedup
from inkwitness.llm.embedding_dedup import near_duplicates, visits

SCHEMA = "vec_id long, embedding array<float>, label int"


def planted(seed=3, width=16):
    draw = np.random.default_rng(seed)
    rows, number = [], 0

    def add(v, label):
        nonlocal number
        rows.append((number, [float(np.float32(x)) for x in v], label))
        number += 1

    for i in range(150):
        add(draw.normal(size=width), i % 2)
    for label, base in ((0, draw.normal(size=width)), (1, draw.normal(size=width))):
        for _ in range(80):  # a near group around the threshold
            add(base + draw.normal(size=width) * 0.11 * np.linalg.norm(base) / math.sqrt(width), label)
        for k in range(20):  # copies, and the same direction at other lengths
            add(base, label)
            add(base * 2.0 ** k, label)
    odd = [None, [], [0.0] * width, [math.nan] + [1.0] * (width - 1), [math.inf] + [1.0] * (width - 1), [None] + [1.0] * (width - 1), [1.0], [2.0], [1.0, 0.0]]
    for v in odd:
        rows.append((number := number + 1, v, 0))
    rows.append((number + 1, rows[0][1], None))
    return rows


@pytest.mark.parametrize("block", [512, 24])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "CELL", 8)
    rows = planted()
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), recall=1.0).collect()}

    def linked(a, b):
        (x, l), (y, m) = held[a], held[b]
        return l is not None and l == m and x is not None and y is not None and len(x) == len(y) and float(x @ y) >= 0.98

    def unit(v):
        if not v or None in v or not all(map(math.isfinite, v)) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    held = {i: (unit(v), label) for i, v, label in rows}
    ids = list(held)
    counts = {a: sum(linked(a, b) for b in ids if b != a) for a in ids}
    want = groups(ids, linked)
    assert {i: r.n_links for i, r in got.items()} == counts and max(counts.values()) > 40
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_bound_visits_every_cell_that_may_hold_a_link():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = (x[:20, :6], x[:20, 6:])
    step = draw.normal(size=x.shape)
    y = 0.98 * x + math.sqrt(1 - 0.98 ** 2) * (step - (step * x).sum(1)[:, None] * x) / np.linalg.norm(step - (step * x).sum(1)[:, None] * x, axis=1)[:, None]
    home, cells = visits(x, books, 2 - 2 * 0.98 + 1e-9)
    other, _ = visits(y, books, 0.0)
    assert all(h == c[0] for h, c in zip(home, cells, strict=True)) and all(o in c for o, c in zip(other, cells, strict=True))
    assert np.mean([len(c) for c in cells]) < 300


def test_lower_recall_finds_most(spark):
    rows = planted()
    full = sum(r.n_links for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), recall=1.0).collect())
    most = sum(r.n_links for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), recall=0.95).collect())
    assert 0.9 * full <= most <= full


def test_empty_repeated_and_clashing(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, [1.0, 0.0], 0, "x", 5), (1, [1.0, 0.0], 0, "x", 5), (None, [1.0, 0.0], 0, "y", 6), (4, [1.0, 0.01], 0, None, None)]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA + ", name string, copies int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in out) == [(0, 0, 0, False), (1, 2, 1, True), (1, 2, 1, True), (4, 2, 1, False)]
