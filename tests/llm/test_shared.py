import random

import pytest
from pyspark.sql import functions as F

from inkwitness.llm.common import components, running_total, word_count


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200), (300, None)]
    lead = {n: n for e in edges if None not in e for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if b is not None and lead[a] != lead[b]:
                lead[a] = lead[b] = min(lead[a], lead[b])
                changed = True
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if b is not None and a != b for n in (a, b)}
    assert got == {n: lead[n] for n in linked}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_running_total_of_hot_group(spark):
    rows = [(None if i % 5 else "x", i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, n long")
    out = running_total(df, ["g"], ["i"], F.col("n"), (F.col("i") / 16).cast("int"), "before").collect()
    want = {}
    for g, i, n in rows:
        want[i] = want.get(("sum", g), 0)
        want["sum", g] = want[i] + n
    assert {r.i: r.before for r in out} == {i: want[i] for i in range(500)}


def test_word_count(spark):
    rows = [(None, 0), ("", 0), (" \t\n\x0b\x0c\r", 0), ("a", 1), (" a  b c d ", 2), ("x " * 3000, 3000)]
    got = spark.createDataFrame(rows, "text string, want long").select(word_count(F.col("text")).alias("n"), "want").collect()
    assert all(r.n == r.want for r in got)
