import random

import numpy as np
from samples import prose

from inkwitness.llm.quality import KEEP, accuracies, fit


def table(n):
    draw, rows = random.Random(5), []
    for i in range(n):
        text = prose(i, draw.randint(3, 300))
        kind = i % 12
        if kind == 0:
            text = " ".join(w + draw.choice(["###", "$$$", "&&&"]) for w in text.split())
        elif kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == 2:
            text = (text.split()[0] + " ") * 60
        rows.append((i, text, int(kind > 2)))
    return rows


def test_bad_documents_go_and_good_ones_stay(docs):
    rows = table(1200)
    model = fit(docs([(i, t) for i, t, _ in rows[:900]]))
    got = {r.doc_id: r.score >= KEEP for r in model.score(docs([(i, t, "x") for i, t, _ in rows[900:]], "doc_id long, text string, posterior string")).collect()}
    assert np.mean([got[i] == bool(q) for i, _, q in rows[900:]]) >= 0.97
    assert np.mean([got[i] for i, _, q in rows[900:] if q]) >= 0.98


def test_em_finds_the_labellers_accuracies():
    draw = np.random.default_rng(2)
    truth = draw.random(20000) < 0.8
    right, speaks = np.array([0.9, 0.8, 0.95, 0.7]), np.array([0.9, 0.9, 0.6, 0.9])
    votes = np.where(draw.random((20000, 4)) < right, np.where(truth, 1, 2)[:, None], np.where(truth, 2, 1)[:, None]) * (draw.random((20000, 4)) < speaks)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    rates, posterior = accuracies(patterns, counts.astype(float))
    assert np.abs(rates[1, :, 1] / (rates[1, :, 1] + rates[1, :, 2]) - right).max() < 0.03
    assert ((posterior >= 0.5)[:, None] * counts[:, None]).sum() / counts.sum() > 0.7


def test_odd_tables(spark, docs):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, prose(1, 80), "d"), (4, prose(1, 80), "d"), (None, prose(2, 50000), None)]
    df = docs(rows, "doc_id long, text string, score string")
    out = fit(df).score(df).collect()
    assert len(out) == 6 and all(r.score == 0 and r.posterior == 0 for r in out if r.doc_id in (1, 2, 3))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fit(empty).score(empty).collect() == []


def test_a_sample_is_enough(docs):
    rows = table(900)
    model = fit(docs([(i, t) for i, t, _ in rows]), sample=200)
    got = {r.doc_id: r.score >= KEEP for r in model.score(docs([(i, t) for i, t, _ in rows])).collect()}
    assert np.mean([got[i] == bool(q) for i, _, q in rows]) >= 0.95
