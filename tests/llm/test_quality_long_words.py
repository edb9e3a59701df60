"""Words without a space in them reach the scorer to their last character."""

import random

from samples import prose

from inkwitness.llm.quality import PIECE, features, fit, pieces

JUNK = "#$%&*|<>{}[]~^=@+"


def run(seed, size):
    draw = random.Random(seed)
    return "".join(draw.choice(JUNK) for _ in range(size))


def test_pieces_hold_every_character():
    words = ["ab", "x" * PIECE, "字" * PIECE, "字" * (PIECE + 1), "k7" * 500]
    cut = pieces([w.encode() for w in words])
    assert b"".join(cut).decode() == "".join(words) and max(len(c.decode()) for c in cut) == PIECE
    assert cut[:3] == [w.encode() for w in words[:3]] and pieces([]) == []


def test_what_follows_a_clean_opening_counts():
    opening = "文" * PIECE
    alone, clean, junk = (features([t.encode()]) for t in (opening, opening * 50, opening + run(1, 50 * PIECE)))
    assert (alone == clean).all() and abs(alone - junk).max() > 0.5


def test_score_sees_the_tail(docs):
    bad = [" ".join(run(i * 100 + k, 8) for k in range(40)) for i in range(60)]
    model = fit(docs([(i, prose(i, 80)) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(bad)]))
    opening = "".join(prose(7, 40).split())[:PIECE]
    rows = model.score(docs([(1, opening), (2, opening + run(3, 20000)), (3, run(3, PIECE) + opening * 300)])).collect()
    assert len({r.score for r in rows}) == 3
