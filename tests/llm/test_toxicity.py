import random
import time

from samples import prose

from inkwitness.llm.toxicity import Lexicon, _matcher, folded, hits, learn, toxicity

BAD = ["idiot", "moron", "scumbag"]


def table(n):
    draw, rows = random.Random(8), []
    for i in range(n):
        words = prose(i, draw.randint(5, 120)).split()
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(BAD))
        elif i % 31 in (1, 2):
            words.insert(draw.randrange(len(words)), "village idiot savant")
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy_disguise_and_exceptions(spark, docs):
    rows = table(600)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows[:400]] + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    lexicon = learn(docs([(i, x) for i, x, _ in rows] + [(700, None)]), labels)
    got = {r.doc_id: r for r in toxicity(docs([(i, x) for i, x, _ in rows[400:]]), lexicon).collect()}
    assert sum(got[i].predicted == t for i, _, t in rows[400:]) >= 0.98 * 200
    clean = prose(1, 60)
    for word in ("idiot", "IDIOT", "1d10t", "іdіоt", "i​diot", "ｉｄｉｏｔ", "mor0n!", "$cumb@g"):
        assert lexicon.score(f"{clean} {word} {clean} {word} moron") > lexicon.score(clean), word
        assert lexicon.score(" ".join([word] * 3)) >= 0.7, word
    assert any("village idiot" in p or "idiot savant" in p for p in lexicon.exceptions)
    named = Lexicon({" idiot ": 3.0}, frozenset({"idiot proof"}), (-2.0, 2.0, 1.0))
    assert named.score("an idiot proof thing") == named.score("a plain proof thing") < named.score("an idiot thing")


def test_long_texts_are_read_whole():
    lexicon = Lexicon({" idiot ": 3.0}, frozenset(), (-2.0, 2.0, 1.0))
    long = "plain words " * 60000
    assert lexicon.score(long + "idiot") > lexicon.score(long)


def test_odd_tables(spark, docs):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "idiot", None)]
    lexicon = Lexicon({" idiot ": 3.0}, frozenset(), (-2.0, 2.0, 1.0))
    out = toxicity(docs(rows, "doc_id long, text string, score string"), lexicon).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id}) == 1
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    none = learn(docs(rows[:2], "doc_id long, text string, lang string"), empty)
    assert none.weights == {} and none.score("idiot") == none.score(None)
    assert toxicity(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []


def test_folding():
    assert folded("Thе 1d10t! $tupid### 2024 x")[0] == " the idiot stupid x "
    assert folded(None) == ("  ", 0)


def test_exceptions_by_one_sweep_equal_a_plain_comparison():
    draw = random.Random(3)
    lexicon = Lexicon({" idiot ": 3.0, " mor": 2.0}, frozenset({"village idiot", "idiot proof", "moron idiot moron"}), (-2.0, 2.0, 1.0))
    automaton = _matcher(lexicon)
    plain = _matcher(Lexicon(lexicon.weights, frozenset(), lexicon.curve))
    for size in (0, 1, 5, 400):
        text = f" {' '.join(draw.choice(['village', 'idiot', 'moron', 'proof', 'x']) for _ in range(size))} "
        spared = [(m + 1, m + 1 + len(p)) for p in lexicon.exceptions for m in range(len(text)) if text.startswith(f" {p} ", m)]
        want = {s: v for s, v in hits(plain, text).items() if not any(a <= s < b for a, b in spared)}
        assert hits(automaton, text) == want
    crowded = "an idiot proof thing " * 50_000
    start = time.perf_counter()
    assert lexicon.score(crowded) == lexicon.score("thing " * 50_000) and time.perf_counter() - start < 20
