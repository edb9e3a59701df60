import random
import re

from samples import groups, prose

from inkwitness.llm.ngram_join import ngram_groups


def sets(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def check(docs, rows, n, percent, columns="doc_id long, text string"):
    got = {r.doc_id: r for r in ngram_groups(docs(rows, columns), n, percent).collect()}
    held = {r[0]: sets(r[1], n) for r in rows}
    want = groups(held, lambda a, b: bool(held[a]) and bool(held[b]) and 100 * len(held[a] & held[b]) >= percent * len(held[a] | held[b]))
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in held.items()}
    return want


def near(text, seed, changes):
    draw, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10 ** 6)}"
    return " ".join(words)


def test_equals_brute_force(docs):
    base, passage = prose(1, 120), prose(2, 60)
    rows = [(i, prose(100 + i, 80)) for i in range(30)]
    rows += [(100 + i, base) for i in range(15)]  # exact copies
    rows += [(200 + i, near(base, i, i % 9)) for i in range(60)]  # near copies, some linked only through others
    rows += [(300 + i, f"{passage} {prose(900 + i, 5 + i)}") for i in range(25)]  # a passage that many share
    rows += [(400, None), (401, ""), (402, " \t"), (403, "one"), (404, "ONE"), (405, "one two"), (406, "one two"), (407, "É é"), (408, "é é"), (409, prose(5, 6000)), (410, near(prose(5, 6000), 1, 20))]
    for n, percent in ((3, 90), (5, 80)):
        assert len(set(check(docs, rows, n, percent).values())) < len(rows) - 30


def test_threshold_is_exact(docs):
    # single words as shingles of size one: 9 of 10 in common is on the line, 8 of 9 below it
    ten = " ".join(f"w{i}" for i in range(10))
    nine = " ".join(f"w{i}" for i in range(9))
    got = check(docs, [(1, ten), (2, nine), (3, " ".join(f"v{i}" for i in range(9))), (4, " ".join(f"v{i}" for i in range(8)))], 1, 90)
    assert got[2] == 1 and got[4] == 4


def test_extra_columns_and_nulls(docs, spark):
    rows = [(1, "a b c d", "x", 3), (2, "a b c d", None, 4), (None, "a b c d", "y", 5)]
    out = ngram_groups(docs(rows, "doc_id long, text string, gram string, n int"), 3, 90).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out) == [(-1, -1), (1, 1), (2, 1)]
    assert ngram_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_ids_are_one_node(docs):
    out = ngram_groups(docs([(5, "a b c d e"), (5, "k l m n o"), (9, "k l m n o"), (7, "a b c d e")]), 3, 90).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(5, 5), (7, 5), (9, 5)} and len(out) == 4
