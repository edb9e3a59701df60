import random

import public_tokenizers
from samples import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwitness.llm.edit_counts import Tree, counted_edits, cut, encoding, with_edits

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
COUNT = lambda text: len(encoding(PATH, PATTERN).encode_ordinary(text))
LETTERS = st.text(alphabet=st.sampled_from("ab c' d\n.1's\té<|"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(LETTERS, st.lists(st.tuples(st.integers(-2, 60), st.integers(-1, 20), LETTERS), max_size=6), st.integers(1, 8))
def test_counts_follow_edits(text, edits, leaf):
    from inkwitness.llm import edit_counts

    old, edit_counts.LEAF = edit_counts.LEAF, leaf
    edit_counts.cut.__defaults__ = (leaf,)
    try:
        leaves = cut(text)
        tree = Tree(leaves, [COUNT(x) for x in leaves])
        assert "".join(leaves) == text and tree.tokens == COUNT(text) and tree.chars == len(text)
        for at, gone, new in edits:
            tree.edit(at, gone, new, COUNT)
            at = min(max(at, 0), len(text))
            text = text[:at] + new + text[min(at + max(gone, 0), len(text)):]
            assert "".join(tree.leaves) == text and tree.tokens == COUNT(text) and tree.chars == len(text)
    finally:
        edit_counts.LEAF = old
        edit_counts.cut.__defaults__ = (old,)


def test_rows_equal_a_full_count_and_little_is_encoded(spark, docs):
    draw, rows, edits = random.Random(2), [], []
    for i in range(40):
        text = prose(i, draw.choice([1, 30, 400, 4000]))
        rows.append((i, text, "x"))
        for k in range(draw.randrange(4)):
            edits.append((i, k, draw.randrange(len(text) + 1), draw.randrange(30), prose(1000 + i + k, draw.randrange(4))))
    rows += [(100, None, "y"), (101, "", "y"), (102, "word", None), (102, "word", None), (None, "no id", "z")]
    edits += [(100, 0, 0, 0, "from nothing"), (101, 0, 5, 5, "x"), (102, 0, None, 1, "x"), (102, 1, 0, 1, None), (777, 0, 0, 0, "nobody")]
    table = with_edits(docs(rows, "doc_id long, text string, edits string"), spark.createDataFrame(edits, "doc_id long, edit_no int, at long, gone long, text string"))
    got = counted_edits(table, PATH, PATTERN).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t, _ in rows}
    after = dict(texts)
    for i, _, at, gone, new in edits:
        if i in after and None not in (at, gone, new):
            after[i] = after[i][:at] + new + after[i][at + gone:]
    for r in got:
        assert (r.chars_before, r.tokens_before, r.chars_after, r.tokens_after) == (len(texts[r.doc_id]), COUNT(texts[r.doc_id]), len(after[r.doc_id]), COUNT(after[r.doc_id]))
    long = [r for r in got if r.chars_before > 10000 and r.n_edits == 1]
    assert long and all(r.chars_encoded < 3000 for r in long)


def test_empty_table(spark):
    assert counted_edits(spark.createDataFrame([], "doc_id long, text string, edits array<struct<at: long, gone: long, text: string>>"), PATH, PATTERN).collect() == []


def test_a_run_without_spaces_is_one_leaf():
    assert len(cut("x" * 5000)) == 1 and len(cut("word " * 2000)) > 10 and cut("") == [""]
