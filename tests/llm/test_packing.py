import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from samples import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkwitness.llm.packing import fractional_patterns, pack, whole_patterns
from inkwitness.llm.word_tokens import word_tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ODD = ["", None, " ", "<|endoftext|> and <|startoftext|>", "a\x1cb\x85c", "İstanbul ΟΔΟΣ", "é é ẛ̣", "don't we'll 12a3 ###!! x y", "日本語 テキスト", "x" * 5000, "\U0001f600 ok​"]


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(text):
    assert np.frombuffer(word_tokenizer(PATH).ids(text), "<u4").tolist() == WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeéñßÀZ '.,-!#19\n\t</w>|"), max_size=60) | st.text(max_size=30))
def test_ids_equal_the_tokenizer(text):
    assert np.frombuffer(word_tokenizer(PATH).ids(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_every_token_of_the_vocabulary_is_reached():
    words = [w for t in WHOLE.get_vocab() if t.endswith("</w>") and (w := t[:-4]).isalpha() and w.isascii()]
    assert all(np.frombuffer(word_tokenizer(PATH).ids(w), "<u4").tolist() == e.ids
               for w, e in zip(words, WHOLE.encode_batch(words, add_special_tokens=False), strict=True))


def test_column_generation_reaches_the_optimum():
    # 3 pieces fill a sequence in one way only: 44, 33 and 23 of 100
    size, demand = np.array([23, 33, 44]), np.array([700.0, 700.0, 700.0])
    patterns, used = fractional_patterns(size, demand, 100)
    assert abs(used.sum() - 700) < 1e-6 and (patterns.T @ used >= demand - 1e-6).all()
    draw = np.random.default_rng(1)
    size, demand = np.arange(1, 65), draw.integers(0, 3000, 64)
    held = demand > 0
    whole = whole_patterns(size[held], demand[held], 64)
    room = sum(times for _, times in whole)
    assert (sum(p * t for p, t in whole) >= demand[held]).all() and all(p @ size[held] <= 64 for p, _ in whole)
    _, used = fractional_patterns(size[held], demand[held].astype(float), 64)
    least = max((size * demand).sum() / 64, demand[size > 32].sum())
    assert least <= used.sum() + 1e-6 and used.sum() <= room <= used.sum() + 12


def check(spark, rows, out, length):
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    times = {}
    for doc_id, text in rows:
        times.setdefault(doc_id, []).append(text)
    for doc_id, texts in times.items():
        want = []
        for text in texts:
            ids = np.array(WHOLE.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
            want += [(s, len(ids[s:s + length]), zlib.crc32(ids[s:s + length].tobytes()), len(ids)) for s in range(0, len(ids), length)]
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id]) == sorted(want)
    for held in by_sequence.values():
        place = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= length


def test_every_token_once(spark, docs):
    draw = random.Random(4)
    rows = [(i, prose(i, draw.choice([1, 3, 40, 200, 700]))) for i in range(150)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    rows += [(5000, prose(1, 3000)), (5000, prose(1, 3000)), (5001, "same")] + [(6000 + i, "a copy of few words") for i in range(60)] + [(None, "no id")]
    out = pack(docs([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class string, length int"), PATH, 256).collect()
    check(spark, rows, out, 256)
    fill = {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert sum(256 - f for f in fill.values()) < 0.05 * sum(fill.values())


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
