import hashlib

import numpy as np
from samples import prose

from inkwitness.llm import fingerprints
from inkwitness.llm.fingerprints import K, S, document_fingerprints, edited, fingerprint, likeness, printed


def test_anchors_equal_a_plain_search():
    text = prose(3, 120)
    codes = np.array([0x110000] * (K - 1) + [ord(c) for c in text] + [0x110001] * (K - 1), np.uint64)
    names, places = fingerprints._anchors(codes)
    inner = {}

    def value(run):
        if run not in inner:
            h = run[0]
            for c in run[1:]:
                h = (h * 0x100000001B3 + c) % 2 ** 64
            h ^= h >> 31
            h = h * 0x9E3779B97F4A7C15 % 2 ** 64
            inner[run] = h ^ h >> 29
        return inner[run]

    want = []
    for i in range(len(codes) - K + 1):
        window = tuple(map(int, codes[i:i + K]))
        runs = [value(window[j:j + S]) for j in range(K - S + 1)]
        if min(runs) in (runs[0], runs[-1]):
            want.append(i)
    assert places.tolist() == want
    again, moved = fingerprints._anchors(np.concatenate([codes[:1].repeat(500), codes]))
    assert dict(zip(moved.tolist(), again.tolist(), strict=True)).items() >= {p + 500: n for p, n in zip(places.tolist(), names.tolist(), strict=True)}.items()


def test_stretches_do_not_matter(monkeypatch):
    text = prose(4, 900)
    whole = fingerprint(text)
    monkeypatch.setattr(fingerprints, "STRETCH", 700)
    assert printed(fingerprint(text)) == printed(whole) and len(whole) == fingerprints.KEPT


def test_likeness():
    a, b = prose(1, 500), prose(2, 500)
    assert likeness(fingerprint(a), fingerprint(a)) == 1 and likeness(fingerprint(""), fingerprint("")) == 1 and likeness(fingerprint(a), fingerprint("")) == 0
    assert likeness(fingerprint(a), fingerprint(b)) < 0.15 < 0.3 < likeness(fingerprint(a), fingerprint(edited(a, b))) < 0.7
    assert likeness(fingerprint(a), fingerprint("x " + a)) > 0.9
    assert 0 < likeness(fingerprint("a short text here"), fingerprint(edited("a short text here", b))) < 1


def test_equals_brute_force(docs, spark):
    rows = [(i * 3 - 50, prose(i % 40, 1 + i % 60), "x") for i in range(130)] + [(9000, None, "y"), (9001, "", "y"), (9002, "é😀b", None), (9003, prose(7, 20000), "z")]
    rows += [(4, "tie b", "t"), (4, "tie a", "t"), (None, "no id", "n")]
    got = document_fingerprints(docs(rows, "doc_id long, text string, part string")).collect()
    order = sorted(((i is None, i, t or "") for i, t, _ in rows), key=lambda r: (r[0], r[1] or 0, r[2]))
    want = []
    for k, (_, i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        changed = edited(text, following)
        x, y = fingerprint(text), fingerprint(changed)
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), printed(x), printed(y), likeness(x, y), likeness(x, fingerprint(following))))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_few_rows(spark):
    assert document_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = document_fingerprints(spark.createDataFrame([(5, "alone it stands")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    none = document_fingerprints(spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert len(none) == 2
