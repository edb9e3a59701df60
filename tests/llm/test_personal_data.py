"""Base spans against plain patterns; added spans on planted cases."""

import re
import time

from samples import prose

from inkwitness.llm.personal_data import estimate, personal_data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": all(int(p) <= 255 for p in match.split(".")) if kind == "ip" else True,
            "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def base(text):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(k, m.group()))


ODD = [None, "", "a@b.c_d@e.f x@y.z@q.r", "foo@bar baz_qux@mail.de.", "1.2.3.4.5.6.7.8 001.2.3.255 256.1.1.1", "4111 1111-1111 1111, 4111111111111112",
       "+1 (017) 555-7713). +12 3 +49-30.1234 567-", "😀 a@b.cd 😀 +49 (30) 1234567 8\n+1", "x" * 300_000 + "@y", "7" * 300_000, "a@b" + ".c" * 60_000, "1 " * 60_000, "+" * 50_000]


def test_base_spans_equal_the_patterns_whatever_the_text(docs):
    start = time.time()
    got = personal_data(docs([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, base int")).collect()
    assert len(got) == len(ODD) and time.time() - start < 120
    for r in got:
        if len(ODD[r.doc_id] or "") < 1000:
            assert [tuple(s) for s in r.base] == base(ODD[r.doc_id]), r.doc_id
    long = {r.doc_id: [tuple(s) for s in r.base] for r in got}
    assert long[10] == [(0, 0, 120_003, "email")] and long[8] == long[9] == long[11] == long[12] == []


def test_planted_spans_are_added_and_clean_texts_left_alone(docs):
    rows = [(i, prose(i, 60)) for i in range(40)]
    rows += [(100 + i, f"{prose(i, 20)} call +1 (017) 555-77{10 + i}, card 4485 2757 4230 8{320 + i} or {4485275742308320 + 7 * i} please {prose(50 + i, 9)}") for i in range(30)]
    rows += [(200 + i, f"{prose(i, 20)} version {i}.{i + 3}, pages 12-{i + 20} of volume {1000 + i}/{2000 + i} {prose(i, 9)}") for i in range(30)]
    got = {r.doc_id: [(s.kind, rows_text[s.start:s.end]) for s in r.added] for r in personal_data(docs(rows + rows[:1])).collect()
           for rows_text in [dict(rows)[r.doc_id]]}
    assert all(not got[i] for i in got if i < 100 or i >= 200)
    assert sum(bool(re.search(r"[0-9]{16}", m)) for i in range(100, 130) for _, m in got[i]) >= 25


def test_estimate_trusts_the_labellers_that_agree():
    patterns = {(1, 1, 0, 1, 0, 0): 60, (1, 1, 0, 0, 0, -1): 20, (-1, -1, 0, -1, 0, 1): 70, (-1, 0, 0, -1, 0, -1): 25}
    posterior = estimate(patterns)
    assert min(posterior[p] for p in patterns if p[0] == 1) > 0.9 > 0.1 > max(posterior[p] for p in patterns if p[0] == -1)
    assert estimate({}) == {}


def test_an_empty_table(spark):
    assert personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []
