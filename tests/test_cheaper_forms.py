"""Cheaper forms of rules and counts give what the plain forms give."""

import re

from pyspark.sql import functions as F

from inkwitness import fixed_values as V
from inkwitness.operators import authorship as A, cleaning as C, matching as M, pages as P, span_rules as SR


def test_each_text_is_judged_once(spark):
    texts = spark.createDataFrame([(1, "word " * 20), (2, "Experience Education Skills me@example.org " + "word " * 20), (3, "few"), (4, None)],
                                  "doc_id long, full_text string")
    got = C.admission(texts)
    want = {r.doc_id: r.admitted for r in C.resume_likelihood(texts).collect()}
    assert {r.doc_id: r.error for r in got.collect()} == {d: V.NOT_A_DOCUMENT if ok is False else None for d, ok in want.items()}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 2


def test_cosine_of_given_pairs(spark):
    texts = spark.createDataFrame([(1, "zebra zebra lion"), (2, "lion zebra"), (3, "the of"), (4, "tiger")], "doc_id long, text string")
    terms = M.term_counts(texts, "doc_id", "text")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (1, 4), (4, 9)], "id_a long, id_b long")
    got = sorted((r.id_a, r.id_b, round(r.cosine, 6)) for r in M.tf_cosine(
        terms.withColumnRenamed("doc_id", "id_a"), terms.withColumnRenamed("doc_id", "id_b"), pairs).collect())
    assert got == [(1, 2, 0.948683), (1, 2, 0.948683), (1, 4, 0.0), (2, 3, 0.0), (4, 9, 0.0)]


def test_word_lists_of_a_page_stay_in_step(spark):
    """Words arrive in any order and may lack text; a page's lists are gathered apart from each other."""
    rows = [(1, 1, n, 14.0 * (9 - n), 0.0, None if n == 2 else f"w{n}") for n in range(10)]
    words = spark.createDataFrame(rows[::-1], "doc_id long, page int, word_no int, y0 double, x0 double, text string").repartition(5)
    (r,) = P.page_word_order(words).collect()
    assert (r.word_count, r.disorder_ratio) == (10, 1.0) and r.sample_words[:4] == ["w0", "w1", None, "w3"]


def test_phrases_are_the_longest_at_their_place(spark):
    plain = "(?i)(?:" + "|".join(re.escape(p) for p in sorted(V.MARKER_PHRASES, key=len, reverse=True)) + ")"
    texts = [" ".join(p.upper() + " " + p[:-1] + p for p in V.MARKER_PHRASES), "Thus, synergy. SYNERGIZE synerg in this in the context", "hence"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_extract_all("t", F.lit(A.PHRASE_PATTERN), F.lit(0)).alias("p")).collect()
    assert [r.p for r in got] == [re.findall(plain, t) for t in texts]


def test_cheap_looks_rule_nothing_out():
    """Every alternative of every pattern holds one of the pieces looked for; the classes have no ASCII character."""
    def literals(parsed):
        """Shortest matches of all alternatives."""
        out = [""]
        for kind, value in parsed:
            name = str(kind)
            if name == "LITERAL":
                more = [chr(value)]
            elif name == "IN":
                more = [" "] if str(value[0][0]) == "CATEGORY" else [chr(value[0][1])]
            elif name == "SUBPATTERN":
                more = literals(value[3])
            elif name == "BRANCH":
                more = [x for branch in value[1] for x in literals(branch)]
            elif name == "MAX_REPEAT":
                more = literals(value[2]) if value[0] else [""]
            else:
                raise ValueError(name)
            out = [a + b for a in out for b in more]
        return out

    assert len(SR.PROMPT_PIECES) == len(V.INJECTION_PATTERNS)
    for (pattern, _, _), pieces in zip(V.INJECTION_PATTERNS, SR.PROMPT_PIECES):
        shortest = literals(re._parser.parse(pattern))
        assert all(re.fullmatch(pattern, x) for x in shortest) and all(any(p in x.lower() for p in pieces) for x in shortest)
    ascii_text = "".join(map(chr, range(128)))
    outside = {c: ord(c) for c in V.ZERO_WIDTH}
    assert min(outside.values()) > 127 and not any(
        a <= ord(c) <= b for c in ascii_text for s, ranges in V.SCRIPT_RANGES.items() if s != "Latin" for a, b in ranges)
