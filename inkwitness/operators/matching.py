"""Skills and the match of a text with a reference text (a job description)."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from inkwitness import fixed_values as V
from inkwitness.functions import text as X


def _plain_word(branch: str) -> bool:
    return re.fullmatch(r"\\b\w+\\b", branch) is not None


def _branches(pattern: str) -> list[str]:
    """Alternatives of a skill pattern, each with its leading boundary."""
    first, *rest = pattern.split(r"|\b")
    return [first] + [r"\b" + b for b in rest]


def _required(branch: str) -> str:
    """A lower-case piece every match of ``branch`` must contain."""
    plain = re.sub(r"\((?:\?:|\?!)[^)]*\)[?]?|\[[^\]]*\]", "\0", branch.replace(r"\b", "\0"))
    plain = re.sub(r"\w\?", "\0", plain).replace(r"\s+", "\0").replace(r"\.", "\1").replace(r"\+", "\2").replace(".", "\0")
    return max(plain.replace("\1", ".").replace("\2", "+").split("\0"), key=len).lower()


def _first_word(branch: str) -> str | None:
    """The whole word every match of ``branch`` starts with, where the pattern fixes one."""
    head = re.match(r"\\b(\w+)(?=\\b|\\s\+|\\\.|/|-)", branch)
    return head.group(1).lower() if head else None


def extract_skills(text: Column) -> Column:
    """Sorted names of the skills a text mentions.

    Alternatives that are one plain word are looked up among the words of the text, which are split
    off once.  The others are expressions, each behind a test that is far cheaper than it: its first
    word, or failing that a piece of it, must be there.
    """
    low = F.lower(text)
    singles = sorted({w for p in V.SKILL_PATTERNS.values() for w in map(_first_word, _branches(p)) if w})
    all_words = F.regexp_extract_all(low, F.lit(X.ANY_WORD), F.lit(0))
    present = F.array_intersect(all_words, F.array(*[F.lit(w) for w in singles]))

    def names(present: Column, low: Column) -> Column:
        out = []
        for name in sorted(V.SKILL_PATTERNS):
            tests = []
            for branch in _branches(V.SKILL_PATTERNS[name]):
                if _plain_word(branch):
                    tests.append(F.array_contains(present, branch[2:-2].lower()))
                else:
                    head = _first_word(branch)
                    maybe = F.array_contains(present, head) if head else F.contains(low, F.lit(_required(branch)))
                    # a look at the first letter is cheaper than the boundary before it
                    tests.append(maybe & text.rlike(f"(?id)(?={branch[2]})" + X.with_boundaries(branch)))
            out.append(F.when(reduce(or_, tests), F.lit(name)))
        return F.array_compact(F.array(*out))

    # a lambda over a one-element array evaluates the shared parts once per text
    shared = F.array(F.struct(present.alias("present"), low.alias("low")))
    return F.get(F.transform(shared, lambda s: names(s["present"], s["low"])), F.lit(0))


def term_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf).  Only the texts are shuffled, by key; what is grouped by key afterwards stays where it is."""
    return texts.select(key, text).repartition(key).select(key, F.explode(X.tokenise(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tf_cosine(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine of term counts for given pairs.

    ``left(id_a, term, tf)``, ``right(id_b, term, tf)``, ``pairs(id_a, id_b)``.  Dot products and
    squared norms are whole numbers; there is one division at the end.  A text's terms travel to its pairs as one list.
    """
    bag = lambda df, key, name: df.groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias(name))
    both = pairs.select("id_a", "id_b").distinct().join(bag(left, "id_a", "_a"), "id_a").join(bag(right, "id_b", "_b"), "id_b")
    zero = F.lit(0).cast("long")
    # a pair's two bags lie in one row, so that its terms need no further shuffle
    terms = both.select("id_a", "id_b", F.inline(F.concat(
        F.transform("_a", lambda x: F.struct(x["term"].alias("term"), x["tf"].alias("a"), zero.alias("b"))),
        F.transform("_b", lambda x: F.struct(x["term"].alias("term"), zero.alias("a"), x["tf"].alias("b"))))))
    met = terms.groupBy("id_b", "id_a", "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = lambda x, y: F.sum(F.col(x) * F.col(y))
    sums = met.groupBy("id_b", "id_a").agg(total("a", "b").alias("dot"), total("a", "a").alias("n2_a"), total("b", "b").alias("n2_b"))
    return pairs.join(sums, ["id_a", "id_b"], "left").select(
        "id_a", "id_b", cosine(F.col("dot"), F.col("n2_a"), F.col("n2_b")).alias("cosine"))


def cosine(dot: Column, n2_a: Column, n2_b: Column) -> Column:
    return F.coalesce(dot.cast("double") / F.sqrt(n2_a.cast("double") * n2_b.cast("double")), F.lit(0.0))


def _match_columns(blank: Column) -> list[Column]:
    cos = F.col("cosine")
    job, own = F.col("job_skills"), F.col("skills")
    overlap = F.when(F.size(job) > 0, F.size(F.array_intersect(job, own)) / F.size(job).cast("double")).otherwise(cos)
    a, b = V.MATCH_WEIGHTS
    none = F.array().cast("array<string>")
    real = lambda c, empty: F.when(blank, empty).otherwise(c)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround((a * cos + b * overlap) * 100, 1)))
    return [
        real(score, F.lit(0.0)).alias("true_match_score"),
        real(F.bround(cos * 100, 1), F.lit(0.0)).alias("tf_cosine"),
        real(F.bround(overlap * 100, 1), F.lit(0.0)).alias("skill_overlap"),
        real(F.array_intersect(job, own), none).alias("matched_skills"),
        real(F.array_except(job, own), none).alias("missing_skills"),
        real(F.array_except(own, job), none).alias("extra_skills"),
        real(F.coalesce("doc_tokens", F.lit(0)), F.lit(0)).cast("long").alias("resume_word_count"),
        real(F.coalesce("job_tokens", F.lit(0)), F.lit(0)).cast("long").alias("jd_word_count"),
        F.when(blank, F.lit(V.MATCH_EMPTY_NOTE)).alias("note"),
    ]


def match_job(texts: DataFrame, jobs: DataFrame, text: str = "clean_text") -> DataFrame:
    """Match of each text with the job it was submitted for.

    ``texts(doc_id, job_id, <text>)``, ``jobs(job_id, job_text)``.  Both sides become term counts;
    the dot product is an equi-join on (job, term).  The job side has one row per job and term and
    the document side is spread over its terms, so one popular job does not end up in one task.
    A text whose job is unknown is kept, with the note of an empty one.
    """
    docs = texts.select("doc_id", "job_id", F.col(text).alias("_body"))
    doc_terms = (
        docs.select("doc_id", "job_id", F.explode(X.tokenise(F.col("_body"))).alias("term"))
        .groupBy("doc_id", "job_id", "term").agg(F.count("*").alias("tf"))
    )
    job_terms = term_counts(jobs, "job_id", "job_text").withColumnRenamed("tf", "job_tf")
    per_doc = (
        doc_terms.join(job_terms, ["job_id", "term"], "left")
        .groupBy("doc_id")
        .agg(F.sum(F.col("tf") * F.col("job_tf")).alias("dot"), F.sum(F.col("tf") * F.col("tf")).alias("n2"),
             F.sum("tf").alias("doc_tokens"))
    )
    per_job = jobs.select("job_id", F.col("job_text"), extract_skills(F.col("job_text")).alias("job_skills")).join(
        job_terms.groupBy("job_id").agg(F.sum(F.col("job_tf") * F.col("job_tf")).alias("job_n2"), F.sum("job_tf").alias("job_tokens")),
        "job_id", "left")
    blank = X.is_blank(F.col("_body")) | F.coalesce(X.is_blank(F.col("job_text")), F.lit(True))
    return (
        docs.withColumn("skills", extract_skills(F.col("_body")))
        .join(per_doc, "doc_id", "left").join(per_job, "job_id", "left")
        .withColumn("cosine", cosine(F.col("dot"), F.col("n2"), F.col("job_n2")))
        .select("doc_id", "job_id", *_match_columns(blank))
    )
