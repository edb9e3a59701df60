"""Machine-authorship score of a text.

Everything is computed inside the row that holds the text: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from inkwitness import fixed_values as V
from inkwitness.functions import text as X
from inkwitness.functions.text import fill



def _tree(phrases: set[str]) -> str:
    """Pattern of the longest of ``phrases`` at a position; what they have in common at the start is written once."""
    begun = {p[0] for p in phrases if p}
    branches = [re.escape(c).replace(r"\ ", " ").replace(r"\-", "-") + _tree({p[1:] for p in phrases if p[:1] == c}) for c in sorted(begun)]
    if len(branches) < 2 and "" not in phrases:
        return "".join(branches)
    return f"(?:{'|'.join(branches)})" + "?" * ("" in phrases) if branches else ""


# The look-ahead skips positions no phrase can start at.
_STARTS = "".join("[" + "".join(sorted({re.escape(p[i]) for p in V.MARKER_PHRASES})) + "]" for i in range(min(4, *map(len, V.MARKER_PHRASES))))
PHRASE_PATTERN = f"(?i)(?={_STARTS}){_tree(set(V.MARKER_PHRASES))}"


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def sentence_uniformity(lengths: Column) -> Column:
    """1 = sentences of equal length, 0 = widely varying; 0.5 where there are fewer than three.

    ``lengths``: words per sentence.  Sums are whole numbers, so the order of adding is immaterial.
    """
    zero = F.lit(0).cast("long")
    n = F.size(lengths)
    total = F.aggregate(lengths, zero, lambda a, x: a + x)
    squares = F.aggregate(lengths, zero, lambda a, x: a + x * x)
    deviation = F.sqrt((n * squares - total * total) / (n * (n - 1)).cast("double"))
    cv = deviation / (total / n.cast("double"))
    return F.when(n < 3, F.lit(V.UNIFORMITY_NEUTRAL)).otherwise(F.bround(_clamp(1.0 - cv / V.UNIFORMITY_CV), 4))


def phrase_density(phrases: Column, words: Column) -> Column:
    """Stock phrases per hundred words, scaled to 0..1."""
    rate = phrases / words.cast("double") * 100
    return F.when(words < 10, F.lit(0.0)).otherwise(F.bround(F.least(F.lit(1.0), rate / V.PHRASES_PER_100), 4))


def bigram_repetition(repeated: Column, distinct: Column, words: Column) -> Column:
    """Share of word pairs used more than once, scaled to 0..1."""
    rate = repeated / distinct.cast("double")
    return F.when(words < 10, F.lit(0.0)).otherwise(F.bround(F.least(F.lit(1.0), rate / V.REPETITION_RATE), 4))


def _bigram_counts(pairs: Column) -> Column:
    """(distinct, repeated) over sorted pairs, in one walk."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("distinct"), F.lit(0).alias("repeated"))

    def step(a: Column, pair: Column) -> Column:
        run = F.when(a["last"] == pair, a["run"] + 1).otherwise(1)
        return F.struct(
            pair.alias("last"), run.alias("run"),
            (a["distinct"] + (run == 1).cast("int")).alias("distinct"),
            (a["repeated"] + (run == 2).cast("int")).alias("repeated"),
        )

    return F.aggregate(pairs, start, step)


def with_authorship(texts: DataFrame, text: str) -> DataFrame:
    """Adds n_sentences, n_words, sentence_uniformity, phrase_density, bigram_repetition, authorship_raw."""
    body = F.col(text)
    neighbours = F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("n_words") - 1, F.lit(1))),
        lambda i: F.concat(F.get(F.col("_w"), i - 1), F.lit(" "), F.get(F.col("_w"), i)),
    )
    a, b, c = V.AUTHORSHIP_WEIGHTS
    return (
        texts.withColumn("_s", X.sentences(body))
        .withColumn("_w", X.words(body))
        .withColumn("n_sentences", F.size("_s"))
        .withColumn("n_words", F.size("_w"))
        .withColumn("_len", F.filter(F.transform("_s", lambda s: X.word_count2(s).cast("long")), lambda n: n > 0))
        .withColumn("_pairs", F.when(F.col("n_words") >= 10, F.sort_array(neighbours)))
        .withColumn("_b", _bigram_counts(F.col("_pairs")))
        .withColumn("sentence_uniformity", F.when(F.col("n_sentences") < 3, F.lit(V.UNIFORMITY_NEUTRAL))
                    .otherwise(sentence_uniformity(F.col("_len"))))
        .withColumn("phrase_density", phrase_density(F.regexp_count(body, F.lit(PHRASE_PATTERN)), F.col("n_words")))
        .withColumn("bigram_repetition", bigram_repetition(F.col("_b.repeated"), F.col("_b.distinct"), F.col("n_words")))
        .withColumn("authorship_raw", a * F.col("sentence_uniformity") + b * F.col("phrase_density") + c * F.col("bigram_repetition"))
        .drop("_s", "_w", "_len", "_pairs", "_b")
    )


def _score() -> Column:
    return F.bround(F.least(F.lit(100.0), F.col("authorship_raw") * 100), 1)


def ai_score(texts: DataFrame, text: str = "clean_text") -> DataFrame:
    """Score of a whole text; below fifteen tokens it is 0 with an empty breakdown."""
    trimmed = X.strip(F.col(text))
    tokens = F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+")))
    short = tokens < V.AUTHORSHIP_MIN_TOKENS
    scored = with_authorship(texts.withColumn("_t", trimmed), "_t")
    part = lambda c: F.when(~short, F.bround(F.col(c) * 100, 1))
    note = fill(V.AUTHORSHIP_NOTE, sentences=F.col("n_sentences"), words=F.col("n_words"))
    return scored.select(
        *texts.columns,
        F.when(short, F.lit(0.0)).otherwise(_score()).alias("ai_content_score"),
        F.lit("heuristic").alias("backend"),
        part("sentence_uniformity").alias("uniformity_pct"),
        part("phrase_density").alias("phrase_pct"),
        part("bigram_repetition").alias("repetition_pct"),
        F.when(short, F.lit(V.AUTHORSHIP_SHORT_NOTE)).otherwise(note).alias("note"),
    )


def _paragraph_columns() -> list[Column]:
    text, n = F.col("text"), F.col("n_words")
    parts = ("sentence_uniformity", "phrase_density", "bigram_repetition")
    factors = [F.when(F.col(p) > limit, F.lit(name)) for p, (limit, name) in zip(parts, V.AUTHORSHIP_FACTORS)]
    return [
        F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(text).alias("text_snippet"),
        _score().alias("ai_score"),
        F.when(n > 40, "high").when(n > 20, "medium").otherwise("low").alias("confidence"),
        F.array_compact(F.array(*factors)).alias("contributing_factors"),
    ]


def paragraph_ai_scores(spans: DataFrame) -> DataFrame:
    """Scores per (page, block) in order of first appearance; short paragraphs keep their number."""
    blocks = (
        spans.groupBy("doc_id", "page", "block_no")
        .agg(F.array_sort(F.collect_list(F.struct("span_no", "text"))).alias("p"), F.min("span_no").alias("first_span"))
        .select("doc_id", "page", "block_no", "first_span", X.strip(F.array_join(F.col("p.text"), " ")).alias("text"))
    )
    scored = with_authorship(blocks, "text").select(
        "doc_id", "page", "first_span", "n_words", *_paragraph_columns())
    numbered = scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(
        F.struct("first_span", "page", "n_words", "text_snippet", "ai_score", "confidence", "contributing_factors"))).alias("p"))
    out = numbered.select("doc_id", F.posexplode("p").alias("paragraph_index", "p"))
    return out.filter(F.col("p.n_words") >= V.AUTHORSHIP_MIN_TOKENS).select(
        "doc_id", "paragraph_index", F.col("p.page").alias("page"), F.col("p.text_snippet").alias("text_snippet"),
        F.col("p.ai_score").alias("ai_score"), F.col("p.confidence").alias("confidence"),
        F.col("p.contributing_factors").alias("contributing_factors"))


def paragraph_ai_scores_of_text(texts: DataFrame, text: str = "text") -> DataFrame:
    """The same over plain text, split at blank lines; the number is the raw position in the split."""
    parts = texts.select("doc_id", F.posexplode(F.split(F.col(text), "\n\n")).alias("paragraph_index", "text"))
    scored = with_authorship(parts.withColumn("text", X.strip(F.col("text"))).filter("text <> ''"), "text")
    return scored.filter(F.col("n_words") >= V.AUTHORSHIP_MIN_TOKENS).select(
        "doc_id", "paragraph_index", F.lit(1).alias("page"), *_paragraph_columns())


def perplexity_to_score(perplexity: Column) -> Column:
    """Calibration of a given perplexity: linear in its logarithm between 10 and 200."""
    low, high = F.log(F.lit(V.PERPLEXITY_LOW)), F.log(F.lit(V.PERPLEXITY_HIGH))
    share = (F.log(perplexity) - low) / (high - low)
    return (
        F.when(perplexity <= V.PERPLEXITY_LOW, F.lit(V.PERPLEXITY_TOP))
        .when(perplexity >= V.PERPLEXITY_HIGH, F.lit(V.PERPLEXITY_BOTTOM))
        .otherwise(F.bround((1.0 - share) * V.PERPLEXITY_TOP, 1))
    )
