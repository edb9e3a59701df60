"""Text left after removing flagged spans, and the admission test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkwitness import fixed_values as V
from inkwitness.functions import text as X

# Boxes meet only if they share a horizontal band, so bands make the position part of the join key.
_BAND_PT, _LOWEST, _HIGHEST = 36.0, -60, 600


def _bands(box: Column) -> Column:
    """Bands a box touches; far-off boxes fall into the outermost bands, which keeps the list short."""
    band = lambda y: F.least(F.greatest(F.floor(y / _BAND_PT), F.lit(_LOWEST)), F.lit(_HIGHEST)).cast("int")
    low, high = F.least(box["y0"], box["y1"]), F.greatest(box["y0"], box["y1"])
    return F.sequence(band(low), band(high))


def boxes_meet(a: Column, b: Column) -> Column:
    """Strict overlap of two boxes; boxes that only touch do not meet."""
    return (a["x0"] < b["x1"]) & (a["x1"] > b["x0"]) & (a["y0"] < b["y1"]) & (a["y1"] > b["y0"])


def touched_spans(spans: DataFrame, boxes: DataFrame, same_page: bool) -> DataFrame:
    """Keys of the spans whose box meets one of ``boxes(doc_id[, page], hit)``."""
    keys = ["doc_id", "page"] if same_page else ["doc_id"]
    hits = boxes.select(*keys, "hit").filter(F.col("hit").isNotNull()).distinct().withColumn("band", F.explode(_bands(F.col("hit"))))
    placed = spans.filter(F.col("bbox").isNotNull()).select("doc_id", "page", "span_no", "bbox").withColumn(
        "band", F.explode(_bands(F.col("bbox"))))
    on = [placed[k] == hits[k] for k in keys + ["band"]]
    return placed.join(hits, on + [boxes_meet(placed["bbox"], hits["hit"])], "left_semi").select("doc_id", "span_no").distinct()


def clean_spans(spans: DataFrame, signals: DataFrame, same_page: bool = False) -> DataFrame:
    """Spans that no high signal's box meets.

    By default the page is ignored, as in the service whose results this reproduces: a flagged box
    on page 1 also removes text at that position on page 2.  ``same_page=True`` compares per page.
    """
    high = signals.filter((F.col("severity") == "high") & F.col("bbox").isNotNull()).withColumn("hit", F.col("bbox"))
    return spans.join(touched_spans(spans, high, same_page), ["doc_id", "span_no"], "left_anti")


def rebuild_paragraphs(spans: DataFrame) -> DataFrame:
    """Text per document: neighbouring spans of one block by a space, blocks by a blank line.

    The page plays no part, so block 3 of page 1 followed by block 3 of page 2 stays one paragraph.
    One shuffle: the window and the aggregate share the partitioning by document.
    """
    before = Window.partitionBy("doc_id").orderBy("span_no")
    first = F.lag(F.lit(1)).over(before).isNull()
    same = F.lag("block_no").over(before).eqNullSafe(F.col("block_no"))
    glue = F.when(first, "").when(same, " ").otherwise("\n\n")
    return (
        spans.select("doc_id", "span_no", F.concat(glue, F.coalesce("text", F.lit(""))).alias("piece"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("span_no", "piece"))).alias("p"))
        .select("doc_id", F.array_join(F.col("p.piece"), "").alias("clean_text"))
    )


def _joined(spans: DataFrame, text: Column, name: str) -> DataFrame:
    return (
        spans.groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("span_no", text.alias("t")))).alias("p"))
        .select("doc_id", F.array_join(F.col("p.t"), " ").alias(name))
    )


def full_text(spans: DataFrame) -> DataFrame:
    """All span texts of a document, in order, joined by a space."""
    return _joined(spans, F.coalesce("text", F.lit("")), "full_text")


def spans_to_text(spans: DataFrame) -> DataFrame:
    """Trimmed, non-blank span texts joined by a space, with their word count."""
    body = X.strip(F.col("text"))
    kept = _joined(spans.filter(body != ""), body, "clean_text")
    return kept.withColumn("clean_word_count", X.letter_word_count(F.col("clean_text")))


def word_counts(spans: DataFrame, clean_texts: DataFrame) -> DataFrame:
    """Words in all spans, in the clean text, and the difference, never below zero.

    Words never cross a space, so counting span by span needs no text to be joined.
    """
    total = spans.groupBy("doc_id").agg(F.sum(X.letter_word_count(F.col("text"))).cast("long").alias("total_words"))
    clean = clean_texts.select("doc_id", X.letter_word_count(F.col("clean_text")).cast("long").alias("clean_words"))
    return total.join(clean, "doc_id", "left").select(
        "doc_id", "total_words",
        F.coalesce("clean_words", F.lit(0)).cast("long").alias("clean_words"),
        F.greatest(F.col("total_words") - F.coalesce("clean_words", F.lit(0)), F.lit(0)).cast("long").alias("flagged_words"),
    )


def resume_likelihood(texts: DataFrame, text: str = "full_text") -> DataFrame:
    """Section words, e-mail and phone found in a text, and whether it is admitted."""
    body, low = F.col(text), F.col("_low")
    keywords = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in V.SECTION_KEYWORDS]))
    short = F.col("word_count") < V.ADMISSION_MIN_WORDS
    passed = F.col("score") >= V.ADMISSION_MIN_SCORE
    return (
        # a column of its own, as the list is not generated code and would make it anew for each word
        texts.withColumn("_low", F.lower(body))
        .withColumn("matched_keywords", keywords).drop("_low")
        .withColumn("has_email", F.contains(body, F.lit("@")) & body.rlike(V.EMAIL_PATTERN))
        .withColumn("has_phone", body.rlike(V.PHONE_PATTERN))
        .withColumn("word_count", X.letter_word_count(body))
        .withColumn("score", F.least(F.size("matched_keywords"), F.lit(V.ADMISSION_KEYWORD_CAP))
                    + F.col("has_email").cast("int") + F.col("has_phone").cast("int"))
        .withColumn("admitted", passed | short)
        .withColumn("reason", F.when(short, "insufficient_text_defer_to_ocr")
                    .when(passed, "heuristic_score_pass").otherwise("heuristic_score_fail"))
    )


def admission(texts: DataFrame, text: str = "full_text") -> DataFrame:
    """``(doc_id, error)``: every text judged once, without an error if it is admitted."""
    judged = resume_likelihood(texts, text)
    return judged.select("doc_id", F.when(~F.col("admitted"), V.NOT_A_DOCUMENT).alias("error"))


def reject_non_documents(texts: DataFrame, text: str = "full_text") -> tuple[DataFrame, DataFrame]:
    """(admitted rows, rejected rows with their message)."""
    judged = resume_likelihood(texts, text)
    return (judged.filter("admitted"),
            judged.filter(~F.col("admitted")).withColumn("error", F.lit(V.NOT_A_DOCUMENT)))
