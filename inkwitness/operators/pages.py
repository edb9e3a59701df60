"""Page-level statistics and the rules that read them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from inkwitness import fixed_values as V
from inkwitness.functions import text as X
from inkwitness.operators.signals import describe, evidence_map, signal


def page_char_counts(page_dims: DataFrame, spans: DataFrame) -> DataFrame:
    """Characters of trimmed text per page, zero for pages without spans."""
    counted = spans.groupBy("doc_id", "page").agg(F.sum(F.length(X.strip(F.col("text")))).alias("_n"))
    return page_dims.select("doc_id", "page").join(counted, ["doc_id", "page"], "left").select(
        "doc_id", "page", F.coalesce("_n", F.lit(0)).cast("long").alias("text_char_count")
    )


_NO_TEXT = "\0"  # stands for a word without text while the words of a page are gathered


def _merge_counts(ranks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pairs out of order on each page; pages of ``sizes`` lie one after another in ``ranks``.

    Widths double inside the pages; each level is counted for all pages in one vectorised pass.
    """
    n, page = len(ranks), np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    width, total, order = 1, np.zeros(len(sizes), np.int64), ranks.astype(np.int64)
    while width < sizes.max(initial=0):
        block = page * (sizes.max() // (2 * width) + 1) + at // (2 * width)
        right = (at // width) % 2 == 1
        # position of each right-half value among the sorted left half of its block
        keyed = block * (n + 1) + order
        left_keys = keyed[~right]
        before = np.searchsorted(left_keys, keyed[right])
        left_end = np.searchsorted(left_keys, (block[right] + 1) * (n + 1))
        np.add.at(total, page[right], left_end - before)
        order = order[np.argsort(keyed, kind="stable")]
        width *= 2
    return total


#: Words of a page up to which every two of its words are compared at once.
_SMALL_PAGE = 512


def _small_counts(ranks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``_merge_counts`` of small pages: every two words are compared, for many pages at a time, distance by distance."""
    total, starts = np.zeros(len(sizes), np.int64), np.cumsum(sizes) - sizes
    by_size = np.argsort(sizes, kind="stable")
    for some in np.array_split(by_size, len(sizes) // 512 + 1):
        width = int(sizes[some].max(initial=0))
        at = np.arange(width)[:, None]
        inside = at < sizes[some]
        # a word's rank on its page; what lies behind the last word is never out of order
        grid = np.where(inside, ranks[np.minimum(starts[some] + at, len(ranks) - 1)] - starts[some], _SMALL_PAGE).astype(np.int16)
        for apart in range(1, width):
            total[some] += (grid[:-apart] > grid[apart:]).sum(axis=0)
    return total


@F.pandas_udf(T.LongType())
def _inversions(numbers: pd.Series, tops: pd.Series, lefts: pd.Series) -> pd.Series:
    """Pairs of words, stored in the order of their numbers, that reading order (band, then left edge) puts the other way round.

    A page whose words lie in the order of their numbers has an empty list of them."""
    sizes = tops.map(len).to_numpy(dtype=np.int64)
    if not sizes.sum():
        return pd.Series(np.zeros(len(sizes), np.int64))
    stored = lambda n, values: values if len(n) == 0 else values[np.argsort(n, kind="stable")]
    band = np.rint(np.concatenate([stored(n, v) for n, v in zip(numbers, tops)]) / V.VISUAL_BAND_PT)
    left = np.concatenate([stored(n, v) for n, v in zip(numbers, lefts)])
    page = np.repeat(np.arange(len(sizes)), sizes)
    ranks = np.empty(len(page), np.int64)
    ranks[np.lexsort((left, band, page))] = np.arange(len(page))
    total, small = np.zeros(len(sizes), np.int64), sizes <= _SMALL_PAGE
    for which, count in ((small, _small_counts), (~small, _merge_counts)):
        if which.any():
            # ranks of a page are consecutive, so that those of the chosen pages close up
            own = np.repeat(which, sizes)
            gone = np.repeat((np.cumsum(sizes) - sizes) - (np.cumsum(sizes * which) - sizes * which), sizes)
            total[which] = count(ranks[own] - gone[own], sizes[which])
    return pd.Series(total)


def words_by_page(words: DataFrame) -> DataFrame:
    """Pages (doc_id, page, no, y0, x0, text) of ``words(doc_id, page, word_no, x0, y0, text)``; the four lists are in step.

    One shuffle gathers them, as plain lists that compress well."""
    # lists of one aggregate stay in step as long as no value is null
    edge = lambda c: F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))))
    return words.groupBy("doc_id", "page").agg(
        F.collect_list("word_no").alias("no"), edge("y0").alias("y0"), edge("x0").alias("x0"),
        F.collect_list(F.coalesce("text", F.lit(_NO_TEXT))).alias("text"))


def order_of_pages(pages: DataFrame) -> DataFrame:
    """How far the stored word order of a page is from its visual reading order.

    ``pages`` as ``words_by_page`` gives them.  Pages of fewer than 8 words score 0.  Nothing is shuffled; ranks and
    inversions are worked out for a batch of pages at once.
    """
    n, key = F.col("word_count"), ["doc_id", "page"]
    judged, sorted_ = n >= V.MIN_WORDS_FOR_ORDER, F.sort_array("no") == F.col("no")
    kept = lambda c, test, kind: F.when(test, F.col(c)).otherwise(F.array().cast(f"array<{kind}>"))
    first = F.when(F.col("in_order"), F.slice("text", 1, V.ORDER_SAMPLE_WORDS)).otherwise(
        F.slice(F.sort_array(F.arrays_zip("no", "text")), 1, V.ORDER_SAMPLE_WORDS)["text"])
    counted = pages.withColumn("word_count", F.size("no").cast("long")).withColumn("in_order", sorted_).select(
        *key, "word_count", _inversions(kept("no", judged & ~F.col("in_order"), "long"), kept("y0", judged, "double"), kept("x0", judged, "double")).alias("inversions"),
        F.when(judged, F.transform(first, lambda w: F.nullif(w, F.lit(_NO_TEXT)))).alias("sample"))
    pairs = F.greatest(n * (n - 1) / 2, F.lit(1.0))
    return counted.select(
        *key, "word_count",
        F.bround(F.col("inversions") / pairs, 4).alias("disorder_ratio"),
        F.coalesce("sample", F.array().cast("array<string>")).alias("sample_words"),
    )


def page_word_order(words: DataFrame) -> DataFrame:
    """``order_of_pages`` of ``words(doc_id, page, word_no, x0, y0, text)``, a word in a row."""
    return order_of_pages(words_by_page(words))


def detect_layer_order(word_order: DataFrame) -> DataFrame:
    ratio = F.col("disorder_ratio")
    severity = F.when(ratio > V.ORDER_HIGH_RATIO, "high").otherwise("medium")
    sample = F.array_join(F.slice("sample_words", 1, 12), ", ")
    return word_order.filter(ratio > V.ORDER_MEDIUM_RATIO).select(
        "doc_id",
        *signal("layer_order_mismatch", severity, F.col("page"), F.lit("MODERATE"), "medium",
                describe("layer_order_mismatch", percent=X.percent(ratio), words=F.col("word_count")),
                X.snippet(sample), evidence_map(disorder_ratio=ratio, word_count=F.col("word_count"))),
    )


def page_image_coverage(page_dims: DataFrame, images: DataFrame, char_counts: DataFrame) -> DataFrame:
    """Share of each page covered by images, and whether an image stands in for its text."""
    area = F.greatest("image_width", F.lit(0.0)) * F.greatest("image_height", F.lit(0.0))
    drawn = (
        images.select("doc_id", "page", F.col("width").alias("image_width"), F.col("height").alias("image_height"))
        .groupBy("doc_id", "page").agg(F.sum(area).alias("_area"))
    )
    page_area = F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    ratio = F.bround(F.least(F.coalesce("_area", F.lit(0.0)) / page_area, F.lit(1.0)), 4)
    chars = F.coalesce("text_char_count", F.lit(0)).cast("long")
    return (
        page_dims.join(drawn, ["doc_id", "page"], "left")
        .join(char_counts, ["doc_id", "page"], "left")
        .select("doc_id", "page", chars.alias("text_char_count"), ratio.alias("image_area_ratio"))
        .withColumn("is_suspected_image_only",
                    (F.col("image_area_ratio") > V.IMAGE_PAGE_RATIO) & (F.col("text_char_count") < V.IMAGE_PAGE_CHARS))
    )


def detect_image_only(image_pages: DataFrame) -> DataFrame:
    ratio, chars, page = F.col("image_area_ratio"), F.col("text_char_count"), F.col("page")
    return image_pages.filter("is_suspected_image_only").select(
        "doc_id",
        *signal("image_only_page", F.lit("high"), page, F.lit("STRONG"), "high",
                describe("image_only_page", page=page, percent=X.percent(ratio), chars=chars),
                evidence=evidence_map(image_area_ratio=ratio, text_char_count=chars)),
    )


def subset_font_anomaly() -> Column:
    """Confidence that a subset font hides keywords: high, medium or null, per span."""
    text = F.col("text")
    low = F.lower(text)
    all_words = F.regexp_extract_all(low, F.lit(X.ANY_WORD), F.lit(0))
    hits = F.size(F.filter(all_words, lambda w: w.isin(*V.SUBSET_TERMS)))
    for phrase in V.SUBSET_PHRASES:
        hits = hits + F.contains(low, F.lit(phrase)).cast("int")
    count = F.size(all_words)
    dense = (count >= V.SUBSET_MIN_WORDS) & (hits >= V.SUBSET_MIN_HITS) & (
        hits / F.greatest(count, F.lit(1)) > V.SUBSET_DENSITY)
    return F.when(
        F.col("font_name").rlike(V.SUBSET_FONT_PATTERN) & ~X.is_blank(text),
        F.when(text.rlike(r"[\x{E000}-\x{F8FF}]"), "high").when(dense, "medium"),
    )


def subset_font_anomalies(spans: DataFrame) -> DataFrame:
    confidence = F.col("confidence")
    return (
        spans.withColumn("confidence", subset_font_anomaly()).filter(confidence.isNotNull()).select(
            "doc_id", "span_no", "page", "font_name", F.col("bbox").alias("span_bbox"),
            F.when(confidence == "high", "[unreadable/pua]").otherwise("[visually hidden/swapped]").alias("suspected_visual_text"),
            F.col("text").alias("suspected_extracted_text"), "confidence",
        )
    )
