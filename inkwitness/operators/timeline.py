"""Date ranges in text and the rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkwitness import fixed_values as V
from inkwitness.functions import text as X
from inkwitness.functions.dates import DATE_RANGE, months_between_floor, parse_resume_date
from inkwitness.operators.signals import describe, evidence_map, in_layout, signal


def page_texts(spans: DataFrame) -> DataFrame:
    """Span texts of a page in order, joined by one space, so that ranges may cross spans."""
    return spans.groupBy("doc_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), " ").alias("text")
    )


def extract_date_ranges(spans: DataFrame, ref_date: Column) -> DataFrame:
    """``date_ranges(doc_id, page, pos, start_d, end_d, raw)``; both ends must be real dates."""
    # a range starts with a year, and its separator follows in the same span or the span ends; other pages are never gathered
    dated = spans.filter(F.col("text").rlike(rf"(?i)\d{{4}}\s*(?:{V.RANGE_SEPARATOR}|\z)")).select("doc_id", "page").distinct()
    spans = spans.join(dated, ["doc_id", "page"], "left_semi")
    hits = lambda group: F.regexp_extract_all(F.col("text"), F.lit(DATE_RANGE), F.lit(group))
    found = page_texts(spans).filter(F.col("text").rlike(DATE_RANGE)).select(
        "doc_id", "page", F.posexplode(F.arrays_zip(hits(0).alias("raw"), hits(1).alias("s"), hits(2).alias("e"))).alias("pos", "hit")
    )
    return found.select(
        "doc_id", "page", "pos",
        parse_resume_date(F.col("hit.s"), ref_date).alias("start_d"),
        parse_resume_date(F.col("hit.e"), ref_date).alias("end_d"),
        F.col("hit.raw").alias("raw"),
    ).filter(F.col("start_d").isNotNull() & F.col("end_d").isNotNull())


def detect_end_before_start(ranges: DataFrame) -> DataFrame:
    start, end, raw = F.col("start_d"), F.col("end_d"), F.col("raw")
    return in_layout(ranges.filter(end < start).select(
        "doc_id", *signal("timeline_end_before_start", F.lit("high"), F.col("page"), F.lit("STRONG"), "high",
                          describe("timeline_end_before_start", end=end, start=start, raw=X.quoted(raw)), raw,
                          evidence_map(start_date=start, end_date=end, raw_text=raw))))


def detect_future_start(ranges: DataFrame, ref_date: Column) -> DataFrame:
    start, raw = F.col("start_d"), F.col("raw")
    return in_layout(ranges.filter(start > ref_date).select(
        "doc_id", *signal("timeline_future_start", F.lit("high"), F.col("page"), F.lit("STRONG"), "high",
                          describe("timeline_future_start", start=start, raw=X.quoted(raw)), raw,
                          evidence_map(start_date=start, today=ref_date, raw_text=raw))))


def overlapping_ranges(ranges: DataFrame) -> DataFrame:
    """Ordered pairs of ranges of one document that overlap by more than a month.

    The earlier range is spread over the years it covers and meets the later one only in the year
    the later one starts in, so a pair is compared once and ranges that never meet are not compared.
    """
    valid = ranges.filter(F.col("end_d") >= F.col("start_d"))
    order = F.struct("start_d", "end_d", "page", "pos")
    years = F.sequence(F.year("start_d"), F.year("end_d"))
    a = valid.select("doc_id", order.alias("a_key"), F.col("raw").alias("a_raw"), F.explode(years).alias("year"))
    b = valid.select("doc_id", order.alias("b_key"), F.col("raw").alias("b_raw"), F.year("start_d").alias("year"))
    months = months_between_floor(F.col("b_key.start_d"), F.col("a_key.end_d"))
    return (
        a.join(b, ["doc_id", "year"])
        .filter((F.col("a_key") < F.col("b_key")) & (F.col("b_key.start_d") < F.col("a_key.end_d")) & (months > 1))
        .select(
            "doc_id", "a_raw", "b_raw",
            F.col("a_key.end_d").alias("end_a"), F.col("b_key.start_d").alias("start_b"),
            F.greatest("a_key.page", "b_key.page").alias("page"), months.alias("overlap_months"),
        )
    )


def detect_overlaps(ranges: DataFrame) -> DataFrame:
    a, b, months = F.col("a_raw"), F.col("b_raw"), F.col("overlap_months")
    return in_layout(overlapping_ranges(ranges).select(
        "doc_id", *signal("timeline_overlap", F.lit("medium"), F.col("page"), F.lit("MODERATE"), "medium",
                          describe("timeline_overlap", raw_a=X.quoted(a), end_a=F.col("end_a"), raw_b=X.quoted(b),
                                   start_b=F.col("start_b"), months=months),
                          F.concat(a, F.lit(" / "), b),
                          evidence_map(period_a=a, period_b=b, overlap_months=months))))


def detect_timeline(ranges: DataFrame, ref_date: Column) -> DataFrame:
    return (
        detect_end_before_start(ranges)
        .unionByName(detect_future_start(ranges, ref_date))
        .unionByName(detect_overlaps(ranges))
    )
