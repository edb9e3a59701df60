"""Column functions over dates.  "Today" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from inkwitness import fixed_values as V

DATE_RANGE = (
    rf"(?i)({V.MONTH_PATTERN}\s*\.?\s*\d{{4}}|(?<!\d)\d{{4}}(?!\d))"
    rf"\s*{V.RANGE_SEPARATOR}\s*"
    rf"({V.MONTH_PATTERN}\s*\.?\s*\d{{4}}|(?<!\d)\d{{4}}(?!\d)|{V.OPEN_END_PATTERN})"
)


def parse_pdf_date(raw: Column) -> Column:
    """``D:YYYYMMDD[HH[MM[SS]]]`` -> timestamp without zone; null when it is not a real date."""
    part = [F.regexp_extract(raw, V.METADATA_DATE_PATTERN, i) for i in range(1, 7)]
    digits = F.concat(*part[:3], *[F.when(p == "", F.lit("00")).otherwise(p) for p in part[3:]])
    # year 0000 and second 60 do not exist
    usable = raw.rlike(V.METADATA_DATE_PATTERN) & (part[0] != "0000")
    return F.when(usable, F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))


def _bounded(year: Column, month: Column, ref_date: Column) -> Column:
    inside = (year >= V.MIN_YEAR) & (year <= F.year(ref_date) + V.MAX_YEAR_AHEAD)
    return F.when(inside, F.make_date(year, month, F.lit(1)))


def parse_resume_date(raw: Column, ref_date: Column) -> Column:
    """Month-year, bare year or an open end ("Present") -> date."""
    value = F.trim(raw)
    months = F.array(*[F.lit(m) for m in V.MONTHS])
    month = F.array_position(months, F.lower(F.substring(value, 1, 3))).cast("int")
    year = F.try_to_number(F.regexp_extract(value, r"(\d{4})$", 1), F.lit("9999")).cast("int")
    return (
        F.when(value.rlike(f"(?i)^{V.OPEN_END_PATTERN}"), ref_date)
        .when(value.rlike(r"^\d{4}$"), _bounded(year, F.lit(1), ref_date))
        .when((month > 0) & year.isNotNull(), _bounded(year, month, ref_date))
    )


def months_between_floor(start: Column, end: Column) -> Column:
    """Whole calendar months from ``start`` to ``end``; days are ignored."""
    return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))
