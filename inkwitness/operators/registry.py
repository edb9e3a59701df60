"""The list of rules and their union.  A new rule is registered here and nowhere else."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame

from inkwitness.operators import metadata, pages, span_rules, timeline
from inkwitness.operators.signals import order_signals
from inkwitness.schemas import SIGNAL_COLUMNS
from inkwitness.session import materialise


@dataclass
class Evidence:
    """What the rules read.  Anything but spans and page sizes may be absent.

    ``words`` has a page in a row (``pages.words_by_page``)."""

    spans: DataFrame
    page_dims: DataFrame
    ref_date: Column
    words: DataFrame | None = None
    images: DataFrame | None = None
    metadata: DataFrame | None = None


def _timeline(e: Evidence) -> DataFrame:
    # four branches read the ranges, which are few, while the texts they come from are not
    return timeline.detect_timeline(materialise(timeline.extract_date_ranges(e.spans, e.ref_date), "date-ranges"), e.ref_date)


def _layer_order(e: Evidence) -> DataFrame | None:
    return None if e.words is None else pages.detect_layer_order(pages.order_of_pages(e.words))


def _metadata(e: Evidence) -> DataFrame | None:
    return None if e.metadata is None else metadata.detect_metadata(e.metadata)


def _image_only(e: Evidence) -> DataFrame | None:
    if e.images is None:
        return None
    chars = pages.page_char_counts(e.page_dims, e.spans)
    return pages.detect_image_only(pages.page_image_coverage(e.page_dims, e.images, chars))


RULES: list[Callable[[Evidence], DataFrame | None]] = [
    lambda e: span_rules.detect_span_signals(e.spans, e.page_dims),
    _timeline,
    _layer_order,
    _metadata,
    _image_only,
]


def run_all_detectors(evidence: Evidence) -> DataFrame:
    """All signals in the shared layout, unordered, as aggregates want them."""
    found = [rule(evidence) for rule in RULES]
    return reduce(lambda a, b: a.unionByName(b), [f for f in found if f is not None])


def ordered_signals(evidence: Evidence, columns: list[str] = SIGNAL_COLUMNS) -> DataFrame:
    """``columns`` of all signals in one total order: document, page, severity, type, box, description; sorted over ranges of documents.

    The signals are written once: ranges are drawn from a sample of them, so that a sort reads its input twice."""
    keys = ["doc_id", "page", "severity", "signal_type", "bbox", "description"]
    found = run_all_detectors(evidence).select(*columns, *(k for k in keys if k not in columns))
    return order_signals(materialise(found, "signals")).select(columns)
