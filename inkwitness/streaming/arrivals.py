"""Spans that arrive over time.

The service this reproduces handles each upload as it comes; on Spark that is a stream of span rows.
The span rules are column expressions, so the same ones run on a stream, without state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwitness.operators.span_rules import detect_row_local
from inkwitness.schemas import SPAN_SCHEMA


def read_arriving_spans(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SPAN_SCHEMA).parquet(folder)


def detect_on_arrival(spans: DataFrame) -> DataFrame:
    """Signals of the rules that need nothing but the span."""
    return detect_row_local(spans)
