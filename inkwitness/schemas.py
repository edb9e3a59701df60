"""Shared row layouts."""

from pyspark.sql import types as T

RGB = T.StructType([T.StructField(c, T.IntegerType()) for c in ("r", "g", "b")])
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])

SPAN_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("span_no", T.IntegerType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("block_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("font_name", T.StringType()),
    T.StructField("font_size", T.DoubleType()),
    T.StructField("font_color", RGB),
    T.StructField("bold", T.BooleanType()),
    T.StructField("italic", T.BooleanType()),
    T.StructField("bbox", BOX),
    T.StructField("origin", T.StringType()),
])

PAGE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("width", T.DoubleType()),
    T.StructField("height", T.DoubleType()),
])

# One row per raised signal; every rule returns exactly these columns in this order.
SIGNAL_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("signal_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("span_no", T.IntegerType()),
    T.StructField("bbox", BOX),
    T.StructField("description", T.StringType()),
    T.StructField("evidence_text", T.StringType()),
    T.StructField("risk_points", T.IntegerType()),
    T.StructField("evidence_strength", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("remediation", T.StringType()),
    T.StructField("evidence", T.MapType(T.StringType(), T.StringType())),
])
SIGNAL_COLUMNS = SIGNAL_SCHEMA.fieldNames()
