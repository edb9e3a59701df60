"""Points, and the helper that shapes a rule's output into the shared signal layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkwitness import fixed_values as V
from inkwitness.functions.text import fill
from inkwitness.schemas import SIGNAL_COLUMNS, SIGNAL_SCHEMA


def points_table(weights: dict[str, int] | None = None) -> dict[tuple[str, str], int]:
    """Points per (category, severity): the category's share, half-even, never below one."""
    weights = weights or V.RISK_WEIGHTS
    return {
        (category, severity): max(1, round(top * V.SEVERITY_FACTOR[severity]))
        for category, top in weights.items()
        for severity in V.SEVERITIES
    }


def signal_points(category: Column, severity: Column, weights: dict[str, int] | None = None) -> Column:
    """Points of one signal as a lookup in a literal map; unknown categories score one."""
    entries = []
    for (cat, sev), points in points_table(weights).items():
        entries += [F.lit(f"{cat}/{sev}"), F.lit(points)]
    return F.coalesce(F.element_at(F.create_map(*entries), F.concat_ws("/", category, severity)), F.lit(1))


def points_for(signal_type: str, severity: Column) -> Column:
    """Points of a signal type whose severity varies by row."""
    category = V.SIGNAL_CATEGORY.get(signal_type)
    if category is None:
        return F.lit(0)
    table = points_table()
    out = F.when(severity == "high", table[category, "high"])
    return out.when(severity == "medium", table[category, "medium"]).otherwise(table[category, "low"])


def with_weights(signals: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Signals with the points that other category weights give; types without a category keep theirs."""
    entries = [F.lit(x) for pair in V.SIGNAL_CATEGORY.items() for x in pair]
    category = F.try_element_at(F.create_map(*entries), F.col("signal_type"))
    points = F.when(category.isNotNull(), signal_points(category, F.col("severity"), weights)).otherwise(F.col("risk_points"))
    return signals.withColumn("risk_points", points.cast("int"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)


def evidence_map(**entries: Column) -> Column:
    pairs = []
    for key, value in entries.items():
        pairs += [F.lit(key), value.cast("string")]
    return F.create_map(*pairs)


def signal(
    signal_type: str,
    severity: Column,
    page: Column,
    strength: Column,
    confidence: str,
    description: Column | None = None,
    evidence_text: Column | None = None,
    evidence: Column | None = None,
    bbox: Column | None = None,
    span_no: Column | None = None,
    remediation: Column | None = None,
    points: Column | None = None,
) -> list[Column]:
    """The columns of one signal, all but ``doc_id``, in the order of the shared layout."""
    values = {
        "signal_type": F.lit(signal_type),
        "severity": severity,
        "page": page,
        "span_no": F.lit(None) if span_no is None else span_no,
        "bbox": F.lit(None) if bbox is None else bbox,
        "description": F.lit(V.DESCRIPTIONS[signal_type]) if description is None else description,
        "evidence_text": F.lit(None) if evidence_text is None else evidence_text,
        "risk_points": points_for(signal_type, severity) if points is None else points,
        "evidence_strength": strength,
        "confidence": F.lit(confidence),
        "remediation": F.lit(V.REMEDIATIONS[signal_type]) if remediation is None else remediation,
        "evidence": F.lit(None) if evidence is None else evidence,
    }
    return [values[f.name].cast(f.dataType).alias(f.name) for f in SIGNAL_SCHEMA.fields if f.name != "doc_id"]


def describe(signal_type: str, **values: Column) -> Column:
    return fill(V.DESCRIPTIONS[signal_type], **values)


def in_layout(df: DataFrame) -> DataFrame:
    return df.select(SIGNAL_COLUMNS)


def order_signals(signals: DataFrame) -> DataFrame:
    """Reading order of signals: by document, page, severity, type, position, description."""
    zero = F.lit(0.0)
    box = [F.coalesce(F.col(f"bbox.{c}"), zero) for c in ("x0", "y0", "x1", "y1")]
    return signals.orderBy("doc_id", "page", severity_rank(F.col("severity")), "signal_type", *box, "description")
