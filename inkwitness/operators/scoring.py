"""Severity counts, risk per category, trust score and label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkwitness import fixed_values as V
from inkwitness.operators.signals import with_weights

CATEGORIES = list(V.RISK_WEIGHTS)


def severity_counts(docs: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals per document by severity; documents without signals count zero."""
    sev = F.col("severity")
    counted = signals.groupBy("doc_id").agg(
        F.count("*").alias("total_signals"),
        *[F.count_if(sev == s).alias(f"{s}_count") for s in V.SEVERITIES],
    )
    names = ["total_signals"] + [f"{s}_count" for s in V.SEVERITIES]
    return docs.join(counted, "doc_id", "left").fillna(0, subset=names)


def _category(signal_type: Column, table: dict[str, str], default: str | None = None) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), signal_type)
    return found if default is None else F.coalesce(found, F.lit(default))


def _category_sums(category: Column) -> list[Column]:
    points = F.coalesce(F.col("risk_points"), F.lit(0)).cast("long")
    return [F.coalesce(F.sum(F.when(category == c, points)), F.lit(0)).alias(c) for c in CATEGORIES]


def risk_breakdown(docs: DataFrame, signals: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """Points per category, each capped at its weight; types without a category add nothing.

    Other ``weights`` change the points of a signal as well as the caps.
    """
    if weights is not None:
        signals = with_weights(signals, weights)
    weights = weights or V.RISK_WEIGHTS
    sums = signals.groupBy("doc_id").agg(*_category_sums(_category(F.col("signal_type"), V.SIGNAL_CATEGORY)))
    capped = docs.join(sums, "doc_id", "left").fillna(0, subset=CATEGORIES)
    for c in CATEGORIES:
        capped = capped.withColumn(c, F.least(F.col(c), F.lit(weights[c]).cast("long")))
    return capped


def risk_total() -> Column:
    total = F.lit(0).cast("long")
    for c in CATEGORIES:
        total = total + F.col(c)
    return F.least(total, F.lit(V.RISK_TOTAL_MAX).cast("long"))


def summarise_signals(docs: DataFrame, signals: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """Counts, capped breakdown, total risk and signal types per document from one aggregate."""
    if weights is not None:
        signals = with_weights(signals, weights)
    weights = weights or V.RISK_WEIGHTS
    sev, kind = F.col("severity"), F.col("signal_type")
    types_of = lambda s: F.array_sort(F.collect_set(F.when(sev == s, kind)))
    sums = signals.groupBy("doc_id").agg(
        F.count("*").alias("total_signals"),
        *[F.count_if(sev == s).alias(f"{s}_count") for s in V.SEVERITIES],
        *_category_sums(_category(kind, V.SIGNAL_CATEGORY)),
        types_of("high").alias("high_types"), types_of("medium").alias("medium_types"),
        F.bool_or(kind == "font_substitution").alias("font_substituted"),
    )
    names = ["total_signals"] + [f"{s}_count" for s in V.SEVERITIES] + CATEGORIES
    out = docs.join(sums, "doc_id", "left").fillna(0, subset=names)
    for c in CATEGORIES:
        out = out.withColumn(c, F.least(F.col(c), F.lit(weights[c]).cast("long")))
    none = F.array().cast("array<string>")
    return (
        out.withColumn("high_types", F.coalesce("high_types", none))
        .withColumn("medium_types", F.coalesce("medium_types", none))
        .withColumn("font_substituted", F.coalesce("font_substituted", F.lit(False)))
        .withColumn("forensic_risk_score", risk_total())
    )


def fraud_component(risk: Column | None, high: Column, medium: Column, low: Column) -> Column:
    """100 minus risk, never below zero; without a signal list the risk comes from the counts."""
    legacy = F.least(F.lit(100), V.LEGACY_PENALTY["high"] * high + V.LEGACY_PENALTY["medium"] * medium + V.LEGACY_PENALTY["low"] * low)
    value = legacy if risk is None else F.coalesce(risk, legacy)
    return F.greatest(F.lit(0.0), 100.0 - value.cast("double"))


def integrity_component(ai: Column) -> Column:
    return F.when(ai.isNull(), F.lit(V.NEUTRAL_INTEGRITY)).otherwise(F.greatest(F.lit(0.0), 100.0 - ai))


def match_component(match: Column) -> Column:
    return F.when(match.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), match)))


def trust_score(ai: Column, match: Column, high: Column, medium: Column, low: Column, risk: Column | None) -> Column:
    """Weighted blend.  With a signal list (``risk`` given) it cannot exceed the fraud component;
    without one, high signals cap it."""
    fraud, integrity, fit = fraud_component(risk, high, medium, low), integrity_component(ai), match_component(match)
    both = V.WEIGHT_FRAUD + V.WEIGHT_INTEGRITY
    blend = F.when(fit.isNull(), fraud * (V.WEIGHT_FRAUD / both) + integrity * (V.WEIGHT_INTEGRITY / both)).otherwise(
        fraud * V.WEIGHT_FRAUD + integrity * V.WEIGHT_INTEGRITY + fit * V.WEIGHT_MATCH)
    capped = F.when(high >= 2, F.least(blend, F.lit(V.LEGACY_CAP_TWO_HIGH))).when(
        high == 1, F.least(blend, F.lit(V.LEGACY_CAP_ONE_HIGH))).otherwise(blend)
    if risk is not None:
        capped = F.when(risk.isNotNull(), F.least(fraud, blend)).otherwise(capped)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), capped)), 1)


def trust_label(score: Column, high: Column) -> Column:
    return (
        F.when(score >= V.VERIFIED_SCORE, F.when(high > 0, "Caution").otherwise("Verified"))
        .when(score >= V.CAUTION_SCORE, F.when(high >= 2, "High Risk").otherwise("Caution"))
        .otherwise("High Risk")
    )


def label_entry(label: Column, table: dict[str, str], default: str = "") -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), label), F.lit(default))


def with_trust(rows: DataFrame, risk: str | None = "forensic_risk_score") -> DataFrame:
    """Adds score, label, emoji, colour, components and weights to rows holding counts and scores."""
    counts = [F.col(f"{s}_count") for s in V.SEVERITIES]
    r = None if risk is None else F.col(risk)
    ai, match = F.col("ai_content_score"), F.col("true_match_score")
    return (
        rows.withColumn("trust_score", trust_score(ai, match, *counts, r))
        .withColumn("trust_label", trust_label(F.col("trust_score"), counts[0]))
        .withColumn("trust_emoji", label_entry(F.col("trust_label"), V.LABEL_EMOJI))
        .withColumn("trust_color", label_entry(F.col("trust_label"), V.LABEL_COLOR))
        .withColumn("fraud_component", F.bround(fraud_component(r, *counts), 1))
        .withColumn("integrity_component", F.bround(integrity_component(ai), 1))
        .withColumn("match_component", F.bround(match_component(match), 1))
        .withColumn("weight_match", F.when(match.isNotNull(), F.lit(V.WEIGHT_MATCH)).otherwise(0.0))
    )


def breakdown_from_signals(docs: DataFrame, signals: DataFrame) -> DataFrame:
    """Uncapped points per category with the wider fallback map; unknown types count as font_anomaly."""
    sums = signals.groupBy("doc_id").agg(*_category_sums(_category(F.col("signal_type"), V.FALLBACK_CATEGORY, V.FALLBACK_DEFAULT)))
    return docs.join(sums, "doc_id", "left").fillna(0, subset=CATEGORIES)


def risk_fallback(stored: Column, breakdown_sum: Column, points_sum: Column, signals: Column) -> Column:
    """Risk shown for a stored scan: stored value, else breakdown, else points; 0 with nothing found."""
    raw = F.coalesce(stored, F.when(breakdown_sum > 0, breakdown_sum).otherwise(points_sum).cast("double"))
    shown = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.floor(raw + 0.5).cast("double")))
    return F.when((signals == 0) & (breakdown_sum == 0), F.lit(0.0)).otherwise(shown).cast("int")


def score_bands(ai: Column, risk: Column) -> list[Column]:
    band = lambda red, amber: F.when(red, V.BAND_RED).when(amber, V.BAND_AMBER).otherwise(V.BAND_GREEN)
    value = F.coalesce(ai, F.lit(0.0))
    return [band(value >= 70, value >= 40).alias("ai_band"), band(risk > 40, risk > 15).alias("risk_band")]
