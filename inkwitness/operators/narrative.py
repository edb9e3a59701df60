"""Plain-language account of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkwitness import fixed_values as V
from inkwitness.functions.text import SPACE, fill, fixed1

N = V.NARRATIVE


def _types(names: Column) -> Column:
    return F.replace(F.array_join(names, ", "), F.lit("_"), F.lit(" "))


def worst_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Highest-scoring paragraph per document, the first of equals."""
    best = F.min_by(F.struct("page", "text_snippet", "ai_score"), F.struct(-F.col("ai_score"), F.col("paragraph_index")))
    return paragraphs.groupBy("doc_id").agg(best.alias("worst_paragraph"))


def narrate(rows: DataFrame) -> DataFrame:
    """Adds verdict_title, recommendation, summary, key_factors and disclaimer.

    Reads counts, high_types, medium_types, font_substituted, ai_content_score, true_match_score,
    matched_skills, missing_skills, trust_score, trust_label, forensic_risk_score and, if there,
    worst_paragraph(page, text_snippet, ai_score).
    """
    c = F.col
    ai, fit, label = c("ai_content_score"), c("true_match_score"), c("trust_label")
    found = (
        F.when(c("high_count") > 0, fill(N["high"], n=c("high_count"), types=_types(c("high_types"))))
        .when(c("medium_count") > 0, fill(N["medium"], n=c("medium_count"), types=_types(c("medium_types"))))
        .when(c("total_signals") == 0, F.lit(N["none"]))
    )
    backend = c("backend") if "backend" in rows.columns else F.lit("heuristic")
    authored = (
        F.when(ai >= 70, fill(N["ai_high"], score=fixed1(ai), backend=backend))
        .when(ai >= 40, fill(N["ai_mid"], score=fixed1(ai)))
        .when(ai.isNotNull(), fill(N["ai_low"], score=fixed1(ai)))
    )
    factors = [found, authored]
    if "worst_paragraph" in rows.columns:
        worst = c("worst_paragraph")
        start = F.btrim(F.replace(F.substring(worst["text_snippet"], 1, 40), F.lit("\n"), F.lit(" ")), F.lit(SPACE))
        factors.append(F.when(ai.isNotNull() & (worst["ai_score"] >= 70), fill(
            N["paragraph"], page=worst["page"], snippet=start, score=fixed1(worst["ai_score"]))))
    for column, kind, top in (("matched_skills", "matched", 5), ("missing_skills", "missing", 4)):
        if column in rows.columns:
            factors.append(F.when(fit.isNotNull() & (F.size(column) > 0), fill(
                N[kind], n=F.size(column), skills=F.array_join(F.slice(column, 1, top), ", "))))
    factors.append(F.when(fit.isNotNull(), fill(N["match"], score=fixed1(fit))).otherwise(F.lit(N["no_job"])))
    listed = F.array_compact(F.array(*factors))
    verdict = lambda i: F.when(label == "High Risk", V.VERDICTS["High Risk"][i]).when(
        label == "Caution", V.VERDICTS["Caution"][i]).otherwise(V.VERDICTS["other"][i])
    risk = F.when(c("forensic_risk_score").isNull(), F.lit("")).otherwise(
        fill(N["risk"], risk=c("forensic_risk_score")))
    font = c("font_substituted")
    return (
        rows.withColumn("_factors", listed)
        .withColumn("verdict_title", verdict(0))
        .withColumn("recommendation", verdict(1))
        .withColumn("summary", fill(N["summary"], score=fixed1(c("trust_score")), label=label, risk=risk,
                                    factors=F.array_join(F.slice("_factors", 1, 2), " ")))
        .withColumn("key_factors", F.when(font, F.concat(F.array(F.lit(N["font"])), c("_factors"))).otherwise(c("_factors")))
        .withColumn("limitations_disclaimer", F.when(font, F.lit(N["disclaimer"] + N["disclaimer_font"])).otherwise(F.lit(N["disclaimer"])))
        .drop("_factors")
    )
