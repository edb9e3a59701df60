"""The whole scan: from spans to signals, risk, clean text, scores, trust and narrative."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from inkwitness import fixed_values as V
from inkwitness.operators import authorship, cleaning, matching, narrative, registry, scoring
from inkwitness.session import materialise


@dataclass
class ScanResult:
    """Tables a scan stores."""

    results: DataFrame
    signals: DataFrame
    paragraphs: DataFrame
    clean_texts: DataFrame
    rejected: DataFrame


def risk_by_document(docs: DataFrame, evidence: registry.Evidence) -> DataFrame:
    """The forensic half alone: signals, capped risk, trust without authorship and match."""
    signals = registry.run_all_detectors(evidence)
    rows = (
        scoring.summarise_signals(docs, signals)
        .withColumn("ai_content_score", F.lit(None).cast("double"))
        .withColumn("true_match_score", F.lit(None).cast("double"))
    )
    return scoring.with_trust(rows)


def scan_documents(docs: DataFrame, evidence: registry.Evidence, jobs: DataFrame | None = None) -> ScanResult:
    """Scan ``docs(doc_id, ... [, job_id])``.

    Documents whose text does not look like one of the expected kind leave at the start and come
    back in ``rejected``.  Signals and paragraph scores are written once, as several branches read them.
    """
    texts = cleaning.full_text(evidence.spans)
    judged = materialise(cleaning.resume_likelihood(texts).select("doc_id", "admitted"), "admission")
    out = judged.filter(~F.col("admitted")).select("doc_id")
    rejected = docs.join(out, "doc_id", "left_semi").withColumn("error", F.lit(V.NOT_A_DOCUMENT))
    keep = lambda df: None if df is None else df.join(out, "doc_id", "left_anti")
    docs, spans = keep(docs), keep(evidence.spans)
    signals = materialise(registry.run_all_detectors(registry.Evidence(
        spans, evidence.page_dims, evidence.ref_date, keep(evidence.words), keep(evidence.images), keep(evidence.metadata))), "signals")

    clean = cleaning.clean_spans(spans, signals)
    clean_texts = materialise(cleaning.rebuild_paragraphs(clean), "clean-texts")
    paragraphs = materialise(authorship.paragraph_ai_scores(clean), "paragraphs")
    counts = cleaning.word_counts(spans, clean_texts).select("doc_id", "clean_words", "flagged_words")
    # a document whose every span was flagged still has a (blank) clean text
    texts = docs.select("doc_id", *[c for c in ("job_id",) if c in docs.columns]).join(clean_texts, "doc_id", "left").withColumn(
        "clean_text", F.coalesce("clean_text", F.lit("")))
    ai = authorship.ai_score(texts.select("doc_id", "clean_text")).drop("clean_text")

    rows = scoring.summarise_signals(docs, signals).join(counts, "doc_id", "left").join(ai, "doc_id")
    if jobs is not None:
        rows = rows.join(matching.match_job(texts, jobs).drop("note", "job_id"), "doc_id", "left")
    else:
        rows = rows.withColumn("true_match_score", F.lit(None).cast("double"))
    rows = scoring.with_trust(rows).join(narrative.worst_paragraphs(paragraphs), "doc_id", "left")
    return ScanResult(narrative.narrate(rows), signals, paragraphs, clean_texts, rejected)
