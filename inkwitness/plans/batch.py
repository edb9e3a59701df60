"""Batches: scan, compare inside each batch, rescore, rank and account."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from inkwitness.operators import near_duplicates as N, registry, scoring, serving
from inkwitness.plans.scan import ScanResult, scan_documents
from inkwitness.session import materialise
from inkwitness.sources.landing import batch_accounting


@dataclass
class BatchResult:
    scan: ScanResult
    leaderboard: DataFrame
    duplicate_pairs: DataFrame
    duplicate_signals: DataFrame
    accounting: DataFrame


def rescore(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """Scores after near-duplicates: counts rise by one, the risk stays (the type has no category)."""
    return scoring.with_trust(N.apply_duplicates(rows, touched))


def scan_batches(docs: DataFrame, evidence: registry.Evidence, failed: DataFrame, jobs: DataFrame | None = None) -> BatchResult:
    """``docs(doc_id, batch_id, batch_pos, filename, ...)``; ``failed(batch_id, filename, error)`` are
    files that did not get as far as spans."""
    scan = scan_documents(docs, evidence, jobs)
    results = materialise(scan.results, "batch-results")
    texts = scan.clean_texts.join(results.select("doc_id", "batch_id"), "doc_id")
    forms, members = N.all_pairs_cosine(texts, "clean_text", scope="batch_id")
    forms = materialise(forms, "similar-forms")
    pairs = N.shared_phrases(N.expand_pairs(forms, members).withColumnRenamed("scope", "batch_id"), texts, "clean_text", "batch_id")
    rescored = rescore(results, N.touched_documents(forms, members))
    done = results.select("batch_id", F.lit(None).cast("string").alias("error"))
    lost = failed.select("batch_id", "error").unionByName(scan.rejected.select("batch_id", "error"))
    return BatchResult(
        scan, serving.leaderboard(rescored), pairs,
        N.detect_duplicate_template(pairs, results.select("doc_id", "filename")),
        batch_accounting(done.unionByName(lost)))
