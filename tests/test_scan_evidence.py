"""What a whole scan reads: thresholds by organisation, every kind of evidence, one total order."""

from pyspark.sql import functions as F

from catalog import views as W
from catalog.queries import QUERIES, _evidence
from inkwitness.operators import serving as Q, span_rules as SR
from inkwitness.operators.registry import run_all_detectors
from inkwitness.schemas import SPAN_SCHEMA

SF = "/root/testdata/sf0.001"
KINDS = {"zero_width_chars", "homoglyph_substitution", "hidden_text", "zero_or_tiny_font", "offpage_text", "font_substitution", "prompt_injection",
         "timeline_end_before_start", "timeline_future_start", "timeline_overlap", "layer_order_mismatch", "metadata_generic_builder_tool",
         "metadata_rapid_edit_window", "metadata_mod_before_creation", "metadata_stripped", "image_only_page"}


def test_two_organisations_get_different_signals_from_equal_spans(spark):
    grey, box = (235, 235, 235), (10.0, 10.0, 200.0, 22.0)  # 34.6 from white
    spans = spark.createDataFrame([(d, 0, 1, 0, "the same words", "Helvetica", 1.5, grey, False, False, box, "layout") for d in (1, 2, 3)], SPAN_SCHEMA)
    documents = spark.createDataFrame([(1, 10), (2, 20), (3, 99)], "doc_id long, owner_id long")
    owners = spark.createDataFrame([(10, "strict"), (20, "plain")], "owner_id long, organization string")
    settings = spark.createDataFrame([("strict", 40, 2.0), ("plain", None, None)], "organization string, near_white_threshold int, hidden_font_size_pt double")
    limited = Q.with_thresholds(spans, Q.document_thresholds(documents, Q.effective_thresholds(owners, settings)))
    dims = spark.createDataFrame([(d, 1, 612.0, 792.0) for d in (1, 2, 3)], "doc_id long, page int, width double, height double")
    found = SR.detect_span_signals(limited, dims).select("doc_id", "signal_type").collect()
    assert sorted(tuple(r) for r in found) == [(1, "hidden_text"), (1, "zero_or_tiny_font")]


def test_every_kind_of_signal_occurs_in_the_scan(spark):
    assert {r[0] for r in run_all_detectors(_evidence(spark, SF)).select("signal_type").distinct().collect()} == KINDS


def test_signals_come_in_reading_order(spark):
    rank = {"high": 0, "medium": 1, "low": 2}
    rows = [(r.doc_id, r.page, rank[r.severity], r.signal_type) for r in QUERIES["run_all_detectors"](spark, SF).collect()]
    assert rows == sorted(rows)


def test_jobs_are_spread_over_the_items_that_exist(spark):
    items = {r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id").collect()}
    used = {r[0] for r in W.candidate_texts(spark, SF).select("job_id").distinct().collect()}
    assert used == set(range(len(items)))
    assert QUERIES["match_job"](spark, SF).where(F.col("note").isNotNull() & (F.col("note") != "")).count() < 20
