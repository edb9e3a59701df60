"""Expected values typed in by hand, so that a wrong constant cannot pass on both sides of a comparison."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkwitness import fixed_values as V
from inkwitness.operators import matching, metadata, pages, scoring, serving
from inkwitness.operators import near_duplicates as N


def test_history_of_two_owners(spark):
    scores = [(1, 10, 92.0, "Verified"), (2, 10, 88.0, "Verified"), (3, 10, 35.0, "High Risk"), (4, 20, 50.0, "Caution")]
    scans = spark.createDataFrame([(i, i, t, label, dt.datetime(2024, 1, i)) for i, _, t, label in scores],
                                  "scan_id long, doc_id long, trust_score double, trust_label string, scanned_at timestamp")
    docs = spark.createDataFrame([(i, o, f"{i}.pdf") for i, o, _, _ in scores], "doc_id long, owner_id long, filename string")
    told = {r.owner_id: r for r in serving.history_summary(scans, docs).collect()}
    assert (told[10].total_scans, told[10].average_trust_score, told[10].verified, told[10].caution, told[10].high_risk) == (3, 71.7, 2, 0, 1)
    assert (told[20].total_scans, told[20].average_trust_score, told[20].caution) == (1, 50.0, 1)
    assert [r.scan_id for r in serving.scan_history(scans, docs, owner=10).collect()] == [3, 2, 1]
    assert [r.scan_id for r in serving.scan_history(scans, docs, owner=10, label="Verified", limit=1, offset=1).collect()] == [1]
    assert serving.history_total(scans, docs, owner=20).first().total == 1
    with pytest.raises(ValueError):
        serving.scan_history(scans, docs, limit=101)


def test_every_scan_has_a_rank_in_its_batch(spark):
    rows = [(1, 0, 70.0, None, 0), (2, 0, None, 90.0, 1), (3, 0, 70.0, 10.0, 2), (4, 0, 0.0, 95.0, 3), (5, 1, 5.0, None, 0)]
    df = spark.createDataFrame(rows, "scan_id long, batch_id long, trust_score double, true_match_score double, batch_pos int")
    assert {r.scan_id: r["rank"] for r in serving.leaderboard(df).collect()} == {3: 1, 1: 2, 4: 3, 2: 4, 5: 1}
    assert {r.scan_id: r["rank"] for r in serving.leaderboard_by(df, "true_match_score").collect()} == {4: 1, 2: 2, 3: 3, 1: 4, 5: 1}


@pytest.mark.parametrize("ratio,severity", [(0.02, None), (0.15, None), (0.20, "medium"), (0.30, "medium"), (0.55, "high")])
def test_word_order_limits(spark, ratio, severity):
    df = spark.createDataFrame([(1, 2, 40, ratio, ["a", "b"])], "doc_id long, page int, word_count long, disorder_ratio double, sample_words array<string>")
    assert [r.severity for r in pages.detect_layer_order(df).collect()] == ([severity] if severity else [])


def test_metadata_cases(spark):
    rows = [(1, {}), (2, {"creator": "Canva", "creationDate": "D:20240101100000", "modDate": "D:20240101100000"}),
            (3, {"creator": "Microsoft Word", "creationDate": "D:20240101100000", "modDate": "D:20240101101000"}),
            (4, {"creator": "Microsoft Word", "creationDate": "D:20240101100000", "modDate": "D:20231231100000"}),
            (5, {"creator": "Microsoft Word", "creationDate": "D:20240101100000", "modDate": "D:20240105100000"})]
    got = metadata.detect_metadata(spark.createDataFrame(rows, "doc_id long, meta map<string,string>")).collect()
    assert sorted((r.doc_id, r.signal_type) for r in got) == [
        (1, "metadata_stripped"), (2, "metadata_generic_builder_tool"), (3, "metadata_rapid_edit_window"), (4, "metadata_mod_before_creation")]


def test_risk_is_capped_by_category(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    signals = spark.createDataFrame([(1, "hidden_text", "high", 999)] * 3, "doc_id long, signal_type string, severity string, risk_points int")
    rows = {r.doc_id: r for r in scoring.risk_breakdown(docs, signals).withColumn("total", scoring.risk_total()).collect()}
    assert 0 < rows[1].total < 100 and rows[2].total == 0


def test_other_weights_change_points_and_caps(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    category = V.SIGNAL_CATEGORY["hidden_text"]
    weights = {c: (40 if c == category else 0) for c in V.RISK_WEIGHTS}
    one = spark.createDataFrame([(1, "hidden_text", "high", 1)], "doc_id long, signal_type string, severity string, risk_points int")
    assert scoring.risk_breakdown(docs, one, weights).first()[category] == 40
    assert scoring.risk_breakdown(docs, one.unionByName(one), weights).first()[category] == 40
    assert scoring.summarise_signals(docs, one, weights).first()["forensic_risk_score"] == 40


def test_skill_aliases(spark):
    df = spark.createDataFrame([("We run K8s on GCP with JAVASCRIPT",), ("Java only",), ("nothing here",)], "t string")
    got = [r.s for r in df.select(matching.extract_skills(F.col("t")).alias("s")).collect()]
    assert "Kubernetes" in got[0] and "JavaScript" in got[0] and "Java" not in got[0] and got[1] == ["Java"] and got[2] == []


def test_unknown_job_keeps_the_document(spark):
    texts = spark.createDataFrame([(1, 5, "Python and SQL developer"), (2, 6, "Python and SQL developer")], "doc_id long, job_id long, clean_text string")
    jobs = spark.createDataFrame([(5, "Python and SQL developer")], "job_id long, job_text string")
    rows = {r.doc_id: r for r in matching.match_job(texts, jobs).collect()}
    assert rows[1].true_match_score == 100.0 and rows[1].note is None
    assert rows[2].true_match_score == 0.0 and rows[2].note and rows[2].matched_skills == []


def test_near_identical_and_unrelated_texts(spark):
    a = "Senior engineer who designed distributed storage systems and led the migration of billing services to containers"
    rows = [(1, 0, a), (2, 0, a.replace("billing", "payment")), (3, 0, "Pastry chef with ten years of baking bread cakes and fine desserts")]
    pairs = N.rank_pairs(N.duplicate_pairs(spark.createDataFrame(rows, "doc_id long, batch_id long, text string"))).collect()
    assert [(p.id_a, p.id_b, p["rank"]) for p in pairs] == [(1, 2, 1)] and pairs[0].similarity_score > 80 and pairs[0].shared_phrases
