"""Registered queries against their SQL, and the pipeline stage by stage against plain Python."""

import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from samples import prose

import corpus_pipeline
from inkwitness.llm.mixing import targets
from inkwitness.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    order = sorted(want.columns)
    pd.testing.assert_frame_equal(got[order].sort_values(order, ignore_index=True), want[order].sort_values(order, ignore_index=True), check_dtype=False, check_exact=True)


def test_every_query_covers_its_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op3_toxicity", "op5_edit_aware_counts", "op9_quality_classifier"):
        assert QUERIES[name](spark, SF).count() == docs
    held = QUERIES["op3_toxicity"](spark, SF).select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert QUERIES["op7_url_association_rules"](spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(i, "\n".join(prose(31 * i + k, 30 + i % 20) for k in range(3)), "en", f"s{i % 4}", 5) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s0", 5) for i in range(10)]  # exact copies
    rows += [(300 + i, " ".join(w + "###" for w in prose(i, 60).split()), "en", "s1", 5) for i in range(12)]
    rows += [(400, None, "en", None, None), (401, "", None, "s2", 0), (402, prose(9, 9000), "en", "s2", 5)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        seen.append([tuple(r) for r in docs.collect()])
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    good, lined, single, mixed, packed = seen
    assert {r[0] for r in good} == set(range(120)) | set(range(200, 210)) | {402}
    assert {r[0] for r in lined} == set(range(120)) | {402} and all(r[4] == len(r[1]) for r in lined)
    assert sorted(single) == sorted(lined)
    sizes = Counter()
    for r in single:
        sizes[r[3]] += len(r[1].split())
    taken = Counter()
    for r in mixed:
        taken[r[3]] += len(r[1].split())
    most = max(len(r[1].split()) for r in single if r[0] != 402)
    assert all(abs(taken[s] - t) <= most for s, t in targets(dict(sizes)).items() if s != "s2") and max(Counter(r[0] for r in mixed).values()) == 2
    held = Counter()
    for r in packed:
        held[r[0]] += r[2]
    times = Counter(r[0] for r in mixed)
    assert held.keys() == times.keys() and all(held[r[0]] == times[r[0]] * r[4] for r in packed)


def test_run(spark, corpus):
    folder, _ = corpus
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
