"""Files as they lie in a folder, re-scanned documents, and the shared folder."""

import pytest

from inkwitness import session
from inkwitness.sources import landing as L


def test_files_too_large_to_read_are_still_reported(spark, tmp_path):
    (tmp_path / "small.pdf").write_bytes(b"abc")
    (tmp_path / "large.pdf").write_bytes(b"x" * 500)
    (tmp_path / "other.txt").write_bytes(b"text")
    assert {r.path.rsplit("/", 1)[1]: r.length for r in L.list_files(spark, str(tmp_path), "*.pdf").collect()} == {"small.pdf": 3, "large.pdf": 500}
    landed = {r.filename: r for r in L.land_files(L.read_files(spark, str(tmp_path), limit=100)).collect()}
    assert set(landed) == {"small.pdf", "large.pdf", "other.txt"}
    assert landed["large.pdf"].content is None and landed["large.pdf"].byte_length == 500 and landed["large.pdf"].sha256 is None
    assert landed["small.pdf"].byte_length == 3 and landed["small.pdf"].sha256.startswith("ba7816bf")


def test_a_document_that_became_clean_loses_its_rows(spark):
    stored = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "doc_id long, kind string")
    fresh = spark.createDataFrame([(2, "new")], "doc_id long, kind string")
    rescanned = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = L.replace_scan_rows(stored, fresh, rescanned).collect()
    assert sorted((r.doc_id, r.kind) for r in got) == [(2, "new"), (3, "d")]


def test_every_bucket_has_several_writers(spark, tmp_path):
    rows = spark.range(2000).withColumnRenamed("id", "doc_id").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else little data is one task
    try:
        L.store_results({"rows": rows}, str(tmp_path), buckets=2, writers=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 2000
    assert all(len(list((tmp_path / "rows" / f"bucket={b}").glob("part-*"))) > 1 for b in range(2))


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_tables_can_be_removed_early(spark):
    table = session.materialise(spark.range(5).toDF("n"), "gone")
    assert table.count() == 5
    session.discard(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        table.count()
