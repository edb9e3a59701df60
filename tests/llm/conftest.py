import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """``docs(rows, columns)``: a table of documents over several partitions."""

    def make(rows, columns="doc_id long, text string"):
        return spark.createDataFrame(rows, columns).repartition(3)

    return make
