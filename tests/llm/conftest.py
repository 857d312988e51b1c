import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, dealt over a few partitions."""

    def make(rows, extra=""):
        return spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string" + extra).repartition(4)

    return make
