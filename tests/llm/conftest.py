import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text) as a documents table in a few partitions; id -1 stands for null."""

    def build(rows, partitions=3):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        rows = [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
