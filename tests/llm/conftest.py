import pytest

from gridfold.llm.base import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) rows, with the other columns of the table and one clashing name."""

    def make(rows, extra="leaks"):
        wide = [(i, t, "en", "src0", len(t or ""), f"own {n}") for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(wide, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra} string")

    return make
