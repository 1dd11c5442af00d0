from pathlib import Path

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text, lang, source) rows, shorter rows filled with nulls, and with columns
    whose names clash with those that operators use inside."""

    def make(*rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, SCHEMA)
        return frame.selectExpr("*", "1 AS id", "'x' AS digest", "2 AS label", "3 AS key", "4 AS number", "'y' AS h", "0.5 AS target")

    return make


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def sf_dir():
    """The smallest given tables."""
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test tables")
    return str(path)
