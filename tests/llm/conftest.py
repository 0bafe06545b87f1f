import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def small() -> str:
    return "/root/testdata/sf0.001"


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def documents(spark):
    """Makes a documents table from texts; ids count from 0."""

    def make(texts, ids=None):
        rows = [(k if ids is None else ids[k], t, "en", "src0", None if t is None else len(t)) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def shop(small):
    """DuckDB with every table of the small folder as a view."""
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in Path(small).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return con
