import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, block int, part int, rep long, score double, carried string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(rows, partitions=3):
        full = [(i, t, "en", None, len(t or ""), 7, 1, None, 3, 0.5, "x") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make
