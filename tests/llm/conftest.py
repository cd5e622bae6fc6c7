import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"
# extra columns whose names the operators use inside
CLASHING = ("id", "key", "n", "row", "v", "c", "pos", "at", "digest", "items", "lang_pred", "n_removed")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make(spark):
    """docs(rows) with doc_id, text, lang, source and columns of clashing names."""

    def docs(rows):
        full = [(i, t, "en", f"s{k % 9}", *["x"] * len(CLASHING)) for k, (i, t) in enumerate(rows)]
        schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame(full, schema)

    return docs
