import os

import pytest
from odd_rows import ODD

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

@pytest.fixture(scope="session")
def odd(spark):
    """Rows of ODD with columns whose names operators use inside."""
    rows = [(i, t, "k", "r", 1.5, 2, "b") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, row string, score double, predicted int, body string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
