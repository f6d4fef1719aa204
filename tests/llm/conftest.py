"""Small helpers for the operators' tests; the session comes from the folder above."""

import pytest

# two tests above import this from "conftest", which is this file in a run of the whole suite
from tests.conftest import rows  # noqa: F401


@pytest.fixture
def documents(spark):
    def make(rows, extra=False):
        if extra:
            return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows],
                                         "doc_id long, text string, quality string, n long, words string")
        return spark.createDataFrame(rows, "doc_id long, text string")
    return make
