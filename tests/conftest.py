import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vecindario.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", **{
        "spark.sql.shuffle.partitions": "2", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    def make(*texts):
        rows = [(0, i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, line_no int, line string")
    return make


@pytest.fixture(scope="session")
def corpus(spark):
    """Forty short lines with frequent and rare words."""
    words = ["sol", "luna", "mar", "río", "casa", "niño", "tren", "calle", "árbol", "pan"]
    rows = []
    for i in range(40):
        picks = [words[(i * k + k * k) % len(words)] for k in range(1, 4 + i % 9)]
        rows.append((i // 4, i % 4, " ".join(picks + ([f"raro{i}"] if i % 3 == 0 else []))))
    return spark.createDataFrame(rows, "doc_id long, line_no int, line string")
