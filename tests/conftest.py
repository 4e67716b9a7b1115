import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from catalog.compare import session

    spark = session("4")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def make_messages(spark):
    """Rows (chat, minute offset, user, text) -> full message table; seq is the place in the list."""
    from parlance.operators.enrich import enrich

    def make(rows, start=datetime(2024, 3, 1)):
        data = [(c, i, start + timedelta(minutes=m), u, t) for i, (c, m, u, t) in enumerate(rows)]
        raw = spark.createDataFrame(data, "chat_id string, seq long, date timestamp_ntz, user string, message string")
        return enrich(raw)

    return make
