import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import day  # noqa: E402

from pricepanel.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_panel(spark):
    """Build a panel from (seller, isbn, day number, price, rank) tuples."""

    def build(*quotes):
        data = [(s, i, day(d), float(p), r) for s, i, d, p, r in quotes]
        return spark.createDataFrame(data, "seller string, isbn string, dateacc date, price2 double, rank int")

    return build


@pytest.fixture(scope="session")
def random_quotes(spark):
    """Quotes with many ties in price, one per seller, product and day."""
    import random

    rng = random.Random(5)
    data = [
        (f"s{s}", f"b{b}", day(d), float(rng.choice([5, 7, 9, 12, 40])))
        for b in range(3) for d in range(5) for s in range(12) if rng.random() < 0.8
    ]
    return spark.createDataFrame(data, "seller string, isbn string, dateacc date, price2 double")
