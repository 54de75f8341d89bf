from datetime import date, timedelta

import pytest

from bazaarflow.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


REPORT = (
    "state_id long, state string, district string, market_id string, market string, commodity string, "
    "variety string, date date, min_price double, max_price double, modal_price double, arrivals_tonnes double"
)
DAY = (
    "state_id long, state string, district string, market_id string, market string, commodity string, date date, "
    "min_price double, max_price double, representative_price double, arrivals_tonnes double, arrival_coverage string, "
    "example_variety string"
)


@pytest.fixture
def reports(spark):
    def make(*rows):
        """rows of (variety, low, high, modal, arrivals)"""
        return spark.createDataFrame(
            [(20, "S", "D", "20-1", "M", "Onion", v, date(2026, 7, 20), lo, hi, modal, arr) for v, lo, hi, modal, arr in rows],
            REPORT,
        )

    return make


@pytest.fixture
def series(spark):
    def make(prices, start=date(2026, 1, 1), market="20-1", step=1, commodity="Onion"):
        rows = [
            (20, "S", "D", market, f"M {market}", commodity, start + timedelta(days=i * step), float(p - 1), float(p + 1), float(p), 5.0, "complete", "Local")
            for i, p in enumerate(prices)
        ]
        return spark.createDataFrame(rows, DAY)

    return make
