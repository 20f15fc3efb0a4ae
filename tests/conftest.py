import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from foresail.schema import LEAD, LEAD_COLUMNS  # noqa: E402
from foresail.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return None if text is None else date.fromisoformat(text)


@pytest.fixture(scope="session")
def make_leads(spark):
    """Leads from dicts; unnamed columns are null, dates may be text."""
    dates = {f.name for f in LEAD.fields if f.dataType.typeName() == "date"}

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = {"lead_id": f"L{i}", "trip_price": 0.0, **r}
            full.append(tuple(day(r.get(c)) if c in dates else r.get(c) for c in LEAD_COLUMNS))
        return spark.createDataFrame(full, LEAD)

    return make


@pytest.fixture(scope="session")
def make_series(spark):
    """Monthly series from revenues (and trips) starting in January 2020."""
    def make(revenues, trips=None, series_id="ALL", start=(2020, 1)):
        rows, (y, m) = [], start
        for i, r in enumerate(revenues):
            rows.append((series_id, date(y, m, 1), float(r), int(trips[i]) if trips else 10))
            y, m = (y + 1, 1) if m == 12 else (y, m + 1)
        return spark.createDataFrame(rows, "series_id string, month date, revenue double, trip_count long")

    return make


@pytest.fixture(scope="session")
def make_forecast(spark):
    def make(values, series_id="ALL", start=(2021, 1), lower=None, upper=None):
        rows, (y, m) = [], start
        for i, v in enumerate(values):
            rows.append((series_id, date(y, m, 1), float(v), float(lower[i] if lower else v * 0.9),
                         float(upper[i] if upper else v * 1.1)))
            y, m = (y + 1, 1) if m == 12 else (y, m + 1)
        return spark.createDataFrame(rows, "series_id string, month date, forecast double, lower double, upper double")

    return make
