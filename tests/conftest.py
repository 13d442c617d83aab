from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session("4", memory="4g", **{"spark.checkpoint.dir": shared})
    yield session
    session.stop()


def business_days(start: dt.date, n: int) -> list[dt.date]:
    out, day = [], start
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


BAR_SCHEMA = ("code string, date date, open double, high double, low double, close double, "
              "volume double, amount double, halted boolean, is_event boolean")


@pytest.fixture(scope="session")
def make_bars(spark):
    """make_bars({code: [(open, high, low, close), ...]}, events={(code, i)}, halted={(code, i)})"""

    def build(paths, events=(), halted=(), volume=1000.0):
        days = business_days(dt.date(2024, 6, 3), max(len(p) for p in paths.values()))
        rows = []
        for code, path in paths.items():
            for i, (o, h, l, c) in enumerate(path):
                stop = (code, i) in halted
                rows.append((code, days[i], *(map(float, (0, 0, 0, c) if stop else (o, h, l, c))),
                             volume, volume * float(c), stop, (code, i) in events))
        return spark.createDataFrame(rows, BAR_SCHEMA)

    return build
