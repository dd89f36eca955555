import datetime as dt

import pytest
from helpers import daily_frame

from hourloom.operators import requests

LAST = dt.date(2020, 1, 25)

CASES = [
    ("Predict TOMORROW please", dt.date(2020, 1, 26), "ok"),
    ("today", dt.date(2020, 1, 16), "ok"),
    ("what about yesterday", dt.date(2020, 1, 15), "ok"),
    ("next week", dt.date(2020, 2, 1), "ok"),
    ("Next Month?", dt.date(2020, 2, 24), "ok"),
    ("usage 2020-01-10", dt.date(2020, 1, 10), "ok"),
    ("usage 12/01/2020", dt.date(2020, 1, 12), "ok"),
    ("31/02/2020", None, "no_date"),
    ("what?", None, "no_date"),
    ("", dt.date(2020, 1, 16), "ok"),
    (None, dt.date(2020, 1, 16), "ok"),
    ("2021-01-24", dt.date(2021, 1, 24), "ok"),
    ("2021-01-25", dt.date(2021, 1, 25), "too_far"),
]


def test_texts_become_dates(spark):
    anchors = requests.anchor_dates(daily_frame(spark, {"m": [1.0] * 20}))
    rows = [(i, "m", text) for i, (text, _, _) in enumerate(CASES)] + [(99, "none", "today")]
    asked = spark.createDataFrame(rows, "request_id long, series_id string, query string")
    got = {r["request_id"]: r for r in requests.resolve_requests(asked, anchors).collect()}
    for i, (text, date, status) in enumerate(CASES):
        assert (got[i]["date"], got[i]["status"]) == (date, status), text
    assert got[99]["status"] == "unknown_series"
    assert got[0]["days_ahead"] == 1 and got[1]["days_ahead"] == -9


@pytest.mark.parametrize("days, status", [(0, "end_before_start"), (1, "ok"), (365, "ok"), (366, "too_long")])
def test_range_lengths(spark, days, status):
    row = (LAST, LAST + dt.timedelta(days=days - 1))
    checked = requests.check_ranges(spark.createDataFrame([row], "start_date date, end_date date")).first()
    assert (checked["range_days"], checked["status"]) == (days, status)


@pytest.mark.parametrize("days, status", [(0, "bad_horizon"), (1, "ok"), (365, "ok"), (366, "bad_horizon")])
def test_horizons(spark, days, status):
    row = requests.next_days(spark.createDataFrame([(LAST,)], "last_date date"), days).first()
    assert row["status"] == status
    assert (row["start_date"] is None) == (status != "ok")
