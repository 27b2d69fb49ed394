import datetime as dt
import json

import pytest

from inkfold.operators import coverage as C, results as RS
from tests.helpers import rows

FLOOR, TODAY, DAY = dt.date(2024, 1, 10), dt.date(2024, 2, 5), dt.timedelta(1)


def log(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "date date")


def d(n):
    return dt.date(2024, 1, n)


@pytest.mark.parametrize(
    "days, expected",
    [
        ([], ("no_collection", None, None, FLOOR, TODAY)),
        ([d(12), d(13), d(13)], ("backfill", d(11), d(14), FLOOR, d(11))),
        ([d(10), d(11)], ("forward", None, d(12), d(12), TODAY)),
        ([d(1), d(2)], ("forward", None, d(3), d(3), TODAY)),
        ([d(12), d(14)], ("gap", None, None, None, None)),
        ([d(11)], ("backfill", d(10), d(12), FLOOR, d(10))),
    ],
)
def test_next_dates(spark, days, expected):
    row = C.next_dates(log(spark, *days), TODAY, FLOOR).collect()[0]
    assert (row.status, row.before, row.after, row.first, row.last) == expected


def test_coverage_counts(spark):
    row = C.coverage(log(spark, d(1), d(1), d(3))).collect()[0]
    assert tuple(row) == (2, d(1), d(3), 3, True)


def test_date_walk_and_missing(spark):
    ranges = spark.createDataFrame([(d(1), d(3)), (d(5), d(5)), (d(9), d(8)), (None, d(2))], "first date, last date")
    assert rows(C.date_walk(ranges)) == [(d(1),), (d(2),), (d(3),), (d(5),)]
    assert rows(C.missing_dates(log(spark, d(1), d(4), d(6)))) == [(d(2),), (d(3),), (d(5),)]
    assert C.missing_dates(log(spark)).isEmpty()


def test_latest_result_and_messages(spark):
    stored = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("k", 2, "mid"), ("j", 1, None)], "key string, seq long, value string")
    assert rows(RS.latest_results(stored)) == [("j", None), ("k", "new")]
    none = RS.next_dates_result(None, 1, "news_db", spark).collect()[0]
    assert json.loads(none.value)["message"] == "database: news_db is not existed"
    empty = RS.next_dates_result(C.next_dates(log(spark), TODAY), 2, "news_db", spark).collect()[0]
    assert json.loads(empty.value)["message"] == "No This Collection: LogInfo"
