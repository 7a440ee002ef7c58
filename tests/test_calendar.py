"""The session calendar against known dates, and under several session time zones."""

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import bars, calendar

#: Easter Sundays, full closures of 2024 and 2021, and half days of 2024, as published.
EASTER = {1954: (4, 18), 1961: (4, 2), 1981: (4, 19), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25), 2049: (4, 18)}
SHUT_2024 = ["01-01", "01-15", "02-19", "03-29", "05-27", "06-19", "07-04", "09-02", "11-28", "12-25"]
SHUT_2021 = ["01-01", "01-18", "02-15", "04-02", "05-31", "07-05", "09-06", "11-25", "12-24"]
HALF_2024 = ["07-03", "11-29", "12-24"]
ZONES = ["UTC", "America/New_York", "Asia/Tokyo"]


def days(spark, first, last):
    return spark.range((first - date(1970, 1, 1)).days, (last - date(1970, 1, 1)).days + 1).select(F.col("id").alias("day"))


def on(day):
    return date(1970, 1, 1) + timedelta(days=day)


def test_easter(spark):
    got = {r.y: (r.e.month, r.e.day) for r in spark.createDataFrame([(y,) for y in EASTER], "y int").select("y", calendar.easter(F.col("y")).alias("e")).collect()}
    assert got == EASTER


@pytest.mark.parametrize("zone", ZONES)
def test_sessions_of_a_year(spark, zone):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = {on(r.day): r for r in calendar.exchange_sessions(days(spark, date(2024, 1, 1), date(2024, 12, 31))).collect()}
        plain = calendar.generate_sessions(days(spark, date(2024, 6, 29), date(2024, 7, 2)), "America/New_York", "18:00", "17:00").collect()
        months = spark.createDataFrame([(1704067200,), (1706745599,), (1706745600,)], "hour long")
        settled = [r[0] for r in months.select(bars.settled(F.col("hour"), F.lit(1706745600 + 7 * 86_400), 7)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    week = [date(2024, 1, 1) + timedelta(days=n) for n in range(366)]
    assert [d.strftime("%m-%d") for d in week if d.weekday() < 5 and d not in rows] == SHUT_2024
    assert [d.strftime("%m-%d") for d in sorted(rows) if rows[d].early] == HALF_2024
    for d, r in rows.items():
        for at, clock in ((r.open_at, "09:30"), (r.close_at, "13:00" if r.early else "16:00")):
            assert datetime.fromtimestamp(at, timezone.utc).astimezone(ZoneInfo("America/New_York")).strftime("%Y-%m-%d %H:%M") == f"{d} {clock}"
    assert [(str(on(r.day)), r.close_at - r.open_at, r.open_at % 86_400) for r in sorted(plain)] == [("2024-07-01", 82_800, 79_200), ("2024-07-02", 82_800, 79_200)]
    assert settled == [True, True, False]


def test_holidays_that_move(spark):
    rows = {on(r.day) for r in calendar.exchange_sessions(days(spark, date(2021, 1, 1), date(2022, 12, 31))).collect()}
    shut = [d for d in (date(2021, 1, 1) + timedelta(days=n) for n in range(365)) if d.weekday() < 5 and d not in rows]
    assert [d.strftime("%m-%d") for d in shut] == SHUT_2021  # Juneteenth is not yet kept, Christmas on the Friday before
    assert date(2021, 12, 31) in rows and date(2022, 6, 20) not in rows  # a Saturday's New Year is not kept, a Sunday's holiday on Monday
    assert calendar.exchange_sessions(days(spark, date(2024, 1, 1), date(2024, 1, 1))).count() == 0


def test_hours_between(spark):
    hours = spark.createDataFrame([(h,) for h in (10, 20, 30, 40, 40)], "hour long")
    asked = spark.createDataFrame([(0, 5), (5, 10), (10, 41), (20, 20), (25, 100), (50, 60)], "a long, b long")
    got = sorted((r.a, r.b, r.n) for r in calendar.hours_between(asked, hours, "a", "b", "n").collect())
    assert got == [(0, 5, 0), (5, 10, 0), (10, 41, 3), (20, 20, 0), (25, 100, 2), (50, 60, 0)]
