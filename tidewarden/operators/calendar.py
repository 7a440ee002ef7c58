"""Sessions, expected hours, contract months: calendars as generated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .windows import asof_backward


def weekday(day: Column) -> Column:
    """0 for Sunday of a day number since 1970."""
    return F.pmod(day + 4, F.lit(7))


def clock_seconds(date: Column, clock: str | Column, zone: str) -> Column:
    """Epoch seconds of a local clock time ("HH:MM") on a date, whatever the session's time zone."""
    clock = F.lit(clock) if isinstance(clock, str) else clock
    local = F.concat(date.cast("string"), F.lit(" "), clock, F.lit(":00")).cast("timestamp_ntz")
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", start, F.convert_timezone(F.lit(zone), F.lit("UTC"), local))


def date_of(day: Column) -> Column:
    """The date of a day number since 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))


def day_of(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("bigint")


def generate_sessions(days: DataFrame, zone: str, opens: str, closes: str) -> DataFrame:
    """day, open_at, close_at (epoch seconds) of weekdays, from local clock times; a close before the open is the next day's."""
    overnight = 1 if closes <= opens else 0
    d = days.select("day").where(weekday(F.col("day")).between(1, 5))
    date = date_of(F.col("day"))
    return d.select("day", clock_seconds(date, opens, zone).alias("open_at"), clock_seconds(F.date_add(date, overnight), closes, zone).alias("close_at"))


def easter(year: Column) -> Column:
    """Easter Sunday of a year, by the Gregorian moon tables: the day after the Paschal full moon's week."""
    century = F.floor(year / 100)
    golden = year % 19
    epact = F.pmod(century - F.floor(century / 4) - F.floor((8 * century + 13) / 25) + 19 * golden + 15, F.lit(30))
    moon = epact - F.floor(epact / 28) * (1 - F.floor(epact / 28) * F.floor(F.lit(29) / (epact + 1)) * F.floor((21 - golden) / 11))
    day = F.pmod(year + F.floor(year / 4) + moon + 2 - century + F.floor(century / 4), F.lit(7))
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), (moon - day).cast("int"))


def nth_weekday(year: Column, month: int, which: int, n: int) -> Column:
    """The n-th weekday (0 for Sunday) of a month; n = -1 for the last one."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        return F.date_add(first, (F.pmod(which - weekday(day_of(first)), F.lit(7)) + 7 * (n - 1)).cast("int"))
    last = F.last_day(first)
    return F.date_sub(last, F.pmod(weekday(day_of(last)) - which, F.lit(7)).cast("int"))


def observed(date: Column, saturdays: bool = True) -> Column:
    """The weekday on which a fixed holiday is kept: Monday for a Sunday, Friday for a Saturday (or not at all)."""
    of = weekday(day_of(date))
    return F.when(of == 0, F.date_add(date, 1)).when(of == 6, F.date_sub(date, 1) if saturdays else F.lit(None).cast("date")).otherwise(date)


def exchange_closures(years: DataFrame) -> DataFrame:
    """day, early of the New York exchange's holidays (early false) and half days (true) in the years (year), by the rules in force in each."""
    y = F.col("year")
    fixed = lambda month, day: F.make_date(y, F.lit(month), F.lit(day))
    since = lambda first, date: F.when(y >= first, date)
    thanks = nth_weekday(y, 11, 4, 4)
    half = lambda date, days: F.when(weekday(day_of(date)).between(*days), date)
    full = [
        observed(fixed(1, 1), saturdays=False), since(1998, nth_weekday(y, 1, 1, 3)), nth_weekday(y, 2, 1, 3), F.date_sub(easter(y), 2), nth_weekday(y, 5, 1, -1),
        since(2022, observed(fixed(6, 19))), observed(fixed(7, 4)), nth_weekday(y, 9, 1, 1), thanks, observed(fixed(12, 25)),
    ]
    early = [half(fixed(7, 3), (1, 4)), F.date_add(thanks, 1), half(fixed(12, 24), (1, 4))]
    told = F.explode(F.array(*(F.struct(d.alias("date"), F.lit(e).alias("early")) for ds, e in ((full, False), (early, True)) for d in ds)))
    return years.select(told.alias("c")).where("c.date is not null").select(day_of(F.col("c.date")).alias("day"), "c.early")


def exchange_sessions(days: DataFrame, zone: str = "America/New_York", opens: str = "09:30", closes: str = "16:00", early: str = "13:00") -> DataFrame:
    """day, open_at, close_at, early of the exchange's sessions among the days (day): weekdays without a holiday, shorter on half days."""
    days = days.select("day").where(weekday(F.col("day")).between(1, 5))
    years = days.select(F.year(date_of(F.col("day"))).alias("year")).distinct()
    told = days.join(exchange_closures(years), "day", "left").where("early is null or early")
    date, half = date_of(F.col("day")), F.coalesce("early", F.lit(False))
    close = clock_seconds(date, F.when(half, F.lit(early)).otherwise(F.lit(closes)), zone)
    return told.select("day", clock_seconds(date, opens, zone).alias("open_at"), close.alias("close_at"), half.alias("early"))


def session_hours(sessions: DataFrame) -> DataFrame:
    """hour, day: the clock hours that sessions overlap."""
    first, last = F.floor(F.col("open_at") / 3600) * 3600, F.floor((F.col("close_at") - 1) / 3600) * 3600
    return sessions.select(F.explode(F.sequence(first, last, F.lit(3600).cast("bigint"))).alias("hour"), "day")


def hours_between(asked: DataFrame, hours: DataFrame, since: str, until: str, out: str) -> DataFrame:
    """asked with the number of hours (hour) that begin after `since` and before `until`: two lookups in their running count, no range join."""
    ranked = hours.select("hour").distinct().withColumn("_line", F.lit(0))
    ranked = ranked.withColumn("_count", F.row_number().over(Window.partitionBy("_line").orderBy("hour")).cast("bigint"))  # an hour of the calendar a row
    told = asked.withColumns({"_line": F.lit(0), "_until": F.col(until) - 1})
    for at, name in ((since, "_upto"), ("_until", "_by")):
        told = asof_backward(told, ranked.withColumnRenamed("_count", name), ["_line"], at, "hour", [name], bin_size=30 * 86_400)
    return told.select(*asked.columns, F.greatest(F.coalesce("_by", F.lit(0)) - F.coalesce("_upto", F.lit(0)), F.lit(0)).cast("bigint").alias(out))


def local_seconds(at: Column, zone: str) -> Column:
    """The clock of a zone at an epoch second, as seconds since 1970 on that clock; summer time counts."""
    stamp = F.timestamp_seconds(at)
    return at + F.unix_timestamp(F.from_utc_timestamp(stamp, zone)) - F.unix_timestamp(F.from_utc_timestamp(stamp, "UTC"))


def reference_week(at: Column, zone: str = "America/New_York") -> Column:
    """Whether a second lies in Sunday 17:00 to Friday 17:00 by the clock of `zone`."""
    local = local_seconds(at, zone)
    day, time = weekday(F.floor(local / 86400)), F.pmod(local, F.lit(86400))
    return (day.between(1, 4)) | ((day == 0) & (time >= 17 * 3600)) | ((day == 5) & (time < 17 * 3600))


def regular_session(at: Column, opens: int, closes: int, zone: str = "America/New_York") -> Column:
    """Whether a second lies in the hours [opens, closes) (seconds of the day) of a weekday, by the clock of `zone`."""
    local = local_seconds(at, zone)
    time = F.pmod(local, F.lit(86400))
    return weekday(F.floor(local / 86400)).between(1, 5) & (time >= opens) & (time < closes)


def business_days_back(day: Column, n: int) -> Column:
    """The n-th weekday before a day (Python-free: the fifteen days before hold ten weekdays at least)."""
    before = F.filter(F.transform(F.sequence(F.lit(1), F.lit(n * 2 + 4)), lambda k: day - k), lambda d: ~weekday(d).isin(0, 6))
    return F.element_at(before, n)


#: Letters of the delivery months, January to December, and the contract rules of futures: months listed, months held,
#: weekdays from the last day of trading to the month's end, months by which it comes before the delivery month, or a day of the month and
#: weekdays before it; weekdays before the delivery month by which the contract is left, or weekdays before its last day; suffix.
MONTHS = "FGHJKMNQUVXZ"
SPECS = (
    ("KC=F", "HKNUZ", "HKNUZ", 8, 0, None, None, 12, None, "NYB"),
    ("CC=F", "HKNUZ", "HKNUZ", 11, 0, None, None, 15, None, "NYB"),
    ("CT=F", "HKNVZ", "HKNZ", 16, 0, None, None, 10, None, "NYB"),
    ("LE=F", "GJMQVZ", "GJMQVZ", 0, 0, None, None, 12, None, "CME"),
    ("BZ=F", MONTHS, MONTHS, 0, 2, None, None, None, 3, "NYM"),
    ("ZT=F", "HMUZ", "HMUZ", 0, 0, None, None, 3, None, "CBT"),
    ("ZN=F", "HMUZ", "HMUZ", 7, 0, None, None, 3, None, "CBT"),
    ("ZB=F", "HMUZ", "HMUZ", 7, 0, None, None, 3, None, "CBT"),
    ("ZC=F", "HKNUZ", "HKNZ", 0, 0, 15, 1, 14, None, "CBT"),
    ("ZW=F", "HKNUZ", "HKNUZ", 0, 0, 15, 1, 14, None, "CBT"),
    ("ZS=F", "FHKNQUX", "FHKNX", 0, 0, 15, 1, 14, None, "CBT"),
    ("SB=F", "HKNV", "HKNV", 0, 1, None, None, None, 16, "NYB"),
    ("PL=F", "FJNV", "FJNV", 2, 0, None, None, 3, None, "NYM"),
    ("FGBL=F", "HMUZ", "HMUZ", 0, 0, 10, 2, None, 3, "EUX"),
    ("TFM=F", MONTHS, MONTHS, 1, 1, None, None, None, 1, "NDX"),
)
_SPEC = "ticker string, listed string, held string, ltd_back int, ltd_months int, ltd_day int, ltd_day_back int, roll_back int, roll_ltd int, suffix string"


def specs_sql() -> str:
    """SPECS as rows of a VALUES list."""
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in SPECS)


def weekdays_before(day: Column, n: Column) -> Column:
    """The n-th weekday before a date (the date itself for 0): whole weeks back, then the days that are left, past a weekend."""
    # Monday 0 to Friday 4; a weekend day counts from the Monday after it
    at = F.weekday(day)
    monday = F.when(at >= 5, F.date_add(day, 7 - at)).otherwise(F.date_sub(day, at))
    place = F.when(at >= 5, F.lit(0)).otherwise(at)
    weeks = F.ceil((n - place) / 5).cast("int")
    weeks = F.greatest(weeks, F.lit(0))
    return F.when(n == 0, day).otherwise(F.date_add(monday, (place - n + weeks * 5 - weeks * 7).cast("int")))


def weekday_from(day: Column) -> Column:
    """The date, or the Monday after it at a weekend."""
    return F.when(F.weekday(day) >= 5, F.date_add(day, 7 - F.weekday(day))).otherwise(day)


def contracts(spark: SparkSession, years: DataFrame) -> DataFrame:
    """ticker, contract, year, month, held, last_day, leaves (the last day on which it is held) of each listed contract of the delivery years."""
    months = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")
    spec = spark.createDataFrame(SPECS, _SPEC)  # a row an instrument
    c = years.select("year", months).crossJoin(F.broadcast(spec)).withColumn("code", F.substring(F.lit(MONTHS), F.col("month"), F.lit(1)))
    c = c.where(F.expr("instr(listed, code) > 0"))
    first = F.make_date("year", "month", F.lit(1))
    month_end = F.date_sub(F.add_months(first, 1 - F.col("ltd_months")), 1)
    end = F.date_sub(month_end, F.greatest(F.weekday(month_end) - 4, F.lit(0)))
    by_day = weekdays_before(F.make_date("year", "month", F.coalesce("ltd_day", F.lit(1))), F.coalesce("ltd_day_back", F.lit(1)))
    c = c.withColumn("last_day", F.when(F.col("ltd_day").isNotNull(), by_day).otherwise(weekdays_before(end, F.col("ltd_back"))))
    by_last, by_month = weekdays_before(F.col("last_day"), F.coalesce("roll_ltd", F.lit(0))), weekdays_before(
        weekday_from(first), F.coalesce("roll_back", F.lit(0)) + 1,
    )
    c = c.withColumn("leaves", F.when(F.col("roll_ltd").isNotNull(), by_last).otherwise(by_month))
    name = F.concat(F.regexp_replace("ticker", "=F$", ""), "code", F.lpad((F.col("year") % 100).cast("string"), 2, "0"), F.lit("."), "suffix")
    return c.select("ticker", name.alias("contract"), "year", "month", F.expr("instr(held, code) > 0").alias("held"), "last_day", "leaves")


def rolls(rows: DataFrame) -> DataFrame:
    """ticker, contract, first_day of the held contracts: in front from the weekday after the one before is left."""
    line = Window.partitionBy("ticker").orderBy("year", "month")
    before = F.lag("leaves").over(line)
    return rows.where("held").select("ticker", "contract", weekday_from(F.date_add(before, 1)).alias("first_day")).where("first_day is not null")


def roll_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """ticker, session (date) of the first two sessions from the day before each edge on, within seven days after it; edges are the morrows of
    last trading days, and rolls. Sessions meet the edges of their week or the one before by an equi-join on weeks."""
    edges = rows.select("ticker", F.date_add("last_day", 1).alias("edge")).union(rolls(rows).select("ticker", "first_day")).distinct()
    week = lambda d: F.floor(F.unix_date(d) / 7)
    spread = edges.withColumn("week", F.explode(F.array(*(week(F.date_sub("edge", 1)) + i for i in (0, 1, 2)))))
    met = (
        spread.join(sessions.withColumn("week", week(F.col("session"))), "week")
        .where((F.col("session") >= F.date_sub("edge", 1)) & (F.col("session") <= F.date_add("edge", 7)))
    )
    nth = F.row_number().over(Window.partitionBy("ticker", "edge").orderBy("session"))
    return met.withColumn("nth", nth).where("nth <= 2").select("ticker", "session").distinct()
