"""Calendar dimensions: market holidays, first Fridays, session eras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Session eras of one broker's calendar: fixed values (start, daily break).
ERAS = (("2015-09-11", True), ("2017-10-07", False), ("2022-10-21", True))


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * k, 451)
    n = h + k - 7 * m + 114
    return F.make_date(year, div(n, 31), n % 31 + 1)


def _nth(year: Column, month: int, day: str, n: int) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), day), 7 * (n - 1))


def us_market_holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(day, name): nine holidays a year and Good Friday; Juneteenth from 2022."""
    y = F.col("y")
    fixed = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    named = [
        (fixed(1, 1), "New Year"), (_nth(y, 1, "MO", 3), "Martin Luther King"), (_nth(y, 2, "MO", 3), "Presidents"), (F.date_sub(easter(y), 2), "Good Friday"),
        (F.next_day(F.date_sub(F.last_day(fixed(5, 1)), 7), "MO"), "Memorial"), (F.when(y >= 2022, fixed(6, 19)), "Juneteenth"), (fixed(7, 4), "Independence"),
        (_nth(y, 9, "MO", 1), "Labor"), (_nth(y, 11, "TH", 4), "Thanksgiving"), (fixed(12, 25), "Christmas"),
    ]
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    return years.select(F.explode(F.array(*[F.struct(d.alias("day"), F.lit(n).alias("name")) for d, n in named])).alias("h")).select("h.*").where("day is not null")


def near_holidays(holidays: DataFrame, tolerance: int = 2, nearest: bool = False) -> DataFrame:
    """(day, holiday): each day within the tolerance of a holiday, once. The earliest holiday in reach
    wins or, with nearest, the same day, then the day after it, before it, and so on."""
    shift = holidays.select("name", "day", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))).alias("s")).select(F.date_add("day", F.col("s"))
        .alias("near"), "day", "name", "s")
    order = F.struct(F.abs("s"), -F.col("s")) if nearest else F.struct(F.col("day"), F.col("name"))
    label = F.concat("name", F.when(F.col("s") != 0, F.lit(" (adjacent)")).otherwise("")) if nearest else F.col("name")
    return shift.groupBy(F.col("near").alias("day")).agg(F.min_by(label, order).alias("holiday"))


def first_fridays(spark: SparkSession, start: str, end: str) -> DataFrame:
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("m"))
    return months.select(F.next_day(F.date_sub("m", 1), "FR").alias("day")).where(F.col("day").between(start, end))


def session_eras(spark: SparkSession) -> DataFrame:
    """(start, end, daily_break): each era up to the next; the last has no end."""
    rows = spark.createDataFrame([(d, b) for d, b in ERAS], "start string, daily_break boolean").select(F.col("start").cast("date").alias("start"), "daily_break")
    return rows.withColumn("end", F.lead("start").over(Window.orderBy("start")))


def era_of(day: Column) -> tuple[Column, Column]:
    """(start, daily break) of the last era that began by the day; null before the first."""
    start, daily = F.lit(None).cast("date"), F.lit(None).cast("boolean")
    for d, b in ERAS:
        start, daily = F.when(day >= F.lit(d).cast("date"), F.lit(d).cast("date")).otherwise(start), F.when(day >= F.lit(d).cast("date"), F.lit(b)).otherwise(daily)
    return start, daily
