"""Server clocks, daylight-saving rules and session hours, as Columns over dates and epoch seconds.

A bar's ``time`` is the server's wall clock written as epoch seconds, so its arithmetic needs no session zone."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86400


@dataclass(frozen=True)
class Clock:
    """Rule (eu, us or fixed) and hours of a server's clock and session. Fixed values of one broker's calendar."""

    rule: str = "eu"
    winter: int = 2
    summer: int = 3
    break_matched: int = 0
    break_mismatch: int = 23
    close_matched: int = 23
    close_mismatch: int = 22
    window_start: date = date(2015, 9, 11)


def wall_seconds(ts: Column) -> Column:
    """Epoch seconds that a wall-clock timestamp reads, whatever the session's zone."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY + F.hour(ts) * HOUR + F.minute(ts) * 60 + F.second(ts)


def day_number(time: Column) -> Column:
    return F.floor(time / DAY).cast("long")


def day_of(time: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day_number(time).cast("int"))


def hour_of(time: Column) -> Column:
    return F.floor(F.pmod(time, F.lit(DAY)) / HOUR).cast("int")


def weekday(time: Column) -> Column:
    """0 is Monday."""
    return F.pmod(day_number(time) + 3, F.lit(7)).cast("int")


def nth_sunday(year: Column, month: int, n: int) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), "SU"), 7 * (n - 1))


def last_sunday(year: Column, month: int) -> Column:
    return F.next_day(F.date_sub(F.last_day(F.make_date(year, F.lit(month), F.lit(1))), 7), "SU")


def eu_is_summer(day: Column) -> Column:
    y = F.year(day)
    return (day >= last_sunday(y, 3)) & (day < last_sunday(y, 10))


def us_is_summer(day: Column) -> Column:
    y = F.year(day)
    return (day >= nth_sunday(y, 3, 2)) & (day < nth_sunday(y, 11, 1))


def offset_hours(day: Column, clock: Clock = Clock()) -> Column:
    """Hours ahead of UTC, by the date on the server's clock, not by the instant."""
    if clock.rule == "fixed":
        return F.lit(clock.winter)
    rule = {"eu": eu_is_summer, "us": us_is_summer}[clock.rule]
    return F.when(rule(day), clock.summer).otherwise(clock.winter)


def to_utc(time: Column, clock: Clock = Clock()) -> Column:
    return time - offset_hours(day_of(time), clock) * HOUR


def calendars_disagree(day: Column) -> Column:
    return us_is_summer(day) & ~eu_is_summer(day)


def dst_bucket(day: Column) -> Column:
    """us-/eu- summer or winter, jointly."""
    return F.concat_ws("/", F.when(us_is_summer(day), "us-summer").otherwise("us-winter"), F.when(eu_is_summer(day), "eu-summer").otherwise("eu-winter"))


def break_hour(day: Column, clock: Clock = Clock()) -> Column:
    return F.when(calendars_disagree(day), clock.break_mismatch).otherwise(clock.break_matched)


def close_hour(day: Column, clock: Clock = Clock()) -> Column:
    return F.when(calendars_disagree(day), clock.close_mismatch).otherwise(clock.close_matched)


def new_york(utc: Column) -> Column:
    """New York wall-clock seconds of a UTC epoch: five hours behind, four in the US summer, which
    begins and ends at two o'clock in the morning there (7 and 6 o'clock UTC)."""
    y = F.year(day_of(utc))
    start = F.datediff(nth_sunday(y, 3, 2), F.lit("1970-01-01").cast("date")).cast("long") * DAY + 7 * HOUR
    end = F.datediff(nth_sunday(y, 11, 1), F.lit("1970-01-01").cast("date")).cast("long") * DAY + 6 * HOUR
    return utc - F.when((utc >= start) & (utc < end), 4 * HOUR).otherwise(5 * HOUR)


def rollovers_crossed(entry: Column, exit_: Column, hour: int = 17) -> Column:
    """Boundaries at 17:00 New York in (entry, exit], weekends counted, UTC epochs. Day arithmetic on the
    local clock: after a change of clocks inside the hold the boundary stays at 17:00."""
    night = lambda t: day_number(new_york(t) - hour * HOUR)
    return F.when(exit_ <= entry, 0).otherwise(night(exit_) - night(entry)).cast("long")


def nights_between(start: Column, end: Column, offset: Column) -> Column:
    """Server dates crossed at an offset in (fractional) hours; 0 if end is not after start."""
    at = lambda t: day_number(F.floor(t + offset * HOUR))
    return F.when(end <= start, 0).otherwise(at(end) - at(start)).cast("long")


def server_day_bounds(moment: Column, offset: Column) -> tuple[Column, Column]:
    """UTC epochs [start, end) of the server's day."""
    start = (day_number(F.floor(moment + offset * HOUR)) * DAY - offset * HOUR).cast("long")
    return start, start + DAY


def offset_is_plausible(offset: Column) -> Column:
    return offset.between(-12, 14)
