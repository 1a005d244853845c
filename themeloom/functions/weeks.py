"""ISO weeks and look-back windows as date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.schema import WINDOW_WEEKS


def week_of(day: Column) -> Column:
    """Monday of the ISO week of a date."""
    return F.date_trunc("week", day).cast("date")


def try_parse_iso_week(text: Column) -> Column:
    """``YYYY-Www`` → struct(week_start, week_end), null where there is no such week."""
    pattern = r"^\s*(\d+)\s*-W\s*(\d+)\s*$"
    year = F.regexp_extract(F.upper(text), pattern, 1).try_cast("int")
    week = F.regexp_extract(F.upper(text), pattern, 2).try_cast("int")
    possible = year.between(1, 9999) & week.between(1, 53)
    first_monday = week_of(F.make_date(F.when(possible, year), F.lit(1), F.lit(4)))
    monday = F.date_add(first_monday, 7 * (week - 1))
    exists = possible & (F.extract(F.lit("YEAROFWEEK"), monday) == year)
    return F.when(
        exists, F.struct(monday.alias("week_start"), F.date_add(monday, 6).alias("week_end"))
    )


def parse_iso_week(text: Column) -> Column:
    """As ``try_parse_iso_week``, failing the query on a malformed or missing week."""
    parsed = try_parse_iso_week(text)
    problem = F.concat(F.lit("invalid ISO week '"), text, F.lit("', expected YYYY-Www"))
    return F.coalesce(parsed, F.raise_error(problem))


def iso_week_of(day: Column) -> Column:
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), day).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )


def window_start_of(week_start: Column, weeks: int = WINDOW_WEEKS) -> Column:
    return F.date_sub(week_start, 7 * (weeks - 1))


def week_end_of(week_start: Column) -> Column:
    return F.date_add(week_start, 6)


def review_window(week_start: Column, weeks: int = WINDOW_WEEKS) -> Column:
    """Monday → struct(window_start, window_end): ``weeks`` whole weeks up to that week's Sunday."""
    return F.struct(
        window_start_of(week_start, weeks).alias("window_start"),
        week_end_of(week_start).alias("window_end"),
    )


def report_weeks_of(day: Column, weeks: int = WINDOW_WEEKS) -> Column:
    """Mondays of all report weeks whose window contains the date."""
    first = week_of(day)
    return F.sequence(first, F.date_add(first, 7 * (weeks - 1)), F.expr("interval 7 days"))
