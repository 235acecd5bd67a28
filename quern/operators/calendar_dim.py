"""A calendar table with fiscal periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calendar_bounds(df: DataFrame, col: str) -> DataFrame:
    """One row per day, from the first of the earliest year of a date column to the last of the latest."""
    span = df.agg(F.min(F.year(col)).alias("a"), F.max(F.year(col)).alias("b")).where("a IS NOT NULL")
    return span.select(F.explode(F.sequence(F.make_date("a", F.lit(1), F.lit(1)), F.make_date("b", F.lit(12), F.lit(31)))).alias("date"))


def date_dimension(df: DataFrame, col: str, fiscal_start: int = 4) -> DataFrame:
    """The days of calendar_bounds with 27 columns of a date table. Weeks begin on Sunday; week 1 holds January 1. A fiscal year is named for the year in which it ends."""
    d = F.col("date")
    year, month, quarter, weekday = F.year(d), F.month(d), F.quarter(d), F.dayofweek(d)
    start, q_start = F.trunc(d, "year"), F.trunc(d, "quarter")
    moved = month + (13 - fiscal_start)
    fiscal_month = F.pmod(moved - 1, F.lit(12)) + 1
    fiscal_year = year if fiscal_start == 1 else year + F.floor(moved / 13)
    named = {
        "year": year,
        "year_start": start,
        "year_end": F.make_date(year, F.lit(12), F.lit(31)),
        "month_number": month,
        "month_start": F.trunc(d, "month"),
        "month_end": F.last_day(d),
        "days_in_month": F.dayofmonth(F.last_day(d)),
        "year_month_number": year * 100 + month,
        "year_month_name": F.date_format(d, "yyyy-MMM"),
        "day_number": F.dayofmonth(d),
        "day_name": F.date_format(d, "EEEE"),
        "day_name_short": F.date_format(d, "EEE"),
        "day_of_week": weekday,
        "month_name": F.date_format(d, "MMMM"),
        "month_name_short": F.date_format(d, "MMM"),
        "quarter": quarter,
        "quarter_name": F.concat(F.lit("Q"), quarter),
        "year_quarter_number": year * 10 + quarter,
        "year_quarter_name": F.concat(year, F.lit(" Q"), quarter),
        "quarter_start": q_start,
        "quarter_end": F.last_day(F.add_months(q_start, 2)),
        "week_number": F.ceil((F.dayofyear(d) + F.dayofweek(start) - 1) / 7).cast("int"),
        "week_start": F.date_sub(d, weekday - 1),
        "week_end": F.date_add(d, 7 - weekday),
        "fiscal_year": fiscal_year.cast("int"),
        "fiscal_quarter": F.ceil(fiscal_month / 3).cast("int"),
        "fiscal_month": fiscal_month.cast("int"),
    }
    return calendar_bounds(df, col).withColumns(named)
