"""Availability texts and calendar dates, as Column functions; today is always given."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, plain

# The ways in which sources write dates, and the words that mean now.
ISO = r"(?U)\b(\d{4})-(\d{2})-(\d{2})\b"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
NAMED = r"(?iU)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s*(\d{4}))?"
NUMERIC = r"(?U)\b(\d{1,2})[/-](\d{1,2})(?:[/-](\d{2,4}))?\b"
NOW = r"(?iU)\b(now|immediate(?:ly)?|today|available\s+now|vacant)\b"
GRACE_DAYS = 60


def as_date(year: Column, month: Column, day: Column) -> Column:
    """The date, null if there is no such day. Numbers have 4, 2 and 2 digits at most."""
    return let(year, lambda y: F.when(y >= 1, F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), month.cast("string"), F.lit("-"), day.cast("string")).try_cast("date")))


def infer_year(month: Column, day: Column, today: Column) -> Column:
    """This year, or the next if the day is more than GRACE_DAYS past; never the last."""
    this = F.year(today)
    return F.when(F.datediff(today, as_date(this, month, day)) > GRACE_DAYS, this + 1).otherwise(this)


def part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def parse_available(text: Column, today: Column | date) -> Column:
    """struct<date string, now boolean>: the first of an ISO date, a month's name with a day, and a numeric date that is a day; else words for now."""
    today = F.lit(today) if isinstance(today, date) else today

    def parse(s: Column) -> Column:
        iso = as_date(part(s, ISO, 1), part(s, ISO, 2), part(s, ISO, 3))
        month = ((F.instr(F.lit(MONTHS), F.substring(F.lower(F.regexp_extract(s, NAMED, 1)), 1, 3)) + 2) / 3).cast("int")
        named = let(F.struct(month.alias("m"), part(s, NAMED, 2).alias("d")), lambda x: as_date(F.coalesce(part(s, NAMED, 3), infer_year(x["m"], x["d"], today)), x["m"], x["d"]))
        year = let(part(s, NUMERIC, 3), lambda y: F.when(y < 100, y + 2000).otherwise(y))
        numeric = let(F.struct(part(s, NUMERIC, 1).alias("m"), part(s, NUMERIC, 2).alias("d")), lambda x: as_date(F.coalesce(year, infer_year(x["m"], x["d"], today)), x["m"], x["d"]))
        day = F.coalesce(F.when(s.rlike(ISO), iso), F.when(s.rlike(NAMED), named), F.when(s.rlike(NUMERIC), numeric))
        return let(day, lambda d: F.struct(F.date_format(d, "yyyy-MM-dd").alias("date"), (d.isNull() & F.coalesce(s.rlike(NOW), F.lit(False))).alias("now")))

    return let(plain(text), parse)


def pacific_date(millis: Column) -> Column:
    """The day in Los Angeles at a number of milliseconds; null for none or 0. The session's time zone is UTC."""
    return F.when(millis != 0, F.to_date(F.from_utc_timestamp(F.timestamp_millis(millis.cast("long")), "America/Los_Angeles")))


def day_label(day: Column) -> Column:
    return F.date_format(day, "MMM d, yyyy")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM yy")


def is_stale(scraped_at: Column, now: Column, hours: int = 48) -> Column:
    """More than so many hours old; a time that isn't one is not stale."""
    return F.coalesce(F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(scraped_at.try_cast("timestamp")) > hours * 3600, F.lit(False))
