"""Dates as columns: tolerant parsing, due times, work windows in a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import col, text


def parsed(x) -> Column:
    """RFC 3339, RFC 2822, plain date-times, dates, or epoch seconds or milliseconds; null for all else."""
    t = F.trim(text(x))
    mail = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\bGMT\b|\bUTC?\b", "+0000")
    number = F.when(t.rlike(r"^-?[0-9]{1,18}$"), t.cast("long"))
    return F.coalesce(
        F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(t)),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.timestamp_seconds(F.when(number > 100_000_000_000, F.floor(number / 1000)).otherwise(number)),
    )


def plus_hours(t, hours) -> Column:
    return F.timestamp_micros(F.unix_micros(col(t)) + (hours * 3_600_000_000).cast("long"))


def next_due(t, tier, kind="crawl") -> Column:
    hours = F.lit(24)
    for k, h in V.TIER_HOURS.items():
        hours = F.when(col(tier) == k, h).otherwise(hours)
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return plus_hours(t, F.when(kind == "closed_check", V.CLOSED_CHECK_HOURS).otherwise(hours))


def in_work_window(t, zone, first: int = 9, last: int = 17) -> Column:
    """Monday to Friday, from the first hour until before the last, in the zone."""
    local = F.from_utc_timestamp(col(t), zone)  # the zone is a name or a column
    return (F.weekday(local) < 5) & (F.hour(local) >= first) & (F.hour(local) < last)


def next_work_window(t, zone, first: int = 9, last: int = 17) -> Column:
    """The time itself inside a window, else the next window's start: the first of the days ahead that is later."""
    local = F.from_utc_timestamp(col(t), zone)
    starts = F.transform(F.sequence(F.lit(0), F.lit(21)), lambda d: F.date_trunc("day", local) + F.make_interval(days=d, hours=F.lit(first)))
    ahead = F.filter(starts, lambda s: (F.weekday(s) < 5) & (s > local))
    return F.when(in_work_window(t, zone, first, last), col(t)).otherwise(F.to_utc_timestamp(F.array_min(ahead), zone))


def zone_of(countries) -> Column:
    """The zone of the first country that has one, else UTC."""
    table = F.create_map(*[F.lit(x) for pair in V.COUNTRY_ZONES.items() for x in pair])
    known = F.filter(F.transform(col(countries), lambda c: F.try_element_at(table, F.upper(c))), lambda z: z.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit("UTC"))


def tolerant(x) -> Column:
    """A timestamp of ISO or database text: a blank for the T, any number of decimals, an offset of hours only; null for all else."""
    t = F.regexp_replace(F.trim(text(x)), r"^(\d{4}-\d{2}-\d{2}) (?=\d)", "$1T")
    t = F.regexp_replace(F.regexp_replace(t, r"(\.\d{3})\d+", "$1"), r"(T.*[+-]\d{2})$", "$1:00")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t))


def local_day(t, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(col(t), zone))


def age_group(since, now: Column, zone: str | None = None) -> Column:
    """Today, This week (seven times 24 hours), Older; null is Older. With a zone Today begins at its midnight, else 24 hours ago."""
    days = (F.unix_micros(now) - F.unix_micros(col(since))) / 86_400_000_000
    return F.when(days < 1 if zone is None else local_day(since, zone) >= local_day(now, zone), "Today").when(days < 7, "This week").otherwise("Older")


def greeting(t, zone: str) -> Column:
    """How a reader is met at this time in the zone."""
    hour = F.hour(F.from_utc_timestamp(col(t), zone))
    return F.when(hour < 5, "Working late").when(hour < 12, "Good morning").when(hour < 18, "Good afternoon").when(hour < 24, "Good evening")


def follow_up_due(sent_at, replied, followed, now: Column, days: int = 6) -> Column:
    return (F.unix_micros(col(sent_at)) <= F.unix_micros(now) - days * 86_400_000_000) & ~col(replied) & ~col(followed)
