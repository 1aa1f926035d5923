"""Dates, times and durations as column expressions. The session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss")


def pad_clock(s: Column) -> Column:
    """TS1: hours, minutes and seconds of two digits each."""
    return F.array_join(F.transform(F.split(s, ":"), lambda p: F.lpad(p, 2, "0")), ":")


def parse_any(s: Column, formats=FORMATS) -> Column:
    """TS2: the first format that fits, row by row; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def combine(d: Column, t: Column) -> Column:
    """TS3: date and clock time as one timestamp, to the second; null if either is missing or bad."""
    return F.when(t.isNotNull(), F.date_trunc("second", F.try_to_timestamp(F.concat_ws(" ", d, t), F.lit("yyyy-MM-dd HH:mm:ss")))).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds since 1970, of timestamps with and without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def shift(ts: Column, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    """TS5: a fixed correction, as of a device or a period."""
    return ts + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes))


def corrected(df: DataFrame, corrections: DataFrame, keys: list[str], ts: str, since: str, minutes: str) -> DataFrame:
    """TS5: ``ts`` moved by the minutes of its device's last correction that began at or before it; adds both of its columns.

    ``corrections``: a row per device (``keys``) and period. Times before a device's first correction stay as they are.
    """
    from ..operators.joins import last_before

    found = last_before(df, corrections, keys, ts, since, [since, minutes])
    return found.withColumn(ts, F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(F.col(minutes), F.lit(0)).cast("int")))


def clock_24(s: Column) -> Column:
    """TS6: 12-hour to 24-hour clock."""
    return F.date_format(F.try_to_timestamp(s, F.lit("hh:mm:ss a")), "HH:mm:ss")


def unswap_february(d: Column, as_of: Column) -> Column:
    """TS7: a future date on a 2nd after February had day and month confused: it was in February."""
    swapped = F.try_to_date(F.concat_ws("-", F.year(d), F.lit("02"), F.lpad(F.month(d).cast("string"), 2, "0")), "yyyy-MM-dd")
    return F.when((F.day(d) == 2) & (F.month(d) > 2) & (d > as_of), swapped).otherwise(d)


def with_year(d: Column, year: Column) -> Column:
    """The same day in another year; null where there is none."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.date_format(d, "MM-dd")), "yyyy-MM-dd")


def unfuture(d: Column, as_of: Column, modal_year: Column, latest: int = 2024) -> Column:
    """TS8: a future date moves to ``latest`` if its group's modal year is later, else to the year before the modal one."""
    return F.when(d > as_of, with_year(d, F.when(modal_year > latest, latest).otherwise(modal_year - 1))).otherwise(d)


def data_date(ts: Column, until: int = 5) -> Column:
    """TS9: before ``until`` o'clock a time still belongs to the day before."""
    return F.to_date(ts - F.make_dt_interval(F.lit(0), F.lit(until)))


def period(hour: Column) -> Column:
    """TS10."""
    return F.when(hour < 5, "early_morning").when(hour < 12, "morning").when(hour < 17, "afternoon").when(hour < 22, "evening").otherwise("night")


def is_weekend(ts: Column, days: tuple[int, ...] = (5, 6)) -> Column:
    """TS11: Monday is 0; which days are the weekend is the study's choice."""
    return F.weekday(ts).isin(*days).cast("int")


def duration_minutes(s: Column, on_error: float | None = None) -> Column:
    """TS13: minutes of "N days HH:MM:SS", "N days MM:SS", "N days H", "HH:MM:SS", "MM:SS" or a number of minutes."""
    part = lambda p, i: F.regexp_extract(s, p, i).cast("double")
    dhms, dms, dh = r"^(\d+) days? (\d+):(\d+):(\d+(?:\.\d+)?)$", r"^(\d+) days? (\d+):(\d+(?:\.\d+)?)$", r"^(\d+) days? (\d+)$"
    hms, ms = r"^(\d+):(\d+):(\d+(?:\.\d+)?)$", r"^(\d+):(\d+(?:\.\d+)?)$"
    return (
        F.when(s.isNull(), F.lit(None))
        .when(s.rlike(dhms), part(dhms, 1) * 1440 + part(dhms, 2) * 60 + part(dhms, 3) + part(dhms, 4) / 60)
        .when(s.rlike(dms), part(dms, 1) * 1440 + part(dms, 2) + part(dms, 3) / 60)
        .when(s.rlike(dh), part(dh, 1) * 1440 + part(dh, 2) * 60)
        .when(s.rlike(hms), part(hms, 1) * 60 + part(hms, 2) + part(hms, 3) / 60)
        .when(s.rlike(ms), part(ms, 1) + part(ms, 2) / 60)
        .otherwise(F.coalesce(s.try_cast("double"), F.lit(on_error)))
    )


def swapped_date(d: Column) -> Column:
    """TS14: day and month exchanged, null where that is no date."""
    return F.try_to_date(F.date_format(d, "yyyy-dd-MM"), "yyyy-MM-dd")


def month_year(s: Column) -> Column:
    """TS15: "Aug-97" as the 15th of that month; years above 50 are of the last century."""
    yy = F.regexp_extract(s, r"^[A-Za-z]{3}-(\d{2})$", 1)
    mon = F.array_position(F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()]), F.lower(F.substring(s, 1, 3)))
    n = yy.try_cast("int")
    return F.when((yy != "") & (mon > 0), F.make_date(F.when(n > 50, 1900 + n).otherwise(2000 + n), mon.cast("int"), F.lit(15)))
