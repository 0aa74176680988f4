"""Dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^(\d{2})-(\d{2})-(\d{4})$"
YEAR_S = 365.25 * 86_400


def _parts(text: Column) -> tuple[Column, Column, Column]:
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    part = lambda k: F.try_to_number(F.regexp_extract(trimmed, PATTERN, k), F.lit("9999")).cast("int")
    return part(1), part(2), part(3)


def rolled_date(text: Column) -> Column:
    """The date of dd-MM-yyyy with days and months beyond their end carried on; null for another form."""
    day, month, year = _parts(text)
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)


def warranty_code(published: Column, now: Column) -> Column:
    """dlp within a year, maint within three, else record; also record for odd or future dates. `now` is a timestamp."""
    day, month, _ = _parts(published)
    age = (F.unix_micros(now) / 1e6 - F.unix_date(rolled_date(published)) * 86_400.0) / YEAR_S
    sound = month.between(1, 12) & day.between(1, 31) & (age >= 0)
    return F.when(sound & (age <= 1), "dlp").when(sound & (age <= 3), "maint").otherwise("record")


def sort_stamp(published: Column) -> Column:
    """Days since 1970 of dd-MM-yyyy, 0 for another form."""
    return F.coalesce(F.unix_date(rolled_date(published)), F.lit(0))


def iso_date(text: Column) -> Column:
    """The date of yyyy-MM-dd, or null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def event_time(last_seen: Column, captured: Column, created: Column) -> Column:
    """When an event counts as seen: last seen, else captured, else created, leaving out NaN."""
    sound = lambda c: F.when(~F.isnan(c), c)
    return F.coalesce(sound(last_seen), sound(captured), created)


def age_days(then_s: Column, now_s: Column) -> Column:
    """Days since an epoch second, never negative."""
    return F.greatest(F.lit(0.0), now_s - then_s) / 86_400.0


def in_kolkata(ts: Column) -> Column:
    """Local wall-clock text of a UTC timestamp."""
    return F.date_format(F.from_utc_timestamp(ts, "Asia/Kolkata"), "dd MMM yyyy HH:mm")


def epoch_seconds(millis: Column) -> Column:
    """Seconds of epoch milliseconds."""
    return millis.cast("double") / 1000


def epoch_millis(seconds: Column) -> Column:
    """Whole epoch milliseconds of seconds, half a millisecond upwards."""
    return F.floor(seconds * 1000 + 0.5)


def iso_text(seconds: Column) -> Column:
    """UTC text such as 2024-01-02T03:04:05.678Z of epoch seconds, in a session whose time zone is UTC."""
    return F.date_format(F.timestamp_millis(epoch_millis(seconds)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def whole32(value: Column) -> Column:
    """A number cut to its whole part in 32 bits, as a bitwise or with zero does; 0 for what is no number."""
    cut = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)
    low = F.pmod(F.when(cut < 0, F.ceil(cut)).otherwise(F.floor(cut)), F.lit(1 << 32))
    return F.coalesce(F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low), F.lit(0)).cast("int")


def touched(last_s: Column, now_s: Column, least_hours: float = 24.0) -> Column:
    """When something was used last, after a use now: written anew only if that is at least a day on, so that reads cost few writes."""
    return F.when(now_s - F.coalesce(last_s, F.lit(0.0)) < least_hours * 3600, last_s).otherwise(now_s)
