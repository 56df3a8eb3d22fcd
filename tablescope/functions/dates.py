"""Date expressions: closed-list lenient parsing and period labels."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import DATE_FORMATS, EXCEL_ERRORS, WHITESPACE


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Shape each layout needs (a superset of what it accepts). A failed parse is
# costly, so a value only tries the layouts whose shape it has.
_D2 = r"[0-9]{2}"
LAYOUT_SHAPES = {
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]": rf"^[0-9]{{4}}-{_D2}-{_D2}T",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]": rf"^[0-9]{{4}}-{_D2}-{_D2} {_D2}:{_D2}:{_D2}",
    "yyyy-MM-dd HH:mm": rf"^[0-9]{{4}}-{_D2}-{_D2} {_D2}:{_D2}$",
    "yyyy-MM-dd": rf"^[0-9]{{4}}-{_D2}-{_D2}$",
    "yyyy/MM/dd[ HH:mm:ss]": rf"^[0-9]{{4}}/{_D2}/{_D2}",
    "yyyyMMdd": r"^[0-9]{8}$",
    "M/d/yyyy[ H:mm[:ss]]": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    "d/M/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "M-d-yyyy": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$",
    "d-M-yyyy": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$",
    "M.d.yyyy": r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$",
    "d.M.yyyy": r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$",
    "d MMM yyyy": r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}$",
    "yyyy-MM": rf"^[0-9]{{4}}-{_D2}$",
}


def to_timestamp_mixed(col, formats=DATE_FORMATS) -> Column:
    """Text → TIMESTAMP, trying each layout in order per value; bad → NULL."""
    text = F.trim(_c(col).cast("string"), F.lit(WHITESPACE))
    tries = []
    for f in formats:
        attempt = F.try_to_timestamp(text, F.lit(f))
        shape = LAYOUT_SHAPES.get(f)
        tries.append(F.when(text.rlike(shape), attempt) if shape else attempt)
    parsed = F.coalesce(*tries)
    ok = text.isNotNull() & (text != "") & ~text.isin(EXCEL_ERRORS)
    if all(f in LAYOUT_SHAPES for f in formats):
        # one test turns most texts away before the shapes are tried one by one
        ok = ok & text.rlike("|".join(f"(?:{LAYOUT_SHAPES[f]})" for f in formats))
    return F.when(ok, parsed)


def as_timestamp(col, dtype) -> Column:
    """Timestamp view of a column of any physical type."""
    from pyspark.sql import types as T
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return _c(col).cast("timestamp")
    if isinstance(dtype, T.StringType):
        return to_timestamp_mixed(col)
    return F.lit(None).cast("timestamp")


def is_date_text(col) -> Column:
    """Header-scorer date test: ≥ 6 characters, not all digits, parses."""
    text = F.trim(_c(col).cast("string"), F.lit(WHITESPACE))
    return (F.length(text) >= 6) & ~text.rlike(r"^[0-9]+$") & to_timestamp_mixed(text).isNotNull()


def has_time_of_day(ts, seconds: bool = True) -> Column:
    t = _c(ts)
    cond = (F.hour(t) != 0) | (F.minute(t) != 0)
    if seconds:
        cond = cond | (F.second(t) != 0)
    return cond


def week_end_sunday(ts) -> Column:
    """The Sunday on or after the day (weekly bins that end on Sunday)."""
    d = F.to_date(_c(ts))
    return F.date_sub(F.next_day(d, "Sun"), F.when(F.dayofweek(d) == 1, 7).otherwise(0))


def monday_week_number(d) -> Column:
    """Week of the year, Monday-first, days before the first Monday in week 0."""
    d = _c(d)
    dow_mon0 = (F.dayofweek(d) + 5) % 7
    return F.floor((F.dayofyear(d) + 6 - dow_mon0) / 7)


def period_start(ts, granularity: str) -> Column:
    """Bin end date of a timestamp: month end, Sunday week end, or the day."""
    t = _c(ts)
    if granularity == "month":
        return F.last_day(t)
    if granularity == "week":
        return week_end_sunday(t)
    return F.to_date(t)


def period_label(day, granularity: str) -> Column:
    """Label of a bin end date: ``yyyy-MM``, ``yyyy-WW`` (Monday weeks), ``yyyy-MM-dd``."""
    d = _c(day)
    if granularity == "month":
        return F.date_format(d, "yyyy-MM")
    if granularity == "week":
        return F.concat(F.date_format(d, "yyyy"), F.lit("-"),
                        F.lpad(monday_week_number(d).cast("string"), 2, "0"))
    return F.date_format(d, "yyyy-MM-dd")


def granularity_for_span(days: int) -> str:
    """Bin width from the span in whole days: > 90 month, > 14 week, else day."""
    if days > 90:
        return "month"
    if days > 14:
        return "week"
    return "day"


def span_days(min_ts, max_ts) -> Column:
    return F.floor((F.unix_micros(_c(max_ts)) - F.unix_micros(_c(min_ts))) / F.lit(86_400_000_000))
