"""Date and time Columns. Nothing here reads the clock or the session time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, date10, text, trim_ws

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def as_date(c) -> Column:
    """Calendar date of a time text, null when it is not one."""
    return F.try_to_date(date10(c), "yyyy-MM-dd")


def date_text(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def shift_date(c, days: int) -> Column:
    return date_text(F.date_add(as_date(c), days))


#: fixed value: the input format of times, trimmed
DATE_TIME = r"^(\d{4})-(\d{2})-(\d{2})(?:[ T](\d{2}):(\d{2})(?::(\d{2}))?)?"


def china_time_ms(c) -> Column:
    """UTC+8 wall-clock text to epoch milliseconds; the time part is optional."""
    src = trim_ws(text(c))
    # one match gives all parts; those that are missing come out empty
    parts = F.split(F.regexp_replace(src, f"(?s){DATE_TIME}.*$", "$1,$2,$3,$4,$5,$6"), ",")
    y, mo, d, h, mi, s = [F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(6)]
    # months and days beyond their range roll over
    first = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), mo - 1)
    days = F.datediff(first, F.lit("1970-01-01").cast("date")) + d - 1
    ms = days.cast("bigint") * DAY_MS + (h.cast("bigint") - 8) * HOUR_MS + mi.cast("bigint") * 60_000 \
        + s.cast("bigint") * 1000
    return F.when(src.rlike(DATE_TIME), ms)


def at_day_end(date_to: str | None) -> str | None:
    """A bare date as upper bound covers its whole day."""
    if date_to and len(date_to) == 10:
        return date_to + " 23:59:59"
    return date_to
