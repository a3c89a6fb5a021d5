"""Clock, calendar and weekday-mask expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440


def hhmm_number(text: Column) -> Column:
    """Integer HHMM from text; goes through double so '1530.00' is accepted."""
    return F.round(F.nullif(F.trim(text), F.lit("")).try_cast("double")).try_cast("int")


def on_clock(number: Column) -> Column:
    """Is an HHMM number a time of day? 2400 is one; null is not."""
    return F.coalesce((number.between(0, 2359) & (number % 100 < 60)) | (number == 2400), F.lit(False))


def clock_minutes(number: Column) -> Column:
    """Minutes after midnight of an HHMM number, 2400 meaning 0. Only meaningful where ``on_clock``."""
    hours = F.floor(number / 100).cast("int")
    return F.when(number == 2400, 0).otherwise(hours * 60 + number % 100).cast("int")


def hhmm_valid(text: Column) -> Column:
    return on_clock(hhmm_number(text))


def hhmm_minutes(text: Column) -> Column:
    return clock_minutes(hhmm_number(text))


def nullable_hhmm(text: Column) -> Column:
    return F.when(hhmm_valid(text), hhmm_minutes(text))


def minutes_text(minutes: Column, sep: str = "") -> Column:
    hours = F.floor(minutes / 60).cast("int").cast("string")
    rest = (minutes % 60).cast("int").cast("string")
    return F.concat(F.lpad(hours, 2, "0"), F.lit(sep), F.lpad(rest, 2, "0"))


def clock_text_minutes(text: Column) -> Column:
    """'HH:mm' (or with zero seconds) to minutes; anything else is null."""
    ok = text.rlike(r"\A([01]\d|2[0-3]):[0-5]\d(:00(\.0+)?)?\z")
    parts = F.split(text, ":")
    return F.when(ok, parts[0].try_cast("int") * 60 + parts[1].try_cast("int"))


def time_bucket(minutes: Column) -> Column:
    return (
        F.when(minutes < 360, "overnight")
        .when(minutes < 720, "morning")
        .when(minutes < 1080, "afternoon")
        .otherwise("evening")
    )


def circular_minutes(a: Column, b: Column) -> Column:
    """Shortest way around the clock between two minutes; null outside 0..1439."""
    gap = F.abs(a - b)
    return F.when(a.between(0, DAY - 1) & b.between(0, DAY - 1), F.least(gap, F.lit(DAY) - gap))


def iso_weekday(date: Column) -> Column:
    return (F.weekday(date) + 1).cast("int")


def weekday_bit(date: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.weekday(date))


def mask_includes(mask: Column, iso_dow: Column) -> Column:
    """Bit test; null when the mask or the weekday is out of its domain."""
    bit = F.call_function("shiftleft", F.lit(1), iso_dow - 1)
    inside = mask.between(0, 127) & iso_dow.between(1, 7)
    return F.when(inside, mask.bitwiseAND(bit) != 0)


def days_of_week_between(first: Column, last: Column, iso_dow: Column) -> Column:
    """How often a weekday occurs in [first, last], without listing the days."""
    offset = F.pmod(iso_dow - 1 - F.weekday(first), F.lit(7))
    return F.floor((F.datediff(last, first) + 7 - offset) / 7).cast("int")


def week_start(date: Column) -> Column:
    return F.date_sub(date, F.weekday(date))


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .otherwise("fall")
    )


def subtract_months(date: Column, months: int | Column) -> Column:
    """Calendar months back with the month end clamped."""
    return F.add_months(date, -F.lit(months) if isinstance(months, int) else -months)


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Struct(minutes, overnight): forward on one day, or evening to next noon at the latest."""
    same_day = end >= start
    overnight = (start >= 18 * 60) & (end <= 12 * 60)
    minutes = F.when(same_day, end - start).when(overnight, DAY - start + end)
    return F.struct(
        minutes.cast("int").alias("minutes"),
        F.coalesce(~same_day & overnight, F.lit(False)).alias("overnight"),
    )
