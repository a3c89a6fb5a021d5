"""Sets of days as bitmaps: one row per key and year, the year's days in six 64-bit words.

A schedule of millions of dated rows becomes one row per flight signature and year. Claims of validity
periods are such words too, computed from their bounds and weekday mask without listing a day. What one
side has and the other lacks is a bitwise and-not; counts are bit counts; dates are listed only for rows
that a result reports. Copies of a row are one bit, and rows without a date are in no set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaycohorts.schema import SIGNATURE

WORDS = 6


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


# every seventh bit, by the place of the first one
_SEVENTHS = [_signed(sum(1 << i for i in range(first, 64, 7))) for first in range(7)]


def words(prefix: str) -> list[str]:
    return [f"{prefix}{k}" for k in range(WORDS)]


def _left(value: Column, places: Column) -> Column:
    return F.call_function("shiftleft", value, places.cast("int"))


def both(a: str, b: str) -> list[Column]:
    """Days in both sets, word by word."""
    return [F.col(x).bitwiseAND(F.col(y)) for x, y in zip(words(a), words(b))]


def only(a: str, b: str) -> list[Column]:
    """Days of the first set that the second lacks."""
    return [F.col(x).bitwiseAND(F.bitwise_not(F.col(y))) for x, y in zip(words(a), words(b))]


def named(columns: list[Column], prefix: str) -> list[Column]:
    return [c.alias(n) for c, n in zip(columns, words(prefix))]


def size(columns: list[Column]) -> Column:
    """Days in a set."""
    total = F.bit_count(columns[0])
    for c in columns[1:]:
        total = total + F.bit_count(c)
    return total.cast("bigint")


def union(prefix: str) -> list[Column]:
    """Aggregates that unite the sets of a group; a set that is not there is empty."""
    return [F.coalesce(F.bit_or(n), F.lit(0).cast("bigint")).alias(n) for n in words(prefix)]


def of_rows(rows: DataFrame, keys: Sequence[str] = SIGNATURE, prefix: str = "b") -> DataFrame:
    """Days of dated rows per key and year; united in the map tasks already."""
    day = F.dayofyear("flight_date") - 1
    bit = _left(F.lit(1).cast("bigint"), day % 64)
    marked = rows.where("flight_date is not null").select(
        *keys, F.year("flight_date").alias("year"), *[F.when(F.floor(day / 64) == k, bit).alias(n) for k, n in enumerate(words(prefix))]
    )
    return marked.groupBy(*keys, "year").agg(*union(prefix))


def _range(first: Column, last: Column, k: int) -> Column:
    """Word k of the days first..last of a year, counted from 0."""
    low, high = F.greatest(first - 64 * k, F.lit(0)), F.least(last - 64 * k, F.lit(63))
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (63 - (high - low)).cast("int"))
    return F.when(low <= high, _left(ones, low)).otherwise(F.lit(0).cast("bigint"))


def _weekdays(mask: Column, new_year: Column, k: int) -> Column:
    """Word k of all days of a year whose weekday is in the mask; ``new_year`` is the weekday of its first day."""
    table = F.array(*[F.lit(x).cast("bigint") for x in _SEVENTHS])
    out = F.lit(0).cast("bigint")
    for weekday in range(7):
        held = mask.bitwiseAND(F.lit(1 << weekday)) != 0
        out = out.bitwiseOR(F.when(held, F.get(table, F.pmod(F.lit(weekday - 64 * k) - new_year, F.lit(7)))).otherwise(F.lit(0).cast("bigint")))
    return out


def of_periods(periods: DataFrame, keys: Sequence[str] = SIGNATURE, prefix: str = "b") -> DataFrame:
    """Days that validity periods claim, per key and year. No row per day is made.

    Periods without a bound, or with a mask outside 0 to 127, claim nothing.
    """
    years = F.sequence(F.year("valid_from"), F.year("valid_to"))
    usable = periods.where("valid_from <= valid_to and weekday_mask between 0 and 127")
    each = usable.select(*keys, "valid_from", "valid_to", "weekday_mask", F.explode(years).alias("year"))
    start = F.make_date("year", F.lit(1), F.lit(1))
    placed = each.select(
        *keys, "year", "weekday_mask", F.weekday(start).alias("new_year"), F.greatest(F.datediff("valid_from", start), F.lit(0)).alias("first"),
        F.least(F.datediff("valid_to", start), F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), start) - 1).alias("last"),
    )
    claimed = [_range(F.col("first"), F.col("last"), k).bitwiseAND(_weekdays(F.col("weekday_mask"), F.col("new_year"), k)) for k in range(WORDS)]
    return placed.select(*keys, "year", *named(claimed, prefix)).groupBy(*keys, "year").agg(*union(prefix))


def compared(claimed: DataFrame, source: DataFrame, keys: Sequence[str] = SIGNATURE) -> DataFrame:
    """Both sides in one row per key and year: words ``c`` of the claims and ``s`` of the source."""
    none = lambda prefix: [F.lit(0).cast("bigint").alias(n) for n in words(prefix)]
    left = claimed.select(*keys, "year", *named([F.col(n) for n in words("b")], "c"), *none("s"))
    right = source.select(*keys, "year", *none("c"), *named([F.col(n) for n in words("b")], "s"))
    return left.unionByName(right).groupBy(*keys, "year").agg(*union("c"), *union("s"))


def dates(rows: DataFrame, columns: list[Column], keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``flight_date`` for every day of the set; years without a day list nothing."""
    none = F.expr("cast(array() as array<int>)")

    def listed(k: int) -> Column:
        word = F.col(f"_w{k}")
        held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", word, i) == 1)
        return F.when(word != 0, F.transform(held, lambda i: i + 64 * k)).otherwise(none)

    some = rows.select(*keep, "year", *named(columns, "_w")).where(" or ".join(f"_w{k} <> 0" for k in range(WORDS)))
    day = F.explode(F.concat(*[listed(k) for k in range(WORDS)])).alias("_day")
    return some.select(*keep, "year", day).withColumn("flight_date", F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col("_day"))).drop("_day", "year")

