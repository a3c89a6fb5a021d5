"""Labels that the studies group by. The label texts are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def delay_severity(delay: Column) -> Column:
    return (
        F.when(delay <= 0, "early_or_on_time")
        .when(delay <= 30, "moderate_1_30")
        .when(delay <= 180, "severe_31_180")
        .otherwise("extreme_over_180")
    )


def route_volume_group(n: Column) -> Column:
    n = F.coalesce(n, F.lit(0))
    return (
        F.when(n < 100, "low_lt_100").when(n < 1000, "medium_100_999").otherwise("high_1000_plus")
    )


def layover_bucket(n: Column) -> Column:
    return F.when(n < 60, "45_59").when(n < 90, "60_89").when(n < 120, "90_119").otherwise("120_180")


def layover_class(n: Column) -> Column:
    return (
        F.when(n < 60, "short_45_59").when(n < 120, "medium_60_119").otherwise("long_120_180")
    )


def cohort_size_bucket(n: Column) -> Column:
    return F.when(n < 100, "30_99").when(n < 500, "100_499").otherwise("500_plus")


def severe_freq_bucket(share: Column) -> Column:
    return (
        F.when(share < 0.10, "under_10_percent")
        .when(share < 0.20, "10_20_percent")
        .otherwise("over_20_percent")
    )


def horizon_bucket(date: Column, reference: Column) -> Column:
    """Days ahead as a label; null for dates in the past."""
    days = F.datediff(date, reference)
    return (
        F.when(days < 0, None)
        .when(days <= 14, "near_term")
        .when(days <= 60, "approximately_30_days")
        .when(days <= 135, "approximately_90_days")
        .otherwise("approximately_180_days")
    )


def delay_outlier(delay: Column) -> Column:
    return F.coalesce(F.abs(delay) > 1440, F.lit(False))


def winsorize(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))
