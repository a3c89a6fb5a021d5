"""Batch flight lookups: a key table against dated records or validity periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaycohorts.functions import clock, codes
from delaycohorts.operators.schedules import month_bins
from delaycohorts.session import materialize

SEGMENT = ("origin", "destination", "crs_departure_minutes", "crs_arrival_minutes")


def check_keys(keys: DataFrame) -> DataFrame:
    """Normalised keys plus ``reason`` (null when the key is usable)."""
    carrier = codes.norm_code(F.col("carrier"))
    number = F.trim(F.col("flight_number"))
    day = F.when(F.col("flight_date").rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.col("flight_date").try_cast("date"))
    code = lambda c: codes.norm_code(F.col(c))
    bad_code = lambda c: F.col(c).isNotNull() & ~code(c).rlike(r"\A\p{L}{3}\z")
    minute = F.col("departure_minutes")
    reason = (
        F.when(F.coalesce(carrier, F.lit("")) == "", "carrier_missing")
        .when(F.coalesce(number, F.lit("")) == "", "number_missing")
        .when(day.isNull(), "date_format")
        .when(bad_code("origin"), "origin_code")
        .when(bad_code("destination"), "destination_code")
        .when(minute.isNotNull() & ~minute.between(0, 1439), "minutes_range")
    )
    return keys.select(
        "lookup_id", carrier.alias("q_carrier"), number.alias("q_number"), day.alias("q_date"),
        code("origin").alias("q_origin"), code("destination").alias("q_destination"),
        minute.alias("q_minutes"), reason.alias("reason"),
    )


def rejected(keys: DataFrame) -> DataFrame:
    """Lookups that cannot be answered, each with its reason."""
    return check_keys(keys).where("reason is not null").select("lookup_id", "reason")


def _optional(wanted: str, actual: str) -> Column:
    return F.col(wanted).isNull() | (F.col(wanted) == F.col(actual))


def _filters() -> Column:
    return (
        _optional("q_origin", "origin") & _optional("q_destination", "destination")
        & _optional("q_minutes", "crs_departure_minutes")
    )


def lookup_segments(keys: DataFrame, records: DataFrame, detail: Sequence[str] = ()) -> DataFrame:
    """Matching distinct segments per lookup with ``copies``, the number of equal records.

    Records are cut to the wanted flight days and collapsed before the join, so a flight day
    full of copies meets its lookups as one row. A lookup without a match keeps a row of nulls.
    """
    usable = check_keys(keys).where("reason is null")
    wanted = usable.select(
        F.col("q_carrier").alias("reporting_carrier"), F.col("q_number").alias("flight_number"),
        F.col("q_date").alias("flight_date"),
    ).distinct()
    key = ["reporting_carrier", "flight_number", "flight_date"]
    part = records.join(wanted, key, "left_semi")
    distinct = part.groupBy(*key, *SEGMENT, *detail).agg(F.count("*").alias("copies"))
    same = (
        (F.col("q_carrier") == F.col("reporting_carrier")) & (F.col("q_number") == F.col("flight_number"))
        & (F.col("q_date") == F.col("flight_date"))
    )
    return usable.join(distinct, same & _filters(), "left").select(
        "lookup_id", "q_date", *SEGMENT, *detail, "copies"
    )


def period_segments(keys: DataFrame, periods: DataFrame) -> DataFrame:
    """Segments per lookup according to validity periods, met month by month."""
    day = F.col("q_date")
    inside = day.between(F.col("valid_from"), F.col("valid_to")) & clock.mask_includes(
        F.col("weekday_mask"), clock.iso_weekday(day)
    )
    same = (
        (F.col("q_carrier") == F.col("reporting_carrier")) & (F.col("q_number") == F.col("flight_number"))
        & (F.trunc("q_date", "MM") == F.col("month_bin"))
    )
    usable = check_keys(keys).where("reason is null")
    return usable.join(month_bins(periods), same & inside & _filters(), "left").select(
        "lookup_id", "q_date", *SEGMENT, F.when(F.col("origin").isNotNull(), F.lit(1)).cast("bigint").alias("copies")
    )


def classify(segments: DataFrame, detail: Sequence[str] = ()) -> DataFrame:
    """One row per lookup: class, count and the ordered distinct segments of that flight day."""
    item = F.when(
        F.col("origin").isNotNull(),
        F.struct("crs_departure_minutes", "crs_arrival_minutes", "origin", "destination", *detail, "copies"),
    )
    grouped = segments.groupBy("lookup_id", "q_date").agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("match_count"),
        F.array_sort(F.collect_list(item)).alias("segments"),
    )
    return _labelled(grouped.withColumnRenamed("q_date", "flight_date"))


def _labelled(grouped: DataFrame) -> DataFrame:
    n = F.col("match_count")
    label = F.when(n == 0, "no_match").when(n == 1, "unique_match").otherwise("multiple_segments")
    return grouped.select("lookup_id", "flight_date", label.alias("classification"), n, "segments")


def lookup_flights(keys: DataFrame, records: DataFrame, detail: Sequence[str] = ()) -> DataFrame:
    """What ``classify`` makes of ``lookup_segments``, without a row per lookup and segment.

    The segments of a flight day are listed and sorted once; a lookup meets the list as one row and keeps what its filters
    let through. Only a ``lookup_id`` asked more than once on a date puts its lists together.
    """
    usable = check_keys(keys).where("reason is null")
    ask = F.struct(*[c for c in usable.columns if c not in ("lookup_id", "q_date", "reason")])
    asked = usable.groupBy("lookup_id", "q_date").agg(F.collect_list(ask).alias("_asks"))
    asks = materialize(asked.select("lookup_id", "q_date", F.size("_asks").alias("_n"), F.explode("_asks").alias("_a")).select(
        "lookup_id", "q_date", "_n", "_a.*"
    ))
    key = {"reporting_carrier": "q_carrier", "flight_number": "q_number", "flight_date": "q_date"}
    wanted = asks.select(*[F.col(q).alias(c) for c, q in key.items()]).distinct()
    distinct = records.join(wanted, [*key], "left_semi").groupBy(*key, *SEGMENT, *detail).agg(F.count("*").alias("copies"))
    fields = ("crs_departure_minutes", "crs_arrival_minutes", "origin", "destination", *detail, "copies")
    days = materialize(distinct.groupBy(*[F.col(c).alias(q) for c, q in key.items()]).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_day")
    ))
    same = lambda q, actual: F.col(q).isNull() | (F.col(q) == actual)
    fits = lambda s: same("q_origin", s["origin"]) & same("q_destination", s["destination"]) & same("q_minutes", s["crs_departure_minutes"])

    def met(some: DataFrame) -> DataFrame:
        found = some.join(days, [*key.values()], "left").withColumn("_fits", F.coalesce(F.filter("_day", fits), F.array()))
        return found.select(
            "lookup_id", F.col("q_date").alias("flight_date"),
            F.aggregate("_fits", F.lit(0).cast("bigint"), lambda n, s: n + s["copies"]).alias("match_count"),
            F.filter("_fits", lambda s: s["origin"].isNotNull()).alias("segments"),
        )

    again = met(asks.where("_n > 1")).groupBy("lookup_id", "flight_date").agg(
        F.sum("match_count").alias("match_count"), F.array_sort(F.flatten(F.collect_list("segments"))).alias("segments")
    )
    return _labelled(met(asks.where("_n = 1")).unionByName(again))


def lookup_periods(keys: DataFrame, periods: DataFrame) -> DataFrame:
    return classify(period_segments(keys, periods))


def segment_rows(results: DataFrame) -> DataFrame:
    """Lookup results as flat rows with the position of each segment."""
    return results.select(
        "lookup_id", "classification", "match_count", F.posexplode_outer("segments").alias("position", "s")
    ).select("lookup_id", "classification", "match_count", "position", "s.*")
