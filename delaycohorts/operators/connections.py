"""Outbound options and replayed outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaycohorts.functions import codes
from delaycohorts.functions.transfer import Transfer

# Accepted band and the constant default of the later studies.
MIN_LAYOVER, MAX_LAYOVER, DEFAULT_LAYOVER = 45, 180, 90


def outbound_by_minute(records: DataFrame, seed: int) -> DataFrame:
    """Per date, airport and minute: the departure that comes first in hash order.

    At most 1440 rows per date and airport remain, whatever a hub holds. Any status counts.
    """
    order = codes.stable_hash(
        F.col("destination"), F.col("flight_number"), F.col("crs_departure_minutes"), str(seed)
    )
    best = F.min(F.struct(order.alias("h"), F.col("destination").alias("out_destination"),
                          F.col("flight_number").alias("out_flight_number")))
    return records.groupBy(
        F.col("flight_date").alias("out_date"), F.col("origin").alias("out_airport"),
        F.col("crs_departure_minutes").alias("out_minutes"),
    ).agg(best.alias("best"))


def hashed_default_layover(seed: int, key: list[Column]) -> Column:
    """Stable 45..180 minutes when no outbound flight exists."""
    word = F.conv(F.substring(F.sha2(F.concat_ws("|", *key, F.lit(str(seed))), 256), 1, 8), 16, 10)
    return (F.lit(MIN_LAYOVER) + word.cast("bigint") % (MAX_LAYOVER - MIN_LAYOVER + 1)).cast("int")


def connection_options(
    cases: DataFrame, records: DataFrame, seed: int = 20260810, default: str = "hashed"
) -> DataFrame:
    """Adds ``layover_minutes``, ``out_destination``, ``out_minutes`` to every case.

    Same-day departures from the arrival airport 45 to 180 minutes later, the first in hash
    order. Departures of an airport, day and hour are one row with at most 60 entries; a case asks
    at most four such hours.
    """
    minute = F.struct(F.col("best.h").alias("h"), "out_minutes", F.col("best.out_destination").alias("out_destination"))
    hours = outbound_by_minute(records, seed).groupBy("out_date", "out_airport", F.floor(F.col("out_minutes") / 60).alias("out_hour")).agg(
        F.collect_list(minute).alias("options")
    )
    base = cases.drop("layover_minutes", "out_destination", "out_minutes")
    first, last = F.col("arrival_minutes") + MIN_LAYOVER, F.col("arrival_minutes") + MAX_LAYOVER
    wanted = base.select(
        "case_id", F.col("prediction_date").alias("out_date"), F.col("destination").alias("out_airport"), first.alias("first"), last.alias("last"),
        F.explode(F.sequence(F.floor(first / 60), F.floor(last / 60))).alias("out_hour"),
    ).where("out_hour < 24")
    fits = F.filter("options", lambda o: o["out_minutes"].between(F.col("first"), F.col("last")))
    hit = wanted.join(hours, ["out_date", "out_airport", "out_hour"]).groupBy("case_id").agg(F.min(F.array_min(fits)).alias("pick"))
    if default == "hashed":
        key = [F.col("prediction_date").cast("string"), F.col("carrier"), F.col("origin"), F.col("destination")]
        fallback = hashed_default_layover(seed, key)
    else:
        fallback = F.lit(DEFAULT_LAYOVER)
    return base.join(hit, "case_id", "left").select(
        *base.columns,
        F.coalesce(F.col("pick.out_minutes") - F.col("arrival_minutes"), fallback).cast("int").alias("layover_minutes"),
        F.coalesce(F.col("pick.out_destination"), F.lit("UNKNOWN")).alias("out_destination"),
        F.coalesce(F.col("pick.out_minutes"), ((F.col("arrival_minutes") + fallback) % 1440).cast("int")).alias("out_minutes"),
        F.col("pick").isNotNull().alias("has_outbound"),
    )


def replay_outcome(
    completed: Column, delay: Column, layover: Column, draw: Column, transfer: Transfer = Transfer()
) -> Column:
    """1.0 when the flight completed and arrival, deplaning, walk and cutoff fit the layover."""
    needed = delay + F.lit(transfer.deplaning + transfer.cutoff) + transfer.inverse(draw)
    return F.when(completed & (needed <= layover), 1.0).otherwise(0.0)
