"""Deterministic samples: cases in hash order, weighted strata, threshold representatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaycohorts.functions import buckets, clock, codes
from delaycohorts.operators.topn import hash_sample, top_n_per_group
from delaycohorts.schema import FLIGHT_KEY

STRATA = ("carrier", "route_volume_group", "season", "time_bucket", "severity")
ROUTE = ("carrier", "origin", "destination")
EXACT_COHORT = ("reporting_carrier", "origin", "destination", "month", "day_of_week", "departure_time_bucket")
TARGET_COUNTS = (20, 24, 25, 28, 29, 30, 31, 32, 35, 40)  # fixed values


def replay_cases(records: DataFrame, years: Sequence[int]) -> DataFrame:
    """Flights of the holdout years as cases with their realized delay.

    ``records`` must hold one row per flight key (see ``first_per_key``): the key is the case.
    """
    identity = codes.stable_hash(*[F.col(c) for c in FLIGHT_KEY])
    status = F.col("flight_status") if "flight_status" in records.columns else F.lit("completed")
    return records.where(F.year("flight_date").isin(*years)).select(
        identity.alias("case_id"), F.col("reporting_carrier").alias("carrier"), "origin", "destination",
        F.col("flight_date").alias("prediction_date"), F.col("crs_departure_minutes").alias("departure_minutes"),
        F.col("crs_arrival_minutes").alias("arrival_minutes"),
        F.coalesce("arrival_delay_minutes", F.lit(0.0)).alias("actual"), status.alias("status"),
        F.year("flight_date").alias("test_year"),
    )


def sample_cases(cases: DataFrame, n: int, seed: int, years: Sequence[int]) -> DataFrame:
    """n cases of each holdout year in hash order."""
    order = codes.stable_hash(F.col("case_id"), str(seed))
    return top_n_per_group(cases.where(F.col("test_year").isin(*years)), ("test_year",), order, n)


def with_route_volume(cases: DataFrame, history: DataFrame) -> DataFrame:
    """Adds the size class of the route before January 1st of the test year."""
    per_year = history.groupBy(
        F.col("reporting_carrier").alias("carrier"), "origin", "destination", F.year("flight_date").alias("y")
    ).agg(F.count("*").alias("n"))
    years = cases.select(*ROUTE, "test_year").distinct()
    before = years.join(per_year, list(ROUTE)).where(F.col("y") < F.col("test_year"))
    volume = before.groupBy(*ROUTE, "test_year").agg(F.sum("n").cast("bigint").alias("route_count"))
    joined = cases.join(volume, [*ROUTE, "test_year"], "left")
    return joined.select(*cases.columns, "route_count", buckets.route_volume_group(F.col("route_count")).alias("route_volume_group"))


def with_strata(cases: DataFrame, history: DataFrame, by_status: bool = False) -> DataFrame:
    """Adds volume group, season, time bucket and severity (or status) of every case."""
    severity = F.col("status") if by_status else buckets.delay_severity(F.col("actual"))
    return with_route_volume(cases, history).select(
        "*", clock.season(F.month("prediction_date")).alias("season"),
        clock.time_bucket(F.col("departure_minutes")).alias("time_bucket"), severity.alias("severity"),
    )


def stratified_sample(cases: DataFrame, target: int, seed: int, strata: Sequence[str] = STRATA) -> DataFrame:
    """``target`` cases per test year spread over the strata, weighted by population / sampled.

    Each stratum offers its first ceil(target / strata) cases in hash order; the offers are
    then cut to the target in a second hash order. Totals come from one small aggregate.
    """
    key = ["test_year", *strata]
    population = cases.groupBy(*key).agg(F.count("*").alias("population_count"))
    quota = population.groupBy("test_year").agg(F.ceil(F.lit(float(target)) / F.count("*")).alias("_quota"))
    offered = top_n_per_group(cases, key, codes.stable_hash(F.col("case_id"), str(seed)), target, rank="stratum_rank")
    offered = offered.join(quota, "test_year").where("stratum_rank <= _quota").drop("_quota")
    chosen = top_n_per_group(offered, ("test_year",), codes.stable_hash(F.col("case_id"), str(seed + 1)), target)
    sampled = chosen.groupBy(*key).agg(F.count("*").alias("sampled_count"))
    weights = sampled.join(population, key)
    return chosen.join(weights, key).select(
        *cases.columns, "stratum_rank", "population_count", "sampled_count",
        (F.col("population_count") / F.col("sampled_count")).alias("weight"),
    )


def near_threshold_cases(
    history: DataFrame, years: Sequence[int], train_start: str, per_count: int,
    seed: int, targets: Sequence[int] = TARGET_COUNTS,
) -> DataFrame:
    """Holdout flights whose exact cohort has a size of interest before the test year.

    One flight per cohort and year, then ``per_count`` flights per cohort size and year.
    """
    per_day = history.groupBy(*EXACT_COHORT, F.year("flight_date").alias("y")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("flight_date") >= F.lit(train_start).cast("date")).alias("n")
    )
    tests = F.explode(F.array(*[F.lit(y) for y in years])).alias("test_year")
    sizes = per_day.select("*", tests).where(F.col("y") < F.col("test_year")).groupBy(*EXACT_COHORT, "test_year").agg(
        F.sum("n").cast("bigint").alias("specific_n")
    ).where(F.col("specific_n").isin(*targets))
    holdout = history.withColumn("test_year", F.year("flight_date")).where(F.col("test_year").isin(*years))
    members = replay_with(holdout.join(sizes, [*EXACT_COHORT, "test_year"]))
    first = top_n_per_group(
        members, ("carrier", "origin", "destination", "month", "day_of_week", "departure_time_bucket", "test_year"),
        codes.stable_hash(F.col("case_id"), str(seed)), 1,
    )
    picked = top_n_per_group(first, ("specific_n", "test_year"), codes.stable_hash(F.col("case_id"), str(seed + 1)), per_count)
    return picked.drop("month", "day_of_week", "departure_time_bucket")


def replay_with(holdout: DataFrame) -> DataFrame:
    """Cases with the cohort columns and size kept alongside."""
    identity = codes.stable_hash(*[F.col(c) for c in FLIGHT_KEY])
    return holdout.select(
        identity.alias("case_id"), F.col("reporting_carrier").alias("carrier"), "origin", "destination",
        F.col("flight_date").alias("prediction_date"), F.col("crs_departure_minutes").alias("departure_minutes"),
        F.col("crs_arrival_minutes").alias("arrival_minutes"), F.col("arrival_delay_minutes").alias("actual"),
        "month", "day_of_week", "departure_time_bucket", "specific_n", "test_year",
    )


# Departure, arrival and onward times used for each time bucket.
BUCKET_TIMES = (
    ("overnight", "03:00", "05:00", "06:30"), ("morning", "09:00", "11:00", "12:30"),
    ("afternoon", "15:00", "17:00", "18:30"), ("evening", "19:00", "21:00", "22:30"),
)
FINAL_DESTINATIONS = ("ZZZ", "YYY", "XXX")


def representative_itineraries(history: DataFrame, n: int, year: int, min_obs: int = 30) -> DataFrame:
    """n cohorts of at least ``min_obs`` rows in hash order, as requests that fall into them."""
    cohorts = history.groupBy(*EXACT_COHORT).agg(F.count("*").alias("observations")).where(F.col("observations") >= min_obs)
    picked = hash_sample(cohorts, codes.stable_hash(*[F.col(c) for c in EXACT_COHORT]), n)
    first = F.make_date(F.lit(year), F.col("month"), F.lit(1))
    day = F.date_add(first, F.pmod(F.col("day_of_week") - clock.iso_weekday(first), F.lit(7)))
    bucket = F.col("departure_time_bucket")

    def time_of(position: int) -> Column:
        chain = F.when(bucket == BUCKET_TIMES[0][0], BUCKET_TIMES[0][position])
        for row in BUCKET_TIMES[1:]:
            chain = chain.when(bucket == row[0], row[position])
        return chain

    final = F.coalesce(*[F.when(~F.lit(code).isin(F.col("origin"), F.col("destination")), code) for code in FINAL_DESTINATIONS])
    return picked.select(
        codes.stable_hash(*[F.col(c) for c in EXACT_COHORT]).alias("request_id"),
        F.col("reporting_carrier").alias("carrier"), "origin", F.col("destination").alias("connection"),
        final.alias("destination"), day.alias("travel_date"), time_of(1).alias("first_departure_time"),
        time_of(2).alias("first_arrival_time"), time_of(3).alias("connecting_departure_time"), "observations",
    )
