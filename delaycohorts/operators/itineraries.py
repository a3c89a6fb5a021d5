"""Requests for whole tables of itineraries: checks, zones, scoring, two-leg resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaycohorts.functions import clock, codes
from delaycohorts.functions.transfer import Transfer, scenario_columns
from delaycohorts.operators import cohorts as C
from delaycohorts.operators import distributions as D
from delaycohorts.schema import DOMESTIC_COUNTRIES
from delaycohorts.session import materialize

# Accepted duration of a first leg and of a layover, in minutes.
MIN_DURATION, MAX_DURATION, MAX_LAYOVER = 30, 900, 720


def check_itineraries(requests: DataFrame) -> DataFrame:
    """Normalised request columns, minutes, and ``reason`` (null when the fields are fine)."""
    code = {c: codes.norm_code(F.col(c)) for c in ("carrier", "origin", "connection", "destination")}
    airports = [code[c] for c in ("origin", "connection", "destination")]
    shaped = lambda c: F.coalesce(c.rlike(codes.AIRPORT_SHAPE), F.lit(False))
    times = {c: clock.clock_text_minutes(F.col(c)) for c in ("first_departure_time", "first_arrival_time", "connecting_departure_time")}
    missing_time = times["first_departure_time"].isNull() | times["first_arrival_time"].isNull() | times["connecting_departure_time"].isNull()
    reason = (
        F.when(~F.coalesce(code["carrier"].rlike(codes.CARRIER_SHAPE), F.lit(False)), "carrier")
        .when(~(shaped(airports[0]) & shaped(airports[1]) & shaped(airports[2])), "airport_code")
        .when((airports[0] == airports[1]) | (airports[0] == airports[2]) | (airports[1] == airports[2]), "distinct_airports")
        .when(F.col("travel_date").isNull(), "travel_date")
        .when(missing_time, "minute_precision")
    )
    return requests.select(
        "request_id", *[v.alias(k) for k, v in code.items()], "travel_date",
        *[F.substring(c, 1, 5).alias(c) for c in times],
        times["first_departure_time"].alias("departure_minutes"),
        times["first_arrival_time"].alias("arrival_minutes"),
        times["connecting_departure_time"].alias("connecting_minutes"),
        reason.alias("reason"),
    )


def domestic_zones(airports: DataFrame, countries: tuple[str, ...] = DOMESTIC_COUNTRIES) -> DataFrame:
    return airports.where(F.col("country").isin(*countries) & codes.norm_text(F.col("tz")).isNotNull()).select("code", "tz")


def airport_zone(df: DataFrame, airports: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the zone of a domestic airport code, null when unsupported."""
    zones = domestic_zones(airports).select(F.col("code").alias(column), F.col("tz").alias(name))
    return df.join(zones, column, "left")


def to_utc(local: Column, zone: Column) -> Column:
    """UTC of a local wall clock; gap and overlap hours use the earlier offset."""
    return F.convert_timezone(zone, F.lit("UTC"), local)


def _local(date: Column, minutes: Column, days: int = 0) -> Column:
    day = F.date_add(date, days).cast("timestamp_ntz")
    return F.timestamp_add("MINUTE", minutes, day)


def _minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes between two zone-free timestamps, whatever the session zone."""
    return (end - start).cast("interval minute").cast("int")


def first_leg_duration(df: DataFrame, airports: DataFrame) -> DataFrame:
    """Adds ``duration_minutes``, ``rolled`` and ``duration_reason`` of the first leg.

    An arrival not after the departure (in UTC) is taken as the next day.
    """
    zoned = airport_zone(airport_zone(df, airports, "origin", "_tz_a"), airports, "connection", "_tz_b")
    start = to_utc(_local(F.col("travel_date"), F.col("departure_minutes")), F.col("_tz_a"))
    same = to_utc(_local(F.col("travel_date"), F.col("arrival_minutes")), F.col("_tz_b"))
    after = to_utc(_local(F.col("travel_date"), F.col("arrival_minutes"), 1), F.col("_tz_b"))
    known = F.col("_tz_a").isNotNull() & F.col("_tz_b").isNotNull()
    timed = zoned.withColumn("_start", start).withColumn("_same", same).withColumn("_after", after).withColumn("rolled", known & (F.col("_same") <= F.col("_start")))
    duration = _minutes_between(F.col("_start"), F.when(F.col("rolled"), F.col("_after")).otherwise(F.col("_same")))
    timed = timed.withColumn("duration_minutes", duration)
    n = F.col("duration_minutes")
    reason = (
        F.when(~known, "unknown_zone")
        .when(n < MIN_DURATION, "duration_too_short")
        .when((n > MAX_DURATION) & F.col("rolled"), "chronology")
        .when(n > MAX_DURATION, "duration_too_long")
    )
    return timed.withColumn("duration_reason", reason).select(*df.columns, "duration_minutes", "rolled", "duration_reason")


def layover(df: DataFrame, transfer: Transfer = Transfer()) -> DataFrame:
    """Adds ``layover_minutes``, ``overnight`` and ``layover_reason`` (local clock, one airport)."""
    e = clock.elapsed_minutes(F.col("arrival_minutes"), F.col("connecting_minutes"))
    timed = df.withColumn("_e", e)
    n = F.col("_e.minutes")
    reason = (
        F.when(n.isNull(), "overnight_rule").when(n < transfer.cutoff, "below_cutoff")
        .when(n > MAX_LAYOVER, "above_12_hours")
    )
    return timed.select(
        *df.columns, n.alias("layover_minutes"), F.col("_e.overnight").alias("overnight"), reason.alias("layover_reason")
    )


def validate_itineraries(requests: DataFrame, airports: DataFrame, transfer: Transfer = Transfer()) -> DataFrame:
    """All checks in order; ``reason`` is the first one that fails."""
    checked = check_itineraries(requests)
    for c, name in (("origin", "_z1"), ("connection", "_z2"), ("destination", "_z3")):
        checked = airport_zone(checked, airports, c, name)
    zone_gap = F.col("_z1").isNull() | F.col("_z2").isNull() | F.col("_z3").isNull()
    zoned = checked.withColumn("reason", F.coalesce("reason", F.when(zone_gap, "unknown_zone"))).drop("_z1", "_z2", "_z3")
    timed = layover(first_leg_duration(zoned, airports), transfer)
    return timed.withColumn("reason", F.coalesce("reason", "duration_reason", "layover_reason")).drop("duration_reason", "layover_reason")


def score_itineraries(
    requests: DataFrame, history: DataFrame, airports: DataFrame, *, min_obs: int = 30,
    lookback: int = 24, transfer: Transfer = Transfer(), model_version: str = "v1",
) -> DataFrame:
    """Every request once: either its probability and evidence, or the reason it was rejected."""
    return score_checked(
        checked_requests(requests, airports, transfer), history, min_obs=min_obs, lookback=lookback, transfer=transfer, model_version=model_version,
    )


def checked_requests(requests: DataFrame, airports: DataFrame, transfer: Transfer = Transfer()) -> DataFrame:
    """Validated requests, written once."""
    return materialize(validate_itineraries(requests, airports, transfer))


def score_checked(
    checked: DataFrame, history: DataFrame, *, min_obs: int = 30, lookback: int = 24,
    transfer: Transfer = Transfer(), model_version: str = "v1",
) -> DataFrame:
    """Scores of requests that ``checked_requests`` returned; several histories may share them."""
    usable = checked.where("reason is null").select(
        F.col("request_id").alias("case_id"), "carrier", "origin", F.col("connection").alias("destination"),
        F.col("travel_date").alias("prediction_date"), "departure_minutes", "layover_minutes",
    )
    daily = materialize(C.daily_delay_counts(history))
    selected = C.select_cohorts(C.with_bounds(usable, lookback), daily, min_obs)
    scored = D.evaluate_cohorts(
        selected, daily, case_columns=["case_id", "cohort_level", "cohort_size", "hist_start", "hist_end", "layover_minutes"],
        layover=F.col("layover_minutes"), transfer=transfer,
    ).withColumnRenamed("case_id", "request_id").drop("layover_minutes", "cohort_n")
    key = codes.itinerary_key(*[F.col(c) for c in (
        "carrier", "origin", "connection", "destination", "travel_date", "first_departure_time",
        "first_arrival_time", "connecting_departure_time")], model_version=model_version)
    joined = checked.join(scored, "request_id", "left")
    ok = F.col("cohort_level").isNotNull()
    joined = joined.withColumn("reason", F.coalesce("reason", F.when(~ok, "no_prior_history")))
    covered = C.history_coverage(joined.withColumn("prediction_date", F.col("travel_date")), history)
    value = lambda c: F.when(ok, c)
    return covered.select(
        "request_id", F.when(ok, "ok").otherwise("rejected").alias("status"), "reason",
        "probability", value(F.col("layover_minutes")).alias("layover_minutes"),
        value(F.col("overnight")).alias("overnight"), "cohort_level", "cohort_size",
        F.col("p50").alias("median_minutes"), F.col("p75").alias("p75_minutes"), F.col("p90").alias("p90_minutes"),
        *[value(c).alias(name) for c, name in zip(scenario_columns(F.col("layover_minutes"), transfer), ("on_time", "delay_15", "delay_30", "delay_45"))],
        value(codes.itinerary_seed(key)).alias("seed"),
        *[value(F.col(c)).alias(c) for c in ("available_start", "available_end", "effective_start", "effective_end", "cutoff_exclusive", "freshness_warning")],
    )


def resolve_two_legs(
    requests: DataFrame, lookups: DataFrame, candidates: DataFrame, airports: DataFrame, answer: str | None = None,
) -> DataFrame:
    """Two schedule lookups to one itinerary per request.

    ``requests``: request_id, first_choice, second_choice (0-based or null).
    ``lookups``: request_id, leg (1/2), outcome class of the response log (``ok`` or an error).
    ``candidates``: request_id, leg, position, carrier, number, origin, destination,
    departure_local, arrival_local (timestamp_ntz), departure_terminal, arrival_terminal, and
    departure_offset, arrival_offset (minutes from UTC, null when the time carried none).
    ``answer`` names a column of ``lookups`` and ``candidates`` that holds what was asked: equal lookups then share
    one list of candidates, which carries ``answer`` in place of request_id and leg and is never copied per request.
    Status order: lookup problems of leg 1 then leg 2, bad choice, ambiguity, airport, times.
    """
    per_leg = lambda c: [F.max(F.when(F.col("leg") == leg, F.col(c))).alias(f"{c}_{leg}") for leg in (1, 2)]
    classes = lookups.groupBy("request_id").agg(*per_leg("outcome"), *(per_leg(answer) if answer else []))
    classes = classes.withColumnsRenamed({"outcome_1": "o1", "outcome_2": "o2"})
    base = requests.join(classes, "request_id", "left")
    if answer:
        sizes = candidates.groupBy(answer).agg(F.count("*").alias("n"))
        for leg in (1, 2):
            base = base.join(sizes.select(F.col(answer).alias(f"{answer}_{leg}"), F.col("n").alias(f"n{leg}")), f"{answer}_{leg}", "left")
    else:
        sizes = candidates.groupBy("request_id").agg(
            F.count_if(F.expr("leg = 1")).alias("n1"), F.count_if(F.expr("leg = 2")).alias("n2")
        )
        base = base.join(sizes, "request_id", "left")
    base = (
        base.withColumn("n1", F.coalesce("n1", F.lit(0))).withColumn("n2", F.coalesce("n2", F.lit(0)))
        .withColumn("i1", F.coalesce("first_choice", F.when(F.col("n1") == 1, 0)))
        .withColumn("i2", F.coalesce("second_choice", F.when(F.col("n2") == 1, 0)))
    )
    for leg in (1, 2):
        own = [F.col(answer).alias(f"{answer}_{leg}")] if answer else [F.col("request_id")]
        side = (candidates if answer else candidates.where(F.col("leg") == leg)).select(
            *own, F.col("position").alias(f"i{leg}"),
            *[F.col(c).alias(f"{c}_{leg}") for c in (
                "carrier", "number", "origin", "destination", "departure_local", "arrival_local",
                "departure_offset", "arrival_offset", "departure_terminal", "arrival_terminal")],
        )
        base = base.join(side, [f"{answer}_{leg}" if answer else "request_id", f"i{leg}"], "left")
    for leg in (1, 2):
        base = airport_zone(base, airports, f"origin_{leg}", f"_za{leg}")
        base = airport_zone(base, airports, f"destination_{leg}", f"_zb{leg}")
        for end, zone, utc in (("departure", f"_za{leg}", f"dep_utc_{leg}"), ("arrival", f"_zb{leg}", f"arr_utc_{leg}")):
            wall, offset = F.col(f"{end}_local_{leg}"), F.col(f"{end}_offset_{leg}")
            by_offset = F.when(F.col(zone).isNotNull(), F.timestamp_add("MINUTE", -offset, wall))
            base = base.withColumn(utc, F.when(offset.isNull(), to_utc(wall, F.col(zone))).otherwise(by_offset))
            # wall clock at the airport, whatever offset the payload used
            base = base.withColumn(f"{end}_local_{leg}", F.convert_timezone(F.lit("UTC"), F.col(zone), F.col(utc)))
    base = base.withColumn("layover_utc", _minutes_between(F.col("arr_utc_1"), F.col("dep_utc_2")))

    def lookup_status(outcome: str, n: str) -> Column:
        o = F.col(outcome)
        return (
            F.when(o == "authentication", "provider_configuration_error")
            .when(o == "malformed", "provider_data_quality_error")
            .when(o.isin("quota", "rate_limit", "timeout", "other_error"), "provider_temporarily_unavailable")
            .when(o.isNull() | (o == "no_match") | (F.col(n) == 0), "schedule_not_found")
        )

    ordered = (F.col("arr_utc_1") > F.col("dep_utc_1")) & (F.col("dep_utc_2") > F.col("arr_utc_1")) & (F.col("arr_utc_2") > F.col("dep_utc_2")) & (F.col("layover_utc") > 0)
    both = F.array_compact(F.array(F.when(F.col("i1").isNull(), "first"), F.when(F.col("i2").isNull(), "second")))
    bad_choice = (
        F.when(F.col("i1") >= F.col("n1"), "first").when(F.col("i2") >= F.col("n2"), "second")
    )
    s1, s2 = lookup_status("o1", "n1"), lookup_status("o2", "n2")
    status = F.coalesce(
        s1, s2,
        F.when(bad_choice.isNotNull(), "invalid_candidate_selection"),
        F.when(F.col("i1").isNull() | F.col("i2").isNull(), "ambiguous"),
        F.when(F.col("destination_1") != F.col("origin_2"), "invalid_connection_airport"),
        F.when(~F.coalesce(ordered, F.lit(False)), "invalid_chronology"),
        F.lit("success"),
    )
    leg = F.coalesce(
        F.when(s1.isNotNull(), "first"), F.when(s2.isNotNull(), "second"), bad_choice,
        F.when(F.size(both) > 0, F.concat_ws(",", both)),
    )
    terminals = [F.col(c) for c in ("departure_terminal_1", "arrival_terminal_1", "departure_terminal_2", "arrival_terminal_2")]
    missing_terminal = terminals[0].isNull() | terminals[1].isNull() | terminals[2].isNull() | terminals[3].isNull()
    resolved = base.withColumn("status", status).withColumn("leg", leg)
    good = F.col("status") == "success"
    when_good = lambda c: F.when(good, c)
    clock_text = lambda c: F.date_format(c, "HH:mm")
    return resolved.select(
        "request_id", "status", "leg",
        when_good(F.col("carrier_1")).alias("carrier"), when_good(F.col("origin_1")).alias("origin"),
        when_good(F.col("destination_1")).alias("connection"), when_good(F.col("destination_2")).alias("destination"),
        when_good(F.to_date("departure_local_1")).alias("travel_date"),
        when_good(clock_text(F.col("departure_local_1"))).alias("first_departure_time"),
        when_good(clock_text(F.col("arrival_local_1"))).alias("first_arrival_time"),
        when_good(clock_text(F.col("departure_local_2"))).alias("connecting_departure_time"),
        when_good(F.col("layover_utc")).alias("layover_minutes"),
        (good & missing_terminal).alias("terminal_warning"),
    )


def score_two_legs(resolved: DataFrame, history: DataFrame, airports: DataFrame, **options) -> DataFrame:
    """Scores the successful resolutions; an estimator rejection becomes invalid_chronology."""
    good = resolved.where(F.col("status") == "success")
    scored = score_itineraries(good, history, airports, **options).select(
        "request_id", F.col("status").alias("_s"), F.col("reason").alias("_r"), "probability", "cohort_level", "cohort_size"
    )
    joined = resolved.join(scored, "request_id", "left")
    rejected = F.col("_s") == "rejected"
    status = F.when(rejected, "invalid_chronology").otherwise(F.col("status"))
    return joined.select(
        "request_id", status.alias("status"), F.when(rejected, F.col("_r")).alias("reason"), "leg",
        F.when(~F.coalesce(rejected, F.lit(False)), F.col("layover_minutes")).alias("layover_minutes"),
        (F.col("terminal_warning") & ~F.coalesce(rejected, F.lit(False))).alias("terminal_warning"),
        "probability", "cohort_level", "cohort_size",
    )
