"""How stable routes, times and operating days of a flight number are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from delaycohorts.functions import clock, codes
from delaycohorts.schema import ROUTE_KEY

NUMBER = ("reporting_carrier", "flight_number")
TIMES = ("crs_departure_minutes", "crs_arrival_minutes")
SHARES = (0.90, 0.95, 0.99, 1.0)


def _route_days(sched: DataFrame) -> DataFrame:
    """One row per flight number, date and route, with the number of source rows."""
    return sched.groupBy(*ROUTE_KEY, "flight_date").agg(F.count("*").alias("n"))


def route_stability(sched: DataFrame) -> DataFrame:
    """Per flight number: dates, daily route sets and their changes, dominant route.

    A daily route set is compared through its size and two independent xor folds over the
    *distinct* routes of the day, so repeated routes cannot cancel out.
    """
    days = _route_days(sched)
    name = F.concat_ws("-", "origin", "destination")
    sets = days.groupBy(*NUMBER, "flight_date").agg(
        F.struct(
            F.count("*").alias("size"), F.bit_xor(F.xxhash64(name)).alias("a"),
            F.bit_xor(codes.hash_int(name)).alias("b"),
        ).alias("route_set"),
        F.sum("n").alias("segments"),
    )
    w = W.partitionBy(*NUMBER).orderBy("flight_date")
    changed = F.lag("route_set").over(w) != F.col("route_set")
    totals = sets.withColumn("_changed", changed).groupBy(*NUMBER).agg(
        F.count("*").cast("bigint").alias("operating_dates"),
        F.count_distinct("route_set").cast("bigint").alias("distinct_daily_route_sets"),
        F.count_if(F.col("segments") > 1).cast("bigint").alias("multi_segment_dates"),
        F.count_if("_changed").cast("bigint").alias("route_set_changes"),
    )
    calendar = days.groupBy(*ROUTE_KEY, F.year("flight_date").alias("y"), F.month("flight_date").alias("m")).agg(
        F.count("*").alias("dates")
    )
    years = calendar.groupBy(*ROUTE_KEY, "y").agg(F.sum("dates").alias("dates"), F.count("*").alias("months"))
    routes = years.groupBy(*ROUTE_KEY).agg(
        F.sum("dates").alias("dates"), F.count("*").alias("years"), F.sum("months").alias("months")
    )
    # most dates first, ties by name: the minimum of (-dates, origin, destination)
    top = F.min(F.struct((-F.col("dates")).alias("d"), "origin", "destination"))
    summary = routes.groupBy(*NUMBER).agg(
        F.count("*").cast("bigint").alias("distinct_routes"), top.alias("_top"),
        F.sum("years").cast("bigint").alias("year_routes"), F.sum("months").cast("bigint").alias("month_routes"),
    )
    dominant = -F.col("_top.d")
    return totals.join(summary, list(NUMBER)).select(
        *totals.columns, "distinct_routes", dominant.cast("bigint").alias("dominant_route_dates"),
        (dominant / F.col("operating_dates")).alias("dominant_route_date_share"),
        F.concat_ws("-", "_top.origin", "_top.destination").alias("dominant_route"),
        (F.col("multi_segment_dates") > 0).alias("has_same_date_multi_segment"),
        "year_routes", "month_routes",
    )


def schedule_modes(sched: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """Most frequent (departure, arrival) per route, ties by the earlier minutes.

    ``extra`` are further grouping columns such as a weekday. Two aggregates, no window.
    """
    names = [*ROUTE_KEY]
    work = sched.select(*ROUTE_KEY, *TIMES, *extra)
    names += [c for c in work.columns if c not in {*ROUTE_KEY, *TIMES}]
    counts = work.groupBy(*names, *TIMES).agg(F.count("*").alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("m"), *TIMES)).alias("_top")
    return counts.groupBy(*names).agg(top).select(
        *names, F.col("_top.crs_departure_minutes").alias("crs_departure_minutes"),
        F.col("_top.crs_arrival_minutes").alias("crs_arrival_minutes"),
        (-F.col("_top.m")).cast("bigint").alias("n"),
    )


def schedule_stability(sched: DataFrame) -> DataFrame:
    """Per route of a flight number: time pairs, deviation from the mode, time changes."""
    daily = sched.groupBy(*ROUTE_KEY, "flight_date", *TIMES).agg(F.count("*").alias("n"))
    modes = schedule_modes(sched).select(
        *ROUTE_KEY, F.col("crs_departure_minutes").alias("modal_departure_minutes"),
        F.col("crs_arrival_minutes").alias("modal_arrival_minutes"), F.col("n").alias("_modal"),
    )
    pair = F.struct(*TIMES)
    w = W.partitionBy(*ROUTE_KEY).orderBy("flight_date", *TIMES)
    changed = daily.withColumn("_changed", F.lag(pair).over(w) != pair)
    # per time pair: the deviation histogram needs no single rows
    pairs = changed.groupBy(*ROUTE_KEY, *TIMES).agg(
        F.sum("n").alias("n"), F.count_if("_changed").alias("changes")
    )
    dates = daily.groupBy(*ROUTE_KEY, "flight_date").agg(F.lit(1).alias("one")).groupBy(*ROUTE_KEY).agg(
        F.count("*").cast("bigint").alias("operating_dates")
    )
    dep = clock.circular_minutes(F.col("crs_departure_minutes"), F.col("modal_departure_minutes"))
    arr = clock.circular_minutes(F.col("crs_arrival_minutes"), F.col("modal_arrival_minutes"))
    q = lambda c: F.percentile(c, F.array(F.lit(0.5), F.lit(0.9)), F.col("n"))
    out = pairs.join(modes, list(ROUTE_KEY)).groupBy(*ROUTE_KEY).agg(
        F.sum("n").cast("bigint").alias("records"),
        F.count_distinct("crs_departure_minutes").cast("bigint").alias("distinct_departure_minutes"),
        F.count_distinct("crs_arrival_minutes").cast("bigint").alias("distinct_arrival_minutes"),
        F.count_distinct(F.struct(*TIMES)).cast("bigint").alias("distinct_time_pairs"),
        F.max("modal_departure_minutes").alias("modal_departure_minutes"),
        F.max("modal_arrival_minutes").alias("modal_arrival_minutes"),
        (F.max("_modal") / F.sum("n")).alias("modal_time_pair_share"),
        q(dep).alias("_dep"), q(arr).alias("_arr"),
        F.sum("changes").cast("bigint").alias("schedule_changes"),
    )
    return out.join(dates, list(ROUTE_KEY)).select(
        *ROUTE_KEY, "records", "operating_dates", "distinct_departure_minutes", "distinct_arrival_minutes",
        "distinct_time_pairs", "modal_departure_minutes", "modal_arrival_minutes", "modal_time_pair_share",
        F.col("_dep")[0].alias("median_departure_deviation"), F.col("_dep")[1].alias("p90_departure_deviation"),
        F.col("_arr")[0].alias("median_arrival_deviation"), F.col("_arr")[1].alias("p90_arrival_deviation"),
        "schedule_changes",
    )


def operating_patterns(sched: DataFrame) -> DataFrame:
    """Span, density, gaps, weekday mask and a class per route of a flight number."""
    days = sched.select(*ROUTE_KEY, "flight_date").distinct()
    w = W.partitionBy(*ROUTE_KEY).orderBy("flight_date")
    gaps = days.withColumn("_gap", F.datediff("flight_date", F.lag("flight_date").over(w)))
    dow = F.weekday("flight_date") + 1
    per_dow = [F.count_if(dow == d).alias(f"_d{d}") for d in range(1, 8)]
    spans = gaps.groupBy(*ROUTE_KEY).agg(
        F.min("flight_date").alias("first_date"), F.max("flight_date").alias("last_date"),
        F.count("*").cast("bigint").alias("operating_dates"),
        F.count_distinct(F.month("flight_date")).cast("bigint").alias("active_months"),
        F.max("_gap").cast("int").alias("maximum_gap_days"), *per_dow,
    )
    # repeated rows of one date count as a gap of 0 days when there is no other gap
    repeated = sched.groupBy(*ROUTE_KEY).agg(F.count("*").alias("_rows"))
    mask = F.lit(0)
    for d in range(1, 8):
        eligible = clock.days_of_week_between(F.col("first_date"), F.col("last_date"), F.lit(d))
        share = F.col(f"_d{d}") / F.greatest(eligible, F.lit(1))
        mask = mask + F.when((F.col(f"_d{d}") > 0) & (share >= 0.5), 2 ** (d - 1)).otherwise(0)
    density = F.col("operating_dates") / F.greatest(F.datediff("last_date", "first_date") + 1, F.lit(1))
    full = spans.join(repeated, list(ROUTE_KEY)).select(
        *ROUTE_KEY, "first_date", "last_date", "operating_dates", "active_months",
        F.coalesce("maximum_gap_days", F.when(F.col("_rows") > F.col("operating_dates"), 0)).alias("maximum_gap_days"),
        mask.cast("int").alias("active_weekday_mask"), density.alias("calendar_density"),
    )
    label = (
        F.when((F.col("operating_dates") < 8) | (F.col("calendar_density") < 0.20), "irregular")
        .when((F.col("maximum_gap_days") > 35) | (F.col("active_months") <= 6), "seasonal")
        .when(F.col("active_weekday_mask") == 127, "daily")
        .when(F.col("active_weekday_mask") == 31, "weekdays_only")
        .when(F.col("active_weekday_mask") == 96, "weekends_only")
        .otherwise("selected_weekdays")
    )
    return full.withColumn("operating_pattern", label)


def _share_counts(share: str, one: str, prefix: str, names: tuple[str, str]) -> list[Column]:
    out = [
        F.count_if(F.col(one) == 1).cast("bigint").alias(names[0]),
        F.count_if(F.col(one) > 1).cast("bigint").alias(names[1]),
    ]
    for limit in SHARES:
        label = "100" if limit == 1.0 else f"ge_{round(limit * 100)}"
        out.append(F.count_if(F.col(share) >= limit).cast("bigint").alias(f"{prefix}_{label}"))
    return out


def _quantile(c: str, q: float, name: str) -> Column:
    return F.percentile(c, F.lit(q)).alias(name)


def route_findings(routes: DataFrame) -> DataFrame:
    """One row of counts, percents, medians and 90th percentiles over flight numbers."""
    parts = _share_counts("dominant_route_date_share", "distinct_routes", "dominant", ("single_route", "multiple_routes"))
    multi = F.count_if("has_same_date_multi_segment").cast("bigint").alias("same_date_multi_segment")
    base = routes.agg(
        F.count("*").cast("bigint").alias("combinations"), *parts, multi,
        _quantile("distinct_routes", 0.5, "median_routes"), _quantile("distinct_routes", 0.9, "p90_routes"),
        _quantile("route_set_changes", 0.5, "median_route_set_changes"),
        _quantile("route_set_changes", 0.9, "p90_route_set_changes"),
    )
    keys = ["single_route", "multiple_routes", "dominant_ge_90", "dominant_ge_95", "dominant_ge_99", "dominant_100", "same_date_multi_segment"]
    return base.select("*", *[_percent(k, "combinations") for k in keys])


def schedule_findings(times: DataFrame) -> DataFrame:
    parts = _share_counts("modal_time_pair_share", "distinct_time_pairs", "modal", ("single_time_pair", "multiple_time_pairs"))
    base = times.agg(
        F.count("*").cast("bigint").alias("route_combinations"), *parts,
        _quantile("distinct_time_pairs", 0.5, "median_time_pairs"), _quantile("distinct_time_pairs", 0.9, "p90_time_pairs"),
        _quantile("median_departure_deviation", 0.5, "median_of_median_departure_deviation"),
        _quantile("p90_departure_deviation", 0.9, "p90_of_route_p90_departure_deviation"),
        _quantile("schedule_changes", 0.5, "median_schedule_changes"), _quantile("schedule_changes", 0.9, "p90_schedule_changes"),
    )
    keys = ["single_time_pair", "multiple_time_pairs", "modal_ge_90", "modal_ge_95", "modal_ge_99", "modal_100"]
    return base.select("*", *[_percent(k, "route_combinations") for k in keys])


def _percent(k: str, total: str) -> Column:
    return F.round(F.lit(100) * F.col(k) / F.col(total), 6).alias(f"{k}_percent")


def pattern_counts(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("operating_pattern").agg(F.count("*").cast("bigint").alias("routes"))


def stability_examples(routes: DataFrame, times: DataFrame, min_dates: int = 900, min_changes: int = 100) -> DataFrame:
    """The top row of four kinds; ties end by name so that the pick is stable."""
    text = lambda c: F.col(c).cast("string")
    route = lambda kind: (F.lit(kind).alias("kind"), *NUMBER, F.col("dominant_route").alias("route"))
    stable = (
        routes.where((F.col("distinct_routes") == 1) & (F.col("operating_dates") >= min_dates))
        .orderBy(F.desc("operating_dates"), *NUMBER).limit(1)
        .select(*route("stable"), F.col("operating_dates").alias("score"))
    )
    moving = (
        routes.where((F.col("distinct_routes") > 1) & ~F.col("has_same_date_multi_segment") & (F.col("operating_dates") >= min_changes))
        .orderBy(F.desc("route_set_changes"), F.desc("operating_dates"), *NUMBER).limit(1)
        .select(*route("route_change"), F.col("route_set_changes").alias("score"))
    )
    retimed = (
        times.where((F.col("records") >= min_changes) & (F.col("distinct_time_pairs") > 1))
        .orderBy(F.desc("schedule_changes"), F.desc("records"), *ROUTE_KEY).limit(1)
        .select(F.lit("schedule_change").alias("kind"), *NUMBER,
                F.concat_ws("-", "origin", "destination").alias("route"), F.col("schedule_changes").alias("score"))
    )
    multi = (
        routes.where("has_same_date_multi_segment")
        .orderBy(F.desc("multi_segment_dates"), F.desc("distinct_routes"), *NUMBER).limit(1)
        .select(*route("multi_segment"), F.col("multi_segment_dates").alias("score"))
    )
    return stable.unionByName(moving).unionByName(retimed).unionByName(multi)


def modal_accuracy(sched: DataFrame) -> DataFrame:
    """Share of rows equal to their mode: overall and when the mode may vary by a dimension."""
    day = F.col("flight_date")
    dims = {"global": F.lit(0), "weekday": clock.iso_weekday(day), "month": F.month(day), "year": F.year(day)}
    # the dimension label joins the grouping, so all four variants share one pass
    rows = sched.select(
        *ROUTE_KEY, *TIMES,
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("label"), value.cast("int").alias("value")) for name, value in dims.items()
        ])).alias("_d"),
    )
    modes = schedule_modes(rows, [F.col("_d.label").alias("dimension"), F.col("_d.value").alias("dim_value")])
    hits = modes.groupBy("dimension").agg(F.sum("n").alias("hits"))
    total = sched.agg(F.count("*")).scalar()
    shares = hits.select("dimension", F.round(F.col("hits") / total, 9).alias("modal_accuracy"))
    base = F.max(F.when(F.col("dimension") == "global", F.col("modal_accuracy"))).over(W.partitionBy(F.lit(1)))
    return shares.select(  # four rows
        "dimension", "modal_accuracy",
        F.round(F.lit(100) * (F.col("modal_accuracy") - base), 6).alias("gain_pp"),
    )


def lookup_statistics(records: DataFrame) -> DataFrame:
    """How often (date, carrier, number) is unique, and what repeated keys look like."""
    routes = records.where(F.col("flight_number").isNotNull()).groupBy(*NUMBER, "flight_date", "origin", "destination").agg(
        F.count("*").alias("n")
    )
    keys = routes.groupBy(*NUMBER, "flight_date").agg(F.sum("n").alias("n"), F.count("*").alias("routes"))
    one, many = F.col("n") == 1, F.col("n") > 1
    base = keys.agg(
        F.count("*").cast("bigint").alias("observed_keys"),
        F.count_if(one).cast("bigint").alias("unique_keys"),
        F.count_if(many).cast("bigint").alias("multiple_segment_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("records_with_flight_number"),
        F.coalesce(F.sum(F.when(one, F.col("n"))), F.lit(0)).cast("bigint").alias("records_in_unique_keys"),
        F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).cast("bigint").alias("records_in_multiple_keys"),
        F.max("n").cast("bigint").alias("maximum_segments"),
        F.count_if(many & (F.col("routes") == F.col("n"))).cast("bigint").alias("multiple_keys_all_distinct_routes"),
        F.count_if(many & (F.col("routes") < F.col("n"))).cast("bigint").alias("multiple_keys_with_repeated_route"),
    )
    pct = lambda c, name: F.round(F.lit(100) * F.col(c) / F.col("observed_keys"), 6).alias(name)
    return base.select("*", pct("unique_keys", "unique_key_percent"), pct("multiple_segment_keys", "multiple_key_percent"))
