"""Validity periods from dated schedules, and the proof of how well they reconstruct them.

All window partitions work on rows already reduced to one per key and date (or week), so a
key that holds a third of the table still means at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from delaycohorts.functions import clock, codes
from delaycohorts.operators import daybits as B
from delaycohorts.operators.topn import top_n_per_group
from delaycohorts.schema import SCHEDULE_COLUMNS, SIGNATURE

GAP_DAYS = 21  # fixed value: a longer silence starts a new pattern period
FLIGHT_DAY = ("reporting_carrier", "flight_number", "flight_date")


def _mask(date: str = "flight_date") -> Column:
    return F.bit_or(clock.weekday_bit(F.col(date))).cast("int")


def weekly_signatures(sched: DataFrame) -> DataFrame:
    """Per signature and Monday week: first and last date, weekday mask, rows."""
    week = clock.week_start(F.col("flight_date")).alias("week_start")
    return sched.groupBy(*SIGNATURE, week).agg(
        F.min("flight_date").alias("observed_from"), F.max("flight_date").alias("observed_to"),
        _mask().alias("weekday_mask"), F.count("*").cast("int").alias("source_observations"),
    )


def _running_id(starts: Column, window) -> Column:
    return F.sum(starts.cast("int")).over(window.rowsBetween(W.unboundedPreceding, W.currentRow))


def exact_periods(sched: DataFrame) -> DataFrame:
    """Lossless compaction: consecutive weeks with the same mask form one period."""
    w = W.partitionBy(*SIGNATURE).orderBy("week_start")
    follows = (F.lag("week_start").over(w) == F.date_sub("week_start", 7)) & (
        F.lag("weekday_mask").over(w) == F.col("weekday_mask")
    )
    marked = weekly_signatures(sched).withColumn("_start", ~F.coalesce(follows, F.lit(False)))
    numbered = marked.withColumn("period_id", _running_id(F.col("_start"), w))
    return numbered.groupBy(*SIGNATURE, "weekday_mask", "period_id").agg(
        F.min("observed_from").alias("valid_from"), F.max("observed_to").alias("valid_to"),
        F.sum("source_observations").cast("int").alias("source_observations"),
        F.count("*").cast("int").alias("weeks"),
    ).drop("period_id")


def pattern_periods(sched: DataFrame, gap: int = GAP_DAYS) -> DataFrame:
    """Approximate compaction: a period lasts until a silence of more than ``gap`` days."""
    days = sched.groupBy(*SIGNATURE, "flight_date").agg(F.count("*").alias("n"))
    w = W.partitionBy(*SIGNATURE).orderBy("flight_date")
    silence = F.datediff("flight_date", F.lag("flight_date").over(w))
    marked = days.withColumn("_gap", silence)
    starts = F.col("_gap").isNull() | (F.col("_gap") > gap)
    numbered = marked.withColumn("period_id", _running_id(starts, w))
    # inside a period: the gap to the day before, or 0 between rows of one day
    inner = F.greatest(F.when(~starts, F.col("_gap")), F.when(F.col("n") > 1, 0))
    return numbered.withColumn("_inner", inner).groupBy(*SIGNATURE, "period_id").agg(
        F.min("flight_date").alias("valid_from"), F.max("flight_date").alias("valid_to"),
        _mask().alias("weekday_mask"), F.sum("n").cast("int").alias("source_observations"),
        F.max("_inner").cast("int").alias("maximum_internal_gap_days"),
    ).drop("period_id")


def expand_periods(periods: DataFrame) -> DataFrame:
    """One row per period day whose weekday bit is set."""
    day = F.explode(F.sequence("valid_from", "valid_to", F.expr("interval 1 day"))).alias("flight_date")
    days = periods.select(day, *SIGNATURE, "weekday_mask")
    return days.where(
        clock.mask_includes(F.col("weekday_mask"), clock.iso_weekday(F.col("flight_date")))
    ).select(*SCHEDULE_COLUMNS)


def false_rows(expanded: DataFrame, sched: DataFrame) -> DataFrame:
    """Rows a representation claims but the source lacks (set difference)."""
    sets = B.compared(B.of_rows(expanded), B.of_rows(sched))
    return B.dates(sets, B.only("c", "s"), SIGNATURE).select(*SCHEDULE_COLUMNS)


def missing_rows(expanded: DataFrame, sched: DataFrame) -> DataFrame:
    return false_rows(sched, expanded)


def compared_days(periods: DataFrame, sched: DataFrame) -> DataFrame:
    """Days that periods claim and the source has, per signature and year, as bitmaps ``c`` and ``s``."""
    return B.compared(B.of_periods(periods), B.of_rows(sched))


def pattern_exclusions(periods: DataFrame, sched: DataFrame) -> DataFrame:
    """Dated rows that the periods claim and the source lacks; only these are ever listed."""
    return B.dates(compared_days(periods, sched), B.only("c", "s"), SIGNATURE).select(*SCHEDULE_COLUMNS)


def pattern_gaps(periods: DataFrame, sched: DataFrame) -> DataFrame:
    """Dated rows of the source that no period claims."""
    return B.dates(compared_days(periods, sched), B.only("s", "c"), SIGNATURE).select(*SCHEDULE_COLUMNS)


def _with_operations(compared: DataFrame) -> DataFrame:
    """Adds the days on which the route (``r``) and the flight number (``f``) operate at any time.

    A flight number has one row per route, pair of times and year here, whatever it flies.
    """
    flight = W.partitionBy("reporting_carrier", "flight_number", "year")
    route = W.partitionBy("reporting_carrier", "flight_number", "year", "origin", "destination")
    any_of = lambda prefix, w: [F.bit_or(s).over(w).alias(n) for s, n in zip(B.words("s"), B.words(prefix))]
    return compared.select("*", *any_of("f", flight), *any_of("r", route))


def _reasons(compared: DataFrame) -> DataFrame:
    """False days parted by reason: words ``t`` wrong time, ``o`` wrong route, ``x`` no operation at all."""
    with_days = _with_operations(compared).withColumns(dict(zip(B.words("e"), B.only("c", "s"))))
    with_days = with_days.withColumns(dict(zip(B.words("q"), B.only("f", "r"))))  # flown, but not on this route
    return with_days.select("*", *B.named(B.both("e", "r"), "t"), *B.named(B.both("e", "q"), "o"), *B.named(B.only("e", "f"), "x"))


def false_row_reasons(periods: DataFrame, sched: DataFrame) -> DataFrame:
    """False rows with why they are wrong: ``route``, ``time`` or ``not_operating``."""
    sets = _reasons(compared_days(periods, sched))
    out = None
    for prefix, reason in (("o", "route"), ("t", "time"), ("x", "not_operating")):
        part = B.dates(sets, [F.col(n) for n in B.words(prefix)], SIGNATURE).select(*SCHEDULE_COLUMNS, F.lit(reason).alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def reconstruction_accuracy(periods: DataFrame, sched: DataFrame, label: str) -> DataFrame:
    """One row: expanded, exact, false, missing, reasons, recall and precision.

    Both sides are sets of days, compared as bitmaps in one shuffle of a row per signature and year.
    """
    sets = _reasons(compared_days(periods, sched))
    column = lambda prefix: [F.col(n) for n in B.words(prefix)]
    totals = sets.agg(
        F.sum(B.size(column("c"))).alias("expanded_rows"), F.sum(B.size(column("e"))).alias("false_positive_rows"),
        F.sum(B.size(B.only("s", "c"))).alias("false_negative_rows"), F.sum(B.size(column("s"))).alias("source_rows"),
        F.sum(B.size(column("o"))).alias("_o"), F.sum(B.size(column("t"))).alias("_t"), F.sum(B.size(column("x"))).alias("_x"),
    )
    exp, fp, fn, src = (F.col(c) for c in ("expanded_rows", "false_positive_rows", "false_negative_rows", "source_rows"))
    return totals.select(
        F.lit(label).alias("representation"), exp, (exp - fp).alias("exact_matches"), fp, fn,
        F.col("_o").alias("route_mismatch_candidates"),
        F.col("_t").alias("schedule_time_mismatch_candidates"),
        F.col("_x").alias("false_positive_nonoperating_dates"),
        F.round((src - fn) / src, 9).alias("source_recall"),
        F.round((exp - fp) / exp, 9).alias("expanded_precision"),
    )


FLIGHT = ("reporting_carrier", "flight_number")


def reconstruct_keys(keys: DataFrame, periods: DataFrame) -> DataFrame:
    """Schedule rows of (carrier, number, date) keys according to the periods."""
    asked = B.of_rows(keys, FLIGHT, "k")
    met = B.of_periods(periods).join(asked, [*FLIGHT, "year"])
    return B.dates(met, B.both("b", "k"), SIGNATURE).select(*SCHEDULE_COLUMNS)


def month_bins(periods: DataFrame) -> DataFrame:
    """Each period once per calendar month it touches, so that containment joins on equality.

    A key date then meets only the periods of its own month, not all of a flight number.
    """
    months = F.sequence(F.trunc("valid_from", "MM"), F.trunc("valid_to", "MM"), F.expr("interval 1 month"))
    return periods.withColumn("month_bin", F.explode(months))


def stratified_keys(sched: DataFrame, routes: DataFrame, times: DataFrame, n: int = 2, seed: int = 20260812) -> DataFrame:
    """n flight-day keys per carrier, year, month, weekday and stability class."""
    candidates = (
        sched.select(*FLIGHT_DAY, "origin", "destination").distinct()
        .join(routes.select("reporting_carrier", "flight_number", "has_same_date_multi_segment"),
              ["reporting_carrier", "flight_number"])
        .join(times.select("reporting_carrier", "flight_number", "origin", "destination",
                           (F.col("distinct_time_pairs") > 1).alias("changing_schedule")),
              ["reporting_carrier", "flight_number", "origin", "destination"])
        .select(*FLIGHT_DAY, "has_same_date_multi_segment", "changing_schedule").distinct()
    )
    day = F.col("flight_date")
    strata = candidates.select(
        "*", F.year(day).alias("_y"), F.month(day).alias("_m"), clock.iso_weekday(day).alias("_d")
    )
    order = codes.stable_hash(F.col("reporting_carrier"), F.col("flight_number"), day, str(seed))
    keys = ("reporting_carrier", "_y", "_m", "_d", "has_same_date_multi_segment", "changing_schedule")
    return top_n_per_group(strata, keys, order, n).select(*FLIGHT_DAY)


def sample_reconstruction(keys: DataFrame, periods: DataFrame, sched: DataFrame, label: str) -> DataFrame:
    """The accuracy of sampled keys only: both sides cut to the days that their flight number is asked for."""
    met = compared_days(periods, sched).join(B.of_rows(keys, FLIGHT, "k"), [*FLIGHT, "year"])
    cut = met.select(*B.named(B.both("c", "k"), "c"), *B.named(B.both("s", "k"), "s"))
    src, fn = F.col("source_segments"), F.col("false_negative_rows")
    return cut.agg(
        F.sum(B.size([F.col(n) for n in B.words("s")])).alias("source_segments"), F.sum(B.size([F.col(n) for n in B.words("c")])).alias("reconstructed_segments"),
        F.sum(B.size(B.only("c", "s"))).alias("false_positive_rows"), F.sum(B.size(B.only("s", "c"))).alias("false_negative_rows"),
    ).select(
        F.lit(label).alias("representation"), src, "reconstructed_segments", "false_positive_rows", fn,
        F.round((src - fn) / src, 9).alias("exact_source_row_accuracy"),
    )


def compaction_summary(sched: DataFrame, exact: DataFrame, pattern: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Row counts, date range and row ratios of the representations."""
    size = lambda df, name: df.agg(F.count("*").cast("bigint").alias(name)).scalar().alias(name)
    base = sched.agg(
        F.count("*").cast("bigint").alias("source_rows"),
        F.min("flight_date").alias("date_start"), F.max("flight_date").alias("date_end"),
    ).select(
        "*", size(exact, "exact_period_rows"), size(pattern, "pattern_period_rows"),
        size(exclusions, "pattern_exclusion_rows"),
    )
    ratio = lambda c: F.round(F.col("source_rows") / F.col(c), 6)
    return base.select(
        "*", ratio("exact_period_rows").alias("exact_row_ratio"),
        ratio("pattern_period_rows").alias("pattern_row_ratio"),
    )
