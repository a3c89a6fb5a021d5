"""Typed records, quality counters and the completed history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from delaycohorts.functions import buckets, clock, codes
from delaycohorts.operators.topn import top_n_per_group
from delaycohorts.schema import (
    FLIGHT_KEY, HISTORY_COLUMNS, MAX_LEGS, RAW_FIELDS, RAW_WIDE_FIELDS, SCHEDULE_COLUMNS,
    SERVING_COLUMNS,
)
from delaycohorts.sources.files import require_columns


def _number(name: str) -> Column:
    """Number from text; blanks become null before the cast, which would raise and catch for each."""
    return codes.norm_text(F.col(name)).try_cast("double")


def _all(*conditions: Column) -> Column:
    """AND where an unknown condition counts as failed, so valid + invalid = all rows."""
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def _core_conditions() -> list[Column]:
    return [
        F.col("FlightDate").try_cast("date").isNotNull(),
        codes.norm_code(F.col("Reporting_Airline")).rlike(codes.CARRIER_SHAPE),
        codes.norm_code(F.col("Origin")).rlike(codes.AIRPORT_SHAPE),
        codes.norm_code(F.col("Dest")).rlike(codes.AIRPORT_SHAPE),
        clock.hhmm_valid(F.col("CRSDepTime")),
        clock.hhmm_valid(F.col("CRSArrTime")),
        codes.flag01(F.col("Cancelled")).isNotNull(),
        codes.flag01(F.col("Diverted")).isNotNull(),
    ]


def valid_record() -> Column:
    weekday = F.col("DayOfWeek").try_cast("int")
    actual = clock.iso_weekday(F.col("FlightDate").try_cast("date"))
    return _all(*_core_conditions(), weekday == actual)


def valid_record_wide() -> Column:
    ids = [F.col(c).try_cast("int").isNotNull() for c in ("OriginAirportID", "DestAirportID")]
    return _all(*_core_conditions(), *ids)


def flight_status() -> Column:
    return (
        F.when(codes.flag01(F.col("Cancelled")), "cancelled")
        .when(codes.flag01(F.col("Diverted")), "diverted")
        .when(_number("ArrDelay").isNull(), "missing_arrival_delay")
        .otherwise("completed")
    )


def _valid_only(parsed: DataFrame, valid: Column, columns: list[Column]) -> DataFrame:
    """``columns`` of the valid rows.

    Written as a generator: a filter would be moved below the parsing and parse everything a second time. It
    only drops rows; the columns stand above it, so those that a caller does not read are not computed.
    """
    return parsed.select("*", F.explode(F.when(valid, F.array(F.lit(True)))).alias("_valid")).select(*columns)


def _core_values() -> dict[str, Column]:
    """What several columns and conditions need, computed once per row."""
    return {
        "_day": F.col("FlightDate").try_cast("date"), "_carrier": codes.norm_code(F.col("Reporting_Airline")),
        "_origin": codes.norm_code(F.col("Origin")), "_dest": codes.norm_code(F.col("Dest")),
        "_dep": clock.hhmm_number(F.col("CRSDepTime")), "_arr": clock.hhmm_number(F.col("CRSArrTime")),
        "_cancelled": codes.flag01(F.col("Cancelled")), "_diverted": codes.flag01(F.col("Diverted")), "_delay": _number("ArrDelay"),
    }


def _core_valid() -> list[Column]:
    return [
        F.col("_day").isNotNull(), F.col("_carrier").rlike(codes.CARRIER_SHAPE), F.col("_origin").rlike(codes.AIRPORT_SHAPE),
        F.col("_dest").rlike(codes.AIRPORT_SHAPE), clock.on_clock(F.col("_dep")), clock.on_clock(F.col("_arr")),
        F.col("_cancelled").isNotNull(), F.col("_diverted").isNotNull(),
    ]


def _core_record(raw: DataFrame) -> tuple[DataFrame, Column, list[Column]]:
    """Rows with their parsed values, whether they are valid, and the 22 columns of a record."""
    require_columns(raw, RAW_FIELDS)
    parsed = raw.select("*", *[c.alias(n) for n, c in _core_values().items()])
    day, delay = F.col("_day"), F.col("_delay")
    departure = clock.clock_minutes(F.col("_dep"))
    weekday = clock.iso_weekday(day)
    status = (
        F.when(F.col("_cancelled"), "cancelled").when(F.col("_diverted"), "diverted")
        .when(delay.isNull(), "missing_arrival_delay").otherwise("completed")
    )
    return parsed, _all(*_core_valid(), F.col("DayOfWeek").try_cast("int") == weekday), [
        day.alias("flight_date"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        weekday.alias("day_of_week"),
        F.col("_carrier").alias("reporting_carrier"),
        codes.norm_text(F.col("Flight_Number_Reporting_Airline")).alias("flight_number"),
        F.col("_origin").alias("origin"),
        F.col("_dest").alias("destination"),
        departure.alias("crs_departure_minutes"),
        clock.clock_minutes(F.col("_arr")).alias("crs_arrival_minutes"),
        clock.time_bucket(departure).alias("departure_time_bucket"),
        _number("DepDelay").alias("departure_delay_minutes"),
        delay.alias("arrival_delay_minutes"),
        F.col("_cancelled").alias("cancelled"),
        F.col("_diverted").alias("diverted"),
        status.alias("flight_status"),
        _number("CarrierDelay").alias("carrier_delay_minutes"),
        _number("WeatherDelay").alias("weather_delay_minutes"),
        _number("NASDelay").alias("nas_delay_minutes"),
        _number("SecurityDelay").alias("security_delay_minutes"),
        _number("LateAircraftDelay").alias("late_aircraft_delay_minutes"),
        buckets.delay_outlier(delay).alias("arrival_delay_outlier"),
    ]


def clean_flights(raw: DataFrame) -> DataFrame:
    """Valid records of any status, 23 typed columns. Narrow: no shuffle."""
    parsed, valid, columns = _core_record(raw)
    return _valid_only(parsed, valid, [*columns, F.col("source_file")])


def judged_flights(raw: DataFrame) -> DataFrame:
    """Every raw row as ``source_file`` and ``record``, its cleaned columns, null where the row is invalid."""
    parsed, valid, columns = _core_record(raw)
    return parsed.select(F.when(valid, F.struct(*columns)).alias("record"), "source_file")


def quality_of_judged(judged: DataFrame) -> DataFrame:
    """What ``quality_by_source`` counts, from judged rows."""
    count = lambda condition, name: F.count_if(condition).cast("bigint").alias(name)
    record = F.col("record")
    return judged.groupBy("source_file").agg(
        F.count("*").cast("bigint").alias("source_rows"),
        count(record.isNotNull(), "cleaned_rows"),
        count(record["flight_status"] == "completed", "completed_flights"),
        count(record["cancelled"], "cancelled_flights"),
        count(record["diverted"], "diverted_flights"),
        count(record.isNotNull() & record["arrival_delay_minutes"].isNull(), "missing_arrival_delay_rows"),
        count(record.isNull(), "invalid_field_rows"),
        count(record["cancelled"] & record["diverted"], "inconsistent_status_rows"),
        count(record["arrival_delay_outlier"], "arrival_delay_outlier_rows"),
    )


def diversion_legs() -> Column:
    """Ordered array of the legs whose airport is present."""

    def leg(i: int) -> Column:
        c = lambda suffix: F.col(f"Div{i}{suffix}")
        airport = codes.norm_text(c("Airport"))
        return F.when(
            airport.isNotNull(),
            F.struct(
                F.lit(i).alias("sequence"),
                F.upper(airport).alias("airport"),
                codes.norm_text(c("AirportID")).try_cast("int").alias("airport_id"),
                codes.norm_text(c("AirportSeqID")).try_cast("bigint").alias("airport_sequence_id"),
                clock.nullable_hhmm(c("WheelsOn")).alias("wheels_on_minutes"),
                codes.norm_text(c("TotalGTime")).try_cast("double").alias("total_ground_minutes"),
                codes.norm_text(c("LongestGTime")).try_cast("double").alias("longest_ground_minutes"),
                clock.nullable_hhmm(c("WheelsOff")).alias("wheels_off_minutes"),
                F.upper(codes.norm_text(c("TailNum"))).alias("tail_number"),
            ),
        )

    return F.array_compact(F.array(*[leg(i) for i in range(1, MAX_LEGS + 1)]))


# target column <- source field, for the plain numeric fields of the wide table
WIDE_NUMBERS = (
    ("departure_delay_minutes", "DepDelay"), ("arrival_delay_minutes", "ArrDelay"),
    ("taxi_out_minutes", "TaxiOut"), ("taxi_in_minutes", "TaxiIn"),
    ("crs_elapsed_minutes", "CRSElapsedTime"), ("actual_elapsed_minutes", "ActualElapsedTime"),
    ("air_time_minutes", "AirTime"), ("distance_miles", "Distance"),
    ("carrier_delay_minutes", "CarrierDelay"), ("weather_delay_minutes", "WeatherDelay"),
    ("nas_delay_minutes", "NASDelay"), ("security_delay_minutes", "SecurityDelay"),
    ("late_aircraft_delay_minutes", "LateAircraftDelay"),
    ("total_additional_ground_minutes", "TotalAddGTime"),
    ("longest_additional_ground_minutes", "LongestAddGTime"),
    ("diversion_actual_elapsed_minutes", "DivActualElapsedTime"),
    ("diversion_arrival_delay_minutes", "DivArrDelay"),
    ("diversion_distance_miles", "DivDistance"),
)
WIDE_CLOCKS = (
    ("departure_minutes", "DepTime"), ("arrival_minutes", "ArrTime"),
    ("wheels_off_minutes", "WheelsOff"), ("wheels_on_minutes", "WheelsOn"),
    ("first_departure_minutes", "FirstDepTime"),
)


def clean_flights_wide(raw: DataFrame) -> DataFrame:
    """Valid records of any status, 40 columns, diversion legs as an array of structs."""
    require_columns(raw, RAW_WIDE_FIELDS)
    ids = {"_origin_id": F.col("OriginAirportID").try_cast("int"), "_dest_id": F.col("DestAirportID").try_cast("int")}
    parsed = raw.select("*", *[c.alias(n) for n, c in (_core_values() | ids).items()])
    return _valid_only(parsed, _all(*_core_valid(), *[F.col(n).isNotNull() for n in ids]), [
        F.col("_day").alias("flight_date"),
        F.col("_carrier").alias("reporting_carrier"),
        codes.norm_text(F.col("Flight_Number_Reporting_Airline")).alias("flight_number"),
        F.upper(codes.norm_text(F.col("Tail_Number"))).alias("tail_number"),
        F.col("_origin").alias("origin"),
        F.col("_dest").alias("destination"),
        F.col("_origin_id").alias("origin_airport_id"),
        F.col("_dest_id").alias("destination_airport_id"),
        clock.clock_minutes(F.col("_dep")).alias("crs_departure_minutes"),
        clock.clock_minutes(F.col("_arr")).alias("crs_arrival_minutes"),
        *[clock.nullable_hhmm(F.col(src)).alias(name) for name, src in WIDE_CLOCKS],
        F.col("_cancelled").alias("cancelled"),
        F.col("_diverted").alias("diverted"),
        F.upper(codes.norm_text(F.col("CancellationCode"))).alias("cancellation_code"),
        *[_number(src).alias(name) for name, src in WIDE_NUMBERS],
        F.col("DivAirportLandings").try_cast("int").alias("diversion_airport_landings"),
        codes.flag01(F.col("DivReachedDest")).alias("diversion_reached_destination"),
        diversion_legs().alias("diversion_details"),
        F.col("source_file"),
    ])


def quality_by_source(raw: DataFrame) -> DataFrame:
    """Nine counters per source file, all files in one scan."""
    valid = valid_record()
    cancelled = F.coalesce(codes.flag01(F.col("Cancelled")), F.lit(False))
    diverted = F.coalesce(codes.flag01(F.col("Diverted")), F.lit(False))
    count = lambda condition, name: F.count_if(condition).cast("bigint").alias(name)
    return raw.groupBy("source_file").agg(
        F.count("*").cast("bigint").alias("source_rows"),
        count(valid, "cleaned_rows"),
        count(valid & (flight_status() == "completed"), "completed_flights"),
        count(valid & cancelled, "cancelled_flights"),
        count(valid & diverted, "diverted_flights"),
        count(valid & _number("ArrDelay").isNull(), "missing_arrival_delay_rows"),
        count(~valid, "invalid_field_rows"),
        count(valid & cancelled & diverted, "inconsistent_status_rows"),
        count(valid & buckets.delay_outlier(_number("ArrDelay")), "arrival_delay_outlier_rows"),
    )


def quality_by_source_wide(raw: DataFrame) -> DataFrame:
    valid = valid_record_wide()
    flag = lambda name: F.coalesce(codes.flag01(F.col(name)), F.lit(False))
    count = lambda condition, name: F.count_if(condition).cast("bigint").alias(name)
    return raw.groupBy("source_file").agg(
        F.count("*").cast("bigint").alias("source_rows"),
        count(valid, "retained_rows"),
        count(~valid, "invalid_core_rows"),
        count(
            valid & codes.norm_text(F.col("Flight_Number_Reporting_Airline")).isNull(),
            "missing_flight_number_rows",
        ),
        count(valid & flag("Cancelled"), "cancelled_rows"),
        count(valid & flag("Diverted"), "diverted_rows"),
    )


def upsert_by_source(existing: DataFrame, new: DataFrame, key: str = "source_file") -> DataFrame:
    """New rows replace the existing rows of the same source."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def pending_sources(files: DataFrame, done: DataFrame, key: str = "source_file") -> DataFrame:
    return files.join(done.select(key), key, "left_anti")


def refresh_history(records: DataFrame) -> DataFrame:
    """Completed flights, one row per flight key: the smallest by source, then by content.

    The minimum of a struct is a partial aggregate, so a key holding a third of the rows is
    reduced in the map tasks and never collected.
    """
    done = records.where((F.col("flight_status") == "completed") & F.col("arrival_delay_minutes").isNotNull())
    columns = [*HISTORY_COLUMNS, *[c for c in FLIGHT_KEY if c not in HISTORY_COLUMNS]]
    return first_per_key(done.select(*columns))


def first_per_key(records: DataFrame) -> DataFrame:
    """One record per flight key: the smallest by source file, then by all other columns.

    A number in the last column is first reduced among rows that are equal in all others: an aggregate by hash, while
    the minimum of a struct sorts every row before and after its shuffle. A null is the smallest value.
    """
    rest = [c for c in records.columns if c not in FLIGHT_KEY and c != "source_file"]
    if rest and isinstance(records.schema[rest[-1]].dataType, NumericType):
        last = F.col(rest[-1])
        least = F.when(F.count("*") == F.count(last), F.min(last)).alias(rest[-1])
        records = records.groupBy(*[c for c in records.columns if c != rest[-1]]).agg(least).select(*records.columns)
    keyed = records.withColumn("_hash", F.xxhash64(*FLIGHT_KEY))  # makes sorting and shuffling cheap, the key decides
    picked = keyed.groupBy("_hash", *FLIGHT_KEY).agg(F.min(F.struct("source_file", *rest)).alias("first"))
    return picked.select(*[c if c in FLIGHT_KEY else F.col(f"first.{c}").alias(c) for c in records.columns])


def duplicate_excess(records: DataFrame) -> DataFrame:
    groups = records.groupBy(*FLIGHT_KEY).count().where("count > 1")
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def yearly_status(records: DataFrame) -> DataFrame:
    return records.groupBy("year").agg(
        F.count("*").cast("bigint").alias("source_cleaned"),
        F.count_if(F.col("flight_status") == "completed").cast("bigint").alias("completed"),
        F.count_if("cancelled").cast("bigint").alias("cancelled"),
        F.count_if("diverted").cast("bigint").alias("diverted"),
    )


def development_sample(records: DataFrame, per_stratum: int = 25, salt: str = "dev") -> DataFrame:
    """``per_stratum`` rows of every year/month/carrier/bucket stratum in hash order."""
    order = codes.stable_hash(salt, *[F.col(c) for c in records.columns])
    strata = ("year", "month", "reporting_carrier", "departure_time_bucket")
    return top_n_per_group(records, strata, order, per_stratum)


def limited_load(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """First usable completed rows; the limit is the purpose of this operator."""
    done = clean_flights(raw).where(F.col("flight_status") == "completed").select(*HISTORY_COLUMNS)
    return done if limit is None else done.limit(limit)


def serving_projection(history: DataFrame) -> DataFrame:
    """Eight columns, no filter, same row count."""
    return require_columns(history, SERVING_COLUMNS).select(*SERVING_COLUMNS)


def assert_same_count(source: DataFrame, target: DataFrame) -> None:
    a, b = source.count(), target.count()
    if a != b:
        raise RuntimeError(f"row-count mismatch: source={a}, target={b}")


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash: row count plus two folds of a 60-bit row digest."""
    digest = F.conv(F.substring(codes.stable_hash(*[F.col(c) for c in df.columns]), 1, 15), 16, 10).cast("bigint")
    return df.select(digest.alias("h")).agg(
        F.count("*").cast("bigint").alias("row_count"),
        F.bit_xor("h").cast("bigint").alias("xor_hash"),
        F.sum(F.col("h") % 1000003).cast("bigint").alias("sum_hash"),
    )


def validate_history(history: DataFrame) -> DataFrame:
    require_columns(history, SERVING_COLUMNS)
    if history.isEmpty():
        raise RuntimeError("history is empty")
    return history


def exact_schedule(records: DataFrame) -> DataFrame:
    """Seven-column schedule facts that carry a flight number."""
    return records.where(F.col("flight_number").isNotNull()).select(*SCHEDULE_COLUMNS)


def codes_seen(history: DataFrame) -> DataFrame:
    """Distinct airports at either end of a flight; pairs collapse before the explode."""
    pairs = history.select("origin", "destination").distinct()
    return pairs.select(F.explode(F.array("origin", "destination")).alias("code")).distinct()


def supported_airports(history: DataFrame, airports: DataFrame, countries: tuple[str, ...]) -> DataFrame:
    known = airports.where(F.col("country").isin(*countries) & codes.norm_text(F.col("tz")).isNotNull())
    return codes_seen(history).join(known, "code").select("code", "city", "name", "tz")


def supported_carriers(history: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct carriers with their display name; raises when a name is missing."""
    seen = history.select(F.col("reporting_carrier").alias("carrier")).distinct()
    named = seen.join(names, "carrier", "left")
    label = F.when(F.col("display_name").isNull(), F.raise_error(F.concat(F.lit("no display name for "), F.col("carrier"))))
    return named.select("carrier", label.otherwise(F.col("display_name")).alias("display_name"))


def date_coverage(df: DataFrame) -> DataFrame:
    """First and last date; an empty table is an error."""
    bounds = df.agg(F.min("flight_date").alias("first_date"), F.max("flight_date").alias("last_date"))
    empty = F.raise_error(F.lit("no eligible historical flights: no dated records"))
    return bounds.select(
        F.when(F.col("first_date").isNull(), empty).otherwise(F.col("first_date")).alias("first_date"),
        "last_date",
    )


def route_year_stats(history: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Size, mean and exact quantiles per year and carrier route."""
    if routes is not None:
        history = history.join(routes, ["reporting_carrier", "origin", "destination"], "left_semi")
    key = ("year", "reporting_carrier", "origin", "destination")
    counted = history.groupBy(*key, "arrival_delay_minutes").agg(F.count("*").alias("n"))
    delay = F.col("arrival_delay_minutes")
    return (
        counted.groupBy(*key)
        .agg(
            F.sum("n").cast("bigint").alias("sample_size"),
            (F.sum(delay * F.col("n")) / F.sum("n")).alias("mean_minutes"),
            F.percentile(delay, F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)), F.col("n")).alias("q"),
        )
        .select(
            *key, "sample_size", "mean_minutes",
            F.col("q")[0].alias("median_minutes"), F.col("q")[1].alias("p75_minutes"),
            F.col("q")[2].alias("p90_minutes"),
        )
    )
