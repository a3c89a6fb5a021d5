"""Flights, raw text rows, itineraries and payloads derived from the given tables.

The monthly government files are not part of the test data, so every registered query
reads these derivations. They are plain projections over joins: the work grows with
``lineitem`` and ``orders``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaycohorts.functions import clock
from delaycohorts.schema import LEG_FIELDS, RAW_WIDE_FIELDS, SCHEDULE_COLUMNS
from delaycohorts.session import short_methods

CARRIERS = "AADLUAWNB6"
AIRPORTS = "ATLBOSDENJFKLAXORD"

# Zone rows of the airports that occur in the derived tables.
AIRPORT_ROWS = (
    ("ATL", "Atlanta", "Hartsfield Jackson", "US", "America/New_York"),
    ("BOS", "Boston", "Logan", "US", "America/New_York"),
    ("DEN", "Denver", "Denver", "US", "America/Denver"),
    ("JFK", "New York", "Kennedy", "US", "America/New_York"),
    ("LAX", "Los Angeles", "Los Angeles", "US", "America/Los_Angeles"),
    ("ORD", "Chicago", "O'Hare", "US", "America/Chicago"),
    ("SFO", "San Francisco", "San Francisco", "US", "America/Los_Angeles"),
    ("YYZ", "Toronto", "Pearson", "CA", "America/Toronto"),
)
AIRPORT_SCHEMA = "code string, city string, name string, country string, tz string"
CARRIER_NAMES = (
    ("AA", "American"), ("DL", "Delta"), ("UA", "United"), ("WN", "Southwest"), ("B6", "JetBlue"),
)


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A given table; how its scan is split is left to the session settings."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def airports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(AIRPORT_ROWS), AIRPORT_SCHEMA)


def carrier_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CARRIER_NAMES), "carrier string, display_name string")


def _pick(text: str, width: int, index: Column) -> Column:
    return F.substring(F.lit(text), (index * width + 1).cast("int"), F.lit(width))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem with the small integers everything else is built from.

    Rows are dealt out by order before anything is derived: a file of one row group is one task, and the
    join with large orders needs this exchange anyway. Orders meet their customers first, so lines are moved once.
    """
    short_methods(spark)
    li = table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag", "l_shipdate",
    ]).repartition("l_orderkey")
    od = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    placed = od.join(cu, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    joined = li.join(placed, li.l_orderkey == placed.o_orderkey).join(su, F.col("l_suppkey") == F.col("s_suppkey"))
    oi = F.col("s_nationkey") % 6
    return joined.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag",
        F.to_date("l_shipdate").alias("flight_date"),
        (F.col("l_suppkey") % 5).cast("int").alias("ci"),
        oi.cast("int").alias("oi"),
        ((oi + 1 + F.col("c_nationkey") % 5) % 6).cast("int").alias("di"),
        (F.col("l_partkey") % 12 + 1).cast("int").alias("fn"),
    )


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed flight records of any status."""
    b = _base(spark, sf_dir)
    m = F.month("flight_date")
    dep = ((F.col("fn") * 97 + F.col("ci") * 53 + F.col("oi") * 131 + (m % 2) * 5) % 1440).cast("int")
    arr = ((F.col("fn") * 97 + F.col("ci") * 53 + F.col("oi") * 131 + 60 + F.col("di") * 25) % 1440).cast("int")
    cancelled = (F.col("l_returnflag") == "R") & (F.col("l_tax") < 0.02)
    diverted = (F.col("l_returnflag") == "N") & (F.col("l_tax") > 0.07)
    delay = F.when(~(cancelled | diverted), F.col("l_quantity").cast("int").cast("double") * 3 - 45)
    return b.select(
        "flight_date",
        F.year("flight_date").alias("year"),
        m.alias("month"),
        clock.iso_weekday(F.col("flight_date")).alias("day_of_week"),
        _pick(CARRIERS, 2, F.col("ci")).alias("reporting_carrier"),
        F.col("fn").cast("string").alias("flight_number"),
        _pick(AIRPORTS, 3, F.col("oi")).alias("origin"),
        _pick(AIRPORTS, 3, F.col("di")).alias("destination"),
        dep.alias("crs_departure_minutes"),
        arr.alias("crs_arrival_minutes"),
        clock.time_bucket(dep).alias("departure_time_bucket"),
        delay.alias("arrival_delay_minutes"),
        cancelled.alias("cancelled"),
        diverted.alias("diverted"),
        F.when(cancelled, "cancelled").when(diverted, "diverted").otherwise("completed").alias("flight_status"),
        F.concat(F.lit("m_"), F.year("flight_date").cast("string"), F.lit("_"), m.cast("string")).alias("source_file"),
        "l_orderkey", "l_linenumber",
    )


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated schedule facts, duplicates kept."""
    return flights(spark, sf_dir).select(*SCHEDULE_COLUMNS)


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows as a monthly file would hold them, with damaged values mixed in."""
    f = flights(spark, sf_dir)
    k = F.col("l_orderkey") % 97
    dep = F.when(k == 1, "2400").when(k == 2, "2460").when(k == 3, "").when(
        k == 4, F.concat(clock.minutes_text(F.col("crs_departure_minutes")), F.lit(".00"))
    ).otherwise(clock.minutes_text(F.col("crs_departure_minutes")))
    delay = F.when(k == 12, "1500.00").otherwise(
        F.coalesce(F.col("arrival_delay_minutes").cast("int").cast("string"), F.lit(""))
    )
    return f.select(
        F.when(k == 5, "2024-13-01").otherwise(F.date_format("flight_date", "yyyy-MM-dd")).alias("FlightDate"),
        F.when(k == 6, F.lit("9")).otherwise(F.col("day_of_week").cast("string")).alias("DayOfWeek"),
        F.when(k == 7, F.concat(F.lit(" "), F.lower("reporting_carrier"), F.lit(" ")))
        .otherwise(F.col("reporting_carrier")).alias("Reporting_Airline"),
        F.when(k == 8, " ").otherwise(F.col("flight_number")).alias("Flight_Number_Reporting_Airline"),
        F.when(k == 9, "A1X").when(k == 10, F.lit(None).cast("string")).otherwise(F.col("origin")).alias("Origin"),
        F.col("destination").alias("Dest"),
        dep.alias("CRSDepTime"),
        clock.minutes_text(F.col("crs_arrival_minutes")).alias("CRSArrTime"),
        F.col("l_linenumber").cast("string").alias("DepDelay"),
        delay.alias("ArrDelay"),
        F.when(k == 11, "2").otherwise(F.col("cancelled").cast("int").cast("string")).alias("Cancelled"),
        F.when(k == 13, "1").otherwise(F.concat(F.col("diverted").cast("int").cast("string"), F.lit(".00"))).alias("Diverted"),
        F.lit("").alias("CarrierDelay"), F.lit("").alias("WeatherDelay"), F.lit("").alias("NASDelay"),
        F.lit("").alias("SecurityDelay"),
        F.when(F.col("arrival_delay_minutes") > 15, "10.0").otherwise("").alias("LateAircraftDelay"),
        "source_file",
    )


def raw_wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows with all wide fields, diversion legs included."""
    f = flights(spark, sf_dir)
    k = F.col("l_orderkey") % 97
    blank = F.lit("")
    diverted = F.col("diverted")
    two_legs = diverted & (F.col("l_linenumber") % 2 == 0)
    values = {name: blank for name in RAW_WIDE_FIELDS}
    values |= {
        "FlightDate": F.when(k == 5, "2024-13-01").otherwise(F.date_format("flight_date", "yyyy-MM-dd")),
        "Reporting_Airline": F.lower("reporting_carrier"),
        "Flight_Number_Reporting_Airline": F.when(k == 8, " ").otherwise(F.col("flight_number")),
        "Tail_Number": F.concat(F.lit("n"), F.col("flight_number")),
        "Origin": F.when(k == 9, "A1X").when(k == 10, F.lit(None).cast("string")).otherwise(F.col("origin")),
        "Dest": F.col("destination"),
        "OriginAirportID": F.when(k == 14, "x").otherwise("10397"),
        "DestAirportID": F.lit("12478"),
        "CRSDepTime": F.when(k == 1, "2400").when(k == 2, "2460").otherwise(clock.minutes_text(F.col("crs_departure_minutes"))),
        "DepTime": F.when(k == 15, "bad").otherwise(clock.minutes_text(F.col("crs_departure_minutes"))),
        "CRSArrTime": clock.minutes_text(F.col("crs_arrival_minutes")),
        "ArrTime": F.when(k == 16, "2460").otherwise(clock.minutes_text(F.col("crs_arrival_minutes"))),
        "DepDelay": F.col("l_linenumber").cast("string"),
        "ArrDelay": F.coalesce(F.col("arrival_delay_minutes").cast("int").cast("string"), blank),
        "Cancelled": F.when(k == 11, "2").otherwise(F.col("cancelled").cast("int").cast("string")),
        "Diverted": F.col("diverted").cast("int").cast("string"),
        "CancellationCode": F.when(F.col("cancelled"), " b ").otherwise(""),
        "TaxiOut": F.lit("12.0"),
        "WheelsOff": F.lit("2115"),
        "Distance": F.lit("760"),
        "DivAirportLandings": F.when(two_legs, "2").when(diverted, "1").otherwise("0"),
        "DivReachedDest": F.when(diverted, "1.00").otherwise(""),
        "Div1Airport": F.when(diverted, " fll ").otherwise(""),
        "Div1AirportID": F.when(diverted, "11697").otherwise(""),
        "Div1WheelsOn": F.when(diverted, "2400").otherwise(""),
        "Div1TotalGTime": F.when(diverted, "33.0").otherwise(""),
        "Div2Airport": F.when(two_legs, "mia").otherwise(""),
        "Div2WheelsOff": F.when(two_legs, "2359").otherwise(""),
        "Div2TailNum": F.when(two_legs, "n9").otherwise(""),
    }
    return f.select(*[values[n].alias(n) for n in RAW_WIDE_FIELDS], "source_file")


def itineraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One two-leg request per order, including malformed and impossible ones."""
    od = table(spark, sf_dir, "orders")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.col("o_orderkey")
    ci = (k % 5).cast("int")
    oi = (F.col("c_nationkey") % 6).cast("int")
    xi = ((oi + 1 + F.col("o_custkey") % 5) % 6).cast("int")
    zi = ((xi + 1 + k % 5) % 6).cast("int")
    dep = ((k * 37 + ci * 11) % 1440).cast("int")
    arr = ((dep + 60 + (k % 7) * 45) % 1440).cast("int")
    layover = F.when(k % 29 == 0, 10).when(k % 31 == 0, 800).otherwise(20 + (k % 11) * 35).cast("int")
    carrier = F.when((k % 40).isin(7, 13), "ZZ").otherwise(_pick(CARRIERS, 2, ci))
    connection = F.when((k % 40).isin(7, 11), "SFO").otherwise(_pick(AIRPORTS, 3, xi))
    origin = _pick(AIRPORTS, 3, oi)
    ahead = F.when(k % 10 == 3, 200).otherwise(30)
    base = od.join(cu, od.o_custkey == cu.c_custkey).select(
        k.alias("request_id"),
        carrier.alias("carrier"), origin.alias("origin"), connection.alias("connection"),
        _pick(AIRPORTS, 3, zi).alias("destination"),
        F.date_add(F.to_date("o_orderdate"), ahead).alias("travel_date"),
        dep.alias("departure_minutes"), arr.alias("arrival_minutes"),
        ((arr + layover) % 1440).cast("int").alias("connecting_minutes"),
        layover.alias("layover_minutes"),
    )
    return base.select(
        "*",
        F.when(F.col("request_id") % 101 == 5, "A*").when(
            F.col("request_id") % 103 == 1, F.concat(F.lit(" "), F.lower("carrier"))
        ).otherwise(F.col("carrier")).alias("carrier_text"),
        F.when(
            F.col("request_id") % 107 == 2,
            F.concat(clock.minutes_text(F.col("departure_minutes"), ":"), F.lit(":30")),
        ).otherwise(clock.minutes_text(F.col("departure_minutes"), ":")).alias("first_departure_time"),
        clock.minutes_text(F.col("arrival_minutes"), ":").alias("first_arrival_time"),
        clock.minutes_text(F.col("connecting_minutes"), ":").alias("connecting_departure_time"),
    )


def requests_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request columns a caller would send."""
    return itineraries(spark, sf_dir).select(
        "request_id", F.col("carrier_text").alias("carrier"), "origin", "connection", "destination",
        "travel_date", "first_departure_time", "first_arrival_time", "connecting_departure_time",
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First legs of the itineraries as prediction cases."""
    return itineraries(spark, sf_dir).select(
        F.col("request_id").alias("case_id"),
        F.col("carrier"), F.col("origin"), F.col("connection").alias("destination"),
        F.col("travel_date").alias("prediction_date"),
        "departure_minutes", "arrival_minutes", "layover_minutes",
    )


def lookup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup requests from orders: some with optional filters, some without a match."""
    k = F.col("request_id")
    return itineraries(spark, sf_dir).select(
        F.col("request_id").alias("lookup_id"),
        F.lower("carrier").alias("carrier"),
        F.concat(F.lit(" "), (k % 12 + 1).cast("string")).alias("flight_number"),
        F.col("travel_date").cast("string").alias("flight_date"),
        F.when(k % 3 == 0, F.col("origin")).alias("origin"),
        F.when(k % 17 == 0, F.col("connection")).alias("destination"),
        F.lit(None).cast("int").alias("departure_minutes"),
    )


def careless_lookup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup requests with missing, malformed and out-of-range fields among them."""
    k = F.col("lookup_id")
    spoil = lambda every, rest, value, column: F.when(k % every == rest, F.lit(value)).otherwise(F.col(column))
    return lookup_keys(spark, sf_dir).withColumns({
        "carrier": spoil(101, 1, "  ", "carrier"), "flight_number": spoil(103, 2, None, "flight_number"),
        "flight_date": F.when(k % 107 == 3, F.replace("flight_date", F.lit("-"), F.lit("/"))).when(k % 107 == 4, F.concat(F.substring("flight_date", 1, 8), F.lit("32"))).otherwise(F.col("flight_date")),
        "origin": spoil(109, 4, "J1K", "origin"), "destination": spoil(113, 5, "BOST", "destination"),
        "departure_minutes": F.when(k % 127 == 6, (k % 3000).cast("int")),
    })


def response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider response log made of the event stream."""
    e = table(spark, sf_dir, "events")
    k = (F.col("event_id") % 12).cast("int")
    status = (
        F.when(k == 0, 204).when(k == 1, 401).when(k == 2, 402).when(k == 3, 403).when(k == 4, 403)
        .when(k == 5, 429).when(k == 6, 408).when(k == 7, 504).when(k == 8, 500).otherwise(200)
    )
    body = (
        F.when(k == 0, "")
        .when(k == 3, F.concat(F.lit('{"code":"QUOTA_EXCEEDED","at":'), F.col("props"), F.lit("}")))
        .when(k == 4, F.concat(F.lit("<html>Access Denied "), F.col("event_type"), F.lit("</html>")))
        .when(k == 5, F.concat(F.lit("Forbidden by cloudflare "), F.col("event_type")))
        .when(k == 8, F.concat(F.lit('{"error": "bad'), F.col("event_type")))
        .otherwise(F.col("props"))
    )
    return e.select("event_id", status.cast("int").alias("status"), body.alias("body"),
                    F.when(k == 5, "text/plain").when(k == 4, "text/html").otherwise("application/json").alias("content_type"))
