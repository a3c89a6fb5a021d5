"""Schedule payload texts derived from the flights, one lookup response per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaycohorts.functions import clock
from delaycohorts.sources import driver_tables as dt


def payload_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_key, requested_number, requested_date, body``: a JSON array per flight record."""
    f = dt.flights(spark, sf_dir)
    k = F.col("l_orderkey") % 20
    local = lambda m: F.concat(
        F.date_format("flight_date", "yyyy-MM-dd"), F.lit("T"), clock.minutes_text(F.col(m), ":"), F.lit(":00")
    )
    number = F.concat(F.lower("reporting_carrier"), F.lit(" "), F.col("flight_number"))
    item = F.struct(
        F.when(k == 0, F.lit(None).cast("string")).otherwise(number).alias("number"),
        F.when(k < 10, "Expected").alias("status"),
        F.concat(F.col("reporting_carrier"), F.col("flight_number")).alias("callSign"),
        F.when(k % 2 == 0, "IsOperator").otherwise("IsCodeshared").alias("codeshareStatus"),
        F.struct(F.when(k < 15, F.col("reporting_carrier")).alias("iata")).alias("airline"),
        F.struct(F.when(k % 3 == 0, " A320 ").alias("model")).alias("aircraft"),
        F.struct(
            F.struct(F.when(k != 1, F.lower("origin")).alias("iata")).alias("airport"),
            F.struct(local("crs_departure_minutes").alias("local")).alias("scheduledTime"),
            F.when(k % 4 == 0, "T1").alias("terminal"),
            F.lit(None).cast("string").alias("gate"),
            F.array(F.lit("Basic"), F.lit("Live")).alias("quality"),
        ).alias("departure"),
        F.struct(
            F.struct(F.col("destination").alias("iata")).alias("airport"),
            F.struct(F.when(k == 2, "soon").otherwise(local("crs_arrival_minutes")).alias("local")).alias("scheduledTime"),
            F.when(k % 5 == 0, "B").alias("terminal"),
            F.when(k % 7 == 0, "22").alias("gate"),
            F.array(F.lit("Basic")).alias("quality"),
        ).alias("arrival"),
    )
    body = (
        F.when(k == 3, "[]")
        .when(k == 4, F.to_json(F.array(item, item)))
        .when(k == 5, '{"message": "not an array"}')
        .when(k == 6, "[{broken")
        .otherwise(F.to_json(F.array(item)))
    )
    return f.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("request_key"),
        F.concat(F.lower("reporting_carrier"), F.col("flight_number")).alias("requested_number"),
        F.col("flight_date").alias("requested_date"),
        body.alias("body"),
    )
