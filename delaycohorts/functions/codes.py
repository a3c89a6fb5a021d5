"""Text normalisation, flags, identities and stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted shapes of codes and flight numbers.
CARRIER_SHAPE = r"\A[A-Z0-9]{2,3}\z"
AIRPORT_SHAPE = r"\A[A-Z]{3}\z"
FLIGHT_NUMBER_SHAPE = r"\A([A-Z0-9]{2,3})\s?\d{1,4}[A-Z]?\z"
STUDY_NUMBER_SHAPE = r"\A([A-Z0-9]{2})\d{1,4}[A-Z]?\z"


def norm_code(c: Column) -> Column:
    return F.upper(F.trim(c))


def norm_text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def flag01(c: Column) -> Column:
    """Text 0/1 (also '1.00') to boolean, anything else null."""
    number = norm_text(c).try_cast("double")
    return F.when(number.isin(0.0, 1.0), number == 1.0)


def stable_hash(*parts: Column | str) -> Column:
    """Engine-independent order key: md5 over the parts written as text."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))


def uniform01(*parts: Column | str) -> Column:
    """Number in [0, 1) from the first 32 bits of the stable hash."""
    word = F.conv(F.substring(stable_hash(*parts), 1, 8), 16, 10).cast("double")
    return word / F.lit(4294967296.0)


def hash_int(*parts: Column | str) -> Column:
    return F.conv(F.substring(stable_hash(*parts), 1, 15), 16, 10).cast("bigint")


def itinerary_key(
    carrier: Column, origin: Column, connection: Column, destination: Column, travel_date: Column,
    first_departure: Column, first_arrival: Column, connecting_departure: Column,
    model_version: str = "v1",
) -> Column:
    """Canonical compact JSON identity with alphabetically ordered fields."""
    if not model_version.strip():
        raise ValueError("model version must not be empty")
    hhmm = lambda c: F.substring(c, 1, 5)
    return F.to_json(
        F.struct(
            norm_code(carrier).alias("carrier"),
            hhmm(connecting_departure).alias("connecting_departure_time"),
            norm_code(connection).alias("connection"),
            norm_code(destination).alias("destination"),
            hhmm(first_arrival).alias("first_arrival_time"),
            hhmm(first_departure).alias("first_departure_time"),
            F.lit(model_version.strip().lower()).alias("model_version"),
            norm_code(origin).alias("origin"),
            F.date_format(travel_date, "yyyy-MM-dd").alias("travel_date"),
        )
    )


def itinerary_seed(key: Column) -> Column:
    """First 8 bytes of SHA-256 as an unsigned 64-bit number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def parse_flight_number(c: Column) -> Column:
    """Struct(number, carrier): blanks stripped, upper case; both null when malformed."""
    number = F.upper(F.regexp_replace(c, " ", ""))
    ok = number.rlike(FLIGHT_NUMBER_SHAPE)
    carrier = F.regexp_extract(number, r"\A([A-Z0-9]{2,3})\s?\d", 1)
    return F.struct(
        F.when(ok, number).alias("number"),
        F.when(ok, carrier).alias("carrier"),
    )
