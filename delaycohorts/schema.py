"""Column names of the data model. All names here are fixed values."""

from __future__ import annotations

RAW_FIELDS = (
    "FlightDate", "DayOfWeek", "Reporting_Airline", "Flight_Number_Reporting_Airline", "Origin",
    "Dest", "CRSDepTime", "CRSArrTime", "DepDelay", "ArrDelay", "Cancelled", "Diverted",
    "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay",
)
LEG_SUFFIXES = (
    "Airport", "AirportID", "AirportSeqID", "WheelsOn", "TotalGTime", "LongestGTime", "WheelsOff",
    "TailNum",
)
MAX_LEGS = 5
LEG_FIELDS = tuple(f"Div{leg}{s}" for leg in range(1, MAX_LEGS + 1) for s in LEG_SUFFIXES)
RAW_WIDE_FIELDS = (
    "FlightDate", "Reporting_Airline", "Flight_Number_Reporting_Airline", "Tail_Number", "Origin",
    "Dest", "OriginAirportID", "DestAirportID", "CRSDepTime", "DepTime", "CRSArrTime", "ArrTime",
    "DepDelay", "ArrDelay", "Cancelled", "Diverted", "CancellationCode", "TaxiOut", "WheelsOff",
    "WheelsOn", "TaxiIn", "CRSElapsedTime", "ActualElapsedTime", "AirTime", "Distance",
    "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay",
    "FirstDepTime", "TotalAddGTime", "LongestAddGTime", "DivAirportLandings", "DivReachedDest",
    "DivActualElapsedTime", "DivArrDelay", "DivDistance",
) + LEG_FIELDS

FLIGHT_KEY = (
    "flight_date", "reporting_carrier", "flight_number", "origin", "destination",
    "crs_departure_minutes",
)
SERVING_COLUMNS = (
    "flight_date", "month", "day_of_week", "reporting_carrier", "origin", "destination",
    "departure_time_bucket", "arrival_delay_minutes",
)
HISTORY_COLUMNS = (
    "flight_date", "year", "month", "day_of_week", "reporting_carrier", "origin", "destination",
    "crs_departure_minutes", "crs_arrival_minutes", "departure_time_bucket",
    "arrival_delay_minutes", "source_file",
)
SCHEDULE_COLUMNS = (
    "flight_date", "reporting_carrier", "flight_number", "origin", "destination",
    "crs_departure_minutes", "crs_arrival_minutes",
)
SIGNATURE = SCHEDULE_COLUMNS[1:]
ROUTE_KEY = ("reporting_carrier", "flight_number", "origin", "destination")

# Countries whose airports count as domestic.
DOMESTIC_COUNTRIES = ("AS", "GU", "MP", "PR", "US", "VI")
