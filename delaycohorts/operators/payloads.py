"""External schedule payloads: normalising, grading, study plans, log redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaycohorts.functions import buckets, codes, text

# Optional candidate fields whose completeness is graded.
OPTIONAL_FIELDS = (
    "departure_terminal", "arrival_terminal", "departure_gate", "arrival_gate", "aircraft_type",
    "quality", "status", "codeshare_status", "operating_carrier", "operating_flight_number",
)
MAX_STUDY_LOOKUPS, UNITS_PER_LOOKUP = 30, 2

_END = "struct<airport:struct<iata:string>, scheduledTime:struct<local:string>, terminal:string, gate:string, quality:array<string>>"
_ITEM = (
    "struct<number:string, status:string, callSign:string, codeshareStatus:string, airline:struct<iata:string>, "
    f"aircraft:struct<model:string>, departure:{_END}, arrival:{_END}>"
)


def explode_payloads(log: DataFrame) -> DataFrame:
    """One row per candidate object; a body that is no JSON array keeps one row with a reason.

    A body is parsed once, into a VARIANT that lives for this row only, and its items are read off it in one
    cast. Null items are kept, as an array may hold them; any other item has to be an object. Only an array
    in which an item came out null is taken apart once more, to tell the two.
    """
    parsed = log.select("request_key", "requested_number", "requested_date", F.try_parse_json("body").alias("_body"))
    typed = parsed.withColumn("_items", F.try_variant_get("_body", "$", f"array<{_ITEM}>"))
    no_object = lambda v: ~F.is_variant_null(v) & F.try_variant_get(v, "$", _ITEM).isNull()
    reason = (
        F.when(F.col("_body").isNull(), "malformed_json").when(F.col("_items").isNull(), "not_an_array")
        .when(F.exists("_items", lambda x: x.isNull()), F.when(F.exists(F.try_variant_get("_body", "$", "array<variant>"), no_object), "non_object_item"))
    )
    tagged = typed.select("request_key", "requested_number", "requested_date", reason.alias("reject"), "_items")
    return tagged.select(
        "request_key", "requested_number", "requested_date", "reject",
        F.posexplode_outer(F.when(F.col("reject").isNull(), F.col("_items"))).alias("item_index", "item"),
    )


def _local_time(c: Column) -> Column:
    """Wall clock of an ISO local time, its offset left off."""
    wall = F.regexp_replace(codes.norm_text(c), r"(Z|[+-]\d{2}:\d{2})\z", "")
    return F.replace(wall, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")


def _offset_minutes(c: Column) -> Column:
    """UTC offset written at the end of an ISO time, null when there is none."""
    tail = F.regexp_extract(codes.norm_text(c), r"(Z|[+-]\d{2}:\d{2})\z", 1)
    minutes = F.substring(tail, 2, 2).try_cast("int") * 60 + F.substring(tail, 5, 2).try_cast("int")
    return F.when(tail == "Z", 0).when(tail != "", F.when(F.startswith(tail, F.lit("-")), -minutes).otherwise(minutes))


def normalize_payloads(log: DataFrame, source: str = "schedule_api") -> DataFrame:
    """Payload log to candidates with a fixed order per request, rejects kept with a reason."""
    x = explode_payloads(log)
    t = lambda path: codes.norm_text(F.col(f"item.{path}"))
    number = F.coalesce(t("number"), F.col("requested_number"))
    from_number = F.regexp_extract(F.upper(number), r"\A([A-Z0-9]{2,3})\s?\d", 1)
    carrier = F.coalesce(t("airline.iata"), F.nullif(from_number, F.lit("")))
    departure, arrival = _local_time(F.col("item.departure.scheduledTime.local")), _local_time(F.col("item.arrival.scheduledTime.local"))
    bad_time = (t("departure.scheduledTime.local").isNotNull() & departure.isNull()) | (
        t("arrival.scheduledTime.local").isNotNull() & arrival.isNull()
    )
    origin, destination = t("departure.airport.iata"), t("arrival.airport.iata")
    missing = carrier.isNull() | origin.isNull() | destination.isNull() | departure.isNull() | arrival.isNull()
    has_item = F.col("item").isNotNull()
    reason = F.coalesce(
        F.col("reject"), F.when(has_item & bad_time, "invalid_local_time"),
        F.when(has_item & missing, "missing_required_fields"),
    )
    operates = t("codeshareStatus") == "IsOperator"
    tags = lambda end: F.transform(
        F.coalesce(F.array_compact(F.col(f"item.{end}.quality")), F.array().cast("array<string>")),
        lambda q: F.concat(F.lit(f"{end}:"), q),
    )
    rows = x.select(
        "request_key", "requested_number", "requested_date", "item_index", reason.alias("reject_reason"),
        F.lit(source).alias("source"), F.coalesce(F.to_date(departure), F.col("requested_date")).alias("flight_date"),
        F.when(has_item, F.upper(carrier)).alias("marketing_carrier"),
        F.when(has_item, F.upper(number)).alias("marketing_flight_number"),
        F.when(operates, F.upper(carrier)).alias("operating_carrier"),
        F.when(operates, F.upper(number)).alias("operating_flight_number"),
        F.upper(origin).alias("origin_iata"), F.upper(destination).alias("destination_iata"),
        departure.alias("scheduled_departure_local"), arrival.alias("scheduled_arrival_local"),
        _offset_minutes(F.col("item.departure.scheduledTime.local")).alias("departure_offset"),
        _offset_minutes(F.col("item.arrival.scheduledTime.local")).alias("arrival_offset"),
        t("departure.terminal").alias("departure_terminal"), t("arrival.terminal").alias("arrival_terminal"),
        t("departure.gate").alias("departure_gate"), t("arrival.gate").alias("arrival_gate"),
        t("status").alias("status"), F.concat(tags("departure"), tags("arrival")).alias("quality"),
        t("codeshareStatus").alias("codeshare_status"), t("aircraft.model").alias("aircraft_type"),
        t("callSign").alias("raw_provider_id"), has_item.alias("has_item"),
    )
    return rows


def candidates_of(normalized: DataFrame) -> DataFrame:
    """The usable candidates; one bad item rejects its whole response."""
    bad = normalized.where("reject_reason is not null").select("request_key").distinct()
    return normalized.where("has_item and reject_reason is null").join(bad, "request_key", "left_anti").drop("has_item", "reject_reason")


def lookup_outcome(normalized: DataFrame) -> DataFrame:
    """no_match, unique_match, multiple_candidates or the first reject per request."""
    n = F.count_if(F.col("has_item"))
    bad = F.min(F.when(F.col("reject_reason").isNotNull(), F.struct(F.coalesce("item_index", F.lit(0)).alias("i"), "reject_reason")))
    grouped = normalized.groupBy("request_key").agg(n.alias("n"), bad.alias("bad"))
    size = F.col("n")
    outcome = (
        F.when(F.col("bad").isNotNull(), F.when(F.col("bad.reject_reason") == "missing_required_fields", "missing_required_fields").otherwise("malformed_response"))
        .when(size == 0, "no_match").when(size == 1, "unique_match").otherwise("multiple_candidates")
    )
    return grouped.select("request_key", outcome.alias("outcome"), F.when(F.col("bad").isNull(), size).otherwise(0).cast("bigint").alias("candidate_count"))


def check_study_rows(rows: DataFrame, reference: Column) -> DataFrame:
    """Study rows with normalised fields, horizon and a reason when a rule fails."""
    number = F.upper(F.replace(F.coalesce("flight_number", F.lit("")), F.lit(" "), F.lit("")))
    prefix = F.regexp_extract(number, codes.STUDY_NUMBER_SHAPE, 1)
    airline = codes.norm_code(F.coalesce("airline", prefix))
    day = F.col("flight_date").try_cast("date")
    named = F.coalesce(F.trim("confirmation_source"), F.lit("")) != ""
    checked = rows.select(
        number.alias("flight_number"), day.alias("flight_date"), airline.alias("airline"),
        buckets.horizon_bucket(day, reference).alias("horizon"),
        F.when(prefix == "", "flight_number").when(airline != prefix, "airline")
        .when(~(F.coalesce("manually_confirmed", F.lit(False)) & named), "not_confirmed")
        .when(day.isNull(), "flight_date").when(day < reference, "historical").alias("reason"),
    )
    return checked


def study_plan(checked: DataFrame, max_lookups: int = MAX_STUDY_LOOKUPS) -> DataFrame:
    """Long plan: totals, counts by airline and horizon, and the rules that are violated."""
    counted = checked.groupingSets([[], ["airline"], ["horizon"]], "airline", "horizon").agg(
        F.grouping_id("airline", "horizon").alias("g"), F.count("*").alias("n"), F.count("reason").alias("bad")
    )
    g = F.col("g")
    sections = counted.select(
        F.when(g == 3, "total").when(g == 1, "airline").otherwise("horizon").alias("section"),
        F.when(g == 3, "planned_requests").when(g == 1, F.col("airline")).otherwise(F.col("horizon")).alias("item"),
        F.col("n").cast("bigint").alias("value"),
    )
    pairs = checked.groupBy("flight_number", "flight_date").agg(F.count("*").alias("n"), F.count("reason").alias("bad"))
    rules = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("dup"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("bad"),
    )
    entries = F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), value.cast("bigint").alias("value"))
        for section, item, value in (
            ("total", "maximum_units", F.col("n") * UNITS_PER_LOOKUP),
            ("violation", "duplicate_candidates", F.col("dup")),
            ("violation", "unusable_rows", F.col("bad")),
            ("violation", "empty_study", (F.col("n") == 0).cast("int")),
            ("violation", "over_request_cap", F.greatest(F.col("n") - max_lookups, F.lit(0))),
        )
    ])
    return sections.unionByName(rules.select(F.explode(entries).alias("e")).select("e.*"))


def provider_coverage(lookups: DataFrame, candidates: DataFrame) -> DataFrame:
    """Outcome counts and field completeness, in total and by airline and horizon.

    ``lookups``: request_key, airline, horizon, outcome. ``candidates``: request_key + fields.
    """
    has = lambda c: (F.size(c) > 0) if c == "quality" else F.col(c).isNotNull()
    filled = candidates.groupBy("request_key").agg(
        F.count("*").alias("returned"), *[F.count_if(has(c)).alias(f"has_{c}") for c in OPTIONAL_FIELDS]
    )
    rows = lookups.join(filled, "request_key", "left")
    outcomes = ("no_match", "unique_match", "multiple_candidates", "missing_required_fields", "malformed_response", "provider_error")
    grouped = rows.groupingSets([[], ["airline"], ["horizon"]], "airline", "horizon").agg(
        F.grouping_id("airline", "horizon").alias("g"), F.count("*").cast("bigint").alias("attempted"),
        *[F.count_if(F.col("outcome") == o).cast("bigint").alias(o) for o in outcomes],
        F.coalesce(F.sum("returned"), F.lit(0)).cast("bigint").alias("returned_candidates"),
        *[F.sum(f"has_{c}").alias(f"has_{c}") for c in OPTIONAL_FIELDS],
    )
    g = F.col("g")
    base = F.nullif(F.col("returned_candidates"), F.lit(0))
    return grouped.select(
        F.when(g == 3, "total").when(g == 1, "airline").otherwise("horizon").alias("dimension"),
        F.when(g == 3, "all").when(g == 1, F.col("airline")).otherwise(F.col("horizon")).alias("value"),
        "attempted", *outcomes, "returned_candidates",
        *[F.round(F.lit(100) * F.col(f"has_{c}") / base, 3).alias(f"{c}_percent") for c in OPTIONAL_FIELDS],
    )


def grade_responses(log: DataFrame) -> DataFrame:
    """Sanitised diagnostics of a response log; every body is parsed once."""
    body, kind, parsed = F.col("body"), F.col("body_kind"), F.col("_parsed")
    read = log.withColumn("_parsed", text.parsed_json(body))
    known = read.withColumn("body_kind", text.body_kind(body, F.col("content_type"), parsed))
    return known.select(
        "event_id", "status", text.classify_response(F.col("status"), parsed).alias("outcome"), "body_kind",
        F.when(kind.isin("html", "text"), text.body_marker(body)).alias("body_marker"),
        F.when(kind == "json", text.error_code(parsed)).alias("error_code"),
        F.octet_length(body).cast("int").alias("body_length"),
    )


def log_values(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``key`` with what of a whole text may be logged: bounded metadata (null if secret) and message (redacted if secret)."""
    return df.select(key, text.safe_metadata(F.col(column)).alias("metadata"), text.safe_message(F.col(column)).alias("message"))


def flag_secrets(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``secret_bearing`` for the whole text."""
    return df.withColumn("secret_bearing", text.looks_secret(F.col(column)))


def redact(df: DataFrame, column: str, secrets: list[str]) -> DataFrame:
    return df.withColumn(column, text.redact(F.col(column), secrets))
