"""The SQL statements by query name."""

from __future__ import annotations

from delaycohorts.plans import oracle as o
from delaycohorts.plans.oracle import BASE, CONNECTIONS, FLIGHTS, FULL, HIST, ITINS, ONE, REPLAY, SEED, YEARS, md5, q, r, tri, w
from delaycohorts.sources.driver_tables import AIRPORT_ROWS, CARRIER_NAMES

KEY6 = "flight_date, reporting_carrier, flight_number, origin, destination, crs_departure_minutes"
SIG = "reporting_carrier, flight_number, origin, destination, crs_departure_minutes, crs_arrival_minutes"
ROUTE = "reporting_carrier, flight_number, origin, destination"


def values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in row) + ")" for row in rows)


ZONES = f"zones AS (SELECT code, city, name, tz FROM (VALUES {values(AIRPORT_ROWS)}) t(code, city, name, country, tz) WHERE country IN ('AS','GU','MP','PR','US','VI'))"

HHMM = "lpad(CAST({0} // 60 AS VARCHAR), 2, '0') || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"
RAW = f"""
raw AS (
  SELECT CASE WHEN k = 5 THEN '2024-13-01' ELSE CAST(flight_date AS VARCHAR) END AS FlightDate,
    CASE WHEN k = 6 THEN '9' ELSE CAST(day_of_week AS VARCHAR) END AS DayOfWeek,
    CASE WHEN k = 7 THEN ' ' || lower(reporting_carrier) || ' ' ELSE reporting_carrier END AS Reporting_Airline,
    CASE WHEN k = 8 THEN ' ' ELSE flight_number END AS Flight_Number_Reporting_Airline,
    CASE WHEN k = 9 THEN 'A1X' WHEN k = 10 THEN NULL ELSE origin END AS Origin, destination AS Dest,
    CASE WHEN k = 1 THEN '2400' WHEN k = 2 THEN '2460' WHEN k = 3 THEN '' WHEN k = 4 THEN {HHMM.format('crs_departure_minutes')} || '.00' ELSE {HHMM.format('crs_departure_minutes')} END AS CRSDepTime,
    {HHMM.format('crs_arrival_minutes')} AS CRSArrTime, CAST(l_linenumber AS VARCHAR) AS DepDelay,
    CASE WHEN k = 12 THEN '1500.00' ELSE coalesce(CAST(CAST(arrival_delay_minutes AS INT) AS VARCHAR), '') END AS ArrDelay,
    CASE WHEN k = 11 THEN '2' ELSE CAST(CAST(cancelled AS INT) AS VARCHAR) END AS Cancelled,
    CASE WHEN k = 13 THEN '1' ELSE CAST(CAST(diverted AS INT) AS VARCHAR) || '.00' END AS Diverted,
    CASE WHEN arrival_delay_minutes > 15 THEN '10.0' ELSE '' END AS LateAircraftDelay, source_file
  FROM (SELECT *, l_orderkey % 97 AS k FROM flights)
),
parsed AS (
  SELECT *, TRY_CAST(FlightDate AS DATE) AS day, upper(trim(Reporting_Airline)) AS carrier, upper(trim(Origin)) AS o_, upper(trim(Dest)) AS d_,
    CAST(round(TRY_CAST(CRSDepTime AS DOUBLE)) AS INT) AS dep4, CAST(round(TRY_CAST(CRSArrTime AS DOUBLE)) AS INT) AS arr4,
    TRY_CAST(ArrDelay AS DOUBLE) AS delay, TRY_CAST(Cancelled AS DOUBLE) AS cx, TRY_CAST(Diverted AS DOUBLE) AS dv FROM raw
),
judged AS (
  SELECT *, coalesce(day IS NOT NULL AND regexp_full_match(carrier, '[A-Z0-9]{{2,3}}') AND regexp_full_match(o_, '[A-Z]{{3}}') AND regexp_full_match(d_, '[A-Z]{{3}}')
      AND (dep4 = 2400 OR (dep4 BETWEEN 0 AND 2359 AND dep4 % 100 < 60)) AND (arr4 = 2400 OR (arr4 BETWEEN 0 AND 2359 AND arr4 % 100 < 60))
      AND TRY_CAST(DayOfWeek AS INT) = isodow(day) AND cx IN (0, 1) AND dv IN (0, 1), false) AS valid,
    CASE WHEN dep4 = 2400 THEN 0 ELSE (dep4 // 100) * 60 + dep4 % 100 END AS dep, CASE WHEN arr4 = 2400 THEN 0 ELSE (arr4 // 100) * 60 + arr4 % 100 END AS arr,
    CASE WHEN cx = 1 THEN 'cancelled' WHEN dv = 1 THEN 'diverted' WHEN delay IS NULL THEN 'missing_arrival_delay' ELSE 'completed' END AS status
  FROM parsed
)"""
WIDE = f"""
wraw AS (
  SELECT *, l_orderkey % 97 AS k, diverted AND l_linenumber % 2 = 0 AS two,
    NOT (l_orderkey % 97 IN (5, 9, 10, 14, 2, 11)) AS valid FROM flights
),
wide AS (
  SELECT flight_date, reporting_carrier, CASE WHEN k = 8 THEN NULL ELSE flight_number END AS flight_number, 'N' || flight_number AS tail_number, origin, destination,
    CAST(10397 AS INT) AS origin_airport_id, CAST(12478 AS INT) AS destination_airport_id,
    CASE WHEN k = 1 THEN 0 ELSE crs_departure_minutes END AS crs_departure_minutes, crs_arrival_minutes,
    CASE WHEN k <> 15 THEN crs_departure_minutes END AS departure_minutes, CASE WHEN k <> 16 THEN crs_arrival_minutes END AS arrival_minutes,
    1275 AS wheels_off_minutes, CAST(NULL AS INT) AS wheels_on_minutes, CAST(NULL AS INT) AS first_departure_minutes, cancelled, diverted,
    CASE WHEN cancelled THEN 'B' END AS cancellation_code, CAST(l_linenumber AS DOUBLE) AS departure_delay_minutes, arrival_delay_minutes,
    12.0::DOUBLE AS taxi_out_minutes, NULL::DOUBLE AS taxi_in_minutes, NULL::DOUBLE AS crs_elapsed_minutes, NULL::DOUBLE AS actual_elapsed_minutes, NULL::DOUBLE AS air_time_minutes,
    760.0::DOUBLE AS distance_miles, NULL::DOUBLE AS carrier_delay_minutes, NULL::DOUBLE AS weather_delay_minutes, NULL::DOUBLE AS nas_delay_minutes, NULL::DOUBLE AS security_delay_minutes,
    NULL::DOUBLE AS late_aircraft_delay_minutes, NULL::DOUBLE AS total_additional_ground_minutes, NULL::DOUBLE AS longest_additional_ground_minutes, NULL::DOUBLE AS diversion_actual_elapsed_minutes,
    NULL::DOUBLE AS diversion_arrival_delay_minutes, NULL::DOUBLE AS diversion_distance_miles, CAST(CASE WHEN two THEN 2 WHEN diverted THEN 1 ELSE 0 END AS INT) AS diversion_airport_landings,
    CASE WHEN diverted THEN true END AS diversion_reached_destination, source_file,
    CAST(CASE WHEN two THEN 2 WHEN diverted THEN 1 ELSE 0 END AS INT) AS leg_count, CASE WHEN diverted THEN 1 END AS leg1_sequence, CASE WHEN diverted THEN 'FLL' END AS leg1_airport,
    CASE WHEN diverted THEN 11697 END AS leg1_airport_id, CASE WHEN diverted THEN 0 END AS leg1_wheels_on_minutes, CASE WHEN diverted THEN 33.0::DOUBLE END AS leg1_total_ground_minutes,
    CASE WHEN two THEN 'MIA' END AS leg2_airport, CASE WHEN two THEN 1439 END AS leg2_wheels_off_minutes, CASE WHEN two THEN 'N9' END AS leg2_tail_number
  FROM wraw WHERE valid
)"""


def ingestion() -> dict[str, str]:
    f = w(FLIGHTS)
    h = w(FLIGHTS, HIST)
    raw = w(FLIGHTS, RAW)
    wide = w(FLIGHTS, WIDE)
    wide_quality = """SELECT source_file, count(*) AS source_rows, count(*) FILTER (valid) AS retained_rows, count(*) FILTER (NOT valid) AS invalid_core_rows,
      count(*) FILTER (valid AND k = 8) AS missing_flight_number_rows, count(*) FILTER (valid AND cancelled) AS cancelled_rows, count(*) FILTER (valid AND diverted) AS diverted_rows FROM wraw {0} GROUP BY 1"""
    all_columns = "flight_date, year, month, day_of_week, reporting_carrier, flight_number, origin, destination, crs_departure_minutes, crs_arrival_minutes, departure_time_bucket, arrival_delay_minutes, cancelled, diverted, flight_status, source_file, l_orderkey, l_linenumber"
    serving = "flight_date, month, day_of_week, reporting_carrier, origin, destination, departure_time_bucket, arrival_delay_minutes"
    digest = o.h60(*serving.split(", "))
    return {
        **dict.fromkeys(("clean_flights", "clean_archives"), raw + """SELECT day AS flight_date, CAST(year(day) AS INT) AS year, CAST(month(day) AS INT) AS month, CAST(isodow(day) AS INT) AS day_of_week, carrier AS reporting_carrier,
            nullif(trim(Flight_Number_Reporting_Airline), '') AS flight_number, o_ AS origin, d_ AS destination, dep AS crs_departure_minutes, arr AS crs_arrival_minutes,
            """ + o.BUCKET.format("dep") + """ AS departure_time_bucket, TRY_CAST(DepDelay AS DOUBLE) AS departure_delay_minutes, delay AS arrival_delay_minutes, cx = 1 AS cancelled, dv = 1 AS diverted,
            status AS flight_status, NULL::DOUBLE AS carrier_delay_minutes, NULL::DOUBLE AS weather_delay_minutes, NULL::DOUBLE AS nas_delay_minutes, NULL::DOUBLE AS security_delay_minutes,
            TRY_CAST(LateAircraftDelay AS DOUBLE) AS late_aircraft_delay_minutes, coalesce(abs(delay) > 1440, false) AS arrival_delay_outlier, source_file FROM judged WHERE valid"""),
        "clean_flights_wide": wide + "SELECT * FROM wide",
        **dict.fromkeys(("quality_by_source", "ingest_bounded"), raw + """SELECT source_file, count(*) AS source_rows, count(*) FILTER (valid) AS cleaned_rows, count(*) FILTER (valid AND status = 'completed') AS completed_flights,
            count(*) FILTER (valid AND cx = 1) AS cancelled_flights, count(*) FILTER (valid AND dv = 1) AS diverted_flights, count(*) FILTER (valid AND delay IS NULL) AS missing_arrival_delay_rows,
            count(*) FILTER (NOT valid) AS invalid_field_rows, count(*) FILTER (valid AND cx = 1 AND dv = 1) AS inconsistent_status_rows, count(*) FILTER (valid AND abs(delay) > 1440) AS arrival_delay_outlier_rows
            FROM judged GROUP BY 1"""),
        "quality_by_source_wide": wide + wide_quality.format(""),
        "upsert_by_source": w(FLIGHTS, RAW, WIDE) + """SELECT source_file, count(*) AS source_rows, count(*) FILTER (valid) AS valid_rows FROM judged WHERE source_file < 'm_1999' GROUP BY 1
            UNION ALL SELECT source_file, count(*), count(*) FILTER (valid) FROM wraw WHERE source_file >= 'm_1999' GROUP BY 1""",
        "pending_sources": f + "SELECT DISTINCT source_file FROM flights WHERE source_file NOT IN (SELECT source_file FROM flights WHERE cancelled AND year < 1998)",
        "refresh_history": h + "SELECT * FROM hist",
        "development_sample": f + f"SELECT {all_columns} FROM (SELECT *, row_number() OVER (PARTITION BY year, month, reporting_carrier, departure_time_bucket ORDER BY " + md5("'dev'", *all_columns.split(", ")) + ") AS k FROM flights) WHERE k <= 25",
        "yearly_status": f + "SELECT year, count(*) AS source_cleaned, count(*) FILTER (flight_status='completed') AS completed, count(*) FILTER (cancelled) AS cancelled, count(*) FILTER (diverted) AS diverted FROM flights GROUP BY 1",
        "duplicate_excess": f + f"SELECT (count(*) - count(DISTINCT ({KEY6})))::BIGINT AS duplicate_rows FROM flights",
        "date_coverage": h + "SELECT min(flight_date) AS first_date, max(flight_date) AS last_date FROM hist",
        "route_year_stats": h + f"""SELECT year, reporting_carrier, origin, destination, count(*) AS sample_size, {r('avg(arrival_delay_minutes)', 'mean_minutes')}, {q(.5, 'median_minutes', 'arrival_delay_minutes')},
            {q(.75, 'p75_minutes', 'arrival_delay_minutes')}, {q(.9, 'p90_minutes', 'arrival_delay_minutes')} FROM hist
            WHERE (reporting_carrier, origin, destination) IN (SELECT (reporting_carrier, origin, destination) FROM hist WHERE day_of_week = 7) GROUP BY 1, 2, 3, 4""",
        **dict.fromkeys(("serving_projection", "serving_layout"), h + f"SELECT {serving} FROM hist"),
        "dataset_fingerprint": h + f"SELECT count(*) AS row_count, bit_xor(x) AS xor_hash, sum(x % 1000003)::BIGINT AS sum_hash FROM (SELECT {digest} AS x FROM hist)",
        "exact_schedule": wide + f"SELECT flight_date, {SIG} FROM wide WHERE flight_number IS NOT NULL",
        "airports_seen": h + "SELECT origin AS code FROM hist UNION SELECT destination FROM hist",
        "supported_airports": w(FLIGHTS, HIST, ZONES) + "SELECT code, city, name, tz FROM zones WHERE code IN (SELECT origin FROM hist UNION SELECT destination FROM hist)",
        "supported_carriers": h + f"SELECT DISTINCT reporting_carrier AS carrier, display_name FROM hist JOIN (VALUES {values(CARRIER_NAMES)}) t(c, display_name) ON c = reporting_carrier",
        "scalar_labels": f + """SELECT season, severity, layover_bucket, layover_class, size_bucket, frequency_bucket, horizon, in_mask, count(*) AS flights, sum(gap)::BIGINT AS clock_distance,
            CAST(bit_or(bit) AS INT) AS weekdays, max(back) AS latest_back, sum(left_)::BIGINT AS weekdays_left, max(number) AS last_number, max(hash) AS top_hash FROM (
            SELECT """ + o.SEASON.format("month") + """ AS season, """ + o.SEVERITY.format("coalesce(arrival_delay_minutes, 0)") + """ AS severity,
              CASE WHEN d < 60 THEN '45_59' WHEN d < 90 THEN '60_89' WHEN d < 120 THEN '90_119' ELSE '120_180' END AS layover_bucket,
              CASE WHEN d < 60 THEN 'short_45_59' WHEN d < 120 THEN 'medium_60_119' ELSE 'long_120_180' END AS layover_class,
              CASE WHEN dep < 100 THEN '30_99' WHEN dep < 500 THEN '100_499' ELSE '500_plus' END AS size_bucket,
              CASE WHEN dep < 400 THEN 'under_10_percent' WHEN dep < 800 THEN '10_20_percent' ELSE 'over_20_percent' END AS frequency_bucket,
              CASE WHEN ahead < 0 THEN NULL WHEN ahead <= 14 THEN 'near_term' WHEN ahead <= 60 THEN 'approximately_30_days' WHEN ahead <= 135 THEN 'approximately_90_days' ELSE 'approximately_180_days' END AS horizon,
              day_of_week IN (1, 3, 5) AS in_mask, 720 - abs(720 - abs(dep - arr)) AS gap, 1 << (day_of_week - 1) AS bit, CAST(flight_date - INTERVAL 6 MONTH AS DATE) AS back,
              (DATE '2001-12-31' - flight_date) // 7 + 1 AS left_, reporting_carrier || flight_number AS number, """ + o.h60("flight_number", "dep") + """ AS hash
            FROM (SELECT *, crs_departure_minutes AS dep, crs_arrival_minutes AS arr, crs_departure_minutes % 200 AS d, flight_date - DATE '1998-06-01' AS ahead FROM flights)) GROUP BY ALL""".replace("reporting_carrier || flight_number AS number", "CASE WHEN regexp_full_match(reporting_carrier || flight_number, '[A-Z0-9]{2,3}[0-9]{1,4}[A-Z]?') THEN reporting_carrier || flight_number END AS number"),
    }


def parity() -> str:
    """The choice at a minimum of 30 against those at 30 and 60, levels and quantiles."""
    ps = (.5, .75, .9, .95)
    found = lambda m: (
        o.chosen("counts", f"sel{m}", o.pick(str(m))), o.members(f"sel{m}", f"mem{m}"),
        f"q{m} AS (SELECT case_id, {', '.join(f'quantile_cont(delay, {p}) AS v{i}' for i, p in enumerate(ps))} FROM mem{m} GROUP BY 1)",
    )
    gap = "greatest(" + ", ".join(f"abs(a.v{i} - b.v{i})" for i in range(len(ps))) + ")"
    rows = [
        f"SELECT CAST({m} AS INT) AS eager_minimum, count(*) AS sample_count, {r(f'max({gap})', 'maximum_quantile_difference')}, count(*) FILTER (s.lv <> t.lv) AS level_mismatches "
        f"FROM sel30 s JOIN q30 a USING (case_id) JOIN sel{m} t USING (case_id) JOIN q{m} b USING (case_id)" for m in (30, 60)
    ]
    return w(*BASE, o.ladder(), *found(30), *found(60)) + " UNION ALL ".join(rows)


def cohorts() -> dict[str, str]:
    full = w(*FULL)
    mem = w(*FULL, o.members())
    out = {
        "cohort_counts": w(*BASE, o.ladder()) + "SELECT case_id, " + ", ".join(o.COUNTS) + " FROM counts",
        "cohort_select": w(*BASE, o.ladder()) + f"SELECT case_id, {o.level_name('lv')} AS cohort_level, ({o.level_size('lv')})::BIGINT AS cohort_size FROM (SELECT *, {o.pick()} AS lv FROM counts)",
        "next_broader": w(*BASE, o.ladder()) + f"""SELECT case_id, {o.level_name('nx')} AS next_level, ({o.level_size('nx')})::BIGINT AS next_size, {o.level_name('el')} AS eligible_level, ({o.level_size('el')})::BIGINT AS eligible_size
            FROM (SELECT *, {o.broader()} AS nx, {o.pick('30', 1)} AS el FROM counts)""",
        "fallback_usage": full + f"SELECT cohort_level, count(*) AS cases, {r('count(*) / (SELECT count(*) FROM sel)', 'share')} FROM sel GROUP BY 1",
        "cohort_members": mem + "SELECT case_id, delay, count(*) AS n FROM mem GROUP BY 1, 2",
        "cohort_quantiles": mem + "SELECT case_id, " + ", ".join(q(p, f"p{round(p * 100)}") for p in (.1, .25, .5, .75, .9, .95)) + ", count(*) AS cohort_n FROM mem GROUP BY 1",
        "delay_distribution": w(*FULL, o.members(), "span AS (SELECT min(flight_date) AS a, max(flight_date) AS z FROM hist)",
            "qs AS (SELECT case_id, " + ", ".join(q(p, f"p{round(p * 100)}") for p in (.1, .25, .5, .75, .9)) + " FROM mem GROUP BY 1)")
            + """SELECT case_id, prediction_date, cohort_level, cohort_size::BIGINT AS cohort_size, p10, p25, p50, p75, p90, a AS available_start, z AS available_end, greatest(hs, a) AS effective_start, least(z, he - 1) AS effective_end,
            he AS cutoff_exclusive, CASE WHEN prediction_date - z > 90 THEN 'Historical data ends on ' || z || ', ' || (prediction_date - z) || ' days before the requested prediction date.' END AS freshness_warning
            FROM sel JOIN qs USING (case_id), span""",
        "connection_probability": w(*FULL, o.members(extra=", c.layover_minutes"),
            f"qs AS (SELECT case_id, {q(.5, 'p50')}, {q(.75, 'p75')}, {q(.9, 'p90')}, count(*) AS cohort_n, {r('avg(' + tri('layover_minutes - 35 - delay') + ')', 'probability')} FROM mem GROUP BY 1)")
            + "SELECT case_id, cohort_level, cohort_size::BIGINT AS cohort_size, layover_minutes, p50, p75, p90, cohort_n, probability FROM sel JOIN qs USING (case_id)",
        "scenario_probabilities": w(ITINS) + "SELECT request_id AS case_id, " + ", ".join(r(tri(f"layover_minutes - 35 - {d}") + "::DOUBLE", n) for d, n in ((0, "on_time"), (15, "delay_15"), (30, "delay_30"), (45, "delay_45")))
            + ", " + ", ".join(r(o.inv(str(p)), f"transfer_p{round(p*100)}") for p in (.1, .5, .9)) + " FROM itins",
        "status_probabilities": w(FLIGHTS, ITINS, o.CASES, o.status_ladder()) + f"SELECT case_id, status_level, status_size, {r('completion_probability', 'completion_probability')}, {r('cancellation_probability', 'cancellation_probability')}, {r('diversion_probability', 'diversion_probability')} FROM shares",
        "combined_probability": w(*CONNECTIONS) + f"SELECT case_id, status_level, {r('conditional_probability', 'conditional_probability')}, {r('probability', 'combined_probability')} FROM conn",
        "connection_options": w(FLIGHTS, ITINS, o.CASES, o.options("cases", "flights", "hashed", name="routed_itins")) + "SELECT case_id, layover_minutes, out_destination, out_minutes, has_outbound FROM routed_itins",
        "replay_outcome": w(FLIGHTS, ONE, o.RECORD_CASES, o.options("cases", "flights", "constant")) + f"SELECT case_id, layover_minutes, {o.OUTCOME}::DOUBLE AS outcome FROM routed",
        "candidate_parity": parity(),
        "scenario_order": w(ITINS) + f"SELECT count(*) AS rows, (count(*) FILTER ({' OR '.join(f'p{a} < p{b}' for a, b in ((0, 15), (15, 30), (30, 45)))}))::BIGINT AS violations FROM (SELECT "
            + ", ".join(f"{tri(f'layover_minutes - 35 - {d}')} AS p{d}" for d in (0, 15, 30, 45)) + " FROM itins)",
    }
    layovers = (20, 25, 30, 45, 60, 75, 90, 120)
    curve = ", ".join(f"avg({tri(f'{m} - 35 - delay')}) AS y{m}" for m in layovers)
    falls = " OR ".join(f"y{b} < y{a} - 1e-12" for a, b in zip(layovers, layovers[1:]))
    # cases of one cohort have one curve; the first case of each stands for it
    same = "lv, CASE WHEN lv NOT IN (4, 6) THEN carrier END, CASE WHEN lv < 5 THEN origin END, CASE WHEN lv < 5 THEN destination END, CASE WHEN lv < 3 THEN m END, CASE WHEN lv = 0 THEN w END, CASE WHEN lv < 2 THEN b END, hs, he"
    out["layover_monotonicity"] = w(
        *FULL, f"heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {same} ORDER BY case_id) AS k, count(*) OVER (PARTITION BY {same}) AS size FROM sel) WHERE k = 1)",
        o.members("heads", "mem"),
        f"curve AS (SELECT case_id, {curve}, {', '.join(f'avg(CASE WHEN delay <= -{m} THEN 1.0 ELSE 0.0 END) AS e{m}' for m in (5, 10, 15))} FROM mem GROUP BY 1)",
    ) + f"""SELECT cohort_level, count(*) AS cohorts, sum(size)::BIGINT AS cases, (count(*) FILTER ({falls}))::BIGINT AS violations,
        {', '.join(r(f'avg(e{m})', f'mean_early_{m}') for m in (5, 10, 15))}, {', '.join(r(f'avg(y{m})', f'mean_probability_{m}') for m in layovers)}
        FROM heads JOIN curve USING (case_id) GROUP BY 1"""
    return out


def replay_metrics() -> dict[str, str]:
    rp, cn = w(*REPLAY), w(*CONNECTIONS)
    vol = o.VOLUME.format("n_route_carrier")
    dims = {"carrier": "carrier", "route_volume_group": vol, "month": "CAST(month(prediction_date) AS VARCHAR)", "time_bucket": o.BUCKET.format("departure_minutes"), "severity": o.SEVERITY.format("actual"), "cohort_level": "cohort_level", "all": "'all'"}
    by_dim = " UNION ALL ".join(f"SELECT test_year, '{d}' AS dimension, {e} AS value, {o.arrival_metrics()} FROM rows_ GROUP BY 1, 2, 3" + ("" if d == "all" else " HAVING count(*) >= 5") for d, e in dims.items())
    bins = o.binned("test_year")
    units = "carrier, origin, destination, strftime(prediction_date, '%Y-%m')"
    boot = f"""SELECT count(*) AS replicates, 0.95::DOUBLE AS confidence, {q(.025, 'lower', 'm')}, {q(.975, 'upper', 'm')} FROM (
        SELECT replicate, sum(c) / sum(ww) AS m FROM (
          SELECT d.replicate, c, ww FROM (SELECT replicate, {o.h60(f"'{SEED}'", "replicate", "idx")} % size AS pick FROM units, generate_series(1, 100) g(replicate)) d JOIN units u ON u.idx = d.pick
        ) GROUP BY 1)"""
    unit_rows = f"""units AS (SELECT *, row_number() OVER (ORDER BY {md5("'unit'", 'a', 'b', 'c_', 'm')}) - 1 AS idx, count(*) OVER () AS size FROM (
        SELECT carrier AS a, origin AS b, destination AS c_, strftime(prediction_date, '%Y-%m') AS m, sum(CASE WHEN actual <= p90 THEN 1.0 ELSE 0.0 END) AS c, count(*) AS ww FROM rows_ GROUP BY 1, 2, 3, 4))"""
    gaps = ", ".join(f"sum(CASE WHEN least(CAST(floor(probability*10) AS INT), 9) = {b} THEN probability - outcome ELSE 0 END) AS g{b}" for b in range(10))
    clusters = f"""clusters AS (SELECT *, row_number() OVER (PARTITION BY test_year ORDER BY {md5("'unit'", 'test_year', 'rt', 'mo')}) - 1 AS idx, count(*) OVER (PARTITION BY test_year) AS size FROM (
        SELECT test_year, origin || '-' || destination AS rt, strftime(prediction_date, '%Y-%m') AS mo, count(*) AS ww, sum((probability-outcome)*(probability-outcome)) AS wb, sum(probability-outcome) AS gap, {gaps} FROM conn GROUP BY 1, 2, 3))"""
    reps = f"""reps AS (SELECT d.test_year, d.replicate, sum(ww) AS ww, sum(wb) AS wb, sum(gap) AS gap, {', '.join(f'sum(g{b}) AS g{b}' for b in range(10))} FROM (
        SELECT test_year, replicate, {o.h60(f"'{SEED}'", "replicate", "idx")} % size AS pick FROM clusters, generate_series(1, 100) g(replicate)) d JOIN clusters u ON u.idx = d.pick AND u.test_year = d.test_year GROUP BY 1, 2)"""
    total = " + ".join(f"abs(g{b})" for b in range(10))
    errors = " UNION ALL ".join(
        f"SELECT case_id, test_year, {r('probability', 'probability')}, outcome::DOUBLE AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY test_year ORDER BY probability {d}, case_id) AS k FROM conn WHERE outcome = {y}) WHERE k <= 20"
        for y, d in ((0, "DESC"), (1, "ASC")))
    return {
        "crps": rp + f"SELECT case_id, cohort_level, actual, {r('p50', 'p50')}, {r('p75', 'p75')}, {r('p90', 'p90')}, {r('crps', 'crps')} FROM rows_",
        "pinball_coverage": rp + f"SELECT test_year, {o.arrival_metrics()} FROM rows_ GROUP BY 1",
        "metrics_by_dimension": rp + by_dim,
        "worst_tail_cases": rp + f"SELECT case_id, actual, {r('p90', 'p90')}, {r('actual - p90', 'p90_error')} FROM rows_ ORDER BY actual - p90 DESC, case_id LIMIT 20",
        "brier": cn + o.conn_metrics("test_year"),
        "calibration_bins": cn + f"SELECT test_year, bin, {r('bin / 10', 'bin_start')}, {r('(bin + 1) / 10', 'bin_end')}, n AS sample_count, w::DOUBLE AS population_weight, {r('wp / w', 'mean_predicted_probability')}, {r('wy / w', 'observed_success_frequency')} FROM ({bins})",
        "ece": cn + f"SELECT test_year, status, {r('sum(abs(wp - wy)) / sum(w)', 'ece')} FROM ({o.binned('test_year, status')}) GROUP BY 1, 2",
        "error_cases": cn + errors,
        "bootstrap_interval": w(*REPLAY, unit_rows) + boot,
        "cluster_bootstrap": w(*CONNECTIONS, clusters, reps, f"long AS (SELECT test_year, 'brier_score' AS metric, wb / ww AS m FROM reps UNION ALL SELECT test_year, 'ece', ({total}) / ww FROM reps UNION ALL SELECT test_year, 'mean_calibration_gap', gap / ww FROM reps)")
            + f"SELECT test_year, metric, count(*) AS replicates, {q(.025, 'lower', 'm')}, {q(.975, 'upper', 'm')} FROM long GROUP BY 1, 2",
        "stratified_weights": w(FLIGHTS, HIST, o.REPLAY_CASES, strata(), stratified(500)) + f"SELECT case_id, test_year, carrier, route_volume_group, season, time_bucket, severity, CAST(stratum_rank AS INT) AS stratum_rank, population_count, sampled_count, {r('weight', 'weight')} FROM weighted",
        "route_volume": w(FLIGHTS, HIST, o.REPLAY_CASES, strata()) + "SELECT case_id, route_count, route_volume_group FROM strata",
        "exact_sample": w(FLIGHTS, HIST) + "SELECT flight_date, reporting_carrier, origin, destination, departure_time_bucket, " + md5(f"'{SEED}'", "flight_date", "reporting_carrier", "origin", "destination", "departure_time_bucket")
            + " AS digest FROM hist ORDER BY digest LIMIT (SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) FROM hist)",
        "hash_sample": w(FLIGHTS, HIST, o.REPLAY_CASES) + "SELECT case_id, test_year, actual FROM (SELECT *, row_number() OVER (PARTITION BY test_year ORDER BY " + md5("case_id", f"'{SEED}'") + ") AS k FROM cases) WHERE k <= 200",
    }


def strata(severity: str | None = None) -> str:
    return f"""
vol AS (SELECT c.carrier, c.origin, c.destination, c.test_year, count(*) AS route_count FROM (SELECT DISTINCT carrier, origin, destination, test_year FROM cases) c
  JOIN hist h ON h.reporting_carrier = c.carrier AND h.origin = c.origin AND h.destination = c.destination AND h.year < c.test_year GROUP BY ALL),
strata AS (SELECT cases.*, route_count, {o.VOLUME.format('route_count')} AS route_volume_group, {o.SEASON.format('month(prediction_date)')} AS season, {o.BUCKET.format('departure_minutes')} AS time_bucket,
  {severity or o.SEVERITY.format('actual')} AS severity FROM cases LEFT JOIN vol USING (carrier, origin, destination, test_year))"""


def stratified(target: int, seed: int = SEED) -> str:
    s = "test_year, carrier, route_volume_group, season, time_bucket, severity"
    return f"""
ranked AS (SELECT *, count(*) OVER (PARTITION BY {s}) AS population_count, row_number() OVER (PARTITION BY {s} ORDER BY {md5('case_id', f"'{seed}'")}) AS stratum_rank FROM strata),
quota AS (SELECT test_year, ceil({target}::DOUBLE / count(*)) AS quota FROM (SELECT DISTINCT {s} FROM strata) GROUP BY 1),
taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_year ORDER BY {md5('case_id', f"'{seed + 1}'")}) AS place FROM ranked JOIN quota USING (test_year) WHERE stratum_rank <= quota) WHERE place <= {target}),
weighted AS (SELECT *, count(*) OVER (PARTITION BY {s}) AS sampled_count, population_count / count(*) OVER (PARTITION BY {s}) AS weight FROM taken)"""


def all_statements() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (ingestion, cohorts, replay_metrics, *EXTRA):
        out |= part()
    return out


from delaycohorts.plans import oracle_schedules, oracle_services, oracle_studies  # noqa: E402

EXTRA = [oracle_schedules.schedules, oracle_services.itineraries, oracle_services.payloads, oracle_studies.studies]
