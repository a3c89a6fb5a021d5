"""SQL for itineraries, two-leg resolution, payloads and logs."""

from __future__ import annotations

from delaycohorts.plans import oracle as o
from delaycohorts.plans.oracle import BASE, FLIGHTS, HIST, ITINS, md5, q, r, tri, w
from delaycohorts.sources.driver_tables import AIRPORT_ROWS

_values = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in row) + ")" for row in AIRPORT_ROWS)
ZONES = f"zones AS (SELECT code, tz FROM (VALUES {_values}) t(code, city, name, country, tz) WHERE country = 'US')"


def utc(day: str, minutes: str, zone: str) -> str:
    local = f"(CAST({day} AS TIMESTAMP) + to_minutes(CAST({minutes} AS BIGINT)))"
    late = f"(({local} AT TIME ZONE {zone}) AT TIME ZONE 'UTC')"
    early = f"({late} - INTERVAL 1 HOUR)"  # in a repeated hour the earlier instant counts
    return f"(CASE WHEN ({early} AT TIME ZONE 'UTC') AT TIME ZONE {zone} = {local} THEN {early} ELSE {late} END)"


def timed(source: str, a: str = "origin", b: str = "connection") -> str:
    """Duration of a first leg in UTC with at most one roll to the next day."""
    return f"""
utc_ AS (SELECT i.*, z1.tz AS za, z2.tz AS zb, {utc('travel_date', 'departure_minutes', 'z1.tz')} AS s, {utc('travel_date', 'arrival_minutes', 'z2.tz')} AS e0, {utc('travel_date + 1', 'arrival_minutes', 'z2.tz')} AS e1
  FROM {source} i LEFT JOIN zones z1 ON z1.code = i.{a} LEFT JOIN zones z2 ON z2.code = i.{b}),
timed AS (SELECT *, CAST(date_diff('minute', s, CASE WHEN e0 <= s THEN e1 ELSE e0 END) AS INT) AS duration_minutes, coalesce(e0 <= s, false) AS rolled FROM utc_),
flown AS (SELECT *, CASE WHEN za IS NULL OR zb IS NULL THEN 'unknown_zone' WHEN duration_minutes < 30 THEN 'duration_too_short' WHEN duration_minutes > 900 AND rolled THEN 'chronology'
  WHEN duration_minutes > 900 THEN 'duration_too_long' END AS duration_reason FROM timed)"""


WAIT = "CASE WHEN connecting_minutes >= arrival_minutes THEN connecting_minutes - arrival_minutes WHEN arrival_minutes >= 1080 AND connecting_minutes <= 720 THEN 1440 - arrival_minutes + connecting_minutes END"
CHECKED = f"""
judged AS (
  SELECT * EXCLUDE (layover_minutes), CAST(wait AS INT) AS layover_minutes, coalesce(connecting_minutes < arrival_minutes AND arrival_minutes >= 1080 AND connecting_minutes <= 720, false) AS overnight,
    CASE WHEN NOT regexp_full_match(upper(trim(carrier_text)), '[A-Z0-9]{{2,3}}') THEN 'carrier' WHEN origin = connection OR origin = destination OR connection = destination THEN 'distinct_airports'
      WHEN request_id % 107 = 2 THEN 'minute_precision' WHEN origin NOT IN (SELECT code FROM zones) OR connection NOT IN (SELECT code FROM zones) OR destination NOT IN (SELECT code FROM zones) THEN 'unknown_zone'
      ELSE coalesce(duration_reason, CASE WHEN wait IS NULL THEN 'overnight_rule' WHEN wait < 15 THEN 'below_cutoff' WHEN wait > 720 THEN 'above_12_hours' END) END AS reason
  FROM (SELECT *, {WAIT} AS wait FROM flown)
)"""
KEY = """'{"carrier":"' || upper(trim(carrier_text)) || '","connecting_departure_time":"' || connecting_departure_time || '","connection":"' || connection || '","destination":"' || destination
  || '","first_arrival_time":"' || first_arrival_time || '","first_departure_time":"' || substr(first_departure_time, 1, 5) || '","model_version":"v1","origin":"' || origin || '","travel_date":"' || travel_date || '"}'"""
SEED_OF = "CAST(CAST('0x' || substr(sha256({0}), 1, 16) AS UBIGINT) AS VARCHAR)"


def scored(source: str) -> tuple[str, ...]:
    """Cases of the accepted requests in ``source`` up to quantiles and probability."""
    return (
        f"""cases AS (SELECT request_id AS case_id, upper(trim(carrier_text)) AS carrier, origin, connection AS destination, travel_date AS prediction_date, departure_minutes, layover_minutes,
          CAST(travel_date - INTERVAL 24 MONTH AS DATE) AS hs, travel_date AS he, 30 AS min_obs FROM {source} WHERE reason IS NULL)""",
        o.ladder(), o.chosen(), o.members(extra=", c.layover_minutes"),
        f"est AS (SELECT case_id, {q(.5, 'median_minutes')}, {q(.75, 'p75_minutes')}, {q(.9, 'p90_minutes')}, {r('avg(' + tri('layover_minutes - 35 - delay') + ')', 'probability')} FROM mem GROUP BY 1)",
    )


CANDS = f"""
legs AS (
  SELECT request_id, 1 AS leg, carrier AS c, CAST(request_id % 12 + 1 AS VARCHAR) AS number, travel_date - 30 AS day FROM itins
  UNION ALL SELECT request_id, 2, carrier, CAST(request_id * 5 % 12 + 1 AS VARCHAR), travel_date - 30 FROM itins
),
cand AS (
  SELECT request_id, leg, c AS carrier, origin, destination, flight_date AS day, crs_departure_minutes AS dm, crs_arrival_minutes AS am,
    row_number() OVER (PARTITION BY request_id, leg ORDER BY crs_departure_minutes, origin, destination, crs_arrival_minutes) - 1 AS pos, count(*) OVER (PARTITION BY request_id, leg) AS n
  FROM legs JOIN (SELECT DISTINCT flight_date, reporting_carrier, flight_number, origin, destination, crs_departure_minutes, crs_arrival_minutes FROM flights) f
    ON f.reporting_carrier = c AND f.flight_number = number AND f.flight_date = day
),
timed_c AS (SELECT cand.*, {utc('day', 'dm', 'z1.tz')} AS du, {utc('day', 'am', 'z2.tz')} AS au FROM cand JOIN zones z1 ON z1.code = origin JOIN zones z2 ON z2.code = destination),
sizes AS (SELECT request_id, count(*) FILTER (leg = 1) AS n1, count(*) FILTER (leg = 2) AS n2 FROM cand GROUP BY 1),
choice AS (
  SELECT request_id, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(CASE WHEN request_id % 2 = 0 THEN 0 END, CASE WHEN n1 = 1 THEN 0 END) AS i1,
    coalesce(CASE WHEN request_id % 3 = 0 THEN 1 WHEN request_id % 3 = 1 THEN 0 END, CASE WHEN n2 = 1 THEN 0 END) AS i2 FROM itins LEFT JOIN sizes USING (request_id)
),
judged2 AS (
  SELECT ch.request_id, i1, i2, n1, n2, a.carrier, a.origin, a.destination AS connection, b.origin AS o2, b.destination, a.day AS travel_date, a.dm, a.am, b.dm AS dm2, CAST(date_diff('minute', a.au, b.du) AS INT) AS wait,
    CASE WHEN ch.request_id % 53 = 1 THEN 'provider_configuration_error' WHEN n1 = 0 THEN 'schedule_not_found' WHEN ch.request_id % 59 = 2 THEN 'provider_data_quality_error'
      WHEN ch.request_id % 61 = 3 THEN 'provider_temporarily_unavailable' WHEN n2 = 0 THEN 'schedule_not_found' WHEN i1 >= n1 OR i2 >= n2 THEN 'invalid_candidate_selection' WHEN i1 IS NULL OR i2 IS NULL THEN 'ambiguous'
      WHEN a.destination <> b.origin THEN 'invalid_connection_airport' WHEN NOT (a.au > a.du AND b.du > a.au AND b.au > b.du) THEN 'invalid_chronology' ELSE 'success' END AS status,
    CASE WHEN ch.request_id % 53 = 1 OR n1 = 0 THEN 'first' WHEN ch.request_id % 59 = 2 OR ch.request_id % 61 = 3 OR n2 = 0 THEN 'second' WHEN i1 >= n1 THEN 'first' WHEN i2 >= n2 THEN 'second'
      WHEN i1 IS NULL AND i2 IS NULL THEN 'first,second' WHEN i1 IS NULL THEN 'first' WHEN i2 IS NULL THEN 'second' END AS leg
  FROM choice ch LEFT JOIN timed_c a ON a.request_id = ch.request_id AND a.leg = 1 AND a.pos = i1 LEFT JOIN timed_c b ON b.request_id = ch.request_id AND b.leg = 2 AND b.pos = i2
)"""


def clock(m: str) -> str:
    return f"lpad(CAST({m} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} % 60 AS VARCHAR), 2, '0')"


def compared() -> str:
    """Both histories scored on their own, then compared request by request."""
    fewer = HIST.replace("hist AS (", "hist_all AS (", 1) + ",\nhist AS (SELECT * FROM hist_all WHERE reporting_carrier <> 'DL')"
    side = lambda hist: w(FLIGHTS, hist, ITINS, ZONES, timed("itins"), CHECKED, *scored("judged")) + """SELECT j.request_id, lv IS NOT NULL AS ok, lv, cohort_size, probability, median_minutes, p75_minutes, p90_minutes
        FROM judged j LEFT JOIN (SELECT case_id, lv, cohort_size FROM sel) s ON s.case_id = j.request_id LEFT JOIN est e ON e.case_id = j.request_id"""
    gap = lambda c, n: r(f"coalesce(max(abs(a.{c} - b.{c})), 0)::DOUBLE", n, 6)
    differs = lambda c, n: f"count(*) FILTER (a.{c} IS DISTINCT FROM b.{c}) AS {n}"
    return f"""WITH a AS ({side(HIST)}), b AS ({side(fewer)}),
    d AS (SELECT count(*) AS cases, {gap('probability', 'maximum_probability_difference')}, {gap('median_minutes', 'maximum_p50_difference')}, {gap('p75_minutes', 'maximum_p75_difference')}, {gap('p90_minutes', 'maximum_p90_difference')},
      {differs('lv', 'cohort_mismatches')}, {differs('cohort_size', 'sample_size_mismatches')}, {differs('ok', 'status_mismatches')} FROM a JOIN b USING (request_id))
    SELECT *, maximum_probability_difference = 0 AND maximum_p50_difference = 0 AND maximum_p75_difference = 0 AND maximum_p90_difference = 0 AND cohort_mismatches = 0 AND sample_size_mismatches = 0 AND status_mismatches = 0 AS exact_match FROM d"""


def itineraries() -> dict[str, str]:
    it = w(ITINS)
    scenarios = ", ".join(r(f"CASE WHEN lv IS NOT NULL THEN ({tri(f'j.layover_minutes - 35 - {d}')})::DOUBLE END", n) for d, n in ((0, "on_time"), (15, "delay_15"), (30, "delay_30"), (45, "delay_45")))
    ok = lambda e, n: f"CASE WHEN lv IS NOT NULL THEN {e} END AS {n}"
    good = lambda e, n: f"CASE WHEN status = 'success' THEN {e} END AS {n}"
    rows = w(FLIGHTS, HIST, ITINS, ZONES, timed("itins"), CHECKED, *scored("judged"), "span AS (SELECT min(flight_date) AS a, max(flight_date) AS z FROM hist)")
    legs2 = f"""
flown_in AS (SELECT request_id, carrier, carrier AS carrier_text, origin, connection, destination, travel_date, dm AS departure_minutes, am AS arrival_minutes, dm2 AS connecting_minutes, 0 AS layover_minutes FROM judged2 WHERE status = 'success')"""
    checked2 = CHECKED.replace("request_id % 107 = 2", "false")
    return {
        "elapsed_minutes": it + f"SELECT request_id, CAST({WAIT} AS INT) AS minutes, connecting_minutes < arrival_minutes AND arrival_minutes >= 1080 AND connecting_minutes <= 720 AS overnight FROM itins",
        "first_leg_duration": w(ITINS, ZONES, timed("itins")) + "SELECT request_id, duration_minutes, rolled, duration_reason AS reason FROM flown",
        "itinerary_seed": it + f"SELECT request_id, {KEY} AS key, {SEED_OF.format('(' + KEY + ')')} AS seed FROM itins",
        "validate_itineraries": w(ITINS, ZONES, timed("itins"), CHECKED) + "SELECT request_id, upper(trim(carrier_text)) AS carrier, reason FROM judged",
        "score_itineraries": rows + f"""SELECT j.request_id, CASE WHEN lv IS NOT NULL THEN 'ok' ELSE 'rejected' END AS status, coalesce(reason, CASE WHEN lv IS NULL THEN 'no_prior_history' END) AS reason, probability,
            {ok('j.layover_minutes', 'layover_minutes')}, {ok('overnight', 'overnight')}, cohort_level, cohort_size::BIGINT AS cohort_size, median_minutes, p75_minutes, p90_minutes, {scenarios},
            {ok(SEED_OF.format('(' + KEY.replace('connection', 'j.connection', 1) + ')').replace('j.connection', 'connection'), 'seed')}, {ok('a', 'available_start')}, {ok('z', 'available_end')}, {ok('greatest(hs, a)', 'effective_start')},
            {ok('least(z, he - 1)', 'effective_end')}, {ok('he', 'cutoff_exclusive')},
            CASE WHEN lv IS NOT NULL AND travel_date - z > 90 THEN 'Historical data ends on ' || z || ', ' || (travel_date - z) || ' days before the requested prediction date.' END AS freshness_warning
            FROM judged j LEFT JOIN (SELECT case_id, lv, cohort_level, cohort_size, hs, he FROM sel) s ON s.case_id = j.request_id LEFT JOIN est e ON e.case_id = j.request_id, span""",
        "lookup_rejections": it + """SELECT lookup_id, reason FROM (
            SELECT lookup_id, CASE WHEN coalesce(trim(c), '') = '' THEN 'carrier_missing' WHEN coalesce(trim(f), '') = '' THEN 'number_missing'
              WHEN NOT regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR TRY_CAST(d AS DATE) IS NULL THEN 'date_format' WHEN NOT regexp_full_match(o, '[A-Z]{3}') THEN 'origin_code'
              WHEN NOT regexp_full_match(z, '[A-Z]{3}') THEN 'destination_code' WHEN m NOT BETWEEN 0 AND 1439 THEN 'minutes_range' END AS reason
            FROM (SELECT request_id AS lookup_id, CASE WHEN request_id % 101 = 1 THEN '  ' ELSE carrier END AS c, CASE WHEN request_id % 103 <> 2 THEN CAST(request_id % 12 + 1 AS VARCHAR) END AS f,
              CASE WHEN request_id % 107 = 3 THEN replace(CAST(travel_date AS VARCHAR), '-', '/') WHEN request_id % 107 = 4 THEN substr(CAST(travel_date AS VARCHAR), 1, 8) || '32' ELSE CAST(travel_date AS VARCHAR) END AS d,
              CASE WHEN request_id % 109 = 4 THEN 'J1K' WHEN request_id % 3 = 0 THEN origin END AS o, CASE WHEN request_id % 113 = 5 THEN 'BOST' WHEN request_id % 17 = 0 THEN connection END AS z,
              CASE WHEN request_id % 127 = 6 THEN request_id % 3000 END AS m FROM itins)) WHERE reason IS NOT NULL""",
        "compare_datasets": compared(),
        "representative_itineraries": w(FLIGHTS, HIST) + f"""SELECT id AS request_id, reporting_carrier AS carrier, origin, destination AS connection, 'ZZZ' AS destination,
            CAST((SELECT min(d) FROM generate_series(make_date(2000, month, 1)::TIMESTAMP, make_date(2000, month, 7)::TIMESTAMP, INTERVAL 1 DAY) t(d) WHERE isodow(d) = day_of_week) AS DATE) AS travel_date,
            CASE departure_time_bucket WHEN 'overnight' THEN '03:00' WHEN 'morning' THEN '09:00' WHEN 'afternoon' THEN '15:00' ELSE '19:00' END AS first_departure_time,
            CASE departure_time_bucket WHEN 'overnight' THEN '05:00' WHEN 'morning' THEN '11:00' WHEN 'afternoon' THEN '17:00' ELSE '21:00' END AS first_arrival_time,
            CASE departure_time_bucket WHEN 'overnight' THEN '06:30' WHEN 'morning' THEN '12:30' WHEN 'afternoon' THEN '18:30' ELSE '22:30' END AS connecting_departure_time, observations
            FROM (SELECT reporting_carrier, origin, destination, month, day_of_week, departure_time_bucket, count(*) AS observations,
              {md5('reporting_carrier', 'origin', 'destination', 'month', 'day_of_week', 'departure_time_bucket')} AS id FROM hist GROUP BY ALL HAVING count(*) >= 5 ORDER BY id LIMIT 50)""",
        "two_leg_resolution": w(FLIGHTS, ITINS, ZONES, CANDS) + f"""SELECT request_id, status, leg, {good('carrier', 'carrier')}, {good('origin', 'origin')}, {good('connection', 'connection')}, {good('destination', 'destination')}, {good('travel_date', 'travel_date')},
            {good(clock('dm'), 'first_departure_time')}, {good(clock('am'), 'first_arrival_time')}, {good(clock('dm2'), 'connecting_departure_time')}, {good('wait', 'layover_minutes')},
            status = 'success' AND (origin = 'DEN' OR o2 = 'DEN') AS terminal_warning FROM judged2""",
        "two_leg_scores": w(FLIGHTS, HIST, ITINS, ZONES, CANDS, legs2, timed("flown_in"), checked2, *scored("judged"))
            + """SELECT j2.request_id, CASE WHEN j2.status = 'success' AND lv IS NULL THEN 'invalid_chronology' ELSE j2.status END AS status,
            CASE WHEN j2.status = 'success' AND lv IS NULL THEN coalesce(j.reason, 'no_prior_history') END AS reason, leg, CASE WHEN j2.status = 'success' AND lv IS NOT NULL THEN wait_ END AS layover_minutes,
            j2.status = 'success' AND lv IS NOT NULL AND (j2.origin = 'DEN' OR o2 = 'DEN') AS terminal_warning, probability, cohort_level, cohort_size::BIGINT AS cohort_size
            FROM (SELECT *, wait AS wait_ FROM judged2) j2 LEFT JOIN judged j USING (request_id) LEFT JOIN (SELECT case_id, lv, cohort_level, cohort_size FROM sel) s ON s.case_id = j2.request_id LEFT JOIN est e ON e.case_id = j2.request_id""",
    }


PAYLOADS = """
pay AS (SELECT *, l_orderkey % 20 AS k, l_orderkey || '-' || l_linenumber AS request_key, upper(reporting_carrier) || ' ' || flight_number AS spaced,
  CAST(flight_date AS TIMESTAMP) + to_minutes(crs_departure_minutes::BIGINT) AS dl, CAST(flight_date AS TIMESTAMP) + to_minutes(crs_arrival_minutes::BIGINT) AS al FROM flights),
item AS (SELECT pay.*, idx FROM pay, (SELECT unnest([0, 1]) AS idx) WHERE idx = 0 OR k = 4),
norm AS (
  SELECT request_key, CASE WHEN k = 3 OR k IN (5, 6) THEN NULL ELSE idx END AS item_index, k IN (3, 5, 6) AS bare, k,
    CASE WHEN k = 5 THEN 'not_an_array' WHEN k = 6 THEN 'malformed_json' WHEN k = 2 THEN 'invalid_local_time' WHEN k = 1 THEN 'missing_required_fields' END AS reject_reason,
    lower(reporting_carrier) || flight_number AS requested_number, flight_date, reporting_carrier, spaced, origin, destination, dl, al FROM item
)"""


def payloads() -> dict[str, str]:
    some = lambda e, n: f"CASE WHEN NOT bare THEN {e} END AS {n}"
    number = "CASE WHEN k = 0 THEN upper(requested_number) ELSE spaced END"
    op = "k % 2 = 0"
    norm = f"""SELECT request_key, requested_number, flight_date AS requested_date, CAST(item_index AS INT) AS item_index, reject_reason, 'schedule_api' AS source, flight_date,
      {some('reporting_carrier', 'marketing_carrier')}, {some(number, 'marketing_flight_number')},
      {some(f"CASE WHEN {op} THEN reporting_carrier END", 'operating_carrier')}, {some(f"CASE WHEN {op} THEN {number} END", 'operating_flight_number')},
      {some("CASE WHEN k <> 1 THEN origin END", 'origin_iata')}, {some('destination', 'destination_iata')}, {some('dl', 'scheduled_departure_local')}, {some("CASE WHEN k <> 2 THEN al END", 'scheduled_arrival_local')},
      CAST(NULL AS INT) AS departure_offset, CAST(NULL AS INT) AS arrival_offset, {some("CASE WHEN k % 4 = 0 THEN 'T1' END", 'departure_terminal')}, {some("CASE WHEN k % 5 = 0 THEN 'B' END", 'arrival_terminal')},
      CAST(NULL AS VARCHAR) AS departure_gate, {some("CASE WHEN k % 7 = 0 THEN '22' END", 'arrival_gate')}, {some("CASE WHEN k < 10 THEN 'Expected' END", 'status')},
      CASE WHEN bare THEN '' ELSE 'departure:Basic,departure:Live,arrival:Basic' END AS quality, {some(f"CASE WHEN {op} THEN 'IsOperator' ELSE 'IsCodeshared' END", 'codeshare_status')},
      {some("CASE WHEN k % 3 = 0 THEN 'A320' END", 'aircraft_type')}, {some("reporting_carrier || flight_number_", 'raw_provider_id')}, NOT bare AS has_item FROM norm"""
    norm = norm.replace("flight_number_", "substr(spaced, 4)")
    outcome = """outcomes AS (SELECT request_key, CASE WHEN bool_or(k = 1) AND arg_min(reject_reason, coalesce(item_index, 0)) FILTER (reject_reason IS NOT NULL) = 'missing_required_fields' THEN 'missing_required_fields'
      WHEN bool_or(reject_reason IS NOT NULL) THEN 'malformed_response' WHEN sum(CASE WHEN bare THEN 0 ELSE 1 END) = 0 THEN 'no_match' WHEN sum(CASE WHEN bare THEN 0 ELSE 1 END) = 1 THEN 'unique_match' ELSE 'multiple_candidates' END AS outcome,
      CASE WHEN bool_or(reject_reason IS NOT NULL) THEN 0 ELSE sum(CASE WHEN bare THEN 0 ELSE 1 END) END::BIGINT AS candidate_count FROM norm GROUP BY 1)"""
    ahead = "(flight_date - DATE '1995-01-01')"
    hor = f"CASE WHEN {ahead} < 0 THEN 'past' WHEN {ahead} <= 14 THEN 'near_term' WHEN {ahead} <= 60 THEN 'approximately_30_days' WHEN {ahead} <= 135 THEN 'approximately_90_days' ELSE 'approximately_180_days' END"
    fields = {"departure_terminal": "k % 4 = 0", "arrival_terminal": "k % 5 = 0", "departure_gate": "false", "arrival_gate": "k % 7 = 0", "aircraft_type": "k % 3 = 0", "quality": "true", "status": "k < 10", "codeshare_status": "true", "operating_carrier": op, "operating_flight_number": op}
    names = ("no_match", "unique_match", "multiple_candidates", "missing_required_fields", "malformed_response", "provider_error")
    has = ", ".join(f"count(*) FILTER ({e}) AS has_{f}" for f, e in fields.items())
    cover = lambda dim, value: f"""SELECT '{dim}' AS dimension, {value} AS value, count(*) AS attempted, {', '.join(f"count(*) FILTER (outcome = '{n}') AS {n}" for n in names)}, coalesce(sum(returned), 0)::BIGINT AS returned_candidates,
      {', '.join(r(f'100.0 * sum(has_{f}) / nullif(sum(returned), 0)', f'{f}_percent', 3) for f in fields)} FROM look GROUP BY 1, 2"""
    plan_rows = """plan AS (SELECT carrier || CAST(request_id % 12 + 1 AS VARCHAR) AS number, carrier, travel_date, CASE WHEN request_id % 19 = 0 THEN 'XX' ELSE carrier END AS airline,
      CASE WHEN request_id % 19 = 0 THEN 1 WHEN request_id % 23 = 0 OR request_id % 37 = 0 THEN 1 WHEN travel_date < DATE '1995-06-01' THEN 1 ELSE 0 END AS bad, travel_date - DATE '1995-06-01' AS d FROM itins)"""
    h2 = "CASE WHEN d < 0 THEN NULL WHEN d <= 14 THEN 'near_term' WHEN d <= 60 THEN 'approximately_30_days' WHEN d <= 135 THEN 'approximately_90_days' ELSE 'approximately_180_days' END"
    log = """log AS (SELECT event_id, event_id % 12 AS k, props, event_type FROM events),
    bodies AS (SELECT *, CAST(CASE k WHEN 0 THEN 204 WHEN 1 THEN 401 WHEN 2 THEN 402 WHEN 3 THEN 403 WHEN 4 THEN 403 WHEN 5 THEN 429 WHEN 6 THEN 408 WHEN 7 THEN 504 WHEN 8 THEN 500 ELSE 200 END AS INT) AS status,
      CASE WHEN k = 0 THEN '' WHEN k = 3 THEN '{"code":"QUOTA_EXCEEDED","at":' || props || '}' WHEN k = 4 THEN '<html>Access Denied ' || event_type || '</html>' WHEN k = 5 THEN 'Forbidden by cloudflare ' || event_type
        WHEN k = 8 THEN '{"error": "bad' || event_type ELSE props END AS body FROM log)"""
    # RE2 has no \x0b in \s, Java has it
    secret = """(contains(lower(text), 'authorization') OR contains(lower(text), 'api-key') OR contains(lower(text), 'key') OR contains(lower(text), 'token') OR contains(lower(text), 'cookie') OR contains(lower(text), 'secret')
      OR regexp_matches(text, '(?i)(?:bearer[\\s\\x0b]+|sk[-_])[A-Za-z0-9._~+/=-]+') OR regexp_matches(text, '[A-Za-z0-9._~+/=-]{24,}'))"""
    redacted = "replace(replace(replace(text, 'password', '[REDACTED]'), 'the ', '[REDACTED]'), 'a', '[REDACTED]')"
    return {
        "normalize_payloads": w(FLIGHTS, PAYLOADS) + norm,
        "lookup_outcome": w(FLIGHTS, PAYLOADS, outcome) + "SELECT * FROM outcomes",
        "provider_coverage": w(FLIGHTS, PAYLOADS, outcome, f"fill AS (SELECT request_key, count(*) AS returned, {has} FROM norm JOIN outcomes USING (request_key) WHERE outcome IN ('unique_match', 'multiple_candidates') AND NOT bare GROUP BY 1)",
            f"look AS (SELECT p.*, outcome, returned, {', '.join('has_' + f for f in fields)} FROM (SELECT DISTINCT request_key, reporting_carrier AS airline, {hor} AS horizon FROM pay) p JOIN outcomes USING (request_key) LEFT JOIN fill USING (request_key))")
            + " UNION ALL ".join((cover("total", "'all'"), cover("airline", "airline"), cover("horizon", "horizon"))),
        "study_plan": w(ITINS, plan_rows) + f"""SELECT 'total' AS section, 'planned_requests' AS item, count(*) AS value FROM plan UNION ALL SELECT 'airline', airline, count(*) FROM plan GROUP BY 2 UNION ALL SELECT 'horizon', {h2}, count(*) FROM plan GROUP BY 2
            UNION ALL SELECT 'total', 'maximum_units', 2 * count(*) FROM plan UNION ALL SELECT 'violation', 'duplicate_candidates', count(*) - count(DISTINCT (number, travel_date)) FROM plan
            UNION ALL SELECT 'violation', 'unusable_rows', sum(bad)::BIGINT FROM plan UNION ALL SELECT 'violation', 'empty_study', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM plan UNION ALL SELECT 'violation', 'over_request_cap', greatest(count(*) - 30, 0) FROM plan""",
        "classify_response": w(log) + """SELECT event_id, status, CASE k WHEN 0 THEN 'no_match' WHEN 1 THEN 'authentication' WHEN 2 THEN 'quota' WHEN 3 THEN 'quota' WHEN 4 THEN 'other_error' WHEN 5 THEN 'rate_limit' WHEN 6 THEN 'timeout' WHEN 7 THEN 'timeout' WHEN 8 THEN 'other_error' ELSE 'ok' END AS outcome,
            CASE WHEN body = '' THEN 'empty' WHEN k = 4 THEN 'html' WHEN k = 5 THEN 'text' WHEN json_valid(body) THEN 'json' ELSE 'text' END AS body_kind,
            CASE WHEN k = 4 THEN 'access_denied' WHEN k = 5 THEN 'cloudflare' WHEN body <> '' AND NOT json_valid(body) THEN 'unknown' END AS body_marker, CASE WHEN k = 3 THEN 'QUOTA_EXCEEDED' END AS error_code, CAST(strlen(body) AS INT) AS body_length FROM bodies""",
        "log_values": f"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')) AS text FROM documents)
            SELECT doc_id, CASE WHEN text <> '' AND NOT {secret} THEN substr(text, 1, 200) END AS metadata, CASE WHEN {secret} THEN '[REDACTED]' ELSE nullif(substr(text, 1, 160), '') END AS message FROM d""",
        "flag_secrets": f"SELECT doc_id, {secret} AS secret_bearing FROM documents",
        "redact": f"SELECT doc_id, md5({redacted}) AS digest, CAST(length({redacted}) AS INT) AS length FROM documents",
    }
