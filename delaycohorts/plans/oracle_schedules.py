"""SQL for schedule periods, stability and lookups."""

from __future__ import annotations

from delaycohorts.plans import oracle as o
from delaycohorts.plans.oracle import FLIGHTS, ITINS, md5, r, w

SIG = "reporting_carrier, flight_number, origin, destination, crs_departure_minutes, crs_arrival_minutes"
COLS = "flight_date, " + SIG
ROUTE = "reporting_carrier, flight_number, origin, destination"
NUM = "reporting_carrier, flight_number"

SCHED = f"sched AS (SELECT {COLS} FROM flights)"
DAYS = f"days AS (SELECT {COLS}, count(*) AS n FROM sched GROUP BY ALL)"
WEEKS = f"""
weeks AS (SELECT {SIG}, flight_date - (isodow(flight_date) - 1)::INT AS week_start, min(flight_date) AS observed_from, max(flight_date) AS observed_to,
  CAST(bit_or(1 << (isodow(flight_date) - 1)::INT) AS INT) AS weekday_mask, CAST(count(*) AS INT) AS source_observations FROM sched GROUP BY ALL)"""
# a week opens a period unless the same signature ran the week before with the same days
EXACT = f"""
opened AS (SELECT a.*, CASE WHEN b.week_start IS NULL THEN 1 ELSE 0 END AS opens FROM weeks a LEFT JOIN weeks b
  ON ({', '.join('a.' + c for c in SIG.split(', '))}) = ({', '.join('b.' + c for c in SIG.split(', '))}) AND b.week_start = a.week_start - 7 AND b.weekday_mask = a.weekday_mask),
exact AS (SELECT {SIG}, weekday_mask, min(observed_from) AS valid_from, max(observed_to) AS valid_to, CAST(sum(source_observations) AS INT) AS source_observations, CAST(count(*) AS INT) AS weeks
  FROM (SELECT *, sum(opens) OVER (PARTITION BY {SIG} ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pid FROM opened) GROUP BY {SIG}, weekday_mask, pid)"""
PATTERN = f"""
gaps AS (SELECT *, flight_date - lag(flight_date) OVER (PARTITION BY {SIG} ORDER BY flight_date) AS gap FROM sched),
pattern AS (SELECT {SIG}, min(flight_date) AS valid_from, max(flight_date) AS valid_to, CAST(bit_or(1 << (isodow(flight_date) - 1)::INT) AS INT) AS weekday_mask,
  CAST(count(*) AS INT) AS source_observations, CAST(max(CASE WHEN gap <= 21 THEN gap END) AS INT) AS maximum_internal_gap_days
  FROM (SELECT *, sum(CASE WHEN gap <= 21 THEN 0 ELSE 1 END) OVER (PARTITION BY {SIG} ORDER BY flight_date) AS pid FROM gaps) GROUP BY {SIG}, pid)"""


def expanded(table: str, name: str) -> str:
    return f"""
{name} AS (SELECT CAST(d AS DATE) AS flight_date, {SIG} FROM (SELECT *, unnest(generate_series(valid_from::TIMESTAMP, valid_to::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM {table})
  WHERE (weekday_mask >> (isodow(d) - 1)::INT) % 2 = 1)"""


STABLE = f"""
ndates AS (SELECT {NUM}, flight_date, count(*) AS segments, string_agg(DISTINCT origin || destination, ',' ORDER BY origin || destination) AS rset FROM sched GROUP BY ALL),
totals AS (SELECT {NUM}, count(*) AS operating_dates, count(DISTINCT rset) AS distinct_daily_route_sets, count(*) FILTER (segments > 1) AS multi_segment_dates,
  count(*) FILTER (rset <> before) AS route_set_changes FROM (SELECT *, lag(rset) OVER (PARTITION BY {NUM} ORDER BY flight_date) AS before FROM ndates) GROUP BY ALL),
rdates AS (SELECT {ROUTE}, count(DISTINCT flight_date) AS dates, count(DISTINCT year(flight_date)) AS years, count(DISTINCT year(flight_date) * 12 + month(flight_date)) AS months FROM sched GROUP BY ALL),
rsum AS (SELECT {NUM}, count(*) AS distinct_routes, max(dates) AS dominant_route_dates, sum(years)::BIGINT AS year_routes, sum(months)::BIGINT AS month_routes,
  first(origin || '-' || destination ORDER BY dates DESC, origin, destination) AS dominant_route FROM rdates GROUP BY ALL),
routes AS (SELECT {NUM}, operating_dates, distinct_daily_route_sets, multi_segment_dates, route_set_changes, distinct_routes, dominant_route_dates,
  dominant_route_dates / operating_dates AS dominant_route_date_share, dominant_route, multi_segment_dates > 0 AS has_same_date_multi_segment, year_routes, month_routes
  FROM totals JOIN rsum USING ({NUM}))"""
MODES = f"modes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ROUTE} ORDER BY n DESC, crs_departure_minutes, crs_arrival_minutes) AS k FROM (SELECT {SIG}, count(*) AS n FROM sched GROUP BY ALL)) WHERE k = 1)"
TIMES = f"""
dev AS (SELECT s.*, m.crs_departure_minutes AS md, m.crs_arrival_minutes AS ma, m.n AS mn, 720 - abs(720 - abs(s.crs_departure_minutes - m.crs_departure_minutes)) AS dd, 720 - abs(720 - abs(s.crs_arrival_minutes - m.crs_arrival_minutes)) AS da
  FROM sched s JOIN modes m USING ({ROUTE})),
moved AS (SELECT {ROUTE}, count(*) FILTER (crs_departure_minutes <> pd OR crs_arrival_minutes <> pa) AS schedule_changes FROM (
  SELECT *, lag(crs_departure_minutes) OVER x AS pd, lag(crs_arrival_minutes) OVER x AS pa FROM days WINDOW x AS (PARTITION BY {ROUTE} ORDER BY flight_date, crs_departure_minutes, crs_arrival_minutes)) GROUP BY ALL),
times AS (SELECT {ROUTE}, count(*) AS records, count(DISTINCT flight_date) AS operating_dates, count(DISTINCT crs_departure_minutes) AS distinct_departure_minutes, count(DISTINCT crs_arrival_minutes) AS distinct_arrival_minutes,
  count(DISTINCT crs_departure_minutes * 10000 + crs_arrival_minutes) AS distinct_time_pairs, max(md) AS modal_departure_minutes, max(ma) AS modal_arrival_minutes, max(mn) / count(*) AS modal_time_pair_share,
  quantile_cont(dd::DOUBLE, 0.5) AS median_departure_deviation, quantile_cont(dd::DOUBLE, 0.9) AS p90_departure_deviation, quantile_cont(da::DOUBLE, 0.5) AS median_arrival_deviation, quantile_cont(da::DOUBLE, 0.9) AS p90_arrival_deviation,
  max(schedule_changes) AS schedule_changes FROM dev JOIN moved USING ({ROUTE}) GROUP BY ALL)"""
OPS = f"""
spans AS (SELECT {ROUTE}, min(flight_date) AS first_date, max(flight_date) AS last_date, count(DISTINCT flight_date) AS operating_dates, count(DISTINCT month(flight_date)) AS active_months, CAST(max(gap) AS INT) AS maximum_gap_days
  FROM (SELECT *, flight_date - lag(flight_date) OVER (PARTITION BY {ROUTE} ORDER BY flight_date) AS gap FROM sched) GROUP BY ALL),
dows AS (SELECT {ROUTE}, isodow(flight_date) AS dow, count(DISTINCT flight_date) AS operated FROM sched GROUP BY ALL),
calendar AS (SELECT CAST(d AS DATE) AS day FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY) t(d)),
masks AS (SELECT {ROUTE}, CAST(sum(CASE WHEN operated / (SELECT count(*) FROM calendar WHERE day BETWEEN first_date AND last_date AND isodow(day) = dow) >= 0.5 THEN 1 << (dow - 1)::INT ELSE 0 END) AS INT) AS active_weekday_mask
  FROM dows JOIN spans USING ({ROUTE}) GROUP BY ALL),
ops AS (SELECT *, CASE WHEN operating_dates < 8 OR calendar_density < 0.2 THEN 'irregular' WHEN maximum_gap_days > 35 OR active_months <= 6 THEN 'seasonal' WHEN active_weekday_mask = 127 THEN 'daily'
  WHEN active_weekday_mask = 31 THEN 'weekdays_only' WHEN active_weekday_mask = 96 THEN 'weekends_only' ELSE 'selected_weekdays' END AS operating_pattern
  FROM (SELECT spans.*, active_weekday_mask, operating_dates / (last_date - first_date + 1) AS calendar_density FROM spans JOIN masks USING ({ROUTE})))"""


def accuracy(table: str, label: str) -> str:
    e = f"{label}_x"
    return f"""SELECT '{label}' AS representation, n AS expanded_rows, n - fp AS exact_matches, fp AS false_positive_rows, fn AS false_negative_rows, fp - time_bad - closed AS route_mismatch_candidates, time_bad AS schedule_time_mismatch_candidates,
      closed AS false_positive_nonoperating_dates, {r('(src - fn) / src', 'source_recall')}, {r('(n - fp) / n', 'expanded_precision')} FROM (
      SELECT (SELECT count(*) FROM {e}) AS n, (SELECT count(*) FROM (SELECT * FROM {e} EXCEPT SELECT * FROM sched)) AS fp, (SELECT count(*) FROM (SELECT * FROM sched EXCEPT SELECT * FROM {e})) AS fn,
        (SELECT count(DISTINCT ({COLS})) FROM sched) AS src,
        (SELECT count(*) FROM {label}_f WHERE (reporting_carrier, flight_number, flight_date, origin, destination) IN (SELECT (reporting_carrier, flight_number, flight_date, origin, destination) FROM sched)) AS time_bad,
        (SELECT count(*) FROM {label}_f WHERE (reporting_carrier, flight_number, flight_date) NOT IN (SELECT (reporting_carrier, flight_number, flight_date) FROM sched)) AS closed)"""


LOOKUPS = """
keys AS (SELECT request_id AS lookup_id, carrier AS qc, CAST(request_id % 12 + 1 AS VARCHAR) AS qn, travel_date AS qd, CASE WHEN request_id % 3 = 0 THEN origin END AS qo, CASE WHEN request_id % 17 = 0 THEN connection END AS qt FROM itins)"""


def lookup(source: str) -> str:
    return f"""
found AS (SELECT lookup_id, crs_departure_minutes, crs_arrival_minutes, origin, destination, count(*) AS copies FROM keys JOIN {source} WHERE reporting_carrier = qc AND flight_number = qn
  AND (qo IS NULL OR qo = origin) AND (qt IS NULL OR qt = destination) GROUP BY ALL),
sums AS (SELECT lookup_id, sum(copies)::BIGINT AS m FROM found GROUP BY 1)
SELECT k.lookup_id, CASE WHEN m IS NULL THEN 'no_match' WHEN m = 1 THEN 'unique_match' ELSE 'multiple_segments' END AS classification, coalesce(m, 0) AS match_count,
  CAST(CASE WHEN m IS NOT NULL THEN row_number() OVER (PARTITION BY k.lookup_id ORDER BY crs_departure_minutes, crs_arrival_minutes, origin, destination) - 1 END AS INT) AS position,
  crs_departure_minutes, crs_arrival_minutes, origin, destination, copies FROM keys k LEFT JOIN sums USING (lookup_id) LEFT JOIN found f ON f.lookup_id = k.lookup_id"""


def schedules() -> dict[str, str]:
    s = lambda *c: w(FLIGHTS, SCHED, *c)
    shares = lambda share, prefix: ", ".join(f"count(*) FILTER ({share} >= {x / 100}) AS {prefix}_{'100' if x == 100 else f'ge_{x}'}" for x in (90, 95, 99, 100))
    pct = lambda keys, total: ", ".join(r(f"100.0 * {k} / {total}", f"{k}_percent", 6) for k in keys)
    qq = lambda c, p, n: r(f"quantile_cont({c}::DOUBLE, {p})", n)
    round_all = lambda cols: ", ".join(r(c, c) for c in cols)
    exact_f = f"exact_f AS (SELECT * FROM exact_x EXCEPT SELECT * FROM sched)"
    pattern_f = f"pattern_f AS (SELECT * FROM pattern_x EXCEPT SELECT * FROM sched)"
    routes_list = "reporting_carrier, flight_number, operating_dates, distinct_daily_route_sets, multi_segment_dates, route_set_changes, distinct_routes, dominant_route_dates, dominant_route, has_same_date_multi_segment, year_routes, month_routes"
    times_list = f"{ROUTE}, records, operating_dates, distinct_departure_minutes, distinct_arrival_minutes, distinct_time_pairs, modal_departure_minutes, modal_arrival_minutes, schedule_changes"
    sample_keys = f"""
cand AS (SELECT DISTINCT reporting_carrier, flight_number, flight_date, has_same_date_multi_segment AS ms, distinct_time_pairs > 1 AS ch FROM sched JOIN routes USING ({NUM}) JOIN times USING ({ROUTE})),
picked AS (SELECT DISTINCT reporting_carrier, flight_number, flight_date FROM (SELECT *, row_number() OVER (PARTITION BY reporting_carrier, year(flight_date), month(flight_date), isodow(flight_date), ms, ch
  ORDER BY {md5('reporting_carrier', 'flight_number', 'flight_date', "'20260812'")}) AS k FROM cand) WHERE k <= 2),
psource AS (SELECT DISTINCT {COLS} FROM sched JOIN picked USING (reporting_carrier, flight_number, flight_date))"""
    rebuilt = lambda t: f"""{t}_r AS (SELECT p.flight_date, {SIG} FROM picked p JOIN {t} USING ({NUM}) WHERE p.flight_date BETWEEN valid_from AND valid_to AND (weekday_mask >> (isodow(p.flight_date) - 1)::INT) % 2 = 1)"""
    sample = lambda t: f"""SELECT '{t}' AS representation, src AS source_segments, n AS reconstructed_segments, fp AS false_positive_rows, fn AS false_negative_rows, {r('(src - fn) / src', 'exact_source_row_accuracy')} FROM (
      SELECT (SELECT count(*) FROM psource) AS src, (SELECT count(*) FROM {t}_r) AS n, (SELECT count(*) FROM (SELECT * FROM {t}_r EXCEPT SELECT * FROM psource)) AS fp, (SELECT count(*) FROM (SELECT * FROM psource EXCEPT SELECT * FROM {t}_r)) AS fn)"""
    modal = lambda d, e: f"SELECT '{d}' AS dimension, sum(n) / (SELECT count(*) FROM sched) AS a FROM (SELECT max(n) AS n FROM (SELECT {SIG}, {e} AS x, count(*) AS n FROM sched GROUP BY ALL) GROUP BY {ROUTE}, x)"
    return {
        "weekly_signatures": s(WEEKS) + "SELECT * FROM weeks",
        "exact_periods": s(WEEKS, EXACT) + "SELECT * FROM exact",
        "pattern_periods": s(PATTERN) + "SELECT * FROM pattern",
        "expand_periods": s(PATTERN, expanded("pattern", "x")) + "SELECT * FROM x",
        "pattern_exclusions": s(PATTERN, expanded("pattern", "x")) + "SELECT * FROM x EXCEPT SELECT * FROM sched",
        "false_row_reasons": s(PATTERN, expanded("pattern", "pattern_x"), pattern_f) + """SELECT *, CASE WHEN (reporting_carrier, flight_number, flight_date, origin, destination) IN (SELECT (reporting_carrier, flight_number, flight_date, origin, destination) FROM sched) THEN 'time'
            WHEN (reporting_carrier, flight_number, flight_date) IN (SELECT (reporting_carrier, flight_number, flight_date) FROM sched) THEN 'route' ELSE 'not_operating' END AS reason FROM pattern_f""",
        "missing_rows": w(FLIGHTS, SCHED.replace("sched AS", "all_sched AS", 1), "sched AS (SELECT * FROM all_sched WHERE month(flight_date) <= 6)", PATTERN, expanded("pattern", "x")) + f"SELECT {COLS} FROM all_sched EXCEPT SELECT {COLS} FROM x",
        "reconstruction_accuracy": s(WEEKS, EXACT, PATTERN, expanded("exact", "exact_x"), expanded("pattern", "pattern_x"), exact_f, pattern_f) + accuracy("exact", "exact") + " UNION ALL " + accuracy("pattern", "pattern"),
        "sample_reconstruction": s(DAYS, WEEKS, EXACT, PATTERN, STABLE, MODES, TIMES, sample_keys, rebuilt("exact"), rebuilt("pattern")) + sample("exact") + " UNION ALL " + sample("pattern"),
        "compaction_summary": s(WEEKS, EXACT, PATTERN, expanded("pattern", "x")) + f"""SELECT *, {r('source_rows / exact_period_rows', 'exact_row_ratio', 6)}, {r('source_rows / pattern_period_rows', 'pattern_row_ratio', 6)} FROM (
            SELECT count(*) AS source_rows, min(flight_date) AS date_start, max(flight_date) AS date_end, (SELECT count(*) FROM exact) AS exact_period_rows, (SELECT count(*) FROM pattern) AS pattern_period_rows,
            (SELECT count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM sched)) AS pattern_exclusion_rows FROM sched)""",
        "route_stability": s(STABLE) + f"SELECT {routes_list}, {r('dominant_route_date_share', 'dominant_route_date_share')} FROM routes",
        "schedule_modes": s(MODES) + f"SELECT {SIG}, n FROM modes",
        "schedule_stability": s(DAYS, MODES, TIMES) + f"SELECT {times_list}, {round_all(['modal_time_pair_share', 'median_departure_deviation', 'p90_departure_deviation', 'median_arrival_deviation', 'p90_arrival_deviation'])} FROM times",
        "operating_patterns": s(OPS) + f"SELECT {ROUTE}, first_date, last_date, operating_dates, active_months, maximum_gap_days, active_weekday_mask, operating_pattern, {r('calendar_density', 'calendar_density')} FROM ops",
        "stability_findings": s(STABLE) + f"""SELECT *, {pct(['single_route', 'multiple_routes', 'dominant_ge_90', 'dominant_ge_95', 'dominant_ge_99', 'dominant_100', 'same_date_multi_segment'], 'combinations')} FROM (
            SELECT count(*) AS combinations, count(*) FILTER (distinct_routes = 1) AS single_route, count(*) FILTER (distinct_routes > 1) AS multiple_routes, {shares('dominant_route_date_share', 'dominant')},
            count(*) FILTER (has_same_date_multi_segment) AS same_date_multi_segment, {qq('distinct_routes', .5, 'median_routes')}, {qq('distinct_routes', .9, 'p90_routes')},
            {qq('route_set_changes', .5, 'median_route_set_changes')}, {qq('route_set_changes', .9, 'p90_route_set_changes')} FROM routes)""",
        "schedule_findings": s(DAYS, MODES, TIMES) + f"""SELECT *, {pct(['single_time_pair', 'multiple_time_pairs', 'modal_ge_90', 'modal_ge_95', 'modal_ge_99', 'modal_100'], 'route_combinations')} FROM (
            SELECT count(*) AS route_combinations, count(*) FILTER (distinct_time_pairs = 1) AS single_time_pair, count(*) FILTER (distinct_time_pairs > 1) AS multiple_time_pairs, {shares('modal_time_pair_share', 'modal')},
            {qq('distinct_time_pairs', .5, 'median_time_pairs')}, {qq('distinct_time_pairs', .9, 'p90_time_pairs')}, {qq('median_departure_deviation', .5, 'median_of_median_departure_deviation')},
            {qq('p90_departure_deviation', .9, 'p90_of_route_p90_departure_deviation')}, {qq('schedule_changes', .5, 'median_schedule_changes')}, {qq('schedule_changes', .9, 'p90_schedule_changes')} FROM times)""",
        "pattern_counts": s(OPS) + "SELECT operating_pattern, count(*) AS routes FROM ops GROUP BY 1",
        "stability_examples": s(DAYS, STABLE, MODES, TIMES) + f"""SELECT * FROM (SELECT 'stable' AS kind, {NUM}, dominant_route AS route, operating_dates AS score FROM routes WHERE distinct_routes = 1 AND operating_dates >= 900 ORDER BY operating_dates DESC, {NUM} LIMIT 1)
            UNION ALL SELECT * FROM (SELECT 'route_change', {NUM}, dominant_route, route_set_changes FROM routes WHERE distinct_routes > 1 AND NOT has_same_date_multi_segment AND operating_dates >= 100 ORDER BY route_set_changes DESC, operating_dates DESC, {NUM} LIMIT 1)
            UNION ALL SELECT * FROM (SELECT 'schedule_change', {NUM}, origin || '-' || destination, schedule_changes FROM times WHERE records >= 100 AND distinct_time_pairs > 1 ORDER BY schedule_changes DESC, records DESC, {ROUTE} LIMIT 1)
            UNION ALL SELECT * FROM (SELECT 'multi_segment', {NUM}, dominant_route, multi_segment_dates FROM routes WHERE has_same_date_multi_segment ORDER BY multi_segment_dates DESC, distinct_routes DESC, {NUM} LIMIT 1)""",
        "modal_accuracy": s("acc AS (" + " UNION ALL ".join(modal(d, e) for d, e in (("global", "0"), ("weekday", "isodow(flight_date)"), ("month", "month(flight_date)"), ("year", "year(flight_date)"))) + ")")
            + f"SELECT dimension, {r('a', 'modal_accuracy')}, {r('100 * (round(a, 9) - (SELECT round(a, 9) FROM acc WHERE dimension = ' + chr(39) + 'global' + chr(39) + '))', 'gain_pp', 6)} FROM acc",
        "lookup_statistics": s() + f"""SELECT *, {r('100.0 * unique_keys / observed_keys', 'unique_key_percent', 6)}, {r('100.0 * multiple_segment_keys / observed_keys', 'multiple_key_percent', 6)} FROM (
            SELECT count(*) AS observed_keys, count(*) FILTER (n = 1) AS unique_keys, count(*) FILTER (n > 1) AS multiple_segment_keys, sum(n)::BIGINT AS records_with_flight_number, (sum(n) FILTER (n = 1))::BIGINT AS records_in_unique_keys,
            (sum(n) FILTER (n > 1))::BIGINT AS records_in_multiple_keys, max(n) AS maximum_segments, count(*) FILTER (n > 1 AND d = n) AS multiple_keys_all_distinct_routes, count(*) FILTER (n > 1 AND d < n) AS multiple_keys_with_repeated_route
            FROM (SELECT count(*) AS n, count(DISTINCT origin || '>' || destination) AS d FROM sched GROUP BY {NUM}, flight_date))""",
        "lookup_flights": w(FLIGHTS, SCHED, ITINS, LOOKUPS) .rstrip() + ", " + lookup("sched ON flight_date = qd"),
        "lookup_periods": w(FLIGHTS, SCHED, WEEKS, EXACT, ITINS, LOOKUPS).rstrip() + ", " + lookup(f"exact ON qd BETWEEN valid_from AND valid_to AND (weekday_mask >> (isodow(qd) - 1)::INT) % 2 = 1"),
    }
