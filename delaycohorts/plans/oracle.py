"""DuckDB SQL with the same meaning as the registered queries, written directly.

Where the jobs use running totals and histograms, the SQL joins single rows and ranks them,
so that the two sides share no method.
"""

from __future__ import annotations

SEED = 20260811
YEARS = (1999, 2000)

FLIGHTS = """
flights AS (
  SELECT flight_date, CAST(year(flight_date) AS INT) AS year, CAST(month(flight_date) AS INT) AS month,
         CAST(isodow(flight_date) AS INT) AS day_of_week,
         substr('AADLUAWNB6', 2*ci+1, 2) AS reporting_carrier, CAST(fn AS VARCHAR) AS flight_number,
         substr('ATLBOSDENJFKLAXORD', 3*oi+1, 3) AS origin, substr('ATLBOSDENJFKLAXORD', 3*di+1, 3) AS destination,
         dep AS crs_departure_minutes, arr AS crs_arrival_minutes,
         CASE WHEN dep < 360 THEN 'overnight' WHEN dep < 720 THEN 'morning' WHEN dep < 1080 THEN 'afternoon' ELSE 'evening' END AS departure_time_bucket,
         CASE WHEN c OR v THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS DOUBLE) * 3 - 45 END AS arrival_delay_minutes,
         c AS cancelled, v AS diverted,
         CASE WHEN c THEN 'cancelled' WHEN v THEN 'diverted' ELSE 'completed' END AS flight_status,
         'm_' || year(flight_date) || '_' || month(flight_date) AS source_file, l_orderkey, l_linenumber
  FROM (
    SELECT *, CAST((fn*97 + ci*53 + oi*131 + 5*(month(flight_date) % 2)) % 1440 AS INT) AS dep,
           CAST((fn*97 + ci*53 + oi*131 + 60 + 25*di) % 1440 AS INT) AS arr
    FROM (
      SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_shipdate AS DATE) AS flight_date,
             l_returnflag = 'R' AND l_tax < 0.02 AS c, l_returnflag = 'N' AND l_tax > 0.07 AS v,
             CAST(l_suppkey % 5 AS INT) AS ci, CAST(s_nationkey % 6 AS INT) AS oi,
             CAST((s_nationkey % 6 + 1 + c_nationkey % 5) % 6 AS INT) AS di, CAST(l_partkey % 12 + 1 AS INT) AS fn
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
           JOIN supplier ON l_suppkey = s_suppkey
    )
  )
)"""

HIST = """
hist AS (
  SELECT flight_date, year, month, day_of_week, reporting_carrier, origin, destination, crs_departure_minutes,
         crs_arrival_minutes, departure_time_bucket, arrival_delay_minutes, source_file, flight_number
  FROM (
    SELECT *, row_number() OVER (
      PARTITION BY flight_date, reporting_carrier, flight_number, origin, destination, crs_departure_minutes
      ORDER BY source_file, crs_arrival_minutes, arrival_delay_minutes) AS k
    FROM flights WHERE flight_status = 'completed' AND arrival_delay_minutes IS NOT NULL
  ) WHERE k = 1
)"""

# one record per flight key, any status: smallest by source, then the remaining columns in order
ONE = """
one AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY flight_date, reporting_carrier, flight_number, origin, destination, crs_departure_minutes
      ORDER BY source_file, crs_arrival_minutes, arrival_delay_minutes NULLS FIRST, cancelled, diverted, flight_status) AS k
    FROM flights
  ) WHERE k = 1
)"""

ITINS = """
itins AS (
  SELECT *, lpad(CAST(departure_minutes // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(departure_minutes % 60 AS VARCHAR), 2, '0')
            || CASE WHEN request_id % 107 = 2 THEN ':30' ELSE '' END AS first_departure_time,
         lpad(CAST(arrival_minutes // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(arrival_minutes % 60 AS VARCHAR), 2, '0') AS first_arrival_time,
         lpad(CAST(connecting_minutes // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(connecting_minutes % 60 AS VARCHAR), 2, '0') AS connecting_departure_time,
         CASE WHEN request_id % 101 = 5 THEN 'A*' WHEN request_id % 103 = 1 THEN ' ' || lower(carrier) ELSE carrier END AS carrier_text
  FROM (
    SELECT *, CAST((arrival_minutes + layover_minutes) % 1440 AS INT) AS connecting_minutes
    FROM (
      SELECT o_orderkey AS request_id,
        CASE WHEN o_orderkey % 40 IN (7, 13) THEN 'ZZ' ELSE substr('AADLUAWNB6', CAST(2*(o_orderkey % 5)+1 AS INT), 2) END AS carrier,
        substr('ATLBOSDENJFKLAXORD', CAST(3*(c_nationkey % 6)+1 AS INT), 3) AS origin,
        CASE WHEN o_orderkey % 40 IN (7, 11) THEN 'SFO' ELSE substr('ATLBOSDENJFKLAXORD', CAST(3*((c_nationkey % 6 + 1 + o_custkey % 5) % 6)+1 AS INT), 3) END AS connection,
        substr('ATLBOSDENJFKLAXORD', CAST(3*(((c_nationkey % 6 + 1 + o_custkey % 5) % 6 + 1 + o_orderkey % 5) % 6)+1 AS INT), 3) AS destination,
        CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 10 = 3 THEN 200 ELSE 30 END AS travel_date,
        CAST((o_orderkey*37 + (o_orderkey % 5)*11) % 1440 AS INT) AS departure_minutes,
        CAST(((o_orderkey*37 + (o_orderkey % 5)*11) % 1440 + 60 + (o_orderkey % 7)*45) % 1440 AS INT) AS arrival_minutes,
        CAST(CASE WHEN o_orderkey % 29 = 0 THEN 10 WHEN o_orderkey % 31 = 0 THEN 800 ELSE 20 + (o_orderkey % 11)*35 END AS INT) AS layover_minutes
      FROM orders JOIN customer ON o_custkey = c_custkey
    )
  )
)"""

CASES = """
cases AS (
  SELECT request_id AS case_id, carrier, origin, connection AS destination, travel_date AS prediction_date,
         departure_minutes, arrival_minutes, layover_minutes,
         CAST(travel_date - INTERVAL 24 MONTH AS DATE) AS hs, travel_date AS he, 30 AS min_obs
  FROM itins
)"""


def r(expr: str, name: str, digits: int = 9) -> str:
    return f"round({expr}, {digits}) AS {name}"


def tri(x: str) -> str:
    """Triangular(15, 25, 40) distribution function."""
    return (
        f"(CASE WHEN ({x}) <= 15 THEN 0 WHEN ({x}) <= 25 THEN (({x})-15)*(({x})-15)/250.0 "
        f"WHEN ({x}) < 40 THEN 1 - (40-({x}))*(40-({x}))/375.0 ELSE 1 END)"
    )


def inv(u: str) -> str:
    return f"(CASE WHEN ({u}) < 0.4 THEN 15 + sqrt(({u})*250.0) ELSE 40 - sqrt((1-({u}))*375.0) END)"


def md5(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


def h60(*parts: str) -> str:
    return f"CAST('0x' || substr({md5(*parts)}, 1, 15) AS BIGINT)"


def u01(*parts: str) -> str:
    return f"(CAST('0x' || substr({md5(*parts)}, 1, 8) AS BIGINT) / 4294967296.0)"


FLIGHT_ID = md5("flight_date", "reporting_carrier", "flight_number", "origin", "destination", "crs_departure_minutes")
SEVERITY = "CASE WHEN {0} <= 0 THEN 'early_or_on_time' WHEN {0} <= 30 THEN 'moderate_1_30' WHEN {0} <= 180 THEN 'severe_31_180' ELSE 'extreme_over_180' END"
SEASON = "CASE WHEN {0} IN (12,1,2) THEN 'winter' WHEN {0} < 6 THEN 'spring' WHEN {0} < 9 THEN 'summer' ELSE 'fall' END"
BUCKET = "CASE WHEN {0} < 360 THEN 'overnight' WHEN {0} < 720 THEN 'morning' WHEN {0} < 1080 THEN 'afternoon' ELSE 'evening' END"
VOLUME = "CASE WHEN coalesce({0},0) < 100 THEN 'low_lt_100' WHEN {0} < 1000 THEN 'medium_100_999' ELSE 'high_1000_plus' END"
LEVELS = ("exact", "route_carrier_month_bucket", "route_carrier_season", "route_carrier", "route", "carrier", "global")
COUNTS = tuple(f"n_{x}" for x in LEVELS)


def ladder(cases: str = "cases", p: str = "") -> str:
    """``{p}counts``: all seven sizes per case, by joining case and history rows."""
    inside = "h.flight_date >= c.hs AND h.flight_date < c.he"
    return f"""
{p}keyed AS (
  SELECT *, month(prediction_date) AS m, isodow(prediction_date) AS w, {BUCKET.format('departure_minutes')} AS b FROM {cases}
),
{p}fine AS (
  SELECT c.case_id, count(*) FILTER (h.month = c.m AND h.day_of_week = c.w AND h.departure_time_bucket = c.b) AS n1,
         count(*) FILTER (h.month = c.m AND h.departure_time_bucket = c.b) AS n2,
         count(*) FILTER (abs(h.month - c.m) IN (0, 1, 11)) AS n3, count(*) AS n4
  FROM {p}keyed c JOIN hist h ON h.reporting_carrier = c.carrier AND h.origin = c.origin AND h.destination = c.destination
  WHERE {inside} GROUP BY 1
),
{p}coarse AS (
  SELECT c.case_id, sum(h.n) AS n5 FROM {p}keyed c JOIN (SELECT origin, destination, flight_date, count(*) AS n FROM hist GROUP BY ALL) h
    ON h.origin = c.origin AND h.destination = c.destination WHERE {inside} GROUP BY 1
),
{p}byc AS (
  SELECT c.case_id, sum(h.n) AS n6 FROM {p}keyed c JOIN (SELECT reporting_carrier, flight_date, count(*) AS n FROM hist GROUP BY ALL) h
    ON h.reporting_carrier = c.carrier WHERE {inside} GROUP BY 1
),
{p}spans AS (SELECT DISTINCT hs, he FROM {p}keyed),
{p}every AS (
  SELECT c.hs, c.he, sum(h.n) AS n7 FROM {p}spans c, (SELECT flight_date, count(*) AS n FROM hist GROUP BY ALL) h WHERE {inside} GROUP BY ALL
),
{p}counts AS (
  SELECT k.*, coalesce(n1,0)::BIGINT AS n_exact, coalesce(n2,0)::BIGINT AS n_route_carrier_month_bucket, coalesce(n3,0)::BIGINT AS n_route_carrier_season,
         coalesce(n4,0)::BIGINT AS n_route_carrier, coalesce(n5,0)::BIGINT AS n_route, coalesce(n6,0)::BIGINT AS n_carrier, coalesce(n7,0)::BIGINT AS n_global
  FROM {p}keyed k LEFT JOIN {p}fine USING (case_id) LEFT JOIN {p}coarse USING (case_id) LEFT JOIN {p}byc USING (case_id)
       LEFT JOIN {p}every USING (hs, he)
)"""


def pick(minimum: str = "min_obs", above: int = 0) -> str:
    whens = [f"WHEN {c} >= {minimum} THEN {i}" for i, c in enumerate(COUNTS[:6]) if i >= above]
    return f"CASE {' '.join(whens)} WHEN n_global > 0 THEN 6 END"


def broader() -> str:
    return "CASE " + " ".join(f"WHEN {c} > 0 THEN {i}" for i, c in enumerate(COUNTS) if i >= 1) + " END"


def level_name(i: str) -> str:
    return "CASE " + i + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(LEVELS)) + " END"


def level_size(i: str) -> str:
    return "CASE " + i + " " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(COUNTS)) + " END"


def chosen(source: str = "counts", name: str = "sel", index: str | None = None) -> str:
    return f"""
{name} AS (
  SELECT *, {level_name('lv')} AS cohort_level, {level_size('lv')} AS cohort_size
  FROM (SELECT *, {index or pick()} AS lv FROM {source}) WHERE lv IS NOT NULL
)"""


SAME = {
    0: "h.reporting_carrier = c.carrier AND h.origin = c.origin AND h.destination = c.destination AND h.month = c.m AND h.day_of_week = c.w AND h.departure_time_bucket = c.b",
    1: "h.reporting_carrier = c.carrier AND h.origin = c.origin AND h.destination = c.destination AND h.month = c.m AND h.departure_time_bucket = c.b",
    2: "h.reporting_carrier = c.carrier AND h.origin = c.origin AND h.destination = c.destination AND abs(h.month - c.m) IN (0, 1, 11)",
    3: "h.reporting_carrier = c.carrier AND h.origin = c.origin AND h.destination = c.destination",
    4: "h.origin = c.origin AND h.destination = c.destination",
    5: "h.reporting_carrier = c.carrier",
    6: "true",
    7: "h.reporting_carrier = c.carrier AND h.month = c.m AND h.departure_time_bucket = c.b",
}


def members(source: str = "sel", name: str = "mem", key: str = "case_id", extra: str = "") -> str:
    """Every single delay of the chosen cohort of every case."""
    parts = [
        f"SELECT c.{key}{extra}, h.arrival_delay_minutes AS delay FROM {source} c JOIN hist h ON {on} AND h.flight_date >= c.hs AND h.flight_date < c.he WHERE c.lv = {i}"
        for i, on in SAME.items()
    ]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def crps_sql(source: str, value: str, keys: str, actual: str) -> str:
    """CRPS per key from single ranked values; ``source`` already holds ``actual``."""
    return f"""
SELECT {keys}, avg(abs({value} - {actual})) - sum((2*rn - n - 1) * {value}) / (max(n)::DOUBLE * max(n)) AS crps
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS rn, count(*) OVER (PARTITION BY {keys}) AS n FROM {source})
GROUP BY {keys}"""


def q(p: float, name: str, value: str = "delay", digits: int = 9) -> str:
    return r(f"quantile_cont({value}, {p})", name, digits)


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


BASE = (FLIGHTS, HIST, ITINS, CASES)
FULL = (*BASE, ladder(), chosen())

REPLAY_CASES = f"""
cases AS (
  SELECT {FLIGHT_ID} AS case_id, reporting_carrier AS carrier, origin, destination, flight_date AS prediction_date,
         crs_departure_minutes AS departure_minutes, crs_arrival_minutes AS arrival_minutes, arrival_delay_minutes AS actual,
         'completed' AS status, year AS test_year, DATE '1995-01-01' AS hs, make_date(year, 1, 1) AS he, 30 AS min_obs
  FROM hist WHERE year IN {YEARS}
)"""
RECORD_CASES = f"""
cases AS (
  SELECT {FLIGHT_ID} AS case_id, reporting_carrier AS carrier, origin, destination, flight_date AS prediction_date,
         crs_departure_minutes AS departure_minutes, crs_arrival_minutes AS arrival_minutes, coalesce(arrival_delay_minutes, 0.0) AS actual,
         flight_status AS status, year AS test_year, DATE '1995-01-01' AS hs, make_date(year, 1, 1) AS he, 30 AS min_obs
  FROM one WHERE year IN {YEARS}
)"""

# Cases of one cohort share their members; the fixed history makes that worthwhile.
REPLAY_ROWS = f"""
mem AS (
  SELECT c.case_id, c.actual, h.arrival_delay_minutes AS delay FROM sel c JOIN hist h ON {SAME[0]} AND h.flight_date >= c.hs AND h.flight_date < c.he WHERE lv = 0
  {' '.join(f"UNION ALL SELECT c.case_id, c.actual, h.arrival_delay_minutes FROM sel c JOIN hist h ON {SAME[i]} AND h.flight_date >= c.hs AND h.flight_date < c.he WHERE lv = {i}" for i in range(1, 7))}
),
quant AS (SELECT case_id, quantile_cont(delay, 0.5) AS p50, quantile_cont(delay, 0.75) AS p75, quantile_cont(delay, 0.9) AS p90 FROM mem GROUP BY 1),
score AS ({crps_sql('mem', 'delay', 'case_id', 'actual')}),
rows_ AS (SELECT * FROM sel JOIN quant USING (case_id) JOIN score USING (case_id))"""
REPLAY = (FLIGHTS, HIST, REPLAY_CASES, ladder(), chosen(), REPLAY_ROWS)


def pin(p: str, x: float) -> str:
    return f"avg(greatest({x}*(actual-{p}), ({x}-1)*(actual-{p})))"


def arrival_metrics(wt: str = "1.0", qs=(("p50", 0.5), ("p75", 0.75), ("p90", 0.9)), digits: int = 9) -> str:
    mean = lambda e: f"sum(({e}) * {wt}) / sum({wt})"
    out = ["count(*) AS sample_count", r(f"sum({wt})::DOUBLE", "population_weight", digits)]
    for name, x in qs:
        out.append(r(mean(f"CASE WHEN actual <= {name} THEN 1.0 ELSE 0.0 END"), f"{name}_coverage", digits))
        out.append(r(mean(f"greatest({x}*(actual-{name}), ({x}-1)*(actual-{name}))"), f"{name}_pinball_loss", digits))
    out.append(r(mean("abs(actual - p50)"), "median_mae", digits))
    out.append(r(mean("crps"), "mean_crps", digits))
    out.append(r(mean("CASE WHEN actual > 30 THEN 1.0 ELSE 0.0 END"), "severe_delay_frequency", digits))
    return ", ".join(out)


def options(cases: str, records: str, default: str, seed: int = SEED, name: str = "routed") -> str:
    """Outbound flight in first hash order of those 45..180 minutes later on the same date."""
    fall = "90" if default == "constant" else (
        "45 + CAST('0x' || substr(sha256(concat_ws('|', prediction_date, carrier, c.origin, c.destination, '" + str(seed) + "')), 1, 8) AS BIGINT) % 136"
    )
    order = md5("f.destination", "f.flight_number", "f.crs_departure_minutes", f"'{seed}'")
    return f"""
{name}_hit AS (
  SELECT case_id, crs_departure_minutes, out_destination FROM (
    SELECT c.case_id, f.crs_departure_minutes, f.destination AS out_destination,
           row_number() OVER (PARTITION BY c.case_id ORDER BY {order}, f.crs_departure_minutes, f.destination) AS k
    FROM {cases} c JOIN {records} f ON f.flight_date = c.prediction_date AND f.origin = c.destination
         AND f.crs_departure_minutes - c.arrival_minutes BETWEEN 45 AND 180
  ) WHERE k = 1
),
{name} AS (
  SELECT c.*{' EXCLUDE (layover_minutes)' if name == 'routed_itins' else ''}, CAST(coalesce(h.crs_departure_minutes - c.arrival_minutes, {fall}) AS INT) AS layover_minutes,
         coalesce(h.out_destination, 'UNKNOWN') AS out_destination,
         CAST(coalesce(h.crs_departure_minutes, (c.arrival_minutes + {fall}) % 1440) AS INT) AS out_minutes, h.case_id IS NOT NULL AS has_outbound
  FROM {cases} c LEFT JOIN {name}_hit h ON c.case_id = h.case_id
)"""


def status_ladder(cases: str = "cases", records: str = "flights") -> str:
    day = f"(SELECT {{0}} flight_date, count(*) AS t, count(*) FILTER (flight_status='completed') AS ok, count(*) FILTER (cancelled) AS c, count(*) FILTER (diverted) AS v FROM {records} GROUP BY ALL)"
    sums = "sum(t) AS t, sum(ok) AS ok, sum(h.c) AS c, sum(v) AS v"
    inside = "h.flight_date >= k.hs AND h.flight_date < k.he"
    return f"""
st1 AS (SELECT case_id, {sums} FROM {cases} k JOIN {day.format('reporting_carrier, origin, destination,')} h ON h.reporting_carrier = k.carrier AND h.origin = k.origin AND h.destination = k.destination WHERE {inside} GROUP BY 1),
st2 AS (SELECT case_id, {sums} FROM {cases} k JOIN {day.format('origin, destination,')} h ON h.origin = k.origin AND h.destination = k.destination WHERE {inside} GROUP BY 1),
st3 AS (SELECT case_id, {sums} FROM {cases} k JOIN {day.format('reporting_carrier,')} h ON h.reporting_carrier = k.carrier WHERE {inside} GROUP BY 1),
st4 AS (SELECT k.hs, k.he, {sums} FROM (SELECT DISTINCT hs, he FROM {cases}) k, {day.format('')} h WHERE {inside} GROUP BY ALL),
shares AS (
  SELECT case_id, status_level, status_size::BIGINT AS status_size, ok / status_size AS completion_probability, c / status_size AS cancellation_probability, v / status_size AS diversion_probability
  FROM (
    SELECT k.case_id, CASE WHEN a.t >= 30 THEN 'route_carrier' WHEN b.t >= 30 THEN 'route' WHEN e.t >= 30 THEN 'carrier' WHEN g.t > 0 THEN 'global' END AS status_level,
           CASE WHEN a.t >= 30 THEN a.t WHEN b.t >= 30 THEN b.t WHEN e.t >= 30 THEN e.t ELSE g.t END AS status_size,
           CASE WHEN a.t >= 30 THEN a.ok WHEN b.t >= 30 THEN b.ok WHEN e.t >= 30 THEN e.ok ELSE g.ok END AS ok,
           CASE WHEN a.t >= 30 THEN a.c WHEN b.t >= 30 THEN b.c WHEN e.t >= 30 THEN e.c ELSE g.c END AS c,
           CASE WHEN a.t >= 30 THEN a.v WHEN b.t >= 30 THEN b.v WHEN e.t >= 30 THEN e.v ELSE g.v END AS v
    FROM {cases} k LEFT JOIN st1 a USING (case_id) LEFT JOIN st2 b USING (case_id) LEFT JOIN st3 e USING (case_id) LEFT JOIN st4 g ON g.hs = k.hs AND g.he = k.he
  ) WHERE status_level IS NOT NULL
)"""


OUTCOME = f"CASE WHEN status = 'completed' AND actual + 35 + {inv(u01('case_id', chr(39) + str(SEED) + chr(39)))} <= layover_minutes THEN 1.0 ELSE 0.0 END"
CONNECTIONS = (
    FLIGHTS, HIST, ONE, RECORD_CASES, options("cases", "one", "hashed"), ladder("routed"), chosen(), members(extra=", c.layover_minutes"),
    f"cond AS (SELECT case_id, avg({tri('layover_minutes - 35 - delay')}) AS conditional_probability FROM mem GROUP BY 1)",
    status_ladder("cases", "one"),
    f"""conn AS (SELECT sel.*, status_level, conditional_probability, completion_probability * conditional_probability AS probability, {OUTCOME} AS outcome
       FROM sel JOIN cond USING (case_id) JOIN shares USING (case_id))""",
)


def binned(dims: str, source: str = "conn", wt: str = "1.0", p: str = "probability") -> str:
    return f"""
SELECT {dims}, least(CAST(floor({p} * 10) AS INT), 9) AS bin, count(*) AS n, sum({wt}) AS w, sum({p} * {wt}) AS wp, sum(outcome * {wt}) AS wy,
       sum(({p} - outcome) * ({p} - outcome) * {wt}) AS wb FROM {source} GROUP BY ALL"""


def conn_metrics(dims: str, source: str = "conn", wt: str = "1.0", p: str = "probability", digits: int = 9) -> str:
    return f"""
SELECT {dims}, sum(n)::BIGINT AS sample_count, {r('sum(wp)/sum(w)', 'mean_predicted_probability', digits)}, {r('sum(wy)/sum(w)', 'observed_success_frequency', digits)},
       {r('sum(wb)/sum(w)', 'brier_score', digits)}, {r('(sum(wp)-sum(wy))/sum(w)', 'mean_calibration_gap', digits)}, {r('sum(abs(wp-wy))/sum(w)', 'ece', digits)}
FROM ({binned(dims, source, wt, p)}) GROUP BY ALL"""


def statements() -> dict[str, str]:
    from delaycohorts.plans import oracle_parts as parts

    return parts.all_statements()
