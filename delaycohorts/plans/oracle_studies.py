"""SQL for the studies: replay windows, tails, thresholds, strata."""

from __future__ import annotations

from delaycohorts.plans import oracle as o
from delaycohorts.plans.oracle import FLIGHTS, HIST, ONE, SEED, YEARS, md5, q, r, tri, u01, w


def _sampled(n: int) -> str:
    """n holdout flights per year in hash order, as the table ``cases``."""
    base = o.REPLAY_CASES.strip().replace("cases AS", "all_cases AS", 1)
    return base + f""",
cases AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY test_year ORDER BY {md5('case_id', f"'{SEED}'")}) AS k FROM all_cases) WHERE k <= {n})"""


def _replay(cases: str, ties: bool = False) -> str:
    configs = [(f"{m}_months", m, 30) for m in (6, 12, 24)] + [("fixed_training_period", None, 30)] + [(f"threshold_{t}", None, t) for t in (10, 30, 60)]
    rows = ", ".join(f"('{n}', {m or 'NULL'}, {t})" for n, m, t in configs)
    crossed = f"""
crossed AS (SELECT cases.* EXCLUDE (hs, he, min_obs, case_id), case_id || config AS case_id, config, least_ AS min_obs,
  CASE WHEN months IS NULL THEN DATE '1995-01-01' ELSE greatest(DATE '1995-01-01', CAST(prediction_date - to_months(months) AS DATE)) END AS hs,
  CASE WHEN months IS NULL THEN make_date(test_year, 1, 1) ELSE prediction_date END AS he FROM cases, (VALUES {rows}) t(config, months, least_))"""
    dims = {"carrier": "carrier", "route_volume_group": o.VOLUME.format("n_route_carrier"), "month": "CAST(month(prediction_date) AS VARCHAR)", "all": "'all'"}
    final = " UNION ALL ".join(f"SELECT test_year, config, '{d}' AS dimension, {e} AS value, {o.arrival_metrics()} FROM rows_ GROUP BY 1, 2, 3, 4" for d, e in dims.items())
    exact = "exact AS (SELECT * REPLACE (round(p50, 9) AS p50, round(p75, 9) AS p75, round(p90, 9) AS p90) FROM rows_)"
    if ties:  # quantiles without the last bits of a double, as in the query
        return w(FLIGHTS, HIST, cases, crossed, o.ladder("crossed"), o.chosen(), o.REPLAY_ROWS, exact) + final.replace("FROM rows_", "FROM exact")
    return w(FLIGHTS, HIST, cases, crossed, o.ladder("crossed"), o.chosen(), o.REPLAY_ROWS) + final


def _pool_sql(center: str, source: str, keys: str, name: str, min_center: str, min_source: int) -> str:
    """Single values with the top fifth replaced; the source tail is read by rank interpolation."""
    on = " AND ".join(f"{{0}}.{k} = {{1}}.{k}" for k in keys.split(", "))
    return f"""
{name}_c AS (SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY v) AS rn, count(*) OVER (PARTITION BY {keys}) AS n, CAST(floor(count(*) OVER (PARTITION BY {keys}) * 0.2::DOUBLE) AS BIGINT) AS kc FROM {center}),
{name}_s AS (SELECT * FROM (SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY v DESC) AS top, CAST(floor(count(*) OVER (PARTITION BY {keys}) * 0.2::DOUBLE) AS BIGINT) AS ks FROM {source}) WHERE top <= ks),
{name}_r AS (SELECT {keys}, v, ks, ks - top AS pos FROM {name}_s),
{name}_p AS (SELECT DISTINCT {keys}, kc, coalesce(ks, 0) AS ks, coalesce(ks, 0) >= {min_source} AND kc > 0 AND {min_center} AS swap FROM {name}_c LEFT JOIN (SELECT DISTINCT {keys}, ks FROM {name}_s) USING ({keys})),
{name}_g AS (SELECT {keys}, ks, (ks - 1) * (i + 0.5::DOUBLE) / kc AS h FROM {name}_p, LATERAL (SELECT unnest(generate_series(0, kc - 1)) AS i) WHERE swap),
{name} AS (
  SELECT c.{keys.replace(', ', ', c.')}, c.v::DOUBLE AS v FROM {name}_c c JOIN {name}_p p ON {on.format('c', 'p')} WHERE NOT swap OR rn <= n - c.kc
  UNION ALL SELECT g.{keys.replace(', ', ', g.')}, a.v + (b.v - a.v) * (h - floor(h)) FROM {name}_g g JOIN {name}_r a ON {on.format('a', 'g')} AND a.pos = CAST(floor(h) AS BIGINT)
    JOIN {name}_r b ON {on.format('b', 'g')} AND b.pos = CAST(ceil(h) AS BIGINT))"""


NAMES = (("baseline", "m_base"), ("hierarchical_tail_pooling", "p1"), ("recent_tail_augmentation", "p2"), ("tail_aware_carrier_month_bucket", "p3"))


def _tails(bare: str = "cases") -> tuple[str, ...]:
    rolling = lambda months: f"greatest(DATE '1995-01-01', CAST(prediction_date - INTERVAL {months} MONTH AS DATE)) AS hs, prediction_date AS he, 30 AS min_obs"
    one = lambda src, lv, name: f"{name} AS (SELECT c.case_id, h.arrival_delay_minutes AS v FROM {src} c JOIN hist h ON {o.SAME[lv]} AND h.flight_date >= c.hs AND h.flight_date < c.he)"
    flat = lambda name: f"{name} AS (SELECT case_id, delay AS v FROM {name}_m)"
    return (
        f"c24 AS (SELECT * EXCLUDE (hs, he, min_obs), {rolling(24)} FROM {bare})", f"c6 AS (SELECT * EXCLUDE (hs, he, min_obs), {rolling(6)} FROM {bare})",
        o.ladder("c24", "a_"), o.chosen("a_counts", "sel24"), o.ladder("c6", "b_"), o.chosen("b_counts", "sel6"),
        o.members("sel24", "m_base_m"), flat("m_base"), o.members("sel6", "m_near_m"), flat("m_near"), one("a_keyed", 2, "m_season"), one("a_keyed", 7, "m_cmb"),
        _pool_sql("m_base", "m_season", "case_id", "p1", "kc < 100", 100), _pool_sql("m_base", "m_near", "case_id", "p2", "true", 30), _pool_sql("m_base", "m_cmb", "case_id", "p3", "kc < 100", 100),
        "pool AS (" + " UNION ALL ".join(f"SELECT case_id, '{n}' AS candidate, v::DOUBLE AS v FROM {t}" for n, t in NAMES) + ")",
    )


def _boundary() -> str:
    sizes = "(2, 3, 4, 5, 6, 20, 24, 25, 28, 29, 30, 31, 32, 35, 40)"
    cohort = "reporting_carrier, origin, destination, month, day_of_week, departure_time_bucket"
    cases = f"""
sizes AS ({' UNION ALL '.join(f"SELECT {cohort}, {y} AS test_year, count(*) AS specific_n FROM hist WHERE flight_date >= DATE '1995-01-01' AND year < {y} GROUP BY ALL HAVING count(*) IN {sizes}" for y in YEARS)}),
near AS (SELECT *, {o.FLIGHT_ID} AS case_id FROM hist JOIN sizes USING ({cohort}) WHERE year = test_year),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {cohort}, test_year ORDER BY {md5('case_id', f"'{SEED}'")}) AS k1 FROM near) WHERE k1 = 1),
cases AS (SELECT case_id, reporting_carrier AS carrier, origin, destination, flight_date AS prediction_date, crs_departure_minutes AS departure_minutes, crs_arrival_minutes AS arrival_minutes, test_year,
  DATE '1995-01-01' AS hs, make_date(test_year, 1, 1) AS he, 30 AS min_obs FROM (SELECT *, row_number() OVER (PARTITION BY specific_n, test_year ORDER BY {md5('case_id', f"'{SEED + 1}'")}) AS k2 FROM firsts) WHERE k2 <= 15)"""
    role = lambda name, index: (o.chosen("counts", f"s_{name}", index), o.members(f"s_{name}", f"m_{name}", extra=", c.layover_minutes, c.cohort_level, c.cohort_size"),
        f"e_{name} AS (SELECT case_id, cohort_level AS {name}_level, cohort_size::BIGINT AS {name}_n, quantile_cont(delay, 0.5) AS {name}_median, quantile_cont(delay, 0.75) AS {name}_p75, quantile_cont(delay, 0.9) AS {name}_p90, avg({tri('layover_minutes - 35 - delay')}) AS {name}_probability FROM m_{name} GROUP BY ALL)")
    return ",\n".join(x.strip() for x in (
        FLIGHTS, HIST, cases, o.options("cases", "flights", "hashed"), o.ladder("routed"), *role("specific", "CASE WHEN n_exact > 0 THEN 0 END"), *role("production", o.pick("30")), *role("broader", o.broader()),
        "edge AS (SELECT routed.*, s.* EXCLUDE (case_id), p.* EXCLUDE (case_id), b.* EXCLUDE (case_id), abs(specific_probability - production_probability) * 100 AS disp, abs(specific_probability - broader_probability) * 100 AS contr FROM routed JOIN e_specific s USING (case_id) JOIN e_production p USING (case_id) JOIN e_broader b USING (case_id))",
    ))


def _midpoints(source: str, k: str, name: str) -> str:
    """Rank-interpolated quantiles at (i + 0.5) / k of the single values in ``source``."""
    return f"""
{name}_o AS (SELECT case_id, delay AS v, {k} AS k, row_number() OVER (PARTITION BY case_id ORDER BY delay) - 1 AS pos, count(*) OVER (PARTITION BY case_id) AS n FROM {source}),
{name}_g AS (SELECT case_id, (n - 1) * (i + 0.5::DOUBLE) / k AS h FROM (SELECT DISTINCT case_id, k, n FROM {name}_o), LATERAL (SELECT unnest(generate_series(0, k - 1)) AS i)),
{name} AS (SELECT g.case_id, a.v + (b.v - a.v) * (h - floor(h)) AS v FROM {name}_g g JOIN {name}_o a ON a.case_id = g.case_id AND a.pos = CAST(floor(h) AS BIGINT) JOIN {name}_o b ON b.case_id = g.case_id AND b.pos = CAST(ceil(h) AS BIGINT))"""


def _blend(source: str = "counts") -> tuple[str, ...]:
    """Values of the blended cohorts as the table ``blended`` with labels in ``labels``."""
    k = "CAST(round_even(2000 * (n_exact / 60::DOUBLE), 0) AS BIGINT)"
    return (
        o.chosen(f"(SELECT * FROM {source} WHERE n_exact >= 60)", "b_whole", "0"), o.chosen(f"(SELECT * FROM {source} WHERE n_exact = 0)", "b_empty", o.pick("30")),
        o.chosen(f"(SELECT * FROM {source} WHERE n_exact BETWEEN 1 AND 59)", "b_narrow", "0"), o.chosen(f"(SELECT * FROM {source} WHERE n_exact BETWEEN 1 AND 59)", "b_broad", o.pick("30", 1)),
        o.members("b_whole", "bm1"), o.members("b_empty", "bm2"), o.members("b_narrow", "bm3", extra=", c.n_exact"), o.members("b_broad", "bm4", extra=", c.n_exact"),
        _midpoints("bm3", k, "g3"), _midpoints("bm4", f"2000 - {k}", "g4"),
        "blended AS (SELECT case_id, delay AS v FROM bm1 UNION ALL SELECT case_id, delay FROM bm2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4)",
        """labels AS (SELECT case_id, 'blend_exact_100pct' AS blend_label, 1.0::DOUBLE AS specific_weight FROM b_whole UNION ALL SELECT case_id, 'blend_' || cohort_level, 0.0 FROM b_empty
          UNION ALL SELECT case_id, 'blend_exact_' || format('{:.3f}', n_exact / 60::DOUBLE) || '_' || cohort_level, n_exact / 60::DOUBLE FROM b_broad)""",
    )


def _thresholds() -> str:
    cases = _sampled(150)
    crossed = "crossed AS (SELECT counts.* EXCLUDE (min_obs, case_id), case_id || t AS case_id, case_id AS id, t AS min_obs FROM counts, (VALUES (20), (30), (40), (60)) x(t))"
    out = f"CASE WHEN actual + 35 + {o.inv(u01('id', chr(39) + str(SEED) + chr(39)))} <= layover_minutes THEN 1.0 ELSE 0.0 END AS outcome"
    stats = "quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90"
    hard = "hm AS (SELECT m.case_id, delay AS v, actual, layover_minutes FROM hard_m m JOIN hard USING (case_id))"
    blend = "bv AS (SELECT b.case_id, v, actual, layover_minutes FROM blended b JOIN counts USING (case_id))"
    est = lambda src, name: f"{name} AS (SELECT * FROM (SELECT case_id, {stats}, avg({tri('layover_minutes - 35 - v')}) AS probability FROM {src} GROUP BY 1) JOIN ({o.crps_sql(src, 'v', 'case_id', 'actual')}) USING (case_id))"
    level = "CASE cohort_level " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(o.LEVELS)) + " END"
    rows = f"""rows_ AS (SELECT test_year, 'hard_n' || min_obs AS method, {level} AS li, NULL::DOUBLE AS sw, actual, layover_minutes, p50, p75, p90, crps, probability, {out} FROM hard JOIN he USING (case_id)
      UNION ALL SELECT test_year, 'research_blend_n_over_60', NULL, specific_weight, actual, layover_minutes, p50, p75, p90, crps, probability, {out.replace("'|', id", "'|', case_id")} FROM (SELECT *, case_id AS id FROM counts) JOIN labels USING (case_id) JOIN be USING (case_id))"""
    return w(FLIGHTS, HIST, cases, o.options("cases", "flights", "hashed"), o.ladder("routed"), crossed, o.chosen("crossed", "hard"), o.members("hard", "hard_m"), hard, est("hm", "he"), *_blend(), blend, est("bv", "be"), rows) + f"""
      SELECT * FROM (SELECT test_year, method, {o.arrival_metrics(digits=6)}, {r('avg(li)', 'mean_cohort_level_index', 6)}, {r('avg(sw)', 'mean_specific_weight', 6)} FROM rows_ GROUP BY 1, 2)
      JOIN (SELECT * EXCLUDE (sample_count) FROM ({o.conn_metrics('test_year, method', 'rows_', digits=6)})) USING (test_year, method)"""


def _strata_inputs(status: bool, target: int, seed: int) -> tuple[str, ...]:
    from delaycohorts.plans.oracle_parts import strata, stratified

    cases = o.RECORD_CASES if status else o.REPLAY_CASES
    picked = f"picked AS (SELECT * EXCLUDE (route_count, population_count, stratum_rank, quota, place, sampled_count) FROM weighted)"
    return (cases, strata("status" if status else None), stratified(target, seed), picked)


def _draws(base: str, sums: tuple[str, ...], replicates: int, seed: int) -> str:
    """Sums over the draws of every replicate; ``units`` holds the base columns, ``unit`` (their md5) and the sums."""
    total = ", ".join(f"sum({c}) AS {c}" for c in sums)
    return f"""
placed AS (SELECT *, row_number() OVER (PARTITION BY {base} ORDER BY unit) - 1 AS idx, count(*) OVER (PARTITION BY {base}) AS size FROM units),
reps AS (SELECT {base}, replicate, {total} FROM (SELECT {base}, replicate, {o.h60(f"'{seed}'", "replicate", "idx")} % size AS idx FROM placed, generate_series(1, {replicates}) g(replicate))
  JOIN placed USING ({base}, idx) GROUP BY ALL)"""


def _limits(base: str, metrics: dict[str, str]) -> str:
    long = " UNION ALL ".join(f"SELECT {base}, '{name}' AS metric, {e} AS m FROM reps" for name, e in metrics.items())
    return f"limits AS (SELECT {base}, metric, count(*) AS replicates, {q(.025, 'lower', 'm', 6)}, {q(.975, 'upper', 'm', 6)} FROM ({long}) GROUP BY ALL)"


def _connection_limits(source: str, base: str, unit: tuple[str, ...], replicates: int, seed: int) -> tuple[str, ...]:
    """Intervals of Brier score, calibration error and gap over weighted rows with probability and outcome."""
    bins = {f"g{b}": f"sum(CASE WHEN least(CAST(floor(probability * 10) AS INT), 9) = {b} THEN (probability - outcome) * weight ELSE 0 END)" for b in range(10)}
    sums = {"ww": "sum(weight)", "wb": "sum((probability - outcome) * (probability - outcome) * weight)", "gap": "sum((probability - outcome) * weight)"} | bins
    units = f"units AS (SELECT {base}, {md5(chr(39) + 'unit' + chr(39), *base.split(', '), *unit)} AS unit, {', '.join(f'{e} AS {n}' for n, e in sums.items())} FROM {source} GROUP BY ALL)"
    error = " + ".join(f"abs({b})" for b in bins)
    return units, _draws(base, tuple(sums), replicates, seed), _limits(base, {"brier_score": "wb / ww", "ece": f"({error}) / ww", "mean_calibration_gap": "gap / ww"})


def _stratified_arrivals_full() -> str:
    exact = "exact AS (SELECT * REPLACE (round(p50, 9) AS p50, round(p75, 9) AS p75, round(p90, 9) AS p90) FROM rows_)"
    unit = md5("'unit'", "test_year", "strategy", "case_id[1:length(case_id) - 1]")
    units = f"units AS (SELECT test_year, strategy, {unit} AS unit, CASE WHEN actual <= p90 THEN weight ELSE 0.0 END AS covered, weight AS ww FROM exact)"
    base = "test_year, strategy"
    head, final = _stratified_arrivals().rsplit("\nSELECT", 1)
    ctes = (exact, units, _draws(base, ("covered", "ww"), 500, SEED), _limits(base, {"p90_coverage": "covered / ww"}))
    found = ("SELECT" + final).replace("FROM rows_", "FROM exact")
    return f"{head},\n" + ",\n".join(c.strip() for c in ctes) + f"\nSELECT * FROM ({found}) LEFT JOIN (SELECT *, 'all' AS dimension FROM limits) USING (test_year, strategy, dimension)"


def _stratified_arrivals() -> str:
    both = """both_ AS (SELECT * EXCLUDE (hs, he, case_id), case_id || 'r' AS case_id, 'previous_24_months' AS strategy, greatest(DATE '1995-01-01', CAST(prediction_date - INTERVAL 24 MONTH AS DATE)) AS hs, prediction_date AS he FROM picked
      UNION ALL SELECT * EXCLUDE (hs, he, case_id), case_id || 'f', 'all_prior_fixed_training', DATE '1995-01-01', make_date(test_year, 1, 1) FROM picked)"""
    dims = {d: d for d in ("carrier", "route_volume_group", "season", "time_bucket", "severity", "cohort_level")} | {"month": "CAST(month(prediction_date) AS VARCHAR)", "all": "'all'"}
    final = " UNION ALL ".join(f"SELECT test_year, strategy, '{d}' AS dimension, {e} AS value, {o.arrival_metrics('weight', digits=6)} FROM rows_ GROUP BY 1, 2, 3, 4" for d, e in dims.items())
    return w(FLIGHTS, HIST, *_strata_inputs(False, 500, SEED), both, o.ladder("both_"), o.chosen(), o.REPLAY_ROWS) + final


def _conn_rows(target: int) -> tuple[str, ...]:
    return (
        FLIGHTS, HIST, ONE, *_strata_inputs(True, target, SEED + 100), o.options("picked", "one", "constant"),
    )


def _stratified_connections_full() -> str:
    head, _ = _stratified_connections().split("two AS (", 1)
    two = "two AS (SELECT * EXCLUDE (combined, conditional), 'combined' AS kind, round(combined, 9) AS probability FROM conn UNION ALL SELECT * EXCLUDE (combined, conditional), 'conditional', round(conditional, 9) FROM conn)"
    limits = _connection_limits("two", "test_year, kind", ("case_id",), 500, SEED + 1)
    return head + ",\n".join(c.strip() for c in (two, *limits)) + f"\nSELECT * FROM ({o.conn_metrics('test_year, kind', 'two', 'weight', digits=6)}) LEFT JOIN limits USING (test_year, kind)"


def _stratified_connections() -> str:
    parts = (*_conn_rows(300), o.ladder("routed"), o.chosen(), o.members(extra=", c.layover_minutes"),
        f"cond AS (SELECT case_id, avg({tri('layover_minutes - 35 - delay')}) AS conditional FROM mem GROUP BY 1)", o.status_ladder("picked", "one"),
        f"conn AS (SELECT sel.*, conditional, completion_probability * conditional AS combined, {o.OUTCOME} AS outcome FROM sel JOIN cond USING (case_id) JOIN shares USING (case_id))",
        "two AS (SELECT *, 'combined' AS kind, combined AS probability FROM conn UNION ALL SELECT *, 'conditional', conditional FROM conn)")
    return w(*parts) + o.conn_metrics("test_year, kind", "two", "weight", digits=6)


def _tail_rows(target: int, probability: str, extra: str = "") -> tuple[str, ...]:
    return (*_conn_rows(target), *_tails("routed"),
        f"scored AS (SELECT case_id, candidate, avg({tri('layover_minutes - 35 - v')}) AS probability FROM pool JOIN routed USING (case_id) GROUP BY 1, 2)",
        f"conn AS (SELECT test_year, weight, candidate, {probability}, {o.OUTCOME} AS outcome{extra} FROM scored JOIN routed USING (case_id))")


def _tail_connections() -> str:
    return w(*_tail_rows(200, "round(probability, 9) AS probability")) + o.conn_metrics("test_year, candidate", "conn", "weight", digits=6)


def _tail_connections_full() -> str:
    cluster = ", origin || '-' || destination AS rt, strftime(prediction_date, '%Y-%m') AS mo"
    limits = _connection_limits("conn", "test_year, candidate", ("rt", "mo"), 300, SEED + 1)
    return w(*_tail_rows(1000, "round(probability, 9) AS probability", cluster), *limits) + f"SELECT * FROM ({o.conn_metrics('test_year, candidate', 'conn', 'weight', digits=6)}) LEFT JOIN limits USING (test_year, candidate)"


def studies() -> dict[str, str]:
    delays = "arrival_delay_minutes"
    sens = lambda label, v: f"SELECT '{label}' AS treatment, {q(.5, 'median', v)}, {q(.75, 'p75', v)}, {q(.9, 'p90', v)}, " + ", ".join(r(f"avg({tri(f'{m} - 35 - {v}')})", f"probability_{m}") for m in (45, 85, 120)) + " FROM clipped"
    tail_rows = f"""level AS (SELECT s.case_id, s.cohort_level, s.cohort_size, s.actual, n.cohort_level AS near_level, share FROM sel24 s JOIN sel6 n USING (case_id) LEFT JOIN (SELECT case_id, avg(CASE WHEN v > 30 THEN 1.0 ELSE 0.0 END) AS share FROM m_near GROUP BY 1) USING (case_id)),
      pooled AS (SELECT case_id, candidate, v, actual FROM pool JOIN level USING (case_id)),
      tq AS (SELECT case_id, candidate, {', '.join(q(p, f'p{round(p * 100)}', 'v') for p in (.5, .75, .9, .95))} FROM pooled GROUP BY 1, 2), tc AS ({o.crps_sql('pooled', 'v', 'case_id, candidate', 'actual')})"""
    pool_keys = "reporting_carrier, origin, destination"
    b = _boundary()
    pp = lambda c, p, n, cond="": r(f"quantile_cont({c}, {p}){cond}", n)
    return {
        "temporal_replay": _replay(_sampled(200)),
        "temporal_replay_full": _replay(o.REPLAY_CASES, ties=True),
        "tail_sensitivity": w(FLIGHTS, HIST, f"clipped AS (SELECT {delays} AS raw, greatest(lo, least(hi, {delays})) AS cut FROM hist, (SELECT quantile_cont({delays}, 0.001) AS lo, quantile_cont({delays}, 0.999) AS hi FROM hist))")
            + sens("all_retained", "raw") + " UNION ALL " + sens("winsorized_0.1_99.9", "cut"),
        "tail_pool": w(FLIGHTS, HIST, f"center AS (SELECT {pool_keys}, {delays} AS v FROM hist)", f"source AS (SELECT c.reporting_carrier, origin, destination, {delays} AS v FROM hist JOIN (SELECT DISTINCT {pool_keys} FROM hist) c USING (origin, destination))",
            _pool_sql("center", "source", pool_keys, "p", "true", 100)) + f"SELECT {pool_keys}, count(*) AS n, {r('avg(v)', 'mean', 6)}, {r('max(v)', 'maximum', 6)}, {q(.9, 'p90', 'v', 6)} FROM p GROUP BY ALL",
        "tail_candidates": w(FLIGHTS, HIST, o.REPLAY_CASES, *_tails(), tail_rows) + f"""SELECT case_id, candidate, CASE WHEN candidate = 'recent_tail_augmentation' THEN cohort_level || '+recent_' || near_level ELSE cohort_level END AS cohort_level,
            cohort_size::BIGINT AS cohort_size, p50, p75, p90, p95, {r('crps', 'crps')}, {r('share', 'recent_severe_share')} FROM tq JOIN tc USING (case_id, candidate) JOIN level USING (case_id)""",
        "blend_cohorts": w(FLIGHTS, HIST, o.REPLAY_CASES, o.ladder(), *_blend()) + f"SELECT case_id, blend_label, {r('any_value(specific_weight)', 'specific_weight', 6)}, {q(.5, 'p50', 'v', 6)}, {q(.75, 'p75', 'v', 6)}, {q(.9, 'p90', 'v', 6)}, count(*) AS cohort_n FROM blended JOIN labels USING (case_id) GROUP BY 1, 2",
        "material_jump_carriers": "WITH " + b + " SELECT carrier, count(*) AS cases FROM edge WHERE disp >= 2.0 GROUP BY 1",
        "boundary_rows": "WITH " + b + " SELECT case_id, test_year, carrier, origin, destination, prediction_date, layover_minutes, specific_n, production_level, production_n, broader_level, broader_n, "
            + ", ".join(r(f"{x}_{m}", f"{x}_{m}") for x in ("specific", "production", "broader") for m in ("median", "p75", "p90", "probability")) + f", {r('disp', 'production_displacement_pp')}, {r('contr', 'boundary_contrast_pp')} FROM edge",
        "boundary_summary": "WITH " + b + f""" SELECT count(*) AS case_count, {pp('disp', .5, 'displacement_median')}, {pp('disp', .9, 'displacement_p90')}, {pp('disp', .95, 'displacement_p95')}, {r('max(disp)', 'displacement_maximum')},
            count(*) FILTER (disp >= 5) AS at_least_5pp, count(*) FILTER (disp >= 10) AS at_least_10pp, count(*) FILTER (specific_n < 30) AS below_30_cases, {pp('disp', .5, 'below_30_median', ' FILTER (specific_n < 30)')},
            {pp('disp', .95, 'below_30_p95', ' FILTER (specific_n < 30)')}, {r('max(disp) FILTER (specific_n < 30)', 'below_30_maximum')}, {pp('contr', .5, 'contrast_median')}, {pp('contr', .95, 'contrast_p95')}, {r('max(contr)', 'contrast_maximum')} FROM edge""",
        "worst_jumps": "WITH " + b + f" SELECT case_id, {r('disp', 'production_displacement_pp')} FROM edge ORDER BY disp DESC, case_id LIMIT 15",
        "threshold_study": _thresholds(),
        "stratified_study": _stratified_arrivals(),
        "stratified_connections": _stratified_connections(),
        "tail_experiment": _tail_connections(),
        "stratified_study_full": _stratified_arrivals_full(),
        "stratified_connections_full": _stratified_connections_full(),
        "tail_experiment_full": _tail_connections_full(),
    }
