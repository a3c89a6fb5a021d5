import datetime as d
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from delaycohorts.operators import cohorts as C
from delaycohorts.operators import distributions as D
from delaycohorts.operators.itineraries import score_itineraries, validate_itineraries
from delaycohorts.plans import studies as ST

HIST = "flight_date date, reporting_carrier string, origin string, destination string, departure_time_bucket string, arrival_delay_minutes double"
CASE = "case_id long, carrier string, origin string, destination string, prediction_date date, departure_minutes int"
ZONES = [("ATL", "US", "America/New_York"), ("JFK", "US", "America/New_York"), ("BOS", "US", "America/New_York"), ("LAX", "US", "America/Los_Angeles"), ("HNL", "US", "Pacific/Honolulu")]


def history(spark, rows):
    return spark.createDataFrame(rows, HIST)


def forty(spark):
    return history(spark, [(d.date(2024, 8, 20), "DL", "ATL", "JFK", "afternoon", float(x)) for x in range(-10, 30)])


def airports(spark):
    return spark.createDataFrame(ZONES, "code string, country string, tz string")


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id long, carrier string, origin string, connection string, destination string, travel_date date, first_departure_time string, first_arrival_time string, connecting_departure_time string")


def test_score_closed_form(spark):
    day = d.date(2026, 8, 20)
    rows = [(1, "DL", "ATL", "JFK", "BOS", day, "15:30", "17:45", "19:10"), (2, "DL", "ATL", "JFK", "ATL", day, "15:30", "17:45", "19:10")]
    got = {r.request_id: r for r in score_itineraries(requests(spark, rows), forty(spark), airports(spark)).collect()}
    r = got[1]
    assert (r.status, r.layover_minutes, r.cohort_level, r.cohort_size) == ("ok", 85, "route_carrier_month_bucket", 40)
    assert (r.probability, r.on_time, r.delay_15, r.delay_30, r.delay_45) == pytest.approx((33.613333333 / 40, 1, 0.9333333, 0.1, 0))
    assert r.freshness_warning and int(r.seed) == 5695745043292164088
    assert (got[2].status, got[2].reason, got[2].probability) == ("rejected", "distinct_airports", None)


@pytest.mark.parametrize("route,times,day,want", [
    (("LAX", "ATL"), ("15:30", "17:45"), d.date(2026, 8, 9), "chronology"),
    (("LAX", "ATL"), ("15:30", "23:00"), d.date(2026, 8, 9), 270),
    (("LAX", "JFK"), ("23:30", "07:45"), d.date(2026, 8, 9), 315),
    (("ATL", "BOS"), ("01:30", "03:30"), d.date(2026, 3, 8), 60),
    (("ATL", "HNL"), ("00:00", "23:00"), d.date(2026, 8, 9), "duration_too_long"),
    (("ATL", "XYZ"), ("10:00", "12:00"), d.date(2026, 8, 9), "unknown_zone"),
])
def test_zones(spark, route, times, day, want):
    last = "HNL" if "HNL" not in route else "LAX"
    r = validate_itineraries(requests(spark, [(1, "DL", *route, last, day, *times, times[1])]), airports(spark)).first()
    assert (r.reason if isinstance(want, str) else r.duration_minutes) == want


def test_bounds_are_strict(spark):
    days = [d.date(2023, 3, 30), d.date(2023, 3, 31), d.date(2025, 3, 30), d.date(2025, 3, 31)]
    h = history(spark, [(x, "DL", "ATL", "JFK", "afternoon", 1.0) for x in days])
    c = spark.createDataFrame([(1, "DL", "ATL", "JFK", d.date(2025, 3, 31), 930)], CASE)
    r = C.cohort_counts(C.with_bounds(c, 24), C.daily_delay_counts(h)).first()
    assert (r.n_route_carrier, r.n_global) == (2, 2)
    with pytest.raises(Exception, match="history end"):
        C.with_bounds(c, 24, end=F.lit("2025-04-01").cast("date")).collect()


def brute(rows, case, lookback_days):
    """All seven cohorts of one case, the plain way."""
    _, carrier, origin, destination, day, minutes = case
    bucket = "overnight" if minutes < 360 else "morning" if minutes < 720 else "afternoon" if minutes < 1080 else "evening"
    past = [r for r in rows if r[0] < day and r[0] >= lookback_days]
    rc = [r for r in past if r[1:4] == (carrier, origin, destination)]
    month = [r for r in rc if r[0].month == day.month and r[4] == bucket]
    return [
        [r for r in month if r[0].isoweekday() == day.isoweekday()], month,
        [r for r in rc if (r[0].month - day.month) % 12 in (0, 1, 11)], rc,
        [r for r in past if r[2:4] == (origin, destination)], [r for r in past if r[1] == carrier], past,
    ]


def test_ladder_matches_brute_force(spark):
    rng = random.Random(7)
    day = lambda: d.date(2023, 1, 1) + d.timedelta(days=rng.randrange(700))
    # one route holds most of the rows
    pick = lambda: ("DL", "ATL", "JFK") if rng.random() < 0.6 else (rng.choice("AB") * 2, rng.choice(("ATL", "BOS")), rng.choice(("JFK", "LAX")))
    rows = [(day(), *pick(), rng.choice(("overnight", "morning", "afternoon", "evening")), float(rng.randrange(-20, 60))) for _ in range(1500)]
    cases = [(i, *pick(), day() + d.timedelta(days=30), rng.randrange(1440)) for i in range(40)]
    cases += [(98, "ZZ", "ATL", "SFO", d.date(2024, 6, 1), 600), (99, "ZZ", "ATL", "SFO", d.date(2022, 1, 1), 600)]
    daily = C.daily_delay_counts(history(spark, rows))
    bounded = C.with_bounds(spark.createDataFrame(cases, CASE), 12)
    selected = C.select_cohorts(bounded, daily, 30)
    scored = D.evaluate_cohorts(selected, daily, case_columns=["case_id"], actual=F.lit(5.0), layover=F.lit(70))
    got = {r.case_id: r for r in selected.collect()}
    scores = {r.case_id: r for r in scored.collect()}
    for case in cases:
        start = case[4].replace(year=case[4].year - 1) if (case[4].month, case[4].day) != (2, 29) else d.date(case[4].year - 1, 2, 28)
        levels = brute(rows, case, start)
        r = got[case[0]]
        assert [r[f"n_{x}"] for x in C.LEVELS] == [len(x) for x in levels]
        index = next((i for i, x in enumerate(levels) if len(x) >= 30 or (i == 6 and x)), None)
        if index is None:
            assert r.cohort_level is None and case[0] not in scores
            continue
        assert r.cohort_level == C.LEVELS[index]
        v = np.array([x[5] for x in levels[index]])
        s = scores[case[0]]
        assert (s.p50, s.p75, s.p90) == pytest.approx(tuple(np.quantile(v, (.5, .75, .9))))
        assert s.crps == pytest.approx(np.abs(v - 5).mean() - 0.5 * np.abs(v[:, None] - v[None, :]).mean())
        t = 35 - v
        p = np.where(t <= 15, 0, np.where(t <= 25, (t - 15) ** 2 / 250, np.where(t < 40, 1 - (40 - t) ** 2 / 375, 1)))
        assert s.probability == pytest.approx(p.mean())


def hist_of(spark, key, values):
    return spark.createDataFrame([(key, float(v), 1) for v in values], "k long, value double, n long").groupBy("k", "value").agg(F.sum("n").alias("n"))


def expand(df):
    return sorted(r.value for r in df.collect() for _ in range(r.n))


@pytest.mark.parametrize("k", [1, 3, 10, 57, 400])
def test_midpoint_quantiles(spark, k):
    values = [random.Random(k).randrange(12) for _ in range(83)]
    got = expand(D.midpoint_quantiles(hist_of(spark, 1, values).withColumn("m", F.lit(k)), ["k"], "m"))
    assert got == pytest.approx(sorted(np.quantile(values, (np.arange(k) + 0.5) / k)))


def test_tail_pool(spark):
    center = hist_of(spark, 1, range(50))
    pooled = expand(ST.tail_pool(center, hist_of(spark, 1, range(200)), ["k"], min_center=100, min_source=20))
    assert len(pooled) == 50 and np.median(pooled) == np.median(range(50)) and np.quantile(pooled, 0.9) > np.quantile(range(50), 0.9)
    assert expand(ST.tail_pool(center, hist_of(spark, 1, range(10)), ["k"], min_center=100, min_source=20)) == list(range(50))


def test_coverage_and_bins_are_exact_on_ties(spark):
    from fractions import Fraction
    import random as rnd

    from delaycohorts.operators import metrics as M

    draw, members, cases, want = rnd.Random(8), [], [], {}
    for k in range(300):
        values = sorted(10 * draw.randrange(-3, 9) for _ in range(2 + k % 60))
        members += [(k, float(v)) for v in values]
        for name, q in (("p50", Fraction(1, 2)), ("p75", Fraction(3, 4)), ("p90", Fraction(9, 10))):
            at = q * (len(values) - 1)
            exact = values[int(at)] + (at - int(at)) * (values[min(int(at) + 1, len(values) - 1)] - values[int(at)])
            if exact.denominator == 1:
                cases.append((k, name, float(exact)))
                want[k, name] = 1.0
    hist = spark.createDataFrame(members, "k long, delay double").groupBy("k", "delay").agg(F.count("*").alias("n"))
    found = M.exact_ties(D.quantiles(hist, ["k"], (0.5, 0.75, 0.9)), ("p50", "p75", "p90"))
    rows = spark.createDataFrame(cases, "k long, name string, actual double").join(found, "k")
    predicted = F.when(F.col("name") == "p50", F.col("p50")).when(F.col("name") == "p75", F.col("p75")).otherwise(F.col("p90"))
    got = {(r["k"], r["name"]): r["c"] for r in rows.select("k", "name", M.covered(F.col("actual"), predicted).alias("c")).collect()}
    assert got == want
    edges = spark.createDataFrame([(k, sum([0.1] * k), k / 10 - 2e-16) for k in range(1, 10)], "k int, above double, below double")
    assert all(r["a"] == r["b"] == r["k"] for r in M.exact_ties(edges, ("above", "below")).select("k", M.bin_of(F.col("above")).alias("a"), M.bin_of(F.col("below")).alias("b")).collect())


def test_full_replay_takes_every_holdout_flight(spark):
    from delaycohorts.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    found = Q.registered()["temporal_replay_full"](spark, sf).where("dimension = 'all'").collect()
    _, cases = Q._all_cases(spark, sf)
    flights = {r["test_year"]: r["count"] for r in cases.groupBy("test_year").count().collect()}
    assert found and max(flights.values()) > 200
    assert all(r["sample_count"] <= flights[r["test_year"]] for r in found) and max(r["sample_count"] for r in found) > 200


@pytest.mark.parametrize("size", [1, 2, 3, 40, 700])
@pytest.mark.parametrize("kc", [1, 7, 99, 350])
def test_midpoints_of_a_packed_histogram(size, kc):
    from delaycohorts.operators import pools as PL

    draw = random.Random(size * 1000 + kc)
    values = sorted(float(draw.randrange(-20, 20)) for _ in range(size))
    v, c = np.unique(values, return_counts=True)
    found, times = PL.midpoints(v, c, kc)
    assert times.sum() == kc
    assert np.sort(np.repeat(found, times)) == pytest.approx(np.quantile(values, (np.arange(kc) + 0.5) / kc))


def test_packed_pool_equals_the_listed_one():
    from delaycohorts.operators import pools as PL

    draw = random.Random(5)
    for _ in range(60):
        center = sorted(float(draw.randrange(-9, 30)) for _ in range(draw.randrange(5, 400)))
        source = sorted(float(draw.randrange(-9, 90)) for _ in range(draw.randrange(5, 900)))
        kc, ks = len(center) // 5, max(1, len(source) // 5)
        if not kc:
            continue
        packed = [np.unique(x, return_counts=True) for x in (center, source)]
        values, counts = PL.pool(*packed, kc, ks)
        want = sorted(center[:-kc] + list(np.quantile(source[-ks:], (np.arange(kc) + 0.5) / kc)))
        assert np.repeat(values, counts) == pytest.approx(want) and (np.diff(values) > 0).all()


def test_pools_are_used_by_the_sizes_of_both_tails(spark):
    from delaycohorts.operators import packed, pools as PL

    cohorts = [("a", 50), ("b", 600), ("c", 140), ("d", 700), ("e", 4)]
    rows = []
    for name, n in cohorts:
        out = packed.Rows([0.5])
        out.add(np.arange(n, dtype=float), np.ones(n, np.int64))
        rows.append((1, name, None, None, *[column[0].as_py() for column in out.columns()]))
    table = spark.createDataFrame(rows, f"k_hash long, k_text string, hist_start date, hist_end date, {packed.ROW_KINDS}").withColumns(
        {"hist_start": F.lit("1995-01-01").cast("date"), "hist_end": F.lit("1999-01-01").cast("date")}
    )
    of = lambda c: F.struct(F.lit(1).cast("bigint").alias("k_hash"), F.col(c).alias("k_text"), F.lit("1995-01-01").cast("date").alias("hist_start"), F.lit("1999-01-01").cast("date").alias("hist_end"))
    asked = [("x", "a", "b", 100, 100), ("x", "a", "c", 100, 100), ("x", "d", "b", 100, 100), ("y", "d", "b", None, 30), ("y", "a", "b", None, 30), ("y", "e", "b", None, 30), ("y", "a", None, None, 30), ("x", "a", "b", 100, 100)]
    df = spark.createDataFrame(asked, "candidate string, c string, s string, min_center int, min_source int")
    df = df.select("candidate", of("c").alias("center"), of("s").alias("source"), "min_center", "min_source")
    used, made = PL.pool_tails(df, table, [0.5])
    assert sorted((r.candidate, r.k_text.split("|")[1:3]) for r in used.collect()) == [("x", ["a", "b"]), ("y", ["a", "b"]), ("y", ["d", "b"])]
    assert sorted((r.k_text.split("|")[1], r.cohort_n, max(r.delays) > 480) for r in made.collect()) == [("a", 50, True), ("d", 700, True)]


@pytest.mark.parametrize("n", [0, 1, 13, 64, 65, 399, 400, 500])
def test_exact_sample_has_the_first_digests(spark, n):
    import hashlib

    from delaycohorts.operators.topn import exact_sample

    # every value three times, and one that holds a third of all rows
    keys = [f"k{i % 90}" for i in range(270)] + ["hot"] * 130
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    digest = lambda k: hashlib.md5(k.encode()).hexdigest()
    found = exact_sample(df, F.md5("k"), n).collect()
    assert sorted(digest(r.k) for r in found) == sorted(map(digest, keys))[:n]
    assert len({r.i for r in found}) == len(found) == min(n, 400)


def test_exact_sample_of_nothing(spark):
    from delaycohorts.operators.topn import exact_sample

    assert exact_sample(spark.createDataFrame([], "k string"), F.md5("k"), 5).collect() == []
