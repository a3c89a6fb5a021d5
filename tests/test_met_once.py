"""Rows that are reduced, listed or checked before they meet many others."""

import datetime as d

from delaycohorts.operators import cleaning as CL
from delaycohorts.operators import cohorts as C
from delaycohorts.operators import distributions as D
from delaycohorts.operators import itineraries as I
from delaycohorts.operators import lookup as L
from delaycohorts.plans import studies as ST

DAY = d.date(2024, 3, 4)


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 1000)
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_delays_of_a_flight_are_reduced_by_hash(spark):
    rows = [("1", 10, 5.0), ("1", 10, 3.0), ("1", 9, 7.0), ("2", 1, None), ("2", 1, -4.0), ("3", None, 2.0), ("3", 0, 1.0), (None, 4, 8.0), (None, 4, 6.0)]
    df = spark.createDataFrame([(DAY, "AA", n, "ATL", "BOS", 300, a, "m", x) for n, a, x in rows],
                               "flight_date date, reporting_carrier string, flight_number string, origin string, destination string, crs_departure_minutes int, crs_arrival_minutes int, source_file string, arrival_delay_minutes double")
    one = CL.first_per_key(df)
    assert one.columns == df.columns
    assert sorted((str(r["flight_number"]), r["crs_arrival_minutes"], r["arrival_delay_minutes"]) for r in one.collect()) == [
        ("1", 9, 7.0), ("2", 1, None), ("3", None, 2.0), ("None", 4, 6.0)]
    assert "min(arrival_delay_minutes" in plan(one)


def case_tables(spark):
    cases = [(i, "AA", "ATL", "BOS", DAY, 300 + i % 3, 200) for i in range(40)] + [(40, "DL", None, "BOS", DAY, 800, 30), (41, "DL", "ATL", "BOS", DAY, None, 30), (1, "AA", "ATL", "BOS", DAY, 800, 30)]
    cases = spark.createDataFrame(cases, "case_id int, carrier string, origin string, destination string, prediction_date date, departure_minutes int, layover_minutes int")
    daily = [("AA", "ATL", "BOS", DAY - d.timedelta(7 * k), "overnight", float(5 * k), 9) for k in range(1, 6)] + [("DL", "ATL", "BOS", DAY - d.timedelta(3), "evening", 1.0, 2)]
    daily = spark.createDataFrame(daily, "carrier string, origin string, destination string, flight_date date, bucket string, delay double, n bigint")
    return C.with_bounds(cases), daily


def test_profiles_are_joined_by_their_hash_and_members_listed_after_the_join(spark):
    cases, daily = case_tables(spark)
    assert "_profile_hash" in plan(C.cohort_counts(cases, daily))
    selected = C.select_cohorts(cases, daily)
    assert {(r["case_id"], r["cohort_level"], r["cohort_size"], r["k_text"]) for r in selected.collect() if r["case_id"] in (0, 41)} == {
        (0, "route_carrier_season", 36, "route_carrier_season|AA|ATL|BOS|3"), (41, "route", 47, "route|ATL|BOS")}
    members = D.attach_members(selected, C.packed_histograms(selected, daily))
    lines = plan(members).splitlines()
    at = lambda word: next(i for i, line in enumerate(lines) if word in line)
    assert at("Generate explode") < at("Join ")
    want = selected.join(C.member_histograms(selected, daily), [*C.KEY, *C.BOUNDS])
    pick = lambda df: sorted(tuple(r) for r in df.select("case_id", "delay", "n").collect())
    assert pick(members) == pick(want) and len(pick(want)) > 100


def test_parity_fetches_the_levels_of_a_profile_once(spark, monkeypatch):
    cases, daily = case_tables(spark)
    written = []
    monkeypatch.setattr(ST, "materialize", lambda df: written.append(df.count()) or df)
    out = {r["eager_minimum"]: r for r in ST.candidate_parity(cases, daily, eager_minimums=(30, 46)).collect()}
    assert written == [4 * len(C.LEVELS)]  # profiles, not cases, by levels
    assert out[30]["sample_count"] == out[46]["sample_count"] == cases.count()
    assert out[46]["level_mismatches"] > out[30]["level_mismatches"]


def test_lookups_meet_the_segments_of_a_flight_day_as_one_row(spark):
    day = "2024-03-04"
    keys = [(1, "aa", "7", day, None, None, None), (2, "AA", " 7", day, "ATL", None, None), (3, "AA", "8", day, None, None, None), (4, "AA", "7", day, None, None, 301),
            (5, "AA", "7", day, None, None, None), (5, "AA", "7", day, "ATL", "JFK", None), (5, "AA", "8", day, None, None, None), (6, "AA", "9", day, None, None, None), (6, "AA", "9", day, None, None, None),
            (7, "", "7", day, None, None, None), (8, "AA", "7", "2024-3-4", None, None, None), (None, "AA", "7", day, "ORD", None, None)]
    keys = spark.createDataFrame(keys, "lookup_id int, carrier string, flight_number string, flight_date string, origin string, destination string, departure_minutes int")
    records = [("7", "ATL", "BOS", 300), ("7", "ATL", "BOS", 300), ("7", "ATL", "JFK", 301), ("7", None, "JFK", 301), ("9", "ORD", None, None), ("9", "ORD", "BOS", 5)]
    records = spark.createDataFrame([(DAY, "AA", *r, 400) for r in records], "flight_date date, reporting_carrier string, flight_number string, origin string, destination string, crs_departure_minutes int, crs_arrival_minutes int")
    got, want = L.lookup_flights(keys, records), L.classify(L.lookup_segments(keys, records))
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 7
    assert "_day" in plan(got)


def test_requests_are_checked_once_for_both_histories(spark, monkeypatch):
    calls, check = [], I.validate_itineraries
    monkeypatch.setattr(I, "validate_itineraries", lambda *a, **b: calls.append(1) or check(*a, **b))
    request = [(i, "AA", "ATL", "BOS", "DEN", DAY, "05:00", "07:00", "08:30") for i in range(3)]
    requests = spark.createDataFrame(request, "request_id int, carrier string, origin string, connection string, destination string, travel_date date, first_departure_time string, first_arrival_time string, connecting_departure_time string")
    history = spark.createDataFrame([(DAY - d.timedelta(k), "AA", "ATL", "BOS", "overnight", float(k)) for k in range(1, 40)],
                                    "flight_date date, reporting_carrier string, origin string, destination string, departure_time_bucket string, arrival_delay_minutes double")
    airports = spark.createDataFrame([(c, "US", "America/New_York") for c in ("ATL", "BOS", "DEN")], "code string, country string, tz string")
    out = ST.compare_datasets(history, history.where("arrival_delay_minutes > 20"), requests, airports).first()
    assert len(calls) == 1 and out["cases"] == 3 and out["sample_size_mismatches"] == 3
