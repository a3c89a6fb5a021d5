import datetime as d
import random

from delaycohorts.operators import lookup as L
from delaycohorts.operators import payloads as P
from delaycohorts.operators import schedules as H
from delaycohorts.operators import stability as T

SCHED = "flight_date date, reporting_carrier string, flight_number string, origin string, destination string, crs_departure_minutes int, crs_arrival_minutes int"
DAY = d.date(2025, 1, 6)


def sched(spark, carrier, number, offsets, routes=None):
    rows = [(DAY + d.timedelta(days=o), carrier, number, "ATL", (routes or {}).get(o, "BOS"), 600, 700) for o in offsets]
    return spark.createDataFrame(rows, SCHED)


def test_exact_periods_are_lossless(spark):
    s = sched(spark, "DL", "1", (0, 2, 7, 9, 35))
    rows = sorted(H.exact_periods(s).collect(), key=lambda r: r.valid_from)
    assert [(r.valid_from, r.valid_to, r.weekday_mask, r.source_observations) for r in rows] == [
        (DAY, DAY + d.timedelta(days=9), 5, 4), (DAY + d.timedelta(days=35), DAY + d.timedelta(days=35), 1, 1)]
    a = H.reconstruction_accuracy(H.exact_periods(s), s, "exact").first()
    assert (a.false_positive_rows, a.false_negative_rows, a.source_recall, a.expanded_precision) == (0, 0, 1.0, 1.0)


def test_patterns(spark):
    s = sched(spark, "AA", "10", (0, 7, 21, 70))
    p = H.pattern_periods(s)
    rows = sorted(p.collect(), key=lambda r: r.valid_from)
    assert [(r.valid_to, r.source_observations, r.maximum_internal_gap_days) for r in rows] == [(DAY + d.timedelta(days=21), 3, 14), (DAY + d.timedelta(days=70), 1, None)]
    a = H.reconstruction_accuracy(p, s, "pattern").first()
    assert (a.false_positive_rows, a.false_negative_rows, a.false_positive_nonoperating_dates) == (1, 0, 1)


def test_copies_do_not_change_periods(spark):
    s = sched(spark, "DL", "1", (0, 0, 0, 2))
    r = H.pattern_periods(s).first()
    assert (r.source_observations, r.maximum_internal_gap_days) == (4, 2)


def test_route_stability(spark):
    r = T.route_stability(sched(spark, "DL", "5", (0, 1, 2), {2: "JFK"})).first()
    assert (r.operating_dates, r.distinct_routes, r.dominant_route, r.route_set_changes) == (3, 2, "ATL-BOS", 1)


def test_lookup(spark):
    rows = [(DAY, "WN", "39", "GSP", "BWI", 360, 450), (DAY, "WN", "39", "BWI", "ABQ", 500, 700)]
    s = spark.createDataFrame(rows, SCHED)
    keys = spark.createDataFrame(
        [(1, "wn ", "39", "2025-01-06", None, None, None), (2, "WN", "39", "2025-01-06", "bwi", None, None), (3, "WN", "39", "2025-01-06", None, None, 360),
         (4, "WN", "40", "2025-01-06", None, None, None), (5, "WN", "39", "06.01.2025", None, None, None)],
        "lookup_id long, carrier string, flight_number string, flight_date string, origin string, destination string, departure_minutes int")
    for result in (L.lookup_flights(keys, s), L.lookup_periods(keys, H.exact_periods(s))):
        got = {r.lookup_id: (r.classification, r.match_count) for r in result.collect()}
        assert got == {1: ("multiple_segments", 2), 2: ("unique_match", 1), 3: ("unique_match", 1), 4: ("no_match", 0)}
    assert [tuple(r) for r in L.rejected(keys).collect()] == [(5, "date_format")]


def test_payload_rejects(spark):
    end = lambda code, t: '{"airport":{"iata":"%s"},"scheduledTime":{"local":"%s"},"quality":["Basic", 3]}' % (code, t)
    item = '{"number":"dl 1","codeshareStatus":"IsOperator","departure":%s,"arrival":%s}' % (end("atl", "2026-08-09T15:30-04:00"), end("BOS", "2026-08-09T18:00Z"))
    log = spark.createDataFrame(
        [("a", "DL1", DAY, f"[{item}]"), ("b", "DL1", DAY, "[]"), ("c", "DL1", DAY, "{}"), ("d", "DL1", DAY, "[3]"), ("e", "DL1", DAY, "[{}]")],
        "request_key string, requested_number string, requested_date date, body string")
    n = P.normalize_payloads(log)
    got = {r.request_key: r.outcome for r in P.lookup_outcome(n).collect()}
    assert got == {"a": "unique_match", "b": "no_match", "c": "malformed_response", "d": "malformed_response", "e": "missing_required_fields"}
    r = P.candidates_of(n).first()
    assert (r.marketing_carrier, r.operating_flight_number, r.origin_iata, r.departure_offset, r.arrival_offset) == ("DL", "DL 1", "ATL", -240, 0)


def brute_days(periods):
    out = set()
    for key, first, last, mask in periods:
        day = first
        while day <= last:
            if mask >> day.weekday() & 1:
                out.add((key, day))
            day += d.timedelta(days=1)
    return out


def test_day_bitmaps_against_listed_days(spark):
    draw = random.Random(4)
    start = d.date(1999, 12, 1)  # two leap years and three year ends
    periods, rows = [], []
    for k in range(60):
        first = start + d.timedelta(days=draw.randrange(800))
        periods.append((str(k % 7), first, first + d.timedelta(days=draw.choice([0, 1, 40, 400])), draw.randrange(128)))
    for _ in range(900):
        rows.append((str(draw.randrange(9)), start + d.timedelta(days=draw.randrange(1200))))
    signature = lambda n: ("DL", n, "ATL", "BOS", 600, 700)
    p = spark.createDataFrame([(*signature(n), a, b, m) for n, a, b, m in periods] + [(*signature("0"), None, start, 127)], SCHED.split("date, ", 1)[1] + ", valid_from date, valid_to date, weekday_mask int")
    s = spark.createDataFrame([(day, *signature(n)) for n, day in rows] + [(None, *signature("0"))], SCHED)
    claimed, source = brute_days(periods), set(rows)
    listed = lambda df: sorted((r.flight_number, r.flight_date) for r in df.collect())
    assert listed(H.pattern_exclusions(p, s)) == sorted(claimed - source)
    assert listed(H.pattern_gaps(p, s)) == sorted(source - claimed)
    assert listed(H.missing_rows(H.expand_periods(p.where("valid_from is not null")), s.where("flight_date is not null"))) == sorted(source - claimed)
    a = H.reconstruction_accuracy(p, s, "x").first()
    assert (a.expanded_rows, a.exact_matches, a.false_positive_rows, a.false_negative_rows) == (len(claimed), len(claimed & source), len(claimed - source), len(source - claimed))
    keys = s.where("flight_number < '4'")
    assert listed(H.reconstruct_keys(keys, p)) == sorted(x for x in claimed if x in source and x[0] < "4")
    few = H.sample_reconstruction(keys, p, s, "x").first()
    assert (few.source_segments, few.reconstructed_segments, few.false_positive_rows) == (sum(x[0] < "4" for x in source), sum(x in source and x[0] < "4" for x in claimed), 0)
    assert H.pattern_exclusions(p.limit(0), s).count() == 0 and H.pattern_exclusions(p, s.limit(0)).count() == len(claimed)


def test_false_rows_have_reasons(spark):
    row = lambda o, dest, minute: (DAY + d.timedelta(days=o), "DL", "5", "ATL", dest, minute, 700)
    s = spark.createDataFrame([row(0, "BOS", 600), row(1, "JFK", 600), row(2, "BOS", 630)], SCHED)
    p = spark.createDataFrame([("DL", "5", "ATL", "BOS", 600, 700, DAY, DAY + d.timedelta(days=3), 127)], SCHED.split("date, ", 1)[1] + ", valid_from date, valid_to date, weekday_mask int")
    got = {((r.flight_date - DAY).days, r.reason) for r in H.false_row_reasons(p, s).collect()}
    assert got == {(1, "route"), (2, "time"), (3, "not_operating")}
