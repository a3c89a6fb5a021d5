import datetime as d

import pytest
from pyspark.sql import functions as F

from delaycohorts.functions import buckets, clock, codes, text
from delaycohorts.functions.transfer import Transfer, scenario_columns


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_hhmm(spark):
    rows = ["5", "1230.00", "2400", "1260", "", "bad", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(clock.nullable_hhmm(F.col("t"))).collect()]
    assert got == [5, 750, 0, None, None, None, None]


def test_clock_and_masks(spark):
    got = one(
        spark, clock.circular_minutes(F.lit(1435), F.lit(5)), clock.circular_minutes(F.lit(1440), F.lit(5)),
        clock.mask_includes(F.lit(21), F.lit(3)), clock.mask_includes(F.lit(21), F.lit(2)), clock.mask_includes(F.lit(128), F.lit(2)),
        clock.weekday_bit(F.lit("2025-01-08").cast("date")),
    )
    assert got == (10, None, True, False, None, 4)


@pytest.mark.parametrize("day,months,want", [("2024-02-29", 24, "2022-02-28"), ("2025-03-31", 24, "2023-03-31"), ("2024-03-31", 1, "2024-02-29")])
def test_months_back(spark, day, months, want):
    assert str(one(spark, clock.subtract_months(F.lit(day).cast("date"), months))[0]) == want


def test_weekday_count_matches_listing(spark):
    df = spark.range(0, 40).select(F.date_add(F.lit("2024-02-20").cast("date"), F.col("id").cast("int")).alias("a"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("w"))
    df = df.withColumn("b", F.date_add("a", 17))
    listed = F.size(F.filter(F.sequence("a", "b"), lambda x: F.weekday(x) + 1 == F.col("w")))
    assert df.where(listed != clock.days_of_week_between(F.col("a"), F.col("b"), F.col("w"))).count() == 0


def test_elapsed(spark):
    e = lambda a, b: clock.elapsed_minutes(F.lit(a), F.lit(b))["minutes"]
    assert one(spark, e(1065, 1150), e(1320, 360), e(900, 840)) == (85, 480, None)


def test_transfer(spark):
    t = Transfer()
    got = one(spark, *scenario_columns(F.lit(85)))
    assert got == pytest.approx((1.0, 1 - 25 / 375, 0.1, 0.0))
    fixed = Transfer(15, 15, 15)
    assert one(spark, fixed.success(F.lit(49), F.lit(0.0)), fixed.success(F.lit(50), F.lit(0.0))) == (0.0, 1.0)
    u = [0.0, 0.2, 0.4, 0.9]
    assert one(spark, *[t.cdf(t.inverse(F.lit(x))) for x in u]) == pytest.approx(u)
    with pytest.raises(ValueError):
        Transfer(30, 20, 40)


def test_itinerary_seed(spark):
    key = codes.itinerary_key(*[F.lit(x) for x in ("dl ", "atl", "JFK", "BOS")], F.lit(d.date(2026, 8, 20)), *[F.lit(x) for x in ("15:30", "17:45", "19:10")])
    text_key, seed = one(spark, key, codes.itinerary_seed(key))
    assert text_key.startswith('{"carrier":"DL","connecting_departure_time":"19:10","connection":"JFK"')
    assert int(seed) == 5695745043292164088


def test_labels(spark):
    ref = F.lit("2026-01-01").cast("date")
    at = lambda n: buckets.horizon_bucket(F.date_add(ref, n), ref)
    assert one(spark, at(-1), at(14), at(60), at(135), at(136)) == (None, "near_term", "approximately_30_days", "approximately_90_days", "approximately_180_days")
    assert one(spark, buckets.route_volume_group(F.lit(None).cast("int")), buckets.delay_outlier(F.lit(None).cast("double"))) == ("low_lt_100", False)


def test_secrets_and_responses(spark):
    s = text.looks_secret
    assert one(spark, s(F.lit("Bearer abc")), s(F.lit("x" * 24)), s(F.lit("plain words")), s(F.lit(None).cast("string"))) == (True, True, False, False)
    c = lambda status, body: text.classify_response(F.lit(status), text.parsed_json(F.lit(body)))
    assert one(spark, c(403, '{"code":"quota_exceeded"}'), c(403, "nope"), c(429, ""), c(204, ""), c(200, "[]")) == ("quota", "other_error", "rate_limit", "no_match", "ok")
    assert one(spark, text.redact(F.lit("a secret b secret"), ["secret"])) == ("a [REDACTED] b [REDACTED]",)


def test_minutes_between_ignores_the_session_zone(spark):
    from delaycohorts.operators.itineraries import _minutes_between

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp_ntz'2000-04-02 01:30:00' a, timestamp_ntz'2000-04-02 03:30:59' b")
        assert df.select(_minutes_between(df.a, df.b)).first()[0] == 120
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_error_codes_are_short_texts(spark):
    code = lambda body: text.error_code(text.parsed_json(F.lit(body)))
    got = one(spark, code('{"code":"E1","error":"E2"}'), code('{"code":7,"error":"E2"}'), code('{"code":null,"type":"t"}'), code('{"code":"two words"}'), code('{"code":"api-key"}'), code("[]"), code("{broken"))
    assert got == ("E1", "E2", "t", None, None, None, None)


def test_log_values(spark):
    m, s = text.safe_metadata, text.safe_message
    long = "word " * 100
    assert one(spark, m(F.lit(" a\n\tb ")), m(F.lit(long + "token")), m(F.lit(" \n")), s(F.lit(long + "token")), s(F.lit(" ")), s(F.lit(None).cast("string"))) == ("a b", None, None, "[REDACTED]", None, None)
    assert one(spark, F.length(m(F.lit(long))), F.length(s(F.lit(long)))) == (200, 160)
