import datetime as d

from delaycohorts.operators import itineraries as I
from delaycohorts.plans import queries
from delaycohorts.sources import driver_tables as dt


def small_tables(spark, folder, n_orders):
    """A few suppliers and customers, ``n_orders`` orders of one day with three lines each."""
    day = d.datetime(1996, 3, 4)
    tables = {
        "customer": ([(i, i % 3) for i in range(4)], "c_custkey long, c_nationkey int"),
        "supplier": ([(i, i % 5) for i in range(7)], "s_suppkey long, s_nationkey int"),
        "orders": ([(i, i % 4, day) for i in range(n_orders)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": (
            [(i, j, i % 5, (i + j) % 7, float(10 + j), 0.05, "N", day) for i in range(n_orders) for j in range(3)],
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_tax double, l_returnflag string, l_shipdate timestamp",
        ),
    }
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_two_legs_share_the_answers_of_equal_lookups(spark, tmp_path):
    sf = small_tables(spark, tmp_path, 600)
    requests, lookups, answers = queries._two_leg_inputs(spark, sf)
    listed = lookups.select("request_id", "leg", "asked").join(answers, "asked").drop("asked")
    want = I.resolve_two_legs(requests, lookups.drop("asked"), listed, dt.airports(spark)).collect()
    got = I.resolve_two_legs(requests, lookups, answers, dt.airports(spark), answer="asked").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r["status"] for r in got}) > 2
    assert 0 < answers.count() * 10 < listed.count()  # candidates are not copied per request


def test_lines_are_moved_once_for_their_customers(spark, tmp_path):
    sf = small_tables(spark, tmp_path, 20)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dt.flights(spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if "hashpartitioning(o_custkey" in line)
    below = []
    for line in plan[at + 1 :]:
        if depth(line) <= depth(plan[at]):
            break
        below.append(line)
    assert any("o_orderkey" in line for line in below) and not any("l_suppkey" in line for line in below)


def test_flights_keep_generated_methods_short(spark, tmp_path):
    sf = small_tables(spark, tmp_path, 20)
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    try:
        for given, wanted in (("65535", "8000"), ("4000", "4000")):  # a limit that the session chose is kept
            spark.conf.set(limit, given)
            dt.flights(spark, sf)
            assert spark.conf.get(limit) == wanted
    finally:
        spark.conf.set(limit, before)
