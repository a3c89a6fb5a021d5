"""Work that is done once per row, or not at all where nobody reads the result."""

from delaycohorts.operators import cleaning as CL
from delaycohorts.operators import payloads as P
from delaycohorts.plans import queries as Q
from delaycohorts.schema import RAW_WIDE_FIELDS

ITEM = '{"number":"AA 1","airline":{"iata":"AA"},"departure":{"airport":{"iata":"ATL"},"scheduledTime":{"local":"2024-01-01T05:00:00"}},"arrival":{"airport":{"iata":"BOS"},"scheduledTime":{"local":"2024-01-01T07:00:00"}}}'
LOG = "request_key string, requested_number string, requested_date date, body string"


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 1000)
    return df._jdf.queryExecution().optimizedPlan().toString()


def payload_log(spark, bodies):
    return spark.createDataFrame([(k, "aa1", None, b) for k, b in bodies.items()], LOG)


def test_items_come_off_a_body_in_one_cast(spark):
    bodies = {
        "one": f"[{ITEM}]", "blank": f"[null,{ITEM}]", "blanks": "[null,null]", "empty": "[]", "number": f"[{ITEM},5]", "nested": "[[]]",
        "blank_and_text": '[null,"x"]', "object": ITEM, "null": "null", "broken": "[{", "wrong_type": '[{"number":{"a":1},"airline":"AA","departure":[1]}]',
        "no_body": None,
    }
    df = P.explode_payloads(payload_log(spark, bodies))
    assert "transform(" not in plan(df)
    seen = {}
    for r in df.orderBy("request_key", "item_index").collect():
        seen.setdefault(r["request_key"], []).append((r["reject"], r["item_index"], None if r["item"] is None else r["item"]["number"]))
    assert seen == {
        "one": [(None, 0, "AA 1")], "blank": [(None, 0, None), (None, 1, "AA 1")], "blanks": [(None, 0, None), (None, 1, None)],
        "empty": [(None, None, None)], "number": [("non_object_item", None, None)], "nested": [("non_object_item", None, None)],
        "blank_and_text": [("non_object_item", None, None)], "object": [("not_an_array", None, None)], "null": [("not_an_array", None, None)],
        "broken": [("malformed_json", None, None)], "wrong_type": [(None, 0, '{"a":1}')], "no_body": [("malformed_json", None, None)],
    }


def test_coverage_writes_only_what_it_reads(spark, monkeypatch):
    written = []
    monkeypatch.setattr(Q, "_payload_log", lambda s, sf: payload_log(spark, {"1": f"[{ITEM}]", "2": "[]"}))
    monkeypatch.setattr(Q, "materialize", lambda df: written.append(set(df.columns)) or df)
    total = Q.provider_coverage(spark, "").where("dimension = 'total'").first()
    assert (total["attempted"], total["unique_match"], total["no_match"], total["returned_candidates"]) == (2, 1, 1, 1)
    assert written == [{"request_key", "item_index", "reject_reason", "has_item", *P.OPTIONAL_FIELDS}]


def test_columns_nobody_reads_are_not_parsed(spark):
    good = {"FlightDate": "2024-01-01", "Reporting_Airline": "aa", "Flight_Number_Reporting_Airline": "7", "Origin": "ATL", "Dest": "BOS", "OriginAirportID": "1", "DestAirportID": "2", "CRSDepTime": "0500", "CRSArrTime": "2400", "Cancelled": "0", "Diverted": "1.00", "Div1Airport": "fll"}
    rows = [good, good | {"FlightDate": "2024-13-01"}, good | {"Origin": None}, good | {"Flight_Number_Reporting_Airline": " "}]
    fields = [*RAW_WIDE_FIELDS, "source_file"]
    raw = spark.createDataFrame([tuple(r.get(c, None if c in r else "") for c in fields) for r in rows], ", ".join(f"{c} string" for c in fields))
    wide = CL.clean_flights_wide(raw)
    assert [len(r["diversion_details"]) for r in wide.collect()] == [1, 1]
    schedule = CL.exact_schedule(wide)
    assert "diversion_details" not in plan(schedule) and "diversion_details" in plan(wide)
    assert [tuple(r)[1:] for r in schedule.collect()] == [("AA", "7", "ATL", "BOS", 300, 0)]
