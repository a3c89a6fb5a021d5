import zipfile

import pytest

from delaycohorts.operators import cleaning as CL
from delaycohorts.schema import RAW_FIELDS, RAW_WIDE_FIELDS
from delaycohorts.sources import archives, files
from delaycohorts.streaming import bounded, ingest_incremental

DEFAULT = dict(zip(RAW_FIELDS, ("2024-01-08", "1", "DL", "100", "ATL", "JFK", "1530", "1745", "2", "-5", "0", "0", "", "", "", "", "")))


def csv_text(rows):
    lines = [",".join(RAW_FIELDS)] + [",".join((DEFAULT | r)[f] for f in RAW_FIELDS) for r in rows]
    return "\n".join(lines) + "\n"


def test_cleaning_and_counters(spark, tmp_path):
    rows = [{}, {"Cancelled": "1", "ArrDelay": ""}, {"Diverted": "1.00", "ArrDelay": ""}, {"Origin": "A1X"}, {"Origin": ""}, {"ArrDelay": "1500"}, {"DayOfWeek": "2"}]
    (tmp_path / "m1.csv").write_text(csv_text(rows))
    raw = files.read_raw(spark, str(tmp_path))
    clean = CL.clean_flights(raw).collect()
    assert sorted(r.flight_status for r in clean) == ["cancelled", "completed", "completed", "diverted"]
    first = next(r for r in clean if r.arrival_delay_minutes == -5)
    assert (first.year, first.month, first.day_of_week, first.departure_time_bucket) == (2024, 1, 1, "afternoon")
    q = CL.quality_by_source(raw).first()
    assert (q.source_rows, q.cleaned_rows, q.invalid_field_rows, q.arrival_delay_outlier_rows, q.missing_arrival_delay_rows) == (7, 4, 3, 1, 2)
    history = CL.refresh_history(CL.clean_flights(raw))
    assert history.count() == 1
    with pytest.raises(ValueError, match="Origin"):
        CL.clean_flights(raw.drop("Origin"))


def test_wide_legs(spark):
    row = {f: "" for f in RAW_WIDE_FIELDS} | {
        "FlightDate": "2024-01-08", "Reporting_Airline": "wn", "Origin": "GSP", "Dest": "BWI", "OriginAirportID": "1", "DestAirportID": "2",
        "CRSDepTime": "2400", "DepTime": "2400", "ArrTime": "bad", "CRSArrTime": "100", "Cancelled": "0", "Diverted": "1",
        "WheelsOff": "2115", "WheelsOn": "2228", "Div2Airport": "fll",
    }
    df = spark.createDataFrame([tuple(row[f] for f in RAW_WIDE_FIELDS) + ("m",)], ", ".join(f"{f} string" for f in (*RAW_WIDE_FIELDS, "source_file")))
    r = CL.clean_flights_wide(df).first()
    assert (r.crs_departure_minutes, r.departure_minutes, r.arrival_minutes, r.wheels_off_minutes, r.wheels_on_minutes) == (0, 0, None, 1275, 1348)
    assert [(x.sequence, x.airport) for x in r.diversion_details] == [(2, "FLL")]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", csv_text([{}, {"Origin": "BOS"}]))
    rows = files.read_archives(spark, str(tmp_path / "*.zip")).collect()
    assert sorted((r.Origin, r.source_file) for r in rows) == [("ATL", "a.zip"), ("BOS", "a.zip")]


def test_incremental(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "m1.csv").write_text(csv_text([{}, {"Origin": "A1X"}]))
    assert ingest_incremental(spark, str(src), out, ck) == 1
    assert ingest_incremental(spark, str(src), out, ck) == 0
    (src / "m2.csv").write_text(csv_text([{"Origin": "BOS"}]))
    ingest_incremental(spark, str(src), out, ck)
    assert spark.read.parquet(f"{out}/flight_records").count() == 2
    counters = {r.source_file: r.invalid_field_rows for r in spark.read.parquet(f"{out}/quality").collect()}
    assert counters == {"m1.csv": 1, "m2.csv": 0}


def test_read_raw_follows_each_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Origin,Dest\nJFK,BOS\n")
    (tmp_path / "b.csv").write_text("Dest,Origin,Extra\nATL,ORD,1\n")
    rows = files.read_raw(spark, str(tmp_path), ("Origin", "Dest")).collect()
    assert {(r["source_file"], r["Origin"], r["Dest"]) for r in rows} == {("a.csv", "JFK", "BOS"), ("b.csv", "ORD", "ATL")}
    (tmp_path / "c.csv").write_text("Origin,Other\nJFK,BOS\n")
    with pytest.raises(ValueError, match="Dest"):
        files.read_raw(spark, str(tmp_path), ("Origin", "Dest"))


def raw_frame(spark, rows):
    return spark.createDataFrame([(*[(DEFAULT | r)[f] for f in RAW_FIELDS], r.get("source_file", "m1")) for r in rows], ", ".join(f"{f} string" for f in (*RAW_FIELDS, "source_file")))


def test_archive_source_round_trip(spark, tmp_path):
    rows = [{"Flight_Number_Reporting_Airline": str(i), "Origin": 'A,"B\nC' if i % 7 == 0 else "ATL", "source_file": "hot" if i % 3 else f"m{i % 4}"} for i in range(400)]
    rows += [{"Flight_Number_Reporting_Airline": "5", "source_file": "hot"}] * 5
    df = raw_frame(spark, rows)
    written = archives.write_archives(df, str(tmp_path / "out"), rows_per_archive=30).collect()
    assert sum(r.n_rows for r in written) == 405 and max(r.n_rows for r in written) <= 30 and len({r.archive for r in written}) == len(written)
    back = archives.read_archive_folder(spark, str(tmp_path / "out")).collect()
    flat = lambda found: sorted((*[r[f] or "" for f in RAW_FIELDS], r["source_file"].split("~")[0]) for r in found)
    assert flat(back) == flat(df.collect())
    again = archives.write_archives(df, str(tmp_path / "out"), rows_per_archive=30).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, written))
    narrow = archives.read_archive_folder(spark, str(tmp_path / "out"), ("Dest", "Origin"))
    assert narrow.columns == ["Dest", "Origin", "source_file"] and narrow.count() == 405


def test_archive_source_odd_folders(spark, tmp_path):
    assert archives.read_archive_folder(spark, str(tmp_path / "none")).collect() == []
    with zipfile.ZipFile(tmp_path / "bom.zip", "w") as z:
        z.writestr("a.csv", "\ufeffOther,Origin,Dest,\n1,JFK,,\n".encode())
        z.writestr("notes.txt", "x")
    assert [tuple(r) for r in archives.read_archive_folder(spark, str(tmp_path), ("Dest", "Origin")).collect()] == [(None, "JFK", "bom.zip")]
    with pytest.raises(Exception, match="missing columns in bom.zip: .*ArrDelay"):
        archives.read_archive_folder(spark, str(tmp_path)).collect()
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.csv", csv_text([{}]))
        z.writestr("b.csv", csv_text([{}]))
    with pytest.raises(Exception, match="expected one CSV in two.zip, found 2"):
        archives.read_archive_folder(spark, str(tmp_path), ("Origin",)).collect()


def test_archive_stream_takes_each_archive_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    archives.write_archives(raw_frame(spark, [{}, {"Origin": "A1X"}]), src).collect()
    run = lambda: bounded.ingest_stream(archives.stream_archive_folder(spark, src), out, ck, available_now=False)
    assert run() == 1 and run() == 0
    archives.write_archives(raw_frame(spark, [{"Origin": "BOS", "source_file": "m2"}]), src).collect()
    assert run() == 1
    found = {r.source_file.split("~")[0]: (r.source_rows, r.invalid_field_rows) for r in bounded.ingested_quality(spark, out).collect()}
    assert found == {"m1": (2, 1), "m2": (1, 0)}


def test_bounded_batches_and_a_replay(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), tmp_path / "ck"
    src.mkdir()
    for i in range(5):
        (src / f"m{i}.csv").write_text(csv_text([{}, {"Cancelled": "1", "Diverted": "1"}, {"Origin": "A1X"}, {"ArrDelay": "1500"}]))
    run = lambda: bounded.ingest_stream(bounded.read_bounded_stream(spark, str(src), 2), out, str(ck))
    assert run() == 3 and run() == 0
    same = lambda: sorted(map(tuple, bounded.ingested_quality(spark, out).collect()))
    want = sorted(map(tuple, CL.quality_by_source(files.read_raw(spark, str(src))).collect()))
    assert same() == want
    records = sorted(map(str, bounded.ingested_records(spark, out).collect()))
    (ck / "commits" / "2").unlink()  # the last batch ended, but was not recorded
    (ck / "commits" / ".2.crc").unlink(missing_ok=True)
    assert run() == 1 and same() == want
    assert sorted(map(str, bounded.ingested_records(spark, out).collect())) == records


def test_written_layouts_are_counted(spark, tmp_path):
    rows = [{"Origin": "BOS" if i % 3 else "ATL", "Flight_Number_Reporting_Airline": str(i)} for i in range(200)]
    records = CL.clean_flights(raw_frame(spark, rows))
    path = str(tmp_path / "serving")
    serving = CL.serving_projection(records)
    n = files.write_serving(serving, path)
    assert n == 200 and files.checked_layout(spark, path, n, serving.schema).where("reporting_carrier = 'DL' and origin = 'ATL'").count() == 67
    assert files.write_schedule(CL.exact_schedule(records), str(tmp_path / "schedule")) == 200
    assert files.write_serving(CL.serving_projection(records).where("origin = 'XXX'"), str(tmp_path / "none")) == 0
    next(iter(sorted((tmp_path / "serving").glob("part-*")))).unlink()
    with pytest.raises(RuntimeError, match="written=200"):
        files.checked_layout(spark, path, n, serving.schema)
