import zipfile

import pytest

from railyard.operators import services
from railyard.sources import feed, sinks

WEEK = "monday,tuesday,wednesday,thursday,friday,saturday,sunday"


def make_zip(path, calendar=True, dates=True, drop=()):
    files = {
        "stops": "﻿stop_id , stop_name,stop_lat,stop_lon,extra\nA,Alpha,47.5,19.0,x\nB,Beta,oops,19.1,\n",
        "routes": "route_id,route_type,route_short_name\nR,3,1\n",
        "trips": "trip_id,route_id,service_id\nT1,R,WD\nT2,R,WE\n",
        "stop_times": "trip_id,stop_id,stop_sequence,arrival_time,departure_time\nT1,A,1,07:00:00,07:00:00\nT1,B,2,07:05:00,07:05:00\nT2,A,1,10:00:00,10:00:00\nT2,B,2,25:05:00,25:05:00\n",
        "feed_info": "feed_publisher_name,feed_version\nme,7\n",
    }
    if calendar:
        files["calendar"] = f"service_id,{WEEK},start_date,end_date\nWD,1,1,1,1,1,0,0,20250101,20261231\nWE,0,0,0,0,0,1,1,20250101,20261231\n"
    if dates:
        files["calendar_dates"] = "service_id,date,exception_type\nWD,20250106,1\nWE,20250111,1\n"
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            if name not in drop:
                z.writestr(f"{name}.txt", text)
    return str(path)


def trips(f):
    return sorted(r.trip_id for r in f["trips"].collect())


@pytest.mark.parametrize("calendar, dates", [(True, True), (True, False), (False, True)])
def test_weekdays(spark, tmp_path, calendar, dates):
    path = make_zip(tmp_path / "f.zip", calendar, dates)
    assert trips(feed.load(spark, path, weekday="monday")) == ["T1"]
    saturday = feed.load(spark, path, weekday="Saturday")
    assert trips(saturday) == ["T2"] and saturday["stop_times"].count() == 2
    assert trips(feed.load(spark, path, date="20250106")) == ["T1"]
    assert trips(feed.load(spark, path)) == ["T1", "T2"]


def test_typing(spark, tmp_path):
    f = feed.load(spark, make_zip(tmp_path / "f.zip"))
    rows = {r.stop_id: r for r in f["stops"].collect()}
    assert f["stops"].columns == ["stop_id", "stop_name", "stop_lat", "stop_lon", "extra"]
    assert (rows["A"].stop_lat, rows["B"].stop_lat, rows["B"].extra) == (47.5, None, None)
    assert f.info() == {"feed_publisher_name": "me", "feed_version": "7"}
    assert f.summary()["stop_times"] == 4 and f.has_rows("calendar") and not f.has_rows("shapes")


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        feed.load(spark, str(tmp_path / "none.zip"))
    with pytest.raises(ValueError, match="trips"):
        feed.load(spark, make_zip(tmp_path / "a.zip", drop=("trips",)))
    plain = make_zip(tmp_path / "b.zip", False, False)
    with pytest.raises(ValueError, match="calendar"):
        feed.load(spark, plain, weekday="monday")
    for options in ({"weekday": "someday"}, {"date": "2025-01-06"}, {"weekday": "sunday", "date": "20250106"}):
        with pytest.raises(ValueError):
            feed.load(spark, plain, **options)


def test_exact_date_fails_closed(spark):
    cal = spark.createDataFrame([("BASE", 1, 1, 1, 1, 1, 0, 0, "20250101", "20251231")], f"service_id string, {', '.join(d + ' int' for d in WEEK.split(','))}, start_date string, end_date string")
    exc = spark.createDataFrame([("BASE", "20250106", 2), ("ADD", "20250106", 1)], "service_id string, date string, exception_type int")
    assert [r[0] for r in services.on_date(cal, exc, "20250106").collect()] == ["ADD"]
    assert services.on_date(cal, exc, "20260105").count() == 0
    assert [r[0] for r in services.on_date(cal, exc, "20250107").collect()] == ["BASE"]


def test_sinks_and_side_tables(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert sinks.cached(spark, str(tmp_path / "c"), make).count() == sinks.cached(spark, str(tmp_path / "c"), make).count() == 3
    assert len(calls) == 1
    sinks.csv(spark.range(2), str(tmp_path / "csv"), single=True)
    sinks.result(str(tmp_path / "r.json"), {"a": 1.5})
    assert '"a": 1.5' in (tmp_path / "r.json").read_text()
    (tmp_path / "split.csv").write_text("# note\nmode,share\ntram,0.3\n")
    assert [tuple(r) for r in feed.optional_table(spark, str(tmp_path), "split").collect()] == [("tram", "0.3")]
    assert feed.optional_table(spark, str(tmp_path), "other") is None
    assert feed.digest(spark, str(tmp_path / "split.csv")).first().sha256 == __import__("hashlib").sha256((tmp_path / "split.csv").read_bytes()).hexdigest()
    (tmp_path / "d.json").write_text('{"features": [{"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}}]}')
    corners = feed.districts(spark, str(tmp_path / "d.json"), 1)
    from railyard.operators import spatial

    points = spark.createDataFrame([(1, 0.5, 1.5), (2, 3.0, 1.0), (3, 1.0, 2.5)], "id int, x double, y double")
    assert [r.id for r in spatial.inside(points, corners).collect()] == [1]
    with pytest.raises(ValueError):
        feed.districts(spark, str(tmp_path / "d.json"), 23)
