import datetime as dt
import json
import statistics
from collections import defaultdict

import pytest

from jobs import service_days
from railyard.queries import jobs as queries
from tests.oracle import connection, differences, rows_of

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 3, 1)


def visit(k, trip, stop, minutes, dist=0.0, day=0):
    return (k, trip, stop, None if minutes is None else DAY + dt.timedelta(days=day, minutes=minutes), dist)


def put(spark, rows, path):
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(str(path))


def tables(spark, out):
    return [sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr) for df in service_days.result(spark, str(out))]


def files(out):
    return {(str(p), p.stat().st_mtime_ns) for name in ("visits", "hours", "edges") for p in out.glob(f"{name}/**/*.parquet")}


def brute(rows):
    """Hours {(day, hour, stop): (departures, trips, mean gap)} and edges {(day, i, j): (n, median time)}."""
    first = {}
    for k, trip, stop, at, dist in rows:
        if None not in (trip, stop, at):
            key = (at.date(), k) if k is not None else object()
            first[key] = min(first.get(key, (at, str(trip), stop, dist)), (at, str(trip), stop, dist))
    hours, trips, ways = defaultdict(list), defaultdict(set), defaultdict(list)
    for key, (at, trip, stop, _) in first.items():
        hours[at.date(), at.hour, stop].append(at)
        trips[at.date(), at.hour, stop].add(trip)
        ways[at.date(), trip].append((at, str(key[1]) if isinstance(key, tuple) else None, stop))
    edges = defaultdict(list)
    for (day, _), own in ways.items():
        own = sorted(own, key=lambda v: (v[0], v[1] is not None, v[1] or "", v[2]))
        for (a, _, i), (b, _, j) in zip(own, own[1:], strict=False):
            if i != j:
                edges[day, i, j].append((b - a).total_seconds())
    gaps = {k: [(b - a).total_seconds() for a, b in zip(sorted(v), sorted(v)[1:], strict=False)] for k, v in hours.items()}
    return {k: (len(v), len(trips[k]), statistics.mean(gaps[k]) if gaps[k] else None) for k, v in hours.items()}, {k: (len(v), statistics.median(v)) for k, v in edges.items()}


def is_brute(spark, out, rows):
    hours, edges = service_days.result(spark, str(out))
    want_hours, want_edges = brute(rows)
    got = {(r.day, r.hour, r.stop): (r.departures, r.trips, r.mean_gap) for r in hours.collect()}
    assert got.keys() == want_hours.keys()
    assert all(got[k][:2] == want_hours[k][:2] and got[k][2] == pytest.approx(want_hours[k][2]) for k in got)
    assert {(r.day, r.i, r.j): (r.n, pytest.approx(r.tau_s)) for r in edges.collect()} == want_edges


FIRST = [visit(1, 1, "a", 60), visit(2, 1, "b", 70, 500.0), visit(3, 2, "a", 65), visit(4, 2, "b", 79, 900.0), visit(5, 1, "a", 1439, day=0), visit(6, 1, "b", 3, day=1), visit(7, None, "a", 61), visit(8, 3, None, 61), visit(9, 3, "a", None)]
# late visits of the first day, a visit that comes twice, visits without id, another day
SECOND = [visit(10, 3, "a", 62), visit(11, 3, "c", 64, 100.0), visit(2, 1, "b", 70, 500.0), visit(None, 4, "a", 90), visit(None, 4, "a", 90), visit(12, 5, "a", 10, day=2), visit(13, 5, "c", 12, day=2)]


def test_two_runs_over_growing_input(spark, tmp_path):
    events, out = tmp_path / "events", tmp_path / "out"
    put(spark, FIRST, events)
    assert service_days.run(spark, str(events), str(out)) == len(FIRST)
    is_brute(spark, out, FIRST)
    second_day = (out / "hours" / "day=2024-03-02")
    untouched = {p: p.stat().st_mtime_ns for p in second_day.glob("*.parquet")}

    put(spark, SECOND, events)
    assert service_days.run(spark, str(events), str(out)) == len(SECOND)  # only what is new
    is_brute(spark, out, FIRST + SECOND)
    assert untouched and untouched == {p: p.stat().st_mtime_ns for p in second_day.glob("*.parquet")}

    before, written = tables(spark, out), files(out)
    assert service_days.run(spark, str(events), str(out)) == 0
    assert tables(spark, out) == before and files(out) == written


def test_one_run_over_all_is_two_runs(spark, tmp_path):
    events = tmp_path / "events"
    put(spark, FIRST, events)
    service_days.run(spark, str(events), str(tmp_path / "two"))
    put(spark, SECOND, events)
    service_days.run(spark, str(events), str(tmp_path / "two"))
    service_days.run(spark, str(events), str(tmp_path / "one"), str(tmp_path / "mark"), json.loads(service_days.CONFIG.read_text()) | {"files_per_batch": 1})
    assert tables(spark, tmp_path / "one") == tables(spark, tmp_path / "two")


def test_a_batch_run_again_leaves_the_same_tables(spark, tmp_path):
    """As after a run that was broken off between its writes and the mark."""
    out, config = tmp_path / "out", json.loads(service_days.CONFIG.read_text())
    put(spark, FIRST, tmp_path / "a")
    put(spark, SECOND, tmp_path / "b")
    batches = [spark.read.parquet(str(tmp_path / x)) for x in "ab"]
    for number in (0, 1):
        service_days.take(batches[number], number, str(out), config)
    before = tables(spark, out)
    service_days.take(batches[1], 1, str(out), config)
    assert tables(spark, out) == before
    is_brute(spark, out, FIRST + SECOND)
    service_days.take(batches[0].limit(0), 2, str(out), config)
    assert tables(spark, out) == before


def test_hours_of_service_only(spark, tmp_path):
    put(spark, FIRST, tmp_path / "events")
    service_days.run(spark, str(tmp_path / "events"), str(tmp_path / "out"), config=json.loads(service_days.CONFIG.read_text()) | {"first_hour": 1, "last_hour": 2})
    assert {r.hour for r in service_days.result(spark, str(tmp_path / "out"))[0].collect()} == {1}


def test_empty_input(spark, tmp_path):
    put(spark, [], tmp_path / "events")
    assert service_days.run(spark, str(tmp_path / "events"), str(tmp_path / "out")) == 0
    assert tables(spark, tmp_path / "out") == [[], []]


def test_copies_of_the_table_in_two_parts(spark, tmp_path):
    """Half of the given table first, the other half later: the rows of the SQL over all of it."""
    rows = spark.read.parquet(f"{SF}/events.parquet")
    whole = rows.collect()
    for part in (whole[::2], whole[1::2]):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        assert service_days.run(spark, str(tmp_path / "events"), str(tmp_path / "out")) == len(part)
    result = connection(SF).execute(f"SELECT day, hour, i, n, trips FROM ({queries.SERVICE_DAYS}) WHERE part = 'hour'")
    theirs, _ = rows_of([c[0] for c in result.description], result.fetchall())
    mine, _ = rows_of(["day", "hour", "i", "n", "trips"], [(str(r.day), r.hour, r.stop, r.departures, r.trips) for r in service_days.result(spark, str(tmp_path / "out"))[0].collect()])
    assert mine == theirs


def test_query_is_its_sql(spark):
    assert differences(spark, queries.job1_service_days, queries.SERVICE_DAYS, SF) == ""
