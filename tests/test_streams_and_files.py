"""Streams against their batch twins; file sources with faults."""

import collections
import datetime as dt
import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from tripweave import views
from tripweave.session import scratch_path
from tripweave.sources import files
from tripweave.streaming import alerts, monitor, run, stats, store, waits

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rides(spark, rows):
    return spark.createDataFrame(rows, "event_id long, t string, vehicle_id long, pickup_area string, wait_time double").select(
        "event_id", F.col("t").cast("timestamp").alias("timestamp"), "vehicle_id", "pickup_area", "wait_time",
        F.lit(40.7).alias("latitude"), F.lit(-74.0).alias("longitude"))


def add_file(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_dropped_and_restart_continues(spark):
    src, cp, out = (scratch_path(spark, t) for t in ("late", "late-cp", "late-out"))
    agg = lambda: stats.hour_orders(run.read_rides(spark, src))
    add_file(rides(spark, [(1, "2024-01-01 10:05:00", 1, "A", 1.0), (2, "2024-01-01 12:00:00", 1, "A", 1.0)]), src)
    run.run_updates(agg(), ["hour_start"], cp, out)
    # the watermark now stands at 11:50: the hour of 10 is closed, the hour of 12 is open
    add_file(rides(spark, [(3, "2024-01-01 10:30:00", 1, "A", 1.0), (4, "2024-01-01 12:10:00", 1, "A", 1.0)]), src)
    got = {str(r["hour_start"])[11:16]: r["orders"] for r in run.run_updates(agg(), ["hour_start"], cp, out).collect()}
    assert got == {"10:00": 1, "12:00": 2}
    # nothing new: the same result from the checkpoint
    assert run.run_updates(agg(), ["hour_start"], cp, out).count() == 2


def events(n, minutes=30, seed=1):
    """Plain rows (event_id, second, vehicle, area, wait) spread over some minutes, and their times."""
    rng = random.Random(seed)
    return [(k, dt.datetime(2024, 1, 1, 8) + dt.timedelta(microseconds=rng.randrange(minutes * 60_000_000)), rng.randrange(400), f"A{rng.randrange(9)}",
             rng.choice([0.0, 1.5, 7.25, 30.0])) for k in range(n)]


def as_rides(spark, rows):
    return rides(spark, [(k, str(t), v, a, w) for k, t, v, a, w in rows])


def smoothed(rows):
    e = None
    for _, _, _, _, w in sorted(rows, key=lambda r: (r[1], r[0])):
        if w > 0:
            e = w if e is None else 0.1 * w + 0.9 * e
    return e


def test_monitor_equals_plain_figures(spark):
    """50 000 events in 30 minutes, over several batches: no figure stops at a buffer."""
    rows = sorted(events(50_000), key=lambda r: r[1])
    src = scratch_path(spark, "busy")
    for k in range(3):
        add_file(as_rides(spark, rows[k::3]), src)  # each batch holds rows of every minute; the delay is longer than the run
    m = monitor.RideMonitor(spark, delay="1 hour", every=2, buffer=50)
    m.run(run.read_rides(spark, src, files_per_trigger=1))
    assert m.last == 2
    st = m.table("stats").first()
    top = rows[-1][1].replace(second=0, microsecond=0)
    recent = lambda n: [r for r in rows if r[1].replace(second=0, microsecond=0) > top - dt.timedelta(minutes=n)]
    assert (st.total_orders, st.late_orders, st.recent_10, st.recent_30) == (50_000, 0, len(recent(10)), len(recent(30)))
    assert st.active_vehicles == len({r[2] for r in recent(30)}) and st.avg_wait_time == pytest.approx(smoothed(rows), abs=1e-6)
    count = collections.Counter(r[3] for r in rows)
    assert [(r.pickup_area, r.n) for r in m.table("hotspots").collect()] == sorted(count.items(), key=lambda x: (-x[1], x[0]))[:5]
    for r in m.table("waits").where("NOT every").collect():
        assert r.avg_wait == pytest.approx(smoothed([x for x in rows if x[3] == r.pickup_area]))
    assert {r.event_id for r in m.table("buffer").collect()} == {r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))[-50:]}


def test_monitor_restarts_and_drops_late_rows(spark):
    rows = events(900, minutes=90)
    src, cp, out = (scratch_path(spark, t) for t in ("again", "again-cp", "again-out"))
    parts = [[r for r in rows if lo <= (r[1].hour - 8) * 60 + r[1].minute < lo + 30] for lo in (0, 30, 60)]
    late, parts[0] = parts[0][:7], parts[0][7:]
    parts[2] += late  # an hour late
    seen = []
    for k, part in enumerate(parts):  # a new monitor on the same folders each time
        add_file(as_rides(spark, part), src)
        m = monitor.RideMonitor(spark, out, every=2, callbacks={"stats_update": [lambda df: seen.append(df.count())]})
        m.run(run.read_rides(spark, src), cp)
        assert m.last == k
    st = m.table("stats").first()
    kept = [r for r in rows if r not in late]
    assert (st.total_orders, st.late_orders, seen) == (893, 7, [1, 1, 1]) and st.avg_wait_time == pytest.approx(smoothed(kept), abs=1e-6)
    m(as_rides(spark, parts[2]), 2)  # a batch that is repeated after its commit
    assert m.table("stats").first() == st


def test_store_after_a_batch_that_died(spark):
    out = scratch_path(spark, "store")
    one = lambda n: spark.createDataFrame([("a", n), ("b", 1)], "k string, n bigint")
    make = lambda: store.Store(spark, out, {"sum": store.add_up("k"), "last": store.keep_last("k"), "now": store.REPLACE}, every=3)
    want = 0
    for v in range(8):
        half = make().begin(v)
        half.write({"sum": one(1000), "now": one(1000)})  # killed before its marker: never read
        whole = make().begin(v)
        assert whole.first == (v == 0)
        store.add(make(), v, {"sum": one(v), "last": one(v), "now": one(v).limit(0) if v == 7 else one(v)})
        want += v
        assert make().begin(v) is None
        got = {n: {r.k: r.n for r in make().table(n).collect()} for n in ("sum", "last", "now")}
        assert got == {"sum": {"a": want, "b": v + 1}, "last": {"a": v, "b": 1}, "now": {} if v == 7 else {"a": v, "b": 1}}
    assert make().version == 7


def test_size_on_disk_follows_the_keys(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), {"rows": store.add_up("k")}, every=4)
    sizes = []
    for v in range(24):
        store.add(s, v, {"rows": spark.range(20).selectExpr("id % 5 AS k", "1L AS n")})
        sizes.append(spark.read.option("recursiveFileLookup", "true").schema("k bigint").parquet(f"{s.out}/rows").count())
    assert max(sizes) <= 2 * 5 + 4 * 20 and {(r.k, r.n) for r in s.table("rows").collect()} == {(k, 24 * 4) for k in range(5)}


def test_waits_of_shuffled_files_equal_the_batch(spark):
    rows = events(1500, minutes=60)
    src = scratch_path(spark, "shuffled")
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=8 * (r[0] % 2)))  # every other row 8 minutes late
    parts = [order[k * 500:(k + 1) * 500] for k in range(3)]
    late = [r for r in parts[0] if r[1].minute < 5][:4]
    parts[0] = [r for r in parts[0] if r not in late]
    parts[2] += late  # beyond the watermark
    end = [(10**6, dt.datetime(2024, 1, 2), 1, "~", 1.0)]
    for part in [*parts, end]:
        add_file(as_rides(spark, part), src)
    found, dropped = waits.run_waits(run.read_rides(spark, src, files_per_trigger=1), every=2)
    got = {r.pickup_area: (r.n, r.avg_wait, r.late) for r in found.collect()}
    kept = [r for r in rows if r not in late]
    for a in {r[3] for r in kept}:
        some = [r for r in kept if r[3] == a]
        assert got[a][0] == sum(r[4] > 0 for r in some) and got[a][1] == pytest.approx(smoothed(some))
    assert sum(x[2] for x in got.values()) + dropped == sum(r[4] > 0 for r in late)


def test_waits_need_no_state_store_and_count_every_late_row(spark):
    rows = events(300, minutes=40) + [(10**5 + k, dt.datetime(2024, 1, 1, 8, 50, 0, k), 1, None, 2.0) for k in range(3)]
    first = [r for r in rows if r[1].minute < 30 or r[3] is None]
    last = [r for r in rows if r not in first] + [first[0]] * 3  # of a closed minute, one and the same row three times
    src, old = scratch_path(spark, "plain"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in (first, last, [(10**6, dt.datetime(2024, 1, 2), 1, "~", 1.0)]):
        add_file(as_rides(spark, part), src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        found, dropped = waits.run_waits(run.read_rides(spark, src, files_per_trigger=1))
        got = {r.pickup_area: (r.n, r.avg_wait, r.late) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    top = max(r[1] for r in first)
    gone = [r for r in last if r[1].replace(second=0, microsecond=0) + dt.timedelta(minutes=11) <= top]
    kept = [r for r in rows if r not in gone or r in first]
    assert sum(x[2] for x in got.values()) + dropped == sum(r[4] > 0 for r in gone) and len(gone) >= 3
    for a in {r[3] for r in kept if r[4] > 0}:
        some = [r for r in kept if r[3] == a]
        assert got[a][0] == sum(r[4] > 0 for r in some) and got[a][1] == pytest.approx(smoothed(some))


def test_vehicles_are_counted_once_per_window(spark):
    rows = events(1200, minutes=90)
    src = scratch_path(spark, "vehicles")
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=8 * (r[0] % 2)))
    for k in range(3):
        add_file(as_rides(spark, order[k * 400:(k + 1) * 400]), src)
    out = run.run_merged(stats.first_sightings(run.read_rides(spark, src, files_per_trigger=1)), store.add_up("window_start"), every=2)
    want = collections.defaultdict(set)
    for _, t, v, _, _ in rows:
        want[t.replace(minute=t.minute // 30 * 30, second=0, microsecond=0)].add(v)
    assert {r.window_start: r.active_vehicles for r in out.collect()} == {k: len(v) for k, v in want.items()}


@needs_data
def test_stream_equals_batch(spark):
    src = scratch_path(spark, "twin")
    views.ride_events(spark, SF).write.parquet(src)
    batch = views.ride_events(spark, SF)
    for fn, keys in ((stats.hour_orders, ["hour_start"]), (stats.peak_orders, []), (stats.window_rates, ["window_start"])):
        s = sorted(map(repr, run.run_updates(fn(run.read_rides(spark, src)), keys).select(*fn(batch).columns).collect()))
        assert s == sorted(map(repr, fn(batch).collect()))


@needs_data
def test_large_parts_are_several_files_and_one_batch(spark, monkeypatch):
    from tripweave.plans import q_stream

    monkeypatch.setattr(q_stream, "FILE_ROWS", 60, raising=False)
    seen = []

    def handle(df, k):
        row = df.withColumn("file", F.input_file_name()).agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.countDistinct("file").alias("files")).first()
        seen.append((row.n, row.files, row.lo, row.hi))

    run.run_batches(q_stream._stream(spark, SF), handle)
    rides = views.ride_events(spark, SF)
    assert len(seen) == q_stream.PARTS and sum(x[0] for x in seen) == rides.count() and min(x[1] for x in seen) > 1
    assert all(a[3] <= b[2] + dt.timedelta(minutes=10) for a, b in zip(seen, seen[1:]))


def test_alert_rules(spark):
    st = spark.createDataFrame([("2024-01-02 00:00:00", 80, 9.0, 0.1)], "t string, high_demand long, high_wait_time double, low_vehicle_availability double")
    st = st.withColumn("as_of", F.expr("cast(t as timestamp_ntz)"))
    got = {r["metric"]: r["severity"] for r in alerts.threshold_alerts(st).collect()}
    assert got == {"high_demand": "high", "low_vehicle_availability": "high"}
    old = alerts.threshold_alerts(st).withColumn("as_of", F.expr("as_of - interval 25 hours"))
    assert alerts.active_alerts(alerts.threshold_alerts(st).unionByName(old)).count() == 2


def test_micro_batch_chain(spark):
    src = scratch_path(spark, "chain")
    add_file(rides(spark, [(1, "2024-01-01 10:05:00", 1, "A", 1.0), (2, "2024-01-01 12:00:00", 1, "B", 9.0)]), src)
    out = run.micro_batches(run.read_rides(spark, src), [lambda d: d.where("wait_time > 5"), lambda d: d.select("event_id")], scratch_path(spark, "o"))
    assert [r["event_id"] for r in out.collect()] == [2]


def test_csv_with_faults(spark):
    root = scratch_path(spark, "csv")
    good = spark.createDataFrame([('Date/Time, Lat ,Lon,Base\n"4/1/2014 0:11:00",40.769,-73.9549,B02512\nbad time,40.7,-74.0,B02598',)], "value string")
    bad = spark.createDataFrame([("when,where\n1,2",)], "value string")
    good.coalesce(1).write.text(f"{root}/trips-raw-a.csv")
    bad.coalesce(1).write.text(f"{root}/trips-raw-b.csv")
    heads = {r["source_file"]: r["good"] for r in files.trip_csv_headers(spark, f"{root}/trips-raw-*.csv").collect()}
    assert sorted(heads.values()) == [False, True]
    df = files.read_trip_csv(spark, f"{root}/trips-raw-*.csv", skip_bad_files=True)
    rows = df.orderBy("Lat").collect()
    assert [r["Base"] for r in rows] == ["B02598", "B02512"] and all(r["source_file"] for r in rows)
    with pytest.raises(Exception):
        files.read_trip_csv(spark, f"{root}/trips-raw-a*.csv", skip_bad_files=False).unionByName(
            files.read_trip_csv(spark, f"{root}/trips-raw-b*.csv", skip_bad_files=False)).collect()
    with pytest.raises(Exception):
        files.read_trip_csv(spark, f"{root}/nothing-*.csv")


@pytest.mark.parametrize("skip", [False, True])
def test_half_a_file_fails(spark, tmp_path, skip):
    whole = gzip.compress(("Date/Time,Lat,Lon,Base\n" + "".join(f"4/1/2014 0:11:00,{k / 7919},-73.9,B{k}\n" for k in range(50_000))).encode())
    (tmp_path / "a.csv.gz").write_bytes(whole)
    (tmp_path / "b.csv.gz").write_bytes(whole[:len(whole) // 2])
    assert files.read_trip_csv(spark, f"{tmp_path}/a*.gz", skip_bad_files=skip).count() == 50_000
    with pytest.raises(Exception):
        files.read_trip_csv(spark, f"{tmp_path}/*.gz", skip_bad_files=skip).agg({"Lat": "sum", "Base": "max"}).collect()


def test_daily_file_with_other_line_ends(spark):
    root = scratch_path(spark, "daily")
    text = "dispatching_base_number,date,active_vehicles,trips\r\nB1,1/2/2015,190,1132\r\nB2,12/31/2015,225,1765\r"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/daily.csv")
    rows = files.read_base_daily(spark, f"{root}/daily.csv").orderBy("date").collect()
    assert [(str(r["date"]), r["trips"]) for r in rows] == [("2015-01-02", 1132), ("2015-12-31", 1765)]


def test_latest_and_absent_sources(spark):
    root = scratch_path(spark, "latest")
    for day, n in (("20240101", 1), ("20240301", 3), ("20240201", 2)):
        files.write_any(spark.range(n), f"{root}/trips_{day}.parquet")
    assert files.read_latest(spark, root, "trips_*.parquet").count() == 3
    files.write_any(spark.range(2).coalesce(1), f"{root}/other-a.csv")
    got = files.load_all_sources(spark, {"other": f"{root}/other-*.csv", "fhv": f"{root}/fhv-*.csv"}, {})
    assert list(got) == ["other"]
    with pytest.raises(ValueError):
        files.file_type("x.xlsx")
    cat = {r["file_type"]: r for r in files.catalog(spark, root).where("n_rows is not null").collect()}
    assert cat[".csv"]["n_rows"] == 2 and cat[".csv"]["columns"] == ["id"]
